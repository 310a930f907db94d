"""YAML 1.2, as far as well-formedness goes: structure, indentation, scalars, flow collections."""

from __future__ import annotations

import re

from skein.llm.syntax.base import Reject

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x80-\x84\x86-\x9f\ud800-\udfff\ufffe\uffff]")
_BLANKS = re.compile(r"[ \t]*")
_REST = re.compile(r"[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|\Z)")
_COMMENT_LINE = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*(?:[ \t]*(?:#[^\n]*)?\Z)?")
_MARKER = re.compile(r"(?:---|\.\.\.)(?=[ \t\n]|\Z)")
_PROPERTY = re.compile(r"(?:&[^\s,\[\]{}]+|!<[^\s>]+>|!(?:[\w-]*!)?[^\s,\[\]{}!]*)(?=[\s,\]}]|\Z)")
_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_PLAIN_START = re.compile(r"[^\s,\[\]{}#&*!|>'\"%@`?:-]|[?:-](?=[^\s])")
_PLAIN_BLOCK = re.compile(r"(?:[^\s:#]|:(?=[^\s])|(?<=[^\s])#|[ \t]+(?=[^\s#]))*")
_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=[^\s])#|[ \t]+(?=[^\s#,\[\]{}]))*")
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_DOUBLE = re.compile(r'"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_SCALAR_HEAD = re.compile(r"[|>](?:([1-9])[+-]?|[+-]([1-9])?)?")


class Yaml:
    def __init__(self, text: str):
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        if _CONTROL.search(text):
            raise Reject("control character")
        self.t, self.p = text, 0

    # -- position

    def column(self) -> int:
        return self.p - (self.t.rfind("\n", 0, self.p) + 1)

    def at(self, n: int = 0) -> str:
        return self.t[self.p + n : self.p + n + 1]

    def gap(self, n: int = 1) -> bool:
        """Whether a blank, a line's or the text's end stands n characters on."""
        return self.t[self.p + n : self.p + n + 1] in ("", " ", "\t", "\n")

    def blanks(self) -> None:
        self.p = _BLANKS.match(self.t, self.p).end()

    def line_over(self) -> bool:
        """Goes to the next line if nothing but a comment is left of this one."""
        m = _REST.match(self.t, self.p)
        if m:
            self.p = m.end()
        return bool(m)

    def next_line(self) -> tuple[int, bool]:
        """From a line's start over blank lines and comments: (indentation, whether a tab follows it); -1 at an end."""
        self.p = _COMMENT_LINE.match(self.t, self.p).end()
        if self.p >= len(self.t) or _MARKER.match(self.t, self.p):
            return -1, False
        at = self.p
        while self.at() == " ":
            self.p += 1
        depth = self.p - at
        tab = self.at() == "\t"
        self.blanks()
        return depth, tab

    # -- stream

    def stream(self) -> None:
        while True:
            self.p = _COMMENT_LINE.match(self.t, self.p).end()
            directives = False
            while self.at() == "%":
                directives = True
                end = self.t.find("\n", self.p)
                self.p = len(self.t) if end < 0 else end + 1
                self.p = _COMMENT_LINE.match(self.t, self.p).end()
            if self.t.startswith("---", self.p) and self.gap(3):
                self.p += 3
                if not self.line_over():
                    self.blanks()
                    self.node(-1, False)
                    self.document_end()
                    continue
            elif directives:
                raise Reject("directives without a document")
            elif self.p >= len(self.t):
                return
            elif self.t.startswith("...", self.p) and self.gap(3):
                self.p += 3
                if not self.line_over():
                    raise Reject("text after a document's end")
                continue
            at = self.p
            depth, tab = self.next_line()
            if depth < 0:
                if self.p == at and self.p >= len(self.t):
                    return
                self.document_end()
                continue
            self.node(-1, True, tab)
            self.document_end()

    def document_end(self) -> None:
        self.p = _COMMENT_LINE.match(self.t, self.p).end()
        if self.p >= len(self.t) or self.t.startswith("---", self.p) and self.gap(3):
            return
        if self.t.startswith("...", self.p) and self.gap(3):
            self.p += 3
            if not self.line_over():
                raise Reject("text after a document's end")
            return
        raise Reject("text after the document's content")

    # -- block nodes; each ends at a line's start

    def node(self, parent: int, fresh: bool, tab: bool = False) -> None:
        """The node at this place. ``fresh``: it stands first in its line or after an indicator, so a collection may begin."""
        if fresh and not tab:
            c = self.at()
            if c == "-" and self.gap():
                self.sequence(self.column())
                return
            if c == "?" and self.gap() or self.keyed():
                self.mapping(self.column())
                return
        elif fresh and (self.at() == "-" and self.gap() or self.keyed()):
            raise Reject("tab as indentation")
        while True:
            m = _PROPERTY.match(self.t, self.p) if self.at() in ("&", "!") else None
            if not m:
                break
            self.p = m.end()
            if self.line_over():
                self.below(parent)
                return
            self.blanks()
        self.scalar_or_flow(parent)

    def below(self, parent: int, same: bool = False) -> None:
        """A node on the lines that follow, deeper than ``parent`` (or, with ``same``, a sequence as deep), or none."""
        at = self.p
        depth, tab = self.next_line()
        if depth > parent or same and depth == parent and self.at() == "-" and self.gap():
            self.node(parent, True, tab)
        else:
            self.p = at

    def keyed(self) -> bool:
        """Whether an implicit key stands here: one line, then a colon."""
        at = self.p
        try:
            while self.at() in ("&", "!"):
                m = _PROPERTY.match(self.t, self.p)
                if not m:
                    return False
                self.p = m.end()
                self.blanks()
            c = self.at()
            if c == ":" and self.gap():
                return True
            if c == "*":
                m = _ALIAS.match(self.t, self.p)
                if not m:
                    return False
                self.p = m.end()
            elif c == '"' or c == "'":
                m = (_DOUBLE if c == '"' else _SINGLE).match(self.t, self.p)
                if not m or "\n" in m[0]:
                    return False
                self.p = m.end()
            elif c == "[" or c == "{":
                begin = self.p
                try:
                    self.flow(-1)
                except Reject:
                    return False
                if "\n" in self.t[begin : self.p]:
                    return False
            elif _PLAIN_START.match(self.t, self.p):
                self.p = _PLAIN_BLOCK.match(self.t, self.p).end()
            else:
                return False
            self.blanks()
            return self.at() == ":" and self.gap()
        finally:
            self.end_of_key, self.p = self.p, at

    def sequence(self, column: int) -> None:
        while True:
            self.p += 1
            self.item(column)
            at = self.p
            depth, tab = self.next_line()
            if depth == column and self.at() == "-" and self.gap() and not tab:
                continue
            if depth > column:
                raise Reject("indentation within a sequence")
            self.p = at
            return

    def item(self, column: int, same: bool = False) -> None:
        """What follows an indicator: on its line, or below."""
        if self.line_over():
            self.below(column, same)
            return
        tab = "\t" in _BLANKS.match(self.t, self.p)[0]
        self.blanks()
        self.node(column, True, tab)

    def mapping(self, column: int) -> None:
        while True:
            if self.at() == "?" and self.gap():
                self.p += 1
                self.item(column)
                at = self.p
                depth, _ = self.next_line()
                if depth == column and self.at() == ":" and self.gap():
                    self.p += 1
                    self.item(column)
                else:
                    self.p = at
            else:
                if not self.keyed():
                    raise Reject("instead of a key")
                self.p = self.end_of_key + 1
                if self.line_over():
                    self.below(column, True)
                else:
                    self.blanks()
                    if self.at() == "-" and self.gap() or self.at() == "?" and self.gap():
                        raise Reject("collection beside its key")
                    self.node(column, False)
            at = self.p
            depth, tab = self.next_line()
            if depth == column and not tab:
                if self.at() == "-" and self.gap():
                    raise Reject("sequence among keys")
                continue
            if depth > column or depth == column:
                raise Reject("indentation within a mapping")
            self.p = at
            return

    def scalar_or_flow(self, parent: int) -> None:
        c = self.at()
        if c in ("|", ">"):
            self.block_scalar(parent)
            return
        if c == "*":
            m = _ALIAS.match(self.t, self.p)
            if not m:
                raise Reject("alias")
            self.p = m.end()
        elif c == '"' or c == "'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(self.t, self.p)
            if not m:
                raise Reject("string never closed")
            self.lines(m[0], parent)
            self.p = m.end()
        elif c == "[" or c == "{":
            self.flow(parent)
        elif _PLAIN_START.match(self.t, self.p):
            self.plain(parent)
            return
        else:
            raise Reject(f"character {c!r} begins no node")
        if not self.line_over():
            raise Reject("text after a node")

    def lines(self, quoted: str, parent: int) -> None:
        """Rejects lines of a quoted scalar that are not deeper than its parent, and document markers among them."""
        for line in quoted.split("\n")[1:]:
            if line.strip() and len(line) - len(line.lstrip(" ")) <= parent or _MARKER.match(line):
                raise Reject("indentation within a string")

    def plain(self, parent: int) -> None:
        self.p = _PLAIN_BLOCK.match(self.t, self.p).end()
        while True:
            self.blanks()
            if self.at() == ":":
                raise Reject("key where none may stand")
            if self.at() == "#":
                if not self.line_over():
                    raise Reject("comment")
                return
            self.line_over()
            at = self.p
            while self.p < len(self.t):  # blank lines
                end = _BLANKS.match(self.t, self.p).end()
                if self.t[end : end + 1] != "\n":
                    break
                self.p = end + 1
            spaces = self.p
            while self.t[spaces : spaces + 1] == " ":
                spaces += 1
            depth = spaces - self.p
            first = _BLANKS.match(self.t, self.p).end()
            if first >= len(self.t) or depth <= parent or self.t[first] == "#" or _MARKER.match(self.t, self.p):
                self.p = at
                return
            self.p = first
            if self.at() == ":" and self.gap():
                raise Reject("key where none may stand")
            self.p = _PLAIN_BLOCK.match(self.t, self.p).end()

    def block_scalar(self, parent: int) -> None:
        m = _SCALAR_HEAD.match(self.t, self.p)
        self.p = m.end()
        if not self.line_over():
            raise Reject("block scalar's header")
        given = m[1] or m[2]
        depth = max(parent, 0) + int(given) if given else 0
        widest = 0
        while self.p < len(self.t):
            end = self.t.find("\n", self.p)
            end = len(self.t) if end < 0 else end
            line = self.t[self.p : end]
            spaces = len(line) - len(line.lstrip(" "))
            if spaces == len(line):
                if not depth:
                    widest = max(widest, spaces)
            elif spaces <= parent or _MARKER.match(line):
                return
            elif not depth:
                if widest > spaces:
                    raise Reject("blank line deeper than the block scalar")
                depth = spaces
            elif spaces < depth:
                if line.lstrip().startswith("#"):
                    return
                raise Reject("indentation within a block scalar")
            self.p = min(end + 1, len(self.t))

    # -- flow nodes

    def flow_gap(self, parent: int) -> None:
        """Over blanks, comments and line ends inside a flow collection."""
        while True:
            self.blanks()
            if self.at() == "#" and self.t[self.p - 1 : self.p] in (" ", "\t", "\n", ""):
                end = self.t.find("\n", self.p)
                self.p = len(self.t) if end < 0 else end
            if self.at() != "\n":
                return
            self.p += 1
            if _MARKER.match(self.t, self.p):
                raise Reject("marker within a flow collection")
            m = _BLANKS.match(self.t, self.p)
            if self.t[m.end() : m.end() + 1] not in ("", "\n", "#") and len(m[0]) <= parent:
                raise Reject("indentation within a flow collection")

    def flow(self, parent: int) -> None:
        closing = "]" if self.at() == "[" else "}"
        self.p += 1
        self.flow_gap(parent)
        while self.at() != closing:
            self.flow_entry(parent)
            self.flow_gap(parent)
            if self.at() == ",":
                self.p += 1
                self.flow_gap(parent)
            elif self.at() != closing:
                raise Reject("within a flow collection")
        self.p += 1

    def flow_entry(self, parent: int) -> None:
        explicit = self.at() == "?" and self.gap()
        if explicit:
            self.p += 1
            self.flow_gap(parent)
        quoted = False
        if not (self.at() == ":" and (self.gap() or self.at(1) in ",]}")):
            if self.at() in (",", "]", "}") and not explicit:
                raise Reject("empty entry")
            begin = self.p
            quoted = self.flow_node(parent)
            end = self.p
            self.flow_gap(parent)
            if self.at() == ":" and not explicit and "\n" in self.t[begin:end] and self.t[begin] not in "[{":
                raise Reject("key of several lines")
        if self.at() == ":" and (quoted or self.gap() or self.at(1) in ",[]{}"):
            self.p += 1
            self.flow_gap(parent)
            if self.at() not in (",", "]", "}"):
                self.flow_node(parent)

    def flow_node(self, parent: int) -> bool:
        """Says whether a colon right after it makes it a key."""
        while self.at() in ("&", "!"):
            m = _PROPERTY.match(self.t, self.p)
            if not m:
                raise Reject("property")
            self.p = m.end()
            self.flow_gap(parent)
            if self.at() in (",", "]", "}", ":"):
                return False
        c = self.at()
        if c == "[" or c == "{":
            self.flow(parent)
            return True
        if c == '"' or c == "'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(self.t, self.p)
            if not m:
                raise Reject("string never closed")
            self.lines(m[0], parent)
            self.p = m.end()
            return True
        if c == "*":
            m = _ALIAS.match(self.t, self.p)
            if not m:
                raise Reject("alias")
            self.p = m.end()
            return False
        if not _PLAIN_START.match(self.t, self.p) or c in "?:-" and self.at(1) in ",[]{}":
            raise Reject("within a flow collection")
        while True:
            end = _PLAIN_FLOW.match(self.t, self.p).end()
            if end == self.p:
                return False
            self.p = end
            at = self.p
            self.flow_gap(parent)
            if self.at() in ("", ",", "]", "}", "[", "{", ":", "#"):
                self.p = at
                return False


def yaml(text: str) -> None:
    Yaml(text).stream()
