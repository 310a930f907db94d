"""What source files import, read by the import declarations of their languages' grammars."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

#: Stands for a declaration that may bring in any name: a wildcard, or the file's own package.
ANY = "*"

_LEX = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\W\d][\w$]*|::|[^\s\w]|\d\w*", re.S)


def _words(text: str) -> list[str]:
    """Names, strings and signs of a text of the C family, without comments."""
    return [t for t in _LEX.findall(text) if not t.startswith(("//", "/*"))]


def _named(word: str) -> bool:
    return word[:1].isalpha() or word[:1] in "_$"


def _python(text: str) -> Iterator[str]:
    try:
        statements = ast.walk(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        statements = []
        for line in text.split("\n"):  # of a file that is no Python, the lines that are
            if line.strip().startswith(("import ", "from ")):
                try:
                    statements += ast.parse(line.strip()).body
                except (SyntaxError, ValueError):
                    continue
    found = [n for n in statements if isinstance(n, (ast.Import, ast.ImportFrom))]
    for node in sorted(found, key=lambda n: (n.lineno, n.col_offset)):
        for alias in node.names:
            yield ANY if alias.name == "*" else alias.asname or alias.name.split(".")[-1]


def _dotted(words: list[str], i: int, joint: str = ".") -> tuple[list[str], int]:
    """The parts of a dotted name that begins at ``i``, a closing ``*`` included, and where it ends."""
    parts = []
    while i < len(words) and (_named(words[i]) or words[i] == "*"):
        parts.append(words[i])
        if i + 1 >= len(words) or words[i + 1] != joint:
            return parts, i + 1
        i += 2
    return parts, i


def _java(text: str) -> Iterator[str]:
    words = _words(text)
    for i, word in enumerate(words):
        if word == "package" and (i == 0 or words[i - 1] in (";", ")", "}")):
            yield ANY
        elif word == "import" and (i == 0 or words[i - 1] in (";", "}", ")")):
            parts, end = _dotted(words, i + 1 + (words[i + 1 : i + 2] == ["static"]))
            if parts and words[end : end + 1] == [";"]:
                yield ANY if parts[-1] == "*" else parts[-1]


def _csharp(text: str) -> Iterator[str]:
    """Using directives; ``using`` that opens a resource is followed by a bracket, or by a type and a name."""
    words = _words(text)
    for i, word in enumerate(words):
        if word == "namespace":
            yield ANY
        elif word == "using":
            at = i + 1 + (words[i + 1 : i + 2] == ["static"])
            if words[at + 1 : at + 2] == ["="] and _named(words[at]):
                yield words[at]
                continue
            parts, end = _dotted(words, at)
            if parts and words[end : end + 1] == [";"]:
                yield ANY if parts[-1] == "*" else parts[-1]


def _bindings(words: list[str], i: int, renames: str) -> tuple[list[str], int]:
    """The names that ``{a, b as c}`` (or ``{a, b: c}``) at ``i`` binds, and where it ends."""
    names, i = [], i + 1
    while i < len(words) and words[i] != "}":
        if _named(words[i]) or words[i][:1] in "\"'":
            if words[i] == "type" and i + 1 < len(words) and _named(words[i + 1]) and words[i + 1] != renames:
                i += 1
            if words[i + 1 : i + 2] == [renames] and i + 2 < len(words):
                i += 2
            if _named(words[i]):
                names.append(words[i])
        i += 1
    return names, i + 1


def _script(text: str) -> Iterator[str]:
    words = _words(text)
    for i, word in enumerate(words):
        rest = words[i + 1 : i + 3]
        if word == "import" and rest and rest[0] not in ("(", "."):
            at = i + 1
            if words[at] == "type" and len(rest) > 1 and rest[1] not in ("from", ",", "="):
                at += 1
            while at < len(words) and words[at] not in ("from", ";", "=") and words[at][0] not in "\"'":
                if words[at] == "{":
                    names, at = _bindings(words, at, "as")
                    yield from names
                elif words[at] == "*" and words[at + 1 : at + 2] == ["as"]:
                    yield from words[at + 2 : at + 3]
                    at += 3
                else:
                    if _named(words[at]):
                        yield words[at]
                    at += 1
        elif word in ("const", "let", "var") and rest:
            names, at = _bindings(words, i + 1, ":") if rest[0] == "{" else ([rest[0]], i + 2)
            if words[at : at + 3] == ["=", "require", "("]:
                yield from (n for n in names if _named(n))


def _go(text: str) -> Iterator[str]:
    words = _words(text)

    def spec(at: int) -> tuple[str, int]:
        alias = words[at] if words[at] == "." or _named(words[at]) else ""
        path = words[at + bool(alias)][1:-1].rstrip("/") if words[at + bool(alias) :] else ""
        return {"": path.rpartition("/")[2], ".": ANY, "_": ""}.get(alias, alias), at + bool(alias) + 1

    i = 0
    while i < len(words):
        if words[i] == "package":
            yield ANY
        elif words[i] == "import" and i + 1 < len(words):
            block = words[i + 1] == "("
            i += 2 if block else 1
            while i < len(words) and words[i] != ")":
                if words[i] == ";":
                    i += 1
                    continue
                name, i = spec(i)
                if name:
                    yield name
                if not block:
                    break
            continue
        elif i == 0 and words[-1][:1] in '"`' and len(words) <= 2:  # a line of an import block
            yield from filter(None, [spec(0)[0]])
            return
        i += 1


def _rust(text: str) -> Iterator[str]:
    words = _words(text)

    def tree(i: int) -> tuple[list[str], int]:
        """The names of one use tree at ``i`` and where it ends."""
        last, names = "", []
        while i < len(words) and words[i] not in (",", ";", "}"):
            if words[i] == "{":
                i += 1
                while i < len(words) and words[i] != "}":
                    some, i = tree(i)
                    names += [last if n == "self" else n for n in some]
                    i += words[i : i + 1] == [","]
                return names, i + 1
            if words[i] == "as" and i + 1 < len(words):
                return [words[i + 1]], i + 2
            if words[i] != "::":
                last = words[i]
            i += 1
        return [last] if last else [], i

    for i, word in enumerate(words):
        if word == "use" and (i == 0 or words[i - 1] in (";", "}", "{", "]", ")", "pub")):
            yield from tree(i + 1)[0]
        elif word == "extern" and words[i + 1 : i + 2] == ["crate"]:
            yield from words[i + 2 : i + 3]


_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(include|define)[ \t]+(\"[^\"\n]+\"|\w+)", re.M)


def _c(text: str) -> Iterator[str]:
    """Headers of the project by their stems, and macros."""
    for kind, what in _DIRECTIVE.findall(text):
        if kind == "define" and what[0] != '"':
            yield what
        elif kind == "include" and what[0] == '"':
            yield re.sub(r"\.(?:h|hh|hpp|hxx)$", "", what[1:-1].rpartition("/")[2])


_READERS = {"python": _python, "java": _java, "csharp": _csharp, "javascript": _script, "typescript": _script, "go": _go, "rust": _rust, "c": _c, "cpp": _c}


def declared(text: str, language: str) -> list[str]:
    """What a text imports in its language, once each and in order; :data:`ANY` for wildcards. Nothing for other languages."""
    reader = _READERS.get(language)
    return list(dict.fromkeys(n for n in reader(text) if n)) if reader else []


def imported_names(line: str, language: str) -> list[str] | None:
    """Names that an import line brings in; empty for other lines, None for those that may bring in anything."""
    names = declared(line.strip(), language)
    return None if ANY in names else names


#: How lines begin that may be part of an import header.
_HEADS = {
    "python": ("import ", "from "), "java": ("import ", "package "), "csharp": ("using ", "global using ", "namespace "), "javascript": ("import ", "import{", "const ", "let ", "var "), "go": ("import ", "package ", '"'),
    "rust": ("use ", "pub use ", "extern crate "), "c": ("#include", "#define"),
}
_HEADS |= {"typescript": _HEADS["javascript"], "cpp": _HEADS["c"]}


def import_lines(text: str, language: str) -> list[str]:
    """The lines of a file that import something, without blanks around."""
    heads = _HEADS.get(language, ())
    lines = [x.strip() for x in text.split("\n")]
    return [x for x in lines if x.startswith(heads) and imported_names(x, language) != []] if heads else []
