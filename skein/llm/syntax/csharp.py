"""C#."""

from __future__ import annotations

import re

from skein.llm.syntax.base import Cursor, Reject

# The reserved words of C#.
WORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort".split())
MODIFIERS = frozenset("new public protected internal private abstract sealed static readonly virtual override extern unsafe volatile const event fixed ref".split())
SOFT_MODIFIERS = frozenset("partial async required file scoped".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= ??= >>= >>>=".split())
BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / % ?? ..".split())
TYPE_FOLLOWS = frozenset(["(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", ">", "?.", "??", "", "=>", "="])
OPERAND = frozenset(["I", "N", "S", "C", "(", "!", "~", "this", "base", "new", "true", "false", "null", "typeof", "sizeof", "default", "checked", "unchecked", "delegate", "stackalloc", "static", "$", *PREDEFINED])

_BLANK = re.compile(r"(?:[ \t\v\f\r\n\xa0\u1680\u2000-\u200a\u202f\u205f\u3000\u0085\u2028\u2029\ufeff]+|//[^\r\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)+")
_DIRECTIVE = re.compile(r"#[ \t]*(if|elif|else|endif|define|undef|warning|error|line|region|endregion|pragma|nullable|r|load)\b[ \t]*([^\r\n]*)")
_SECTION = re.compile(r"^[ \t]*#[ \t]*(if|elif|else|endif)\b[ \t]*([^\r\n]*)", re.M)
_CONDITION = re.compile(r"\s*(\|\||&&|==|!=|[!()]|[^\W\d]\w*)")
_TOKEN = re.compile(
    r"""(?P<name>@?(?:[^\W\d]|\\u[0-9a-fA-F]{4})(?:\w|\\u[0-9a-fA-F]{4})*)"""
    r"""|(?P<number>0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[fFdDmMuUlL]*)"""
    r"""|(?P<raw>\$*"{3,})|(?P<string>@"(?:[^"]|"")*"(?:u8)?|"(?:[^"\\\r\n]|\\(?:x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[abefnrtv0'"\\]))*"(?:u8)?)"""
    r"""|(?P<char>'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[abefnrtv0'"\\]))')|(?P<hole>\$@"|@\$"|\$")"""
    r"""|(?P<sign>\?\?=|\.\.|=>|->|::|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\?\.(?!\d)|[{}()\[\];,.<>=!~?:+\-*/&|^%])"""
)
_PLAIN = {False: re.compile(r'(?:[^"\\{}\r\n]|\\.|\{\{|\}\})*'), True: re.compile(r'(?:[^"{}]|""|\{\{|\}\})*')}


def _hole(text: str, at: int) -> tuple[int, int]:
    """(end of the expression, end of the hole) of an interpolation whose expression begins at ``at``."""
    depth, end, expression = 0, at, -1
    while end < len(text):
        c = text[end]
        if c in "([{":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "}":
            if not depth:
                return (end if expression < 0 else expression), end + 1
            depth -= 1
        elif c in "\"'" or c in "$@" and text[end + 1 : end + 2] in ('"', "$", "@"):
            m = _TOKEN.match(text, end)
            if not m:
                raise Reject("string in an interpolation")
            end = _interpolated(text, end, m) if m.lastgroup == "hole" else _raw(text, end, m[0]) if m.lastgroup == "raw" else m.end()
            continue
        elif c == ":" and not depth and expression < 0 and text[end + 1 : end + 2] != ":" and text[end - 1] != ":":
            expression = end
            while end < len(text) and text[end] not in "}\"":
                end += 1
            continue
        end += 1
    raise Reject("interpolation never closed")


def _interpolated(text: str, at: int, m: re.Match) -> int:
    """The end of an interpolated string; its expressions are parsed."""
    verbatim = "@" in m[0]
    end = m.end()
    while True:
        end = _PLAIN[verbatim].match(text, end).end()
        c = text[end : end + 1]
        if c == '"':
            return end + 1
        if c != "{":
            raise Reject("interpolated string")
        stop, after = _hole(text, end + 1)
        part = CSharp(text[end + 1 : stop])
        part.ternary_or_lambda()
        if part.eat(","):
            part.expression()
        if part.k[part.i]:
            raise part.fail("in an interpolation")
        end = after


def _raw(text: str, at: int, quotes: str) -> int:
    marks = quotes.lstrip("$")
    end = text.find(marks, at + len(quotes))
    if end < 0:
        raise Reject("raw string never closed")
    end += len(marks)
    while text[end : end + 1] == '"':
        end += 1
    return end


class Sections:
    """The conditional sections of a file: which lines there are for a compiler that defines no symbols but the file's own."""

    def __init__(self) -> None:
        self.symbols: set[str] = set()
        self.open: list[str] = []  # if, else or region, the innermost last

    def holds(self, condition: str) -> bool:
        words, at = [], 0
        condition = condition.split("//")[0].rstrip()
        while at < len(condition):
            m = _CONDITION.match(condition, at)
            if not m:
                raise Reject("condition of a directive")
            words.append(m[1])
            at = m.end()
        words.append("")
        place = 0

        def operand() -> bool:
            nonlocal place
            word = words[place]
            place += 1
            if word == "!":
                return not operand()
            if word == "(":
                value = binary(0)
                if words[place] != ")":
                    raise Reject("condition of a directive")
                place += 1
                return value
            if not word or not (word[0].isalpha() or word[0] == "_"):
                raise Reject("condition of a directive")
            return word == "true" or word in self.symbols and word != "false"

        def binary(level: int) -> bool:
            nonlocal place
            signs = (("||",), ("&&",), ("==", "!="))[level]
            value = binary(level + 1) if level < 2 else operand()
            while words[place] in signs:
                sign = words[place]
                place += 1
                other = binary(level + 1) if level < 2 else operand()
                value = value or other if sign == "||" else value and other if sign == "&&" else (value == other) == (sign == "==")
            return value

        value = binary(0)
        if words[place]:
            raise Reject("condition of a directive")
        return value

    def past(self, text: str, at: int) -> int:
        """Where the text goes on after the directive at ``at``: behind its line, or behind the sections that it leaves out."""
        m = _DIRECTIVE.match(text, at)
        if not m or text[text.rfind("\n", 0, at) + 1 : at].strip(" \t\r\ufeff"):
            raise Reject("directive")
        word, rest = m[1], m[2]
        if word in ("define", "undef"):
            (self.symbols.add if word == "define" else self.symbols.discard)(rest.split("//")[0].strip())
        elif word in ("region", "if"):
            self.open.append(word)
        if word == "if" and not self.holds(rest):
            return self.skip(text, m.end(), True)
        if word in ("elif", "else", "endif", "endregion"):
            if not self.open or self.open[-1] not in (("region",) if word == "endregion" else ("if", "else")) or word in ("elif", "else") and self.open[-1] == "else":
                raise Reject(f"#{word} without its beginning")
            if word in ("elif", "else"):
                return self.skip(text, m.end(), False)
            self.open.pop()
        return m.end()

    def skip(self, text: str, at: int, wanted: bool) -> int:
        """Behind the directive that ends the sections left out from ``at`` on; with ``wanted`` the next one that holds counts."""
        depth = 0
        for m in _SECTION.finditer(text, at):
            if m[1] == "if":
                depth += 1
            elif depth:
                depth -= m[1] == "endif"
            elif m[1] == "endif":
                self.open.pop()
                return m.end()
            elif self.open[-1] == "else":
                raise Reject(f"#{m[1]} after #else")
            else:
                if m[1] == "else":
                    self.open[-1] = "else"
                if wanted and (m[1] == "else" or self.holds(m[2])):
                    return m.end()
        raise Reject("#if never closed")


def tokens(text: str) -> tuple[list[str], list[str]]:
    kinds, texts, at, n = [], [], 0, len(text)
    sections = Sections()
    match, blank = _TOKEN.match, _BLANK.match
    while at < n:
        m = blank(text, at)
        if m:
            at = m.end()
            continue
        if text[at] == "#":
            at = sections.past(text, at)
            continue
        m = match(text, at)
        if not m:
            raise Reject(f"character {text[at]!r}")
        kind, t, at = m.lastgroup, m[0], m.end()
        if kind == "name":
            kinds.append(t if t in WORDS else "I")
        elif kind == "sign":
            kinds.append(t)
        elif kind == "number":
            if text[at : at + 1].isalpha() or text[at : at + 1] == "_":
                raise Reject("name after number")
            kinds.append("N")
        elif kind == "char":
            kinds.append("C")
        else:
            if kind == "hole":
                at = _interpolated(text, m.start(), m)
            elif kind == "raw":
                at = _raw(text, m.start(), t)
            kinds.append("S")
        texts.append(t)
    if sections.open:
        raise Reject(f"#{sections.open[-1]} never closed")
    return kinds, texts


class CSharp(Cursor):
    def __init__(self, text: str):
        super().__init__(*tokens(text.removeprefix("\ufeff")))
        self.place = False
        self.types: dict[tuple[int, bool], int] = {}

    # -- types, by look-ahead: each returns the index after, or -1

    def past_arguments(self, i: int) -> int:
        i += 1
        while self.k[i] == ",":
            i += 1
        if self.k[i] == ">":
            return i + 1
        while True:
            if self.k[i] == "[":
                i = self.pair[i] + 1
            if self.k[i] in ("in", "out"):
                i += 1
            i = self.past_type(i)
            if i < 0:
                return -1
            if self.k[i] == ",":
                i += 1
            elif self.k[i] == ">":
                return i + 1
            else:
                return -1

    def past_type(self, i: int, suffixes: bool = True) -> int:
        """Where the type at ``i`` ends, -1 if there is none; found once a place, as brackets within brackets ask again and again."""
        known = self.types.get((i, suffixes))
        if known is None:
            known = self.types[i, suffixes] = self._past_type(i, suffixes)
        return known

    def _past_type(self, i: int, suffixes: bool) -> int:
        k = self.k[i]
        if k in ("ref", "readonly"):
            return self.past_type(i + 1, suffixes)
        if k in PREDEFINED or k == "void":
            i += 1
        elif k == "delegate" and self.k[i + 1] == "*":
            i += 2
            while self.k[i] == "I" or self.k[i] == "[":
                i = i + 1 if self.k[i] == "I" else self.pair[i] + 1
            if self.k[i] != "<":
                return -1
            i = self.past_arguments(i)
            if i < 0:
                return -1
        elif k == "I":
            if self.k[i + 1] == "::":
                i += 2
            while True:
                if self.k[i] != "I":
                    return -1
                i += 1
                if self.k[i] == "<":
                    i = self.past_arguments(i)
                    if i < 0:
                        return -1
                if self.k[i] != ".":
                    break
                i += 1
        elif k == "(":
            i += 1
            n = 0
            while True:
                i = self.past_type(i)
                if i < 0:
                    return -1
                n += 1
                if self.k[i] == "I":
                    i += 1
                if self.k[i] == ",":
                    i += 1
                elif self.k[i] == ")" and n > 1:
                    i += 1
                    break
                else:
                    return -1
        else:
            return -1
        while suffixes:
            k = self.k[i]
            if k == "?" or k == "*":
                i += 1
            elif k == "[":
                j = i + 1
                while self.k[j] == ",":
                    j += 1
                if self.k[j] != "]":
                    break
                i = j + 1
            else:
                break
        return i

    def type(self, suffixes: bool = True) -> None:
        i = self.past_type(self.i, suffixes)
        if i < 0:
            raise self.fail("instead of a type")
        self.i = i

    def types(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def name(self) -> None:
        self.need("I")

    def dotted(self) -> None:
        self.name()
        while self.k[self.i] in (".", "::"):
            self.i += 1
            self.name()

    # -- declarations

    def unit(self) -> None:
        self.outer(True)
        if self.k[self.i]:
            raise self.fail("outside of any declaration")

    def outer(self, top: bool = False) -> None:
        while self.k[self.i] and self.k[self.i] != "}":
            k = self.k[self.i]
            if k == "extern" and self.v[self.i + 1] == "alias":
                self.i += 2
                self.name()
                self.need(";")
            elif k == "using" and self.k[self.i + 1] != "(" and not (self.k[self.i + 1] == "I" and self.v[self.i + 1] == "var") or self.word("global") and self.k[self.i + 1] == "using":
                self.using()
            elif k == "namespace":
                self.i += 1
                self.dotted()
                if self.eat(";"):
                    continue
                self.need("{")
                self.outer()
                self.need("}")
                self.eat(";")
            elif k == ";":
                self.i += 1
            elif k == "[" and self.k[self.i + 1] == "I" and self.v[self.i + 1] in ("assembly", "module") and self.k[self.i + 2] == ":":
                self.attributes()
            elif self.type_ahead():
                self.attributes()
                self.modifiers()
                self.declared_type()
            elif top:
                self.statement(True)
            else:
                raise self.fail("in a namespace")

    def using(self) -> None:
        self.eat_word("global")
        self.i += 1
        self.eat("static")
        self.eat("unsafe")
        if self.k[self.i] == "I" and self.k[self.i + 1] == "=":
            self.i += 2
        self.type()
        self.need(";")

    def attributes(self) -> None:
        while self.k[self.i] == "[":
            self.i += 1
            if self.k[self.i + 1] == ":":
                self.i += 2
            while True:
                self.type(False)
                if self.k[self.i] == "(":
                    self.arguments()
                if not self.eat(",") or self.k[self.i] == "]":
                    break
            self.need("]")

    def modifiers(self) -> None:
        while self.k[self.i] in MODIFIERS or self.k[self.i] == "I" and self.v[self.i] in SOFT_MODIFIERS and self.k[self.i + 1] not in ("(", "=", ";", ",", ".", ")", "{", "<", "=>", "[", "?") :
            self.i += 1

    def past_modifiers(self, i: int) -> int:
        while self.k[i] == "[":
            i = self.pair[i] + 1
        while self.k[i] in MODIFIERS or self.k[i] == "I" and self.v[i] in SOFT_MODIFIERS and (self.k[i + 1] == "I" or self.k[i + 1] in WORDS):
            i += 1
        return i

    def type_ahead(self) -> bool:
        i = self.past_modifiers(self.i)
        k = self.k[i]
        if k in ("class", "struct", "interface", "enum"):
            return True
        if k == "delegate":
            return self.k[i + 1] != "(" and self.k[i + 1] != "{" and self.k[i + 1] != "*"
        return k == "I" and self.v[i] == "record" and (self.k[i + 1] in ("class", "struct") or self.k[i + 1] == "I" and self.k[i + 2] in ("(", "<", "{", ":", ";"))

    def declared_type(self) -> None:
        k = self.k[self.i]
        self.i += 1
        if k == "delegate":
            self.type()
            self.name()
            self.type_parameters()
            self.parameters("(", ")")
            self.constraints()
            self.need(";")
            return
        if k == "I":
            self.eat("class") or self.eat("struct")
        self.name()
        self.type_parameters()
        if self.k[self.i] == "(":
            self.parameters("(", ")")
        if self.eat(":"):
            while True:
                self.type()
                if self.k[self.i] == "(":
                    self.arguments()
                if not self.eat(","):
                    break
        self.constraints()
        if k != "enum" and self.eat(";"):
            return
        self.need("{")
        if k == "enum":
            while not self.eat("}"):
                self.attributes()
                self.name()
                if self.eat("="):
                    self.expression()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            while not self.eat("}"):
                self.member()
        self.eat(";")

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.attributes()
                self.eat("in") or self.eat("out")
                self.name()
                if not self.eat(","):
                    break
            self.need(">")

    def constraints(self) -> None:
        while self.word("where"):
            self.i += 1
            self.name()
            self.need(":")
            while True:
                if self.k[self.i] in ("class", "struct", "default"):
                    self.i += 1
                    self.eat("?")
                elif self.eat("new"):
                    self.need("(")
                    self.need(")")
                else:
                    self.type()
                if not self.eat(","):
                    break

    def parameters(self, opening: str, closing: str) -> None:
        self.need(opening)
        while not self.eat(closing):
            self.attributes()
            while self.k[self.i] in ("ref", "out", "in", "params", "this", "readonly") or self.word("scoped") and self.k[self.i + 1] in ("ref", "I"):
                self.i += 1
            self.type()
            self.name()
            if self.eat("="):
                self.expression()
            if self.k[self.i] != closing:
                self.need(",")
                if self.k[self.i] == closing:
                    raise self.fail("after a comma")

    def member(self) -> None:
        if self.type_ahead():
            self.attributes()
            self.modifiers()
            self.declared_type()
            return
        self.attributes()
        self.modifiers()
        k = self.k[self.i]
        if k == "~":
            self.i += 1
            self.name()
            self.need("(")
            self.need(")")
            self.function_body()
            return
        if k in ("implicit", "explicit"):
            self.i += 1
            self.need("operator")
            self.eat("checked")
            self.type()
            self.parameters("(", ")")
            self.function_body()
            return
        if k == "I" and self.k[self.i + 1] == "(":
            self.i += 1
            self.parameters("(", ")")
            if self.eat(":"):
                self.need_in(("base", "this"))
                self.arguments()
            self.function_body()
            return
        self.type()
        if self.eat("operator"):
            self.eat("checked")
            if self.k[self.i] in ("true", "false"):
                self.i += 1
            else:
                self.need_in(BINARY | {"!", "~", "++", "--", "+", "-"})
                while self.k[self.i] == ">":
                    self.i += 1
            self.parameters("(", ")")
            self.function_body()
            return
        # a name, perhaps of an interface's member
        i = self.i
        if self.k[i] == "I":
            after = self.past_type(i, False)
            if after > 0 and self.k[after] == "." and self.k[after + 1] == "this":
                self.i = after + 1
            elif self.k[after - 1] == ">" and self.k[after] == "(":
                self.i = i
                while self.k[self.i + 1] == "." or self.k[self.i + 1] == "<" and self.k[self.past_arguments(self.i + 1)] == ".":
                    self.i = self.i + 2 if self.k[self.i + 1] == "." else self.past_arguments(self.i + 1) + 1
                self.i += 1
                self.type_parameters()
            else:
                self.i = after
        if self.eat("this"):
            self.parameters("[", "]")
            self.accessors()
            return
        if self.k[self.i - 1] not in ("I", ">"):
            raise self.fail("instead of a member's name")
        k = self.k[self.i]
        if k == "(":
            self.parameters("(", ")")
            self.constraints()
            self.function_body()
        elif k == "{" or k == "=>":
            self.accessors()
        else:
            self.i -= 1
            self.declarators()
            self.need(";")

    def function_body(self) -> None:
        if self.eat(";"):
            return
        if self.eat("=>"):
            self.thrown_or_expression()
            self.need(";")
            return
        self.block()

    def thrown_or_expression(self) -> None:
        if self.eat("throw"):
            self.expression()
        else:
            self.eat("ref")
            self.expression()

    def accessors(self) -> None:
        if self.eat("=>"):
            self.thrown_or_expression()
            self.need(";")
            return
        self.need("{")
        some = False
        while not self.eat("}"):
            self.attributes()
            self.modifiers()
            if not (self.k[self.i] == "I" and self.v[self.i] in ("get", "set", "init", "add", "remove")):
                raise self.fail("instead of an accessor")
            self.i += 1
            some = True
            self.function_body()
        if not some:
            raise self.fail("after no accessor")
        if self.eat("="):
            self.initial()
            self.need(";")

    def initial(self) -> None:
        if self.k[self.i] == "{":
            self.array_values()
        else:
            self.eat("ref")
            self.expression()

    def array_values(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.initial()
            if self.k[self.i] != "}":
                self.need(",")

    def declarators(self) -> None:
        while True:
            self.name()
            if self.k[self.i] == "[":
                self.i += 1
                self.expression()
                self.need("]")
            if self.eat("="):
                if self.eat("stackalloc"):
                    self.i -= 1
                self.initial()
            if not self.eat(","):
                return

    # -- statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement(True)

    def declares(self) -> int:
        """The index of the first name, if variables or a local function are declared here, else 0."""
        k = self.k[self.i]
        if k != "I" and k not in PREDEFINED and k not in ("(", "ref", "void", "delegate"):
            return 0
        i = self.past_type(self.i + (k == "I" and self.v[self.i] == "scoped" and self.k[self.i + 1] in ("ref", "I")))
        if i > 0 and self.k[i] == "I" and (self.k[i + 1] in ("=", ";", ",", "in", ")", "[", "(", "<")):
            if k == "I" and self.v[self.i] == "await" and self.k[i + 1] in ("(", "<"):
                return 0
            return i
        return 0

    def statement(self, declarations: bool = False) -> None:
        k = self.k[self.i]
        rule = _STATEMENTS.get(k)
        if rule:
            self.i += 1
            rule(self)
            return
        if k == "{":
            self.block()
            return
        if k == ";":
            self.i += 1
            return
        if k == "I":
            v, after = self.v[self.i], self.k[self.i + 1]
            if after == ":":
                self.i += 2
                if self.k[self.i] != "}":
                    self.statement(declarations)
                return
            if v == "yield" and after in ("return", "break"):
                self.i += 2
                if after == "return":
                    self.expression()
                self.need(";")
                return
            if v == "await" and after in ("foreach", "using"):
                self.i += 1
                self.statement(declarations)
                return
        if k in ("checked", "unchecked") and self.k[self.i + 1] == "{" or k == "unsafe":
            self.i += 1
            self.block()
            return
        if declarations:
            while self.k[self.i] == "[" and self.k[self.pair[self.i] + 1] in ("I", "static", *PREDEFINED, "void", "[") and self.k[self.i + 1] == "I":
                self.attributes()
            if k == "const":
                self.i += 1
                self.type()
                self.declarators()
                self.need(";")
                return
            at = self.i
            while self.k[self.i] in ("static", "unsafe", "extern") or self.word("async") and (self.k[self.i + 1] in ("I", "void", "static", "unsafe") or self.k[self.i + 1] in PREDEFINED):
                self.i += 1
            name = self.declares()
            if name:
                self.i = name
                if self.k[name + 1] in ("(", "<"):
                    self.i += 1
                    self.type_parameters()
                    self.parameters("(", ")")
                    self.constraints()
                    self.function_body()
                    return
                self.declarators()
                self.need(";")
                return
            self.i = at
        self.effect()
        self.need(";")

    def effect(self) -> None:
        if not self.expression():
            raise self.fail("after what is no statement")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.condition()
        self.statement()
        if self.eat("else"):
            self.statement()

    def while_(self) -> None:
        self.condition()
        self.statement()

    def do(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def for_(self) -> None:
        self.need("(")
        if self.k[self.i] != ";":
            name = self.declares()
            if name:
                self.i = name
                self.declarators()
            else:
                self.effects()
        self.need(";")
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")
        if self.k[self.i] != ")":
            self.effects()
        self.need(")")
        self.statement()

    def effects(self) -> None:
        self.effect()
        while self.eat(","):
            self.effect()

    def foreach(self) -> None:
        self.need("(")
        name = self.declares()
        if name:
            self.i = name + 1
        else:
            self.ternary_or_lambda()
        self.need("in")
        self.expression()
        self.need(")")
        self.statement()

    def switch(self) -> None:
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("default"):
                self.need(":")
            else:
                self.need("case")
                self.pattern()
                if self.eat_word("when"):
                    self.expression()
                self.need(":")
            while self.k[self.i] not in ("case", "}") and not (self.k[self.i] == "default" and self.k[self.i + 1] == ":"):
                self.statement(True)

    def jump(self) -> None:
        self.need(";")

    def goto(self) -> None:
        if self.eat("case"):
            self.expression()
        elif not self.eat("default"):
            self.name()
        self.need(";")

    def return_(self) -> None:
        if self.k[self.i] != ";":
            self.thrown_or_expression()
        self.need(";")

    def throw(self) -> None:
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")

    def try_(self) -> None:
        self.block()
        some = False
        while self.eat("catch"):
            some = True
            if self.eat("("):
                self.type()
                self.eat("I")
                self.need(")")
            if self.eat_word("when"):
                self.condition()
            self.block()
        if self.eat("finally"):
            self.block()
        elif not some:
            raise self.fail("instead of catch")

    def lock(self) -> None:
        self.condition()
        self.statement()

    def using_statement(self) -> None:
        scoped = self.eat("(")
        name = self.declares()
        if name:
            self.i = name
            self.declarators()
        else:
            self.expression()
        if scoped:
            self.need(")")
            self.statement()
        else:
            self.need(";")

    def fixed(self) -> None:
        self.need("(")
        self.type()
        self.declarators()
        self.need(")")
        self.statement()

    # -- patterns

    def pattern(self) -> None:
        while True:
            while self.eat_word("not"):
                pass
            self.one_pattern()
            if self.k[self.i] == "I" and self.v[self.i] in ("and", "or"):
                self.i += 1
            else:
                return

    def one_pattern(self) -> None:
        k = self.k[self.i]
        if k in ("<", ">", "<=", ">=", "==", "!="):
            self.i += 1
            self.shift()
            return
        if k == "[":
            self.i += 1
            self.patterns("]")
            self.designation()
            return
        if k == "..":
            self.i += 1
            if self.k[self.i] not in (",", "]"):
                self.pattern()
            return
        if k == "{":
            self.property_patterns()
            self.designation()
            return
        if k == "(":
            self.i += 1
            self.patterns(")")
            if self.k[self.i] == "{":
                self.property_patterns()
            self.designation()
            return
        i = self.past_type(self.i)
        if i > 0 and (self.k[i] in ("{", "(") or self.k[i] == "I" and self.v[i] not in ("and", "or", "when") or k in PREDEFINED or self.k[i - 1] in ("]", "?") ) and not (self.k[i - 1] == "?" and self.k[i] not in ("I", ")", ",")):
            self.i = i
            if k == "I" and self.v[i - 1] == "var" and self.k[i] == "(":
                self.condition()
                return
            if self.eat("("):
                self.patterns(")")
            if self.k[self.i] == "{":
                self.property_patterns()
            self.designation()
            return
        self.shift()

    def designation(self) -> None:
        if self.k[self.i] == "I" and self.v[self.i] not in ("and", "or", "when"):
            self.i += 1

    def patterns(self, closing: str) -> None:
        while not self.eat(closing):
            if self.k[self.i] == "I" and self.k[self.i + 1] == ":":
                self.i += 2
            self.pattern()
            if self.k[self.i] != closing:
                self.need(",")

    def property_patterns(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.dotted()
            self.need(":")
            self.pattern()
            if self.k[self.i] != "}":
                self.need(",")

    # -- expressions: each says whether it may stand as a statement

    def expression(self) -> bool:
        effect = self.ternary_or_lambda()
        while self.k[self.i] in ASSIGN or self.k[self.i] == ">" and self.shift_assigns():
            if not self.place:
                raise self.fail("assigns to what is no place")
            while self.k[self.i] == ">":
                self.i += 1
            self.i += 1
            self.eat("ref")
            if self.eat("throw"):
                pass
            self.ternary_or_lambda()
            effect = True
        return effect

    def shift_assigns(self) -> bool:
        return self.k[self.i + 1] == ">=" or self.k[self.i + 1] == ">" and self.k[self.i + 2] == ">="

    def ternary_or_lambda(self) -> bool:
        if self.lambda_():
            return False
        if self.word("from") and self.k[self.i + 1] in ("I", *PREDEFINED) and (self.k[self.i + 2] in ("in", "I", "<", "[", ".")):
            self.query()
            return False
        self.place = True
        effect = self.binary()
        if self.k[self.i] == "?":
            self.i += 1
            self.branch()
            self.need(":")
            self.branch()
            self.place = False
            return False
        return effect

    def branch(self) -> None:
        self.eat("throw") or self.eat("ref")
        self.expression()

    def lambda_(self) -> bool:
        i = self.i
        while self.k[i] == "[" and self.k[self.pair[i] + 1] in ("(", "static", "I") and self.k[i + 1] == "I" and self.pair[i] > i + 1:
            i = self.pair[i] + 1
        while self.k[i] == "static" or self.k[i] == "I" and self.v[i] == "async" and self.k[i + 1] in ("(", "I", "static", "delegate"):
            i += 1
        if self.k[i] == "I" and self.k[i + 1] == "=>":
            self.i = i + 2
        elif self.k[i] == "(" and self.k[self.pair[i] + 1] == "=>":
            self.i = i
            if self.k[i + 1] == "I" and self.k[i + 2] in (",", ")"):
                self.i += 1
                while not self.eat(")"):
                    self.name()
                    if self.k[self.i] != ")":
                        self.need(",")
            else:
                self.lambda_parameters()
            self.i += 1
        else:
            after = self.past_type(i) if i > self.i or self.k[i] in PREDEFINED else -1
            if after > 0 and self.k[after] == "(" and self.k[self.pair[after] + 1] == "=>":
                self.i = after
                self.lambda_parameters()
                self.i += 1
            else:
                return False
        if self.k[self.i] == "{":
            self.block()
        else:
            self.thrown_or_expression()
        self.place = False
        return True

    def lambda_parameters(self) -> None:
        self.parameters("(", ")") if self.past_type(self.i + 1) > 0 or self.k[self.i + 1] in ("ref", "out", "in", "params", "[", ")") else self.loose_parameters()

    def loose_parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.name()
            if self.k[self.i] != ")":
                self.need(",")

    def query(self) -> None:
        self.i += 1
        if self.k[self.i + 1] != "in":
            self.type()
        self.name()
        self.need("in")
        self.expression()
        while self.k[self.i] == "I" or self.k[self.i] == "in":
            v = self.v[self.i]
            if v in ("from", "join"):
                self.i += 1
                if self.k[self.i + 1] != "in":
                    self.type()
                self.name()
                self.need("in")
                self.expression()
                if v == "join":
                    for word in ("on", "equals"):
                        if not self.eat_word(word):
                            raise self.fail(f"instead of {word}")
                        self.expression()
                    if self.eat_word("into"):
                        self.name()
            elif v == "let":
                self.i += 1
                self.name()
                self.need("=")
                self.expression()
            elif v == "where":
                self.i += 1
                self.expression()
            elif v == "orderby":
                self.i += 1
                while True:
                    self.expression()
                    self.eat_word("ascending") or self.eat_word("descending")
                    if not self.eat(","):
                        break
            elif v in ("select", "group"):
                self.i += 1
                self.expression()
                if v == "group":
                    if not self.eat_word("by"):
                        raise self.fail("instead of by")
                    self.expression()
                if not self.eat_word("into"):
                    return
                self.name()
            else:
                break
        raise self.fail("instead of select")

    def binary(self) -> bool:
        effect = self.unary()
        while True:
            k = self.k[self.i]
            if k in BINARY:
                if k == ">":
                    if self.shift_assigns():
                        return effect
                    while self.k[self.i + 1] == ">":
                        self.i += 1
                self.i += 1
                if k == ".." and self.k[self.i] in ("]", ")", ",", ";"):
                    effect = self.place = False
                    continue
                if k == "??" and self.eat("throw"):
                    self.expression()
                    self.place = False
                    return False
                if not self.lambda_():
                    self.unary()
            elif k == "is":
                self.i += 1
                self.pattern()
            elif k == "as":
                self.i += 1
                i = self.past_type(self.i, False)
                if i < 0:
                    raise self.fail("instead of a type")
                while self.k[i] == "[" and self.k[i + 1] in ("]", ",") or self.k[i] == "?" and self.k[i + 1] in (")", ",", ";", "]", "}", "??", "==", "!=", "&&", "||", "["):
                    i = i + 1 if self.k[i] == "?" else self.pair[i] + 1
                self.i = i
            elif k == "switch":
                self.i += 1
                self.arms()
            elif k == "I" and self.v[self.i] == "with" and self.k[self.i + 1] == "{":
                self.i += 1
                self.object_values()
            else:
                return effect
            effect = self.place = False

    def arms(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.pattern()
            if self.eat_word("when"):
                self.expression()
            self.need("=>")
            self.thrown_or_expression()
            if self.k[self.i] != "}":
                self.need(",")

    def shift(self) -> None:
        """An operand of a pattern."""
        self.unary()
        while self.k[self.i] in ("+", "-", "*", "/", "%", "<<", "|", "&"):
            self.i += 1
            self.unary()

    def unary(self) -> bool:
        k = self.k[self.i]
        if k in ("++", "--"):
            self.i += 1
            self.unary()
            return True
        if k in ("+", "-", "!", "~", "&", "*", "^", ".."):
            self.i += 1
            if k == ".." and self.k[self.i] in ("]", ")", ","):
                return False
            self.unary()
            return False
        if k == "I" and self.v[self.i] == "await" and (self.k[self.i + 1] in OPERAND and self.k[self.i + 1] != "("  or self.k[self.i + 1] == "("):
            self.i += 1
            self.unary()
            return True
        if k == "(":
            after = self.pair[self.i] + 1
            if self.past_type(self.i + 1) == after - 1 and self.cast(after):
                self.i = after
                if not self.lambda_():
                    self.unary()
                return False
        return self.postfix()

    def cast(self, after: int) -> bool:
        k = self.k[after]
        if self.k[self.i + 1] in PREDEFINED or self.k[after - 2] in ("]", "?", "*"):
            return k in OPERAND or k in ("+", "-", "++", "--", "&", "*", "^", "[")
        return k in OPERAND and not (k == "I" and self.v[after] in ("and", "or", "when", "with", "in", "is", "as", "switch", "equals", "on", "by", "into", "select", "where", "orderby", "ascending", "descending", "join", "group", "let", "from"))

    def arguments(self, opening: str = "(", closing: str = ")") -> None:
        self.need(opening)
        while not self.eat(closing):
            if self.k[self.i] == "I" and self.k[self.i + 1] == ":":
                self.i += 2
            self.argument()
            if self.k[self.i] != closing:
                self.need(",")
                if self.k[self.i] == closing:
                    raise self.fail("after a comma")

    def argument(self) -> None:
        k = self.k[self.i]
        if k in ("ref", "out", "in"):
            self.i += 1
            name = self.declares_one()
            if name:
                self.i = name + 1
                return
        elif k == "I" and self.v[self.i] in ("var",) and self.k[self.i + 1] in ("I", "("):
            self.i += 2 if self.k[self.i + 1] == "I" else 1
            if self.k[self.i] == "(":
                self.i = self.pair[self.i] + 1
            return
        if self.k[self.i] == "[" and self.k[self.i + 1] == "=":
            raise self.fail()
        self.expression()
        if self.k[self.i] == "=" and self.k[self.i - 1] == "I":
            self.i += 1
            self.expression()

    def declares_one(self) -> int:
        i = self.past_type(self.i)
        return i if i > 0 and self.k[i] == "I" and self.k[i + 1] in (")", ",") else 0

    def postfix(self) -> bool:
        effect = self.primary()
        while True:
            k = self.k[self.i]
            if k in (".", "->", "?.", "::"):
                self.i += 1
                self.name()
                self.generic()
                effect = False
            elif k == "(":
                self.arguments()
                effect = True
            elif k == "[":
                self.arguments("[", "]")
                effect = False
            elif k == "?" and self.k[self.i + 1] == "[" and self.k[self.pair[self.i + 1] + 1] != ":":
                self.i += 1
                self.arguments("[", "]")
                effect = False
            elif k in ("++", "--"):
                self.i += 1
                effect = True
            elif k == "!" and self.k[self.i + 1] not in OPERAND:
                self.i += 1
            else:
                return effect

    def generic(self) -> None:
        """Type arguments of a name in an expression, if what follows them says so."""
        if self.k[self.i] == "<":
            i = self.past_arguments(self.i)
            if i > 0 and (self.k[i] in TYPE_FOLLOWS or self.k[i] == "{" or self.k[i] == "I" and self.k[i + 1] in ("=", ";", ",", ")")):
                self.i = i

    def primary(self) -> bool:
        k = self.k[self.i]
        if k == "I":
            self.i += 1
            self.generic()
            if self.k[self.i] == "I" and self.k[self.i - 1] == "I" and self.v[self.i - 1] == "var":
                self.i += 1
            return False
        if k in ("N", "S", "C", "true", "false", "null"):
            self.i += 1
            return False
        if k in ("this", "base") or k in PREDEFINED:
            self.i += 1
            if k in PREDEFINED and self.k[self.i] != ".":
                i = self.past_type(self.i - 1)
                if self.k[i] != "I" or self.k[i + 1] not in (",", ")"):
                    raise self.fail("after a type")
                self.i = i + 1
            return False
        if k == "(":
            self.i += 1
            while True:
                if self.k[self.i] == "I" and self.k[self.i + 1] == ":":
                    self.i += 2
                name = self.declares_one()
                if name:
                    self.i = name + 1
                else:
                    self.eat("ref")
                    self.expression()
                if not self.eat(","):
                    break
            self.need(")")
            return False
        if k == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("..")
                self.expression()
                if self.k[self.i] != "]":
                    self.need(",")
            return False
        if k == "new":
            self.i += 1
            self.creation()
            return True
        if k in ("typeof", "sizeof", "default", "checked", "unchecked"):
            self.i += 1
            if k == "default" and self.k[self.i] != "(":
                return False
            if k in ("checked", "unchecked"):
                self.condition()
                return False
            self.need("(")
            self.type()
            self.need(")")
            return False
        if k == "stackalloc":
            self.i += 1
            if self.k[self.i] == "[":
                self.arguments("[", "]")
                self.array_values()
                return False
            self.type(False)
            self.arguments("[", "]") if self.k[self.i] == "[" else None
            if self.k[self.i] == "{":
                self.array_values()
            return False
        if k == "delegate":
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters("(", ")")
            self.block()
            return False
        raise self.fail("instead of an operand")

    def creation(self) -> None:
        k = self.k[self.i]
        if k == "(":
            self.arguments()
            if self.k[self.i] == "{":
                self.object_values()
            return
        if k == "{":
            self.object_values()
            return
        if k == "[":
            self.need("[")
            while self.eat(","):
                pass
            self.need("]")
            self.array_values()
            return
        self.type(False)
        self.eat("?")
        if self.k[self.i] == "(":
            self.arguments()
            if self.k[self.i] == "{":
                self.object_values()
        elif self.k[self.i] == "[":
            sized = False
            while self.k[self.i] == "[":
                if self.k[self.i + 1] in ("]", ","):
                    self.i += 1
                    while self.eat(","):
                        pass
                    self.need("]")
                else:
                    sized = True
                    self.arguments("[", "]")
            if self.k[self.i] == "{":
                self.array_values()
            elif not sized:
                raise self.fail("neither size nor values")
        elif self.k[self.i] == "{":
            self.object_values()
        else:
            raise self.fail("after new")

    def object_values(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.k[self.i] == "[":
                self.attempt(self.indexed) or self.initial()
            elif self.k[self.i] == "I" and self.k[self.i + 1] == "=":
                self.i += 2
                self.object_values() if self.k[self.i] == "{" else self.initial()
            elif self.k[self.i] == "{":
                self.array_values()
            else:
                self.expression()
            if self.k[self.i] != "}":
                self.need(",")

    def indexed(self) -> None:
        self.arguments("[", "]")
        self.need("=")
        self.object_values() if self.k[self.i] == "{" else self.initial()


_STATEMENTS = {
    "if": CSharp.if_, "while": CSharp.while_, "do": CSharp.do, "for": CSharp.for_, "foreach": CSharp.foreach, "switch": CSharp.switch, "break": CSharp.jump, "continue": CSharp.jump,
    "goto": CSharp.goto, "return": CSharp.return_, "throw": CSharp.throw, "try": CSharp.try_, "lock": CSharp.lock, "using": CSharp.using_statement, "fixed": CSharp.fixed,
}


def csharp(text: str) -> None:
    CSharp(text).unit()
