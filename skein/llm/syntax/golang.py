"""Go."""

from __future__ import annotations

import re

from skein.llm.syntax.base import Cursor, Reject

# The keywords of Go.
WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
#: A line that ends after one of these ends a statement.
ENDS = frozenset(["I", "N", "S", "C", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
TYPE_STARTS = frozenset(["I", "*", "[", "(", "map", "chan", "func", "struct", "interface", "<-"])

_TOKEN = re.compile(
    r"(?P<blank>[ \t\r]+)|(?P<line>\n)|(?P<note>//[^\n]*)|(?P<block>/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F]_?)*)?(?:[pP][+-]?\d(?:_?\d)*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?)"
    r"|(?P<string>`[^`]*`|\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\")"
    r"|(?P<rune>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!~()\[\]{},;.:])"
)


def tokens(text: str) -> tuple[list[str], list[str]]:
    """With the semicolons that line ends stand for."""
    kinds, texts, at, n = [], [], 0, len(text)
    match, last = _TOKEN.match, ""
    while at < n:
        m = match(text, at)
        if not m:
            raise Reject(f"character {text[at]!r}")
        kind, at = m.lastgroup, m.end()
        if kind == "blank" or kind == "note":
            continue
        t = m[0]
        if kind == "line" or kind == "block":
            if last in ENDS and "\n" in t:
                kinds.append(";")
                texts.append("\n")
                last = ";"
            continue
        if kind == "name":
            last = t if t in WORDS else "I"
        elif kind == "sign":
            last = t
        elif kind == "number":
            if text[at : at + 1].isalpha() or text[at : at + 1] == "_":
                raise Reject("name after number")
            last = "N"
        else:
            last = "S" if kind == "string" else "C"
        kinds.append(last)
        texts.append(t)
    if last in ENDS:
        kinds.append(";")
        texts.append("\n")
    return kinds, texts


class Go(Cursor):
    def __init__(self, text: str):
        super().__init__(*tokens(text.removeprefix("\ufeff")))
        self.no_type: set[int] = set()  # where brackets within brackets have asked for a type in vain
        self.literals = True  # composite literals of a plain type name: not in the heads of if, for and switch

    def end(self) -> None:
        """A semicolon, which may be missing before a closing bracket."""
        if self.k[self.i] not in (")", "}"):
            self.need(";")

    def unit(self) -> None:
        self.need("package")
        self.need("I")
        self.need(";")
        while self.k[self.i] == "import":
            self.group(self.imported)
            self.need(";")
        while self.k[self.i]:
            k = self.k[self.i]
            if k == "func":
                self.i += 1
                if self.k[self.i] == "(":
                    self.parameters()
                self.need("I")
                if self.k[self.i] == "[":
                    self.type_parameters()
                self.signature()
                if self.k[self.i] == "{":
                    self.block()
            else:
                self.declaration()
            self.need(";")

    def declaration(self) -> None:
        rule = {"var": self.variable, "const": self.constant, "type": self.type_spec}.get(self.k[self.i])
        if not rule:
            raise self.fail("instead of a declaration")
        self.group(rule)

    def group(self, rule) -> None:
        self.i += 1
        if self.eat("("):
            while not self.eat(")"):
                rule()
                self.end()
        else:
            rule()

    def imported(self) -> None:
        self.eat(".") or self.eat("I")
        self.need("S")

    def names(self) -> None:
        self.need("I")
        while self.eat(","):
            self.need("I")

    def variable(self) -> None:
        self.names()
        typed = self.k[self.i] != "="
        if typed:
            self.type()
        if self.eat("="):
            self.expressions()

    def constant(self) -> None:
        self.names()
        if self.k[self.i] not in (";", ")"):
            if self.k[self.i] != "=":
                self.type()
            self.need("=")
            self.expressions()

    def type_spec(self) -> None:
        self.need("I")
        if self.k[self.i] == "[" and self.k[self.i + 1] == "I" and self.k[self.i + 2] != "]":
            if not self.attempt(self.type_parameters):
                pass
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if self.k[self.i] != "]":
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def type(self) -> None:
        if self.i in self.no_type:
            raise self.fail("instead of a type")
        k = self.k[self.i]
        if k == "I":
            self.i += 1
            if self.k[self.i] == "." and self.k[self.i + 1] == "I":
                self.i += 2
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
                self.i += 1
                self.type()
                while self.eat(",") and self.k[self.i] != "]":
                    self.type()
                self.need("]")
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    before, self.literals = self.literals, True
                    self.expression()
                    self.literals = before
                self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.eat("S")
                self.end()
        elif k == "interface":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.k[self.i] == "I" and self.k[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            raise self.fail("instead of a type")

    def field(self) -> None:
        if self.eat("*"):
            self.type()
        elif self.k[self.i] == "I" and self.k[self.i + 1] in (";", "S", ".", "}"):
            self.type()
        elif self.k[self.i] == "I" and self.k[self.i + 1] == "[" and not self.attempt(self.named_field):
            self.type()
        elif self.k[self.i] == "I":
            self.named_field()
        elif self.k[self.i - 1] not in (";", "}", "S", "I", "]", ")"):
            raise self.fail("instead of a field")

    def named_field(self) -> None:
        self.names()
        self.type()
        if self.k[self.i] not in (";", "S", "}"):
            raise self.fail("after a field")

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.k[self.i] in TYPE_STARTS:
            self.type()

    def parameters(self) -> None:
        """Either all named or none."""
        if not self.attempt(self.parameter_list, True):
            self.parameter_list(False)

    def parameter_list(self, named: bool) -> None:
        self.need("(")
        while not self.eat(")"):
            if named:
                self.names()
            self.eat("...")
            self.type()
            if self.k[self.i] != ")":
                self.need(",")

    # -- statements

    def block(self) -> None:
        self.need("{")
        before, self.literals = self.literals, True
        self.statements()
        self.literals = before
        self.need("}")

    def statements(self) -> None:
        while self.k[self.i] not in ("}", "case", "default"):
            if self.eat(";"):
                continue
            self.statement()
            self.end()

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.cases(self.communication)
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue"):
            self.i += 1
            self.eat("I")
        elif k == "goto":
            self.i += 1
            self.need("I")
        elif k == "fallthrough":
            self.i += 1
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.k[self.i - 1] != ")":
                raise self.fail(f"{k} of what is no call")
        elif k == "I" and self.k[self.i + 1] == ":":
            self.i += 2
            if self.k[self.i] not in ("}", ";"):
                self.statement()
        else:
            self.simple()

    def simple(self, ranges: bool = False) -> str:
        """Says whether it was a value, a range clause, or another statement."""
        if ranges and self.k[self.i] == "range":
            self.i += 1
            self.expression()
            return "range"
        at = self.i
        many = self.expressions()
        k = self.k[self.i]
        if k in ASSIGN:
            if k == ":=" and any(x not in ("I", ",") for x in self.k[at : self.i]):
                raise self.fail("declares what is no name")
            if many > 1 and k not in ("=", ":="):
                raise self.fail("after several places")
            self.i += 1
            if ranges and k in ("=", ":=") and self.eat("range"):
                self.expression()
                return "range"
            self.expressions()
            return "type" if self.v[self.i - 2] == "type" and self.v[self.i - 3] == "(" else "other"
        elif many > 1:
            raise self.fail("after several expressions")
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expression()
        else:
            return "value"
        return "other"

    def condition(self, *more: str) -> None:
        if self.simple() not in ("value", *more):
            raise self.fail("after what is no value")

    def head(self, rule) -> None:
        before, self.literals = self.literals, False
        rule()
        self.literals = before

    def if_(self) -> None:
        self.i += 1
        self.head(self.if_head)
        self.block()
        if self.eat("else"):
            if self.k[self.i] == "if":
                self.if_()
            else:
                self.block()

    def if_head(self) -> None:
        if self.k[self.i] == "{":
            raise self.fail("instead of a condition")
        if self.k[self.i] == ";" or self.simple() != "value" or self.k[self.i] == ";":
            self.need(";")
            self.condition()

    def for_(self) -> None:
        self.i += 1
        self.head(self.for_head)
        self.block()

    def for_head(self) -> None:
        if self.k[self.i] == "{":
            return
        first = "" if self.k[self.i] == ";" else self.simple(True)
        if first == "range":
            return
        if first != "value" or self.k[self.i] == ";":
            self.need(";")
            if self.k[self.i] != ";":
                self.expression()
            self.need(";")
            if self.k[self.i] != "{":
                self.simple()

    def switch(self) -> None:
        self.i += 1
        self.head(self.switch_head)
        self.cases(self.case_values)

    def switch_head(self) -> None:
        first = "" if self.k[self.i] in (";", "{") else self.simple()
        if first == "other" and self.k[self.i] != ";":
            raise self.fail("after what is no value")
        if self.eat(";") and self.k[self.i] != "{":
            self.condition("type")

    def cases(self, rule) -> None:
        self.need("{")
        before, self.literals = self.literals, True
        while not self.eat("}"):
            if not self.eat("default"):
                self.need("case")
                rule()
            self.need(":")
            self.statements()
        self.literals = before

    def case_values(self) -> None:
        self.value_or_type()
        while self.eat(","):
            self.value_or_type()

    def communication(self) -> None:
        self.simple()

    # -- expressions

    def expressions(self) -> int:
        self.expression()
        n = 1
        while self.eat(","):
            self.expression()
            n += 1
        return n

    def value_or_type(self) -> None:
        at = self.i
        if self.attempt(self.expression):
            after = self.i
            if self.k[after] not in (",", ")", "]", "}", ":", ";", "..."):
                self.i = at
                if not self.attempt(self.type):
                    self.i = after
            return
        try:
            self.type()
        except Reject:
            self.no_type.add(at)
            raise

    def expression(self) -> None:
        self.unary()
        while self.k[self.i] in BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.k[self.i] in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.k[self.i] == "<-" and self.k[self.i + 1] == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self) -> None:
        k = self.k[self.i]
        named = False
        if k == "I":
            self.i += 1
            named = True
        elif k in ("N", "S", "C"):
            self.i += 1
        elif k == "(":
            self.i += 1
            before, self.literals = self.literals, True
            self.value_or_type()
            self.literals = before
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
            if self.k[self.i] == "{":
                self.block()
        elif k in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type()
            if self.k[self.i] == "{":
                self.values()
            elif self.k[self.i] not in ("(", ")", ",", "]", ":", "}"):
                raise self.fail("after a type")
        else:
            raise self.fail("instead of an operand")
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    named = False
                else:
                    self.need("I")
            elif k == "[":
                self.i += 1
                before, self.literals = self.literals, True
                self.index()
                self.literals = before
            elif k == "(":
                self.i += 1
                before, self.literals = self.literals, True
                while not self.eat(")"):
                    self.value_or_type()
                    self.eat("...")
                    if self.k[self.i] != ")":
                        self.need(",")
                self.literals = before
                named = False
            elif k == "{" and named and self.literals:
                self.values()
                named = False
            else:
                return

    def index(self) -> None:
        if self.k[self.i] != ":":
            self.value_or_type()
        if self.eat(","):
            while not self.eat("]"):
                self.type()
                if self.k[self.i] != "]":
                    self.need(",")
            return
        colons = 0
        while self.eat(":"):
            colons += 1
            if self.k[self.i] not in (":", "]"):
                self.expression()
        if colons > 2:
            raise self.fail("after a slice")
        self.need("]")

    def values(self) -> None:
        self.need("{")
        before, self.literals = self.literals, True
        while not self.eat("}"):
            self.value()
            if self.eat(":"):
                self.value()
            if self.k[self.i] != "}":
                self.need(",")
        self.literals = before

    def value(self) -> None:
        if self.k[self.i] == "{":
            self.values()
        else:
            self.expression()


def go(text: str) -> None:
    Go(text).unit()
