"""JavaScript (script or module) and TypeScript."""

from __future__ import annotations

import re

from skein.llm.syntax.base import Cursor, Reject

# Reserved words of ECMAScript.
WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("+ - * / % ** == != === !== < > <= >= << >> >>> & | ^ && || ?? in instanceof".split())
PREFIX = frozenset("+ - ! ~ ++ -- typeof void delete".split())
#: After these a slash divides; after any other token it opens a regular expression.
VALUE_ENDS = frozenset(["I", "N", "S", "`", "R", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "#"])

_NAME = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    r"(?P<blank>[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<line>\r\n|[\r\n\u2028\u2029])|(?P<note>//[^\n\r\u2028\u2029]*)|(?P<block>/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"
    rf"|(?P<name>{_NAME})|(?P<private>\#{_NAME})"
    r"|(?P<number>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?n?)"
    r"""|(?P<string>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"""
    r"|(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n\u2028\u2029]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/(?P<flags>[\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{)")


_ESCAPE_OR_CLASS = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]")


def regex_body(body: str) -> None:
    """Rejects a regular expression whose groups do not pair up or whose quantifiers stand after nothing."""
    plain = _ESCAPE_OR_CLASS.sub("a", body)
    depth = 0
    for i, c in enumerate(plain):
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise Reject("group never opened")
        elif c in "*+?" and (i == 0 or plain[i - 1] in "(|^") and not (c == "?" and i and plain[i - 1] == "("):
            raise Reject("nothing to repeat")
    if depth:
        raise Reject("group never closed")


def tokens(text: str, typed: bool) -> tuple[list[str], list[str], list[bool]]:
    """Kinds, texts, and whether a line ends before each token. In TypeScript ``>`` always stands alone."""
    kinds: list[str] = []
    texts: list[str] = []
    breaks: list[bool] = []
    braces: list[str] = []
    at, fresh, n = 0, True, len(text)
    if text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
    match = _TOKEN.match
    while at < n:
        c = text[at]
        if c == "`" or (c == "}" and braces and braces[-1] == "${"):
            if c == "}":
                braces.pop()
                kinds.append("}$")
                texts.append("}")
                breaks.append(fresh)
            m = _TEMPLATE.match(text, at + 1)
            if not m:
                raise Reject("template never closed")
            if m["end"] == "`":
                kinds.append("`")
            else:
                kinds.append("${")
                braces.append("${")
            texts.append("`")
            breaks.append(fresh)
            fresh, at = False, m.end()
            continue
        if c == "/" and (not kinds or kinds[-1] not in VALUE_ENDS or (kinds[-1] == ")" and _after_head(kinds)) or (kinds[-1] == "}" and fresh)):
            m = _REGEX.match(text, at)
            if m and not text.startswith(("//", "/*"), at):
                if len(set(m["flags"])) < len(m["flags"]) or set(m["flags"]) - set("dgimsuvy"):
                    raise Reject("regular expression flags")
                regex_body(m[0][1 : m[0].rindex("/")])
                kinds.append("R")
                texts.append(m[0])
                breaks.append(fresh)
                fresh, at = False, m.end()
                continue
        m = match(text, at)
        if not m:
            raise Reject(f"character {c!r}")
        kind, t = m.lastgroup, m[0]
        at = m.end()
        if kind == "blank" or kind == "note":
            continue
        if kind == "line":
            fresh = True
            continue
        if kind == "block":
            fresh = fresh or "\n" in t
            continue
        if kind == "name":
            kinds.append(t if t in WORDS else "I")
        elif kind == "sign":
            if t == "{" or t == "}":
                if t == "{":
                    braces.append("{")
                elif braces:
                    braces.pop()
            if typed and t[0] == ">" and len(t) > 1:
                for _ in range(len(t) - t.endswith("=")):
                    kinds.append(">")
                    texts.append(">")
                    breaks.append(fresh)
                    fresh = False
                if t.endswith("="):
                    kinds[-1] = texts[-1] = ">="
                continue
            kinds.append(t)
        elif kind == "number":
            if at < n and (text[at] == "_" or text[at].isalnum() or text[at] == "$"):
                raise Reject("name after number")
            kinds.append("N")
        else:
            kinds.append("S" if kind == "string" else "#")
        texts.append(t)
        breaks.append(fresh)
        fresh = False
    return kinds, texts, breaks


def _after_head(kinds: list[str]) -> bool:
    """Whether the closing parenthesis ends the head of if, while, for or with."""
    depth = 0
    for i in range(len(kinds) - 1, -1, -1):
        if kinds[i] == ")":
            depth += 1
        elif kinds[i] == "(":
            depth -= 1
            if not depth:
                return i > 0 and kinds[i - 1] in ("if", "while", "for", "with")
    return False


class Script(Cursor):
    """Recursive descent over the tokens of one file."""

    def __init__(self, text: str, typed: bool):
        kinds, texts, breaks = tokens(text.removeprefix("\ufeff"), typed)
        super().__init__(kinds, texts)
        self.line = [*breaks, True, True, True, True]
        self.typed, self.functions, self.loops, self.ambient, self.plain_arrows = typed, 0, 0, 0, False

    # -- small helpers

    def name(self) -> None:
        self.need("I")

    def any_name(self) -> None:
        k = self.k[self.i]
        if k != "I" and k not in WORDS:
            raise self.fail("instead of a name")
        self.i += 1

    def end(self) -> None:
        """A semicolon, written or inserted."""
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and k != "" and not self.line[self.i]:
            raise self.fail("instead of an end of statement")

    # -- statements

    def program(self) -> None:
        while self.k[self.i]:
            self.statement()

    def block(self) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            self.statement()
        self.i += 1

    def body(self) -> None:
        loops, self.loops = self.loops, 0
        self.functions += 1
        self.block()
        self.functions -= 1
        self.loops = loops

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def looped(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def statement(self) -> None:
        k = self.k[self.i]
        rule = _STATEMENTS.get(k)
        if rule:
            rule(self)
            return
        if k == "I":
            v, after = self.v[self.i], self.k[self.i + 1]
            if after == ":":
                self.i += 2
                self.loops += 1
                self.statement()
                self.loops -= 1
                return
            if v == "async" and after == "function" and not self.line[self.i + 1]:
                self.i += 1
                self.function()
                return
            if v == "let" and after in ("I", "[", "{"):
                self.declaration()
                self.end()
                return
            if v in ("using", "await") and after == "I" and (v == "using" or self.v[self.i + 1] == "using" and self.k[self.i + 2] == "I") and not self.line[self.i + 1] and self.v[self.i + 1] not in ("of", "in"):
                self.i += v == "await"
                self.declaration()
                self.end()
                return
            if self.typed and self.typed_statement(v, after):
                return
        self.expression()
        self.end()

    def typed_statement(self, v: str, after: str) -> bool:
        if self.line[self.i + 1]:
            return False
        if v == "type" and after == "I" and self.k[self.i + 2] in ("=", "<"):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.end()
        elif v == "interface" and after == "I":
            self.i += 2
            self.type_parameters()
            if self.eat("extends"):
                self.types()
            self.object_type()
        elif v in ("namespace", "module") and after in ("I", "S") or v == "global" and after == "{":
            self.i += 1
            if self.k[self.i] == "S":
                self.i += 1
            while self.k[self.i] == "I":
                self.i += 1
                if not self.eat("."):
                    break
            if self.k[self.i] == "{":
                self.block()
            else:
                self.end()
        elif v == "declare" and (after in ("var", "const", "function", "class", "enum") or after == "I"):
            self.i += 1
            self.ambient += 1
            self.statement()
            self.ambient -= 1
        elif v == "abstract" and after == "class":
            self.i += 1
            self.class_()
        else:
            return False
        return True

    def empty(self) -> None:
        self.i += 1

    def declaration(self, loop: bool = False) -> None:
        constant = self.k[self.i] == "const"
        self.i += 1
        if constant and self.typed and self.k[self.i] == "enum":
            self.enum()
            return
        while True:
            pattern = self.k[self.i] != "I"
            self.binding()
            if self.typed:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment(not loop)
            elif not loop and (pattern or constant) and not self.ambient:
                raise self.fail("instead of a first value")
            if not self.eat(","):
                return

    def variables(self) -> None:
        enum = self.k[self.i] == "const" and self.k[self.i + 1] == "enum"
        self.declaration()
        if not enum:
            self.end()

    def binding(self) -> None:
        k = self.k[self.i]
        if k == "I" or k == "this" and self.typed:
            self.i += 1
        elif k == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
        elif k == "{":
            self.i += 1
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    short = self.k[self.i] == "I"
                    self.key()
                    if self.eat(":"):
                        self.binding()
                    elif not short:
                        raise self.fail("instead of :")
                    if self.eat("="):
                        self.assignment()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            raise self.fail("instead of a binding")

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.eat("else"):
            self.statement()

    def for_(self) -> None:
        self.i += 1
        self.eat_word("await")
        self.need("(")
        k = self.k[self.i]
        if k in ("var", "const") or k == "I" and self.v[self.i] in ("let", "using") and self.k[self.i + 1] in ("I", "[", "{") and self.v[self.i + 1] not in ("of", "in"):
            self.declaration(True)
        elif k != ";":
            self.expression(False)
        if self.eat("in"):
            self.expression()
        elif self.eat_word("of"):
            self.assignment()
        else:
            self.need(";")
            if self.k[self.i] != ";":
                self.expression()
            self.need(";")
            if self.k[self.i] != ")":
                self.expression()
        self.need(")")
        self.looped()

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.looped()

    def do(self) -> None:
        self.i += 1
        self.looped()
        self.need("while")
        self.condition()
        self.eat(";")

    def jump(self) -> None:
        k = self.k[self.i]
        self.i += 1
        named = self.k[self.i] == "I" and not self.line[self.i]
        if named:
            self.i += 1
        if not self.loops and not named and not self.typed:
            raise self.fail(f"{k} outside of a loop")
        self.end()

    def return_(self) -> None:
        if not self.functions and not self.typed:
            raise self.fail("return outside of a function")
        self.i += 1
        if self.k[self.i] not in (";", "}", "") and not self.line[self.i]:
            self.expression()
        self.end()

    def throw(self) -> None:
        self.i += 1
        if self.line[self.i]:
            raise self.fail("instead of what is thrown")
        self.expression()
        self.end()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = self.eat("catch")
        if caught:
            if self.eat("("):
                self.binding()
                if self.typed and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            raise self.fail("instead of catch")

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        self.loops += 1
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.k[self.i] not in ("case", "default", "}"):
                self.statement()
        self.loops -= 1

    def with_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def debugger(self) -> None:
        self.i += 1
        self.end()

    def import_(self) -> None:
        if self.k[self.i + 1] in ("(", "."):
            self.expression()
            self.end()
            return
        self.i += 1
        if self.k[self.i] != "S":
            if self.typed and self.word("type") and not (self.k[self.i + 1] == "I" and self.v[self.i + 1] == "from" and self.k[self.i + 2] == "S") and self.k[self.i + 1] in ("I", "{", "*"):
                self.i += 1
            if self.k[self.i] == "I":
                self.i += 1
                if self.typed and self.eat("="):
                    self.expression()
                    self.end()
                    return
                more = self.eat(",")
            else:
                more = True
            if more:
                if self.eat("*"):
                    if not self.eat_word("as"):
                        raise self.fail("instead of as")
                    self.name()
                else:
                    self.specifiers()
            if not self.eat_word("from"):
                raise self.fail("instead of from")
        self.need("S")
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if self.k[self.i] == "with" or self.word("assert") and not self.line[self.i]:
            self.i += 1
            if self.k[self.i] != "{":
                raise self.fail("instead of {")
            self.object()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.typed and self.word("type") and self.k[self.i + 1] not in (",", "}") and self.v[self.i + 1] != "as":
                self.i += 1
            if not self.eat("S"):
                self.any_name()
            if self.eat_word("as") and not self.eat("S"):
                self.any_name()
            if self.k[self.i] != "}":
                self.need(",")

    def export(self) -> None:
        self.i += 1
        k = self.k[self.i]
        if k == "default":
            self.i += 1
            if self.k[self.i] == "function" or self.word("async") and self.k[self.i + 1] == "function" and not self.line[self.i + 1]:
                self.eat_word("async")
                self.function(False)
            elif self.k[self.i] in ("class", "@"):
                self.decorated() if self.k[self.i] == "@" else self.class_(False)
            elif self.typed and self.word("abstract") and self.k[self.i + 1] == "class":
                self.i += 1
                self.class_(False)
            elif self.typed and self.word("interface"):
                self.statement()
            else:
                self.assignment()
                self.end()
        elif k == "*":
            self.i += 1
            if self.eat_word("as") and not self.eat("S"):
                self.any_name()
            if not self.eat_word("from"):
                raise self.fail("instead of from")
            self.need("S")
            self.attributes()
            self.end()
        elif k == "{" or self.typed and self.word("type") and self.k[self.i + 1] in ("{", "*"):
            if k != "{":
                self.i += 1
            if self.eat("*"):
                self.eat_word("as") and self.any_name()
            else:
                self.specifiers()
            if self.eat_word("from"):
                self.need("S")
                self.attributes()
            self.end()
        elif self.typed and k == "=":
            self.i += 1
            self.expression()
            self.end()
        elif self.typed and k == "import" or self.typed and self.word("as"):
            self.i += 1
            if k != "import":
                self.eat_word("namespace")
                self.name()
                self.end()
                return
            self.i -= 1
            self.import_()
        elif k in ("var", "const", "function", "class", "@") or k == "I" and self.v[self.i] in ("let", "async") or self.typed and k in ("I", "enum"):
            at = self.i
            self.statement()
            if k == "I" and self.v[at] == "async" and self.k[at + 1] != "function":
                raise self.fail("instead of function")
        else:
            raise self.fail("instead of what is exported")

    def enum(self) -> None:
        if not self.typed:
            raise self.fail()
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            self.key()
            if self.eat("="):
                self.assignment()
            if self.k[self.i] != "}":
                self.need(",")

    def decorated(self) -> None:
        self.decorators()
        if self.k[self.i] == "export":
            self.export()
        else:
            if self.typed:
                self.eat_word("abstract")
            self.class_()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.k[self.i] == "(":
                self.condition()
                continue
            self.name()
            while self.eat("."):
                self.any_name()
            if self.k[self.i] == "(":
                self.arguments()

    # -- functions and classes

    def function(self, named: bool = True, expression: bool = False) -> None:
        self.need("function")
        self.eat("*")
        if self.k[self.i] == "I":
            self.i += 1
        elif named and not expression:
            raise self.fail("instead of the function's name")
        self.signature()
        if self.typed and self.k[self.i] != "{" and not expression:
            self.end()
            return
        self.body()

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.typed and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.k[self.i] == "@":
                self.decorators()
            rest = self.eat("...")
            if self.typed:
                while self.k[self.i] == "I" and self.v[self.i] in ("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] in ("I", "{", "["):
                    self.i += 1
            self.binding()
            if self.typed:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            if self.k[self.i] != ")":
                if rest and not self.typed:
                    raise self.fail("after the rest parameter")
                self.need(",")

    def class_(self, named: bool = True, expression: bool = False) -> None:
        self.need("class")
        if self.k[self.i] == "I" and not (self.v[self.i] == "implements" and self.typed):
            self.i += 1
        elif named and not expression:
            raise self.fail("instead of the class's name")
        self.type_parameters()
        if self.eat("extends"):
            self.postfix()
            if self.typed and self.k[self.i] == "<":
                self.type_arguments()
        if self.typed and self.eat_word("implements"):
            self.types()
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        if self.k[self.i] == "@":
            self.decorators()
        modifiers = ("static", "async", "get", "set", "accessor", *(("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ()))
        while self.k[self.i] == "I" and self.v[self.i] in modifiers and self.k[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and not (
            self.line[self.i + 1] and self.v[self.i] not in ("static", "public", "private", "protected", "abstract")
        ):
            if self.v[self.i] == "static" and self.k[self.i + 1] == "{":
                self.i += 1
                self.body()
                return
            self.i += 1
        self.eat("*")
        if self.typed and self.k[self.i] == "[" and self.k[self.i + 1] == "I" and self.k[self.i + 2] == ":":
            self.index_signature()
            self.end()
            return
        self.key(True)
        if self.typed:
            self.eat("?") or self.eat("!")
        if self.k[self.i] in ("(", "<"):
            self.signature()
            if self.typed and self.k[self.i] != "{":
                self.end()
            else:
                self.body()
            return
        if self.typed and self.eat(":"):
            self.type()
        if self.eat("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.end()

    def key(self, private: bool = False) -> None:
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif k in ("S", "N") or private and k == "#":
            self.i += 1
        else:
            self.any_name()

    # -- expressions

    def expression(self, allow_in: bool = True) -> None:
        self.assignment(allow_in)
        while self.eat(","):
            self.assignment(allow_in)

    def assignment(self, allow_in: bool = True) -> None:
        while True:
            if self.arrow():
                return
            if self.word("yield") and self.functions and self.k[self.i + 1] not in ("=", ".", ":"):
                self.i += 1
                star = self.eat("*")
                if star or self.k[self.i] not in (")", "]", "}", ",", ";", "", ":", "}$", "in") and not self.line[self.i]:
                    self.assignment(allow_in)
                return
            target = self.binary(allow_in)
            k = self.k[self.i]
            if k in ASSIGN or k == ">" and self.typed and self.joined() in ASSIGN:
                if not target:
                    raise self.fail("assigns to what is no place")
                self.i += 1 if k != ">" else len(self.joined()) - 1
                continue
            if k == "?":
                self.i += 1
                if not (self.typed and self.k[self.i] == "(") or not self.attempt(self.chosen):
                    self.plain_arrows, before = self.typed, self.plain_arrows
                    self.chosen()
                    self.plain_arrows = before
                continue
            return

    def chosen(self) -> None:
        self.assignment()
        self.need(":")

    def joined(self) -> str:
        """The sign that a run of ``>`` in TypeScript stands for."""
        at, sign = self.i, ""
        while self.k[at] == ">" and len(sign) < 3:
            sign, at = sign + ">", at + 1
        return sign + (">=" if self.k[at] == ">=" else "")

    def binary(self, allow_in: bool) -> bool:
        """Operands and the operators between them; says whether it was one operand that may be assigned to."""
        target = self.unary()
        while True:
            k = self.k[self.i]
            if k in BINARY:
                if k == "in" and not allow_in:
                    return target
                self.i += 1
                if k == ">" and self.typed:
                    if self.k[self.i] == ">":
                        if self.joined() == ">>=":
                            self.i -= 1
                            return target
                        while self.k[self.i] == ">":
                            self.i += 1
                    elif self.k[self.i] == ">=":
                        self.i -= 1
                        return target
                target = False
                self.unary()
            elif self.typed and k == "I" and self.v[self.i] in ("as", "satisfies") and not self.line[self.i]:
                self.i += 1
                if not self.eat("const"):
                    self.type()
            else:
                return target

    def unary(self) -> bool:
        k, target = self.k[self.i], True
        while k in PREFIX or k == "I" and self.v[self.i] == "await" and self.k[self.i + 1] not in (")", "]", "}", ",", ";", "", "=", ".", ":", "=>", "?", "in", "+", "-", "*", "==", "===", "&&", "||") and not self.line[self.i + 1]:
            target = False
            self.i += 1
            k = self.k[self.i]
        if self.typed and k == "<":
            self.type_arguments()
            self.unary()
            return False
        if k == "#":
            self.i += 1
            if self.k[self.i] != "in":
                raise self.fail("instead of in")
            return False
        got = self.postfix()
        if self.k[self.i] in ("++", "--") and not self.line[self.i]:
            if not got:
                raise self.fail("changes what is no place")
            self.i += 1
            return False
        return got and target

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        at, k = self.i, self.k[self.i]
        if k == "I":
            if self.k[at + 1] == "=>":
                self.i += 2
            elif self.v[at] == "async" and not self.line[at + 1] and self.k[at + 1] in ("I", "(", "<"):
                self.i += 1
                if self.k[self.i] == "I" and self.k[self.i + 1] != "=>" or not self.arrow():
                    self.i = at
                    return False
                return True
            else:
                return False
        elif k == "(":
            after = self.pair[at] + 1
            if self.k[after] == "=>":
                self.parameters()
                self.i += 1
            elif self.typed and self.k[after] == ":" and not self.plain_arrows:
                if not self.attempt(self.typed_head):
                    return False
            else:
                return False
        elif k == "<" and self.typed:
            if not self.attempt(self.typed_head):
                return False
        else:
            return False
        if self.k[self.i] == "{":
            self.body()
        else:
            self.functions += 1
            self.assignment()
            self.functions -= 1
        return True

    def typed_head(self) -> None:
        self.signature()
        self.need("=>")

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if self.k[self.i] != ")":
                self.need(",")

    def template(self) -> None:
        while self.eat("${"):
            self.expression()
            self.need("}$")
        self.need("`")

    def postfix(self) -> bool:
        """An operand with what follows it; says whether it may be assigned to."""
        target = self.primary()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if not self.eat("#"):
                    self.any_name()
                target = True
            elif k == "?.":
                self.i += 1
                if self.k[self.i] == "(":
                    self.arguments()
                elif self.k[self.i] == "[":
                    self.i += 1
                    self.expression()
                    self.need("]")
                elif not self.eat("#"):
                    self.any_name()
                target = False
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                target = True
            elif k == "(":
                self.arguments()
                target = False
            elif k == "`" or k == "${":
                self.template()
                target = False
            elif self.typed and k == "!" and not self.line[self.i]:
                self.i += 1
            elif self.typed and k == "<" and self.attempt(self.called_with_types):
                target = False
            else:
                return target

    def called_with_types(self) -> None:
        self.type_arguments()
        if self.k[self.i] not in ("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "^", "|", "&", "}", "", "`", "${") and not self.line[self.i]:
            raise self.fail()

    def primary(self) -> bool:
        k = self.k[self.i]
        if k == "I":
            if self.v[self.i] == "async" and self.k[self.i + 1] == "function" and not self.line[self.i + 1]:
                self.i += 1
                self.function(expression=True)
                return False
            self.i += 1
            return True
        if k in ("N", "S", "R", "this", "null", "true", "false"):
            self.i += 1
            return False
        if k == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return True
        if k == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
            return True
        if k == "{":
            self.object()
            return True
        if k == "`" or k == "${":
            self.template()
            return False
        if k == "function":
            self.function(expression=True)
            return False
        if k == "class":
            self.class_(expression=True)
            return False
        if k == "@":
            self.decorators()
            self.class_(expression=True)
            return False
        if k == "new":
            self.i += 1
            if self.eat("."):
                self.any_name()
                return False
            self.new_target()
            if self.typed and self.k[self.i] == "<":
                self.attempt(self.type_arguments)
            if self.k[self.i] == "(":
                self.arguments()
            return False
        if k == "super":
            self.i += 1
            if self.k[self.i] not in ("(", ".", "["):
                raise self.fail("after super")
            return False
        if k == "import":
            self.i += 1
            if self.eat("."):
                self.any_name()
                return False
            if self.k[self.i] != "(":
                raise self.fail("after import")
            self.arguments()
            return False
        raise self.fail("instead of an operand")

    def new_target(self) -> None:
        if self.k[self.i] == "new":
            self.primary()
        else:
            self.primary()
        while True:
            if self.eat("."):
                if not self.eat("#"):
                    self.any_name()
            elif self.k[self.i] == "[":
                self.i += 1
                self.expression()
                self.need("]")
            else:
                return

    def object(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                self.property()
            if self.k[self.i] != "}":
                self.need(",")

    def property(self) -> None:
        k, after = self.k[self.i], self.k[self.i + 1]
        if k == "I" and after in (",", "}", "="):
            self.i += 1
            if self.eat("="):
                self.assignment()
            return
        while self.k[self.i] == "I" and self.v[self.i] in ("async", "get", "set") and self.k[self.i + 1] not in ("(", ":", ",", "}", "=", "<"):
            self.i += 1
        star = self.eat("*")
        self.key()
        if self.k[self.i] in ("(", "<"):
            self.signature()
            self.body()
        elif star:
            raise self.fail("instead of parameters")
        else:
            self.need(":")
            self.assignment()

    # -- types

    def type_parameters(self) -> None:
        if not self.typed or not self.eat("<"):
            return
        while True:
            while self.k[self.i] in ("const", "in") or self.word("out") and self.k[self.i + 1] == "I":
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.k[self.i] == ">":
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.types()
        self.need(">")

    def types(self) -> None:
        self.type()
        while self.eat(","):
            if self.k[self.i] in (">", "{"):
                return
            self.type()

    def return_type(self) -> None:
        if self.word("asserts") and self.k[self.i + 1] in ("I", "this") and not self.line[self.i + 1]:
            self.i += 2
            if self.eat_word("is"):
                self.type()
        elif self.k[self.i] in ("I", "this") and self.k[self.i + 1] == "I" and self.v[self.i + 1] == "is" and not self.line[self.i + 1]:
            self.i += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        k = self.k[self.i]
        if k == "new" or self.word("abstract") and self.k[self.i + 1] == "new":
            self.i += 1 + (k != "new")
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type()
            return
        if k == "<" or k == "(" and self.k[self.pair[self.i] + 1] == "=>":
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        self.union()
        if self.k[self.i] == "extends" and not self.line[self.i]:
            self.i += 1
            self.union()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()

    def union(self) -> None:
        if self.k[self.i] in ("|", "&"):
            self.i += 1
        while True:
            self.array_type()
            if self.k[self.i] not in ("|", "&"):
                return
            self.i += 1
            if self.k[self.i] in ("new", "<") or self.k[self.i] == "(" and self.k[self.pair[self.i] + 1] == "=>":
                self.type()
                return

    def array_type(self) -> None:
        while self.k[self.i] == "I" and self.v[self.i] in ("keyof", "unique", "readonly", "infer") and self.k[self.i + 1] not in (",", ">", ")", "]", "}", ";", "=", "|", "&", "", "[", ".", "<"):
            self.i += 1
        self.one_type()
        while self.k[self.i] == "[" and not self.line[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def one_type(self) -> None:
        k = self.k[self.i]
        if k in ("S", "N", "null", "true", "false", "this", "void"):
            self.i += 1
        elif k == "-":
            self.i += 1
            self.need("N")
        elif k == "I":
            self.i += 1
            while self.eat("."):
                self.any_name()
            if self.k[self.i] == "<" and not self.line[self.i]:
                self.type_arguments()
        elif k == "typeof":
            self.i += 1
            if self.k[self.i] == "import":
                self.one_type()
                return
            if not self.eat("this"):
                self.name()
            while self.eat("."):
                self.eat("#") or self.any_name()
            if self.k[self.i] == "<" and not self.line[self.i]:
                self.type_arguments()
        elif k == "import":
            self.i += 1
            self.need("(")
            self.type()
            if self.eat(","):
                self.object()
            self.need(")")
            while self.eat("."):
                self.any_name()
            if self.k[self.i] == "<":
                self.type_arguments()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.k[self.i] == "I" and (self.k[self.i + 1] == ":" or self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":"):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if self.k[self.i] != "]":
                    self.need(",")
        elif k == "{":
            self.object_type()
        elif k == "`" or k == "${":
            while self.eat("${"):
                self.type()
                self.need("}$")
            self.need("`")
        else:
            raise self.fail("instead of a type")

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        if self.eat(":"):
            self.type()

    def object_type(self) -> None:
        self.need("{")
        if self.k[self.i] in ("+", "-") or self.k[self.i] == "[" and self.k[self.i + 2] == "in" or self.word("readonly") and self.k[self.i + 1] == "[" and self.k[self.i + 3] == "in":
            self.mapped_type()
            return
        while not self.eat("}"):
            while self.k[self.i] == "I" and self.v[self.i] in ("readonly", "get", "set") and self.k[self.i + 1] not in ("(", ":", "?", ";", ",", "}", "<") and not self.line[self.i + 1]:
                self.i += 1
            if self.k[self.i] == "new" and self.k[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            elif self.k[self.i] in ("(", "<"):
                self.signature()
            elif self.k[self.i] == "[" and self.k[self.i + 1] == "I" and self.k[self.i + 2] == ":":
                self.index_signature()
            else:
                self.key()
                self.eat("?")
                if self.k[self.i] in ("(", "<"):
                    self.signature()
                elif self.eat(":"):
                    self.type()
            if self.k[self.i] == ",":
                self.i += 1
            else:
                self.end()

    def mapped_type(self) -> None:
        if self.k[self.i] in ("+", "-"):
            self.i += 1
        self.eat_word("readonly")
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.eat_word("as"):
            self.type()
        self.need("]")
        if self.k[self.i] in ("+", "-"):
            self.i += 1
        self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";") or self.eat(",")
        self.need("}")


_STATEMENTS = {
    "{": Script.block, ";": Script.empty, "var": Script.variables, "const": Script.variables, "function": Script.function, "class": Script.class_, "if": Script.if_, "for": Script.for_,
    "while": Script.while_, "do": Script.do, "break": Script.jump, "continue": Script.jump, "return": Script.return_, "throw": Script.throw, "try": Script.try_, "switch": Script.switch, "with": Script.with_,
    "debugger": Script.debugger, "import": Script.import_, "export": Script.export, "enum": Script.enum, "@": Script.decorated,
}


def javascript(text: str) -> None:
    Script(text, False).program()


def typescript(text: str) -> None:
    Script(text, True).program()
