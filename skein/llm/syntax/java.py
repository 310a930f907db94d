"""Java."""

from __future__ import annotations

import re

from skein.llm.syntax.base import Cursor, Reject

# The reserved words of Java.
WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVES = frozenset("boolean byte char short int long float double".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / %".split())
OPERAND = frozenset(["I", "N", "S", "C", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch", "void", *PRIMITIVES])

_TOKEN = re.compile(
    r"[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
    r'|"""[ \t\f]*(?:\r\n|[\r\n])(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[btnfrs0-7"\'\\]))*"|\'(?:[^\'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[btnfrs"\'\\]))\''
    r"|0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d[\d_]*)?[lLfFdD]?|0[bB][01][01_]*[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?"
    r"|[^\W\d][\w$]*|\$[\w$]*|>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,.<>=!~?:+\-*/&|^%@]|[\s\S]"
)
SIGNS = frozenset(">= ... -> :: ++ -- && || == != <= <<= << += -= *= /= %= &= |= ^= { } ( ) [ ] ; , . < > = ! ~ ? : + - * / & | ^ % @".split())


def kind_of(t: str) -> str:
    """The kind of a token; blank for what is skipped."""
    if t in SIGNS:
        return t
    c = t[0]
    if c.isspace() or c == "\x1a" or t.startswith(("//", "/*")):
        return ""
    if c == '"' and len(t) > 1:
        return "S"
    if c == "'" and len(t) > 2:
        return "C"
    if c.isdigit() or c == ".":
        return "N"
    if c.isalpha() or c in "_$":
        return t if t in WORDS else "I"
    raise Reject(f"character {t!r}")


def tokens(text: str) -> tuple[list[str], list[str]]:
    kinds, texts, known = [], [], {}
    for t in _TOKEN.findall(text):
        k = known.get(t)
        if k is None:
            k = known[t] = kind_of(t)
        if k:
            kinds.append(k)
            texts.append(t)
    return kinds, texts


class Java(Cursor):
    def __init__(self, text: str):
        super().__init__(*tokens(text.removeprefix("\ufeff")))
        self.classes = [""]

    # -- types, by look-ahead: each returns the index after, or -1

    def past_annotations(self, i: int) -> int:
        while self.k[i] == "@" and self.k[i + 1] == "I":
            i += 2
            while self.k[i] == "." and self.k[i + 1] == "I":
                i += 2
            if self.k[i] == "(":
                i = self.pair[i] + 1
        return i

    def past_arguments(self, i: int) -> int:
        """After type arguments that open at i."""
        i += 1
        if self.k[i] == ">":
            return i + 1
        while True:
            i = self.past_annotations(i)
            if self.k[i] == "?":
                i += 1
                if self.k[i] in ("extends", "super"):
                    i = self.past_type(i + 1)
            else:
                i = self.past_type(i)
            if i < 0:
                return -1
            if self.k[i] == ",":
                i += 1
            elif self.k[i] == ">":
                return i + 1
            else:
                return -1

    def past_type(self, i: int, arrays: bool = True) -> int:
        i = self.past_annotations(i)
        k = self.k[i]
        if k in PRIMITIVES:
            i += 1
        elif k == "I":
            while True:
                i += 1
                if self.k[i] == "<":
                    i = self.past_arguments(i)
                    if i < 0:
                        return -1
                if self.k[i] == "." and self.k[self.past_annotations(i + 1)] == "I":
                    i = self.past_annotations(i + 1)
                else:
                    break
        else:
            return -1
        while arrays:
            j = self.past_annotations(i)
            if self.k[j] == "[" and self.k[j + 1] == "]":
                i = j + 2
            else:
                break
        return i

    def type(self, arrays: bool = True) -> None:
        i = self.past_type(self.i, arrays)
        if i < 0:
            raise self.fail("instead of a type")
        self.i = i

    def types(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    # -- declarations

    def unit(self) -> None:
        at = self.i
        self.modifiers()
        if self.eat("package"):
            self.dotted()
            self.need(";")
        else:
            self.i = at
        while self.k[self.i] in ("import", ";"):
            if not self.eat(";"):
                self.i += 1
                self.eat("static")
                self.name()
                while self.eat("."):
                    if self.eat("*"):
                        break
                    self.name()
                self.need(";")
        if self.word("module") or self.word("open") and self.v[self.i + 1] == "module":
            self.module()
        while self.k[self.i]:
            if not self.eat(";"):
                self.modifiers()
                self.declared_type()

    def module(self) -> None:
        self.eat_word("open")
        self.i += 1
        self.dotted()
        self.need("{")
        while not self.eat("}"):
            while not self.eat(";"):
                self.need_in(("I", ".", ",", "static"))

    def name(self) -> None:
        self.need("I")

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def modifiers(self) -> None:
        while True:
            k = self.k[self.i]
            if k in MODIFIERS and not (k == "default" and self.k[self.i + 1] in (":", "->")):
                self.i += 1
            elif k == "@" and self.k[self.i + 1] == "I":
                self.annotation()
            elif k == "I" and (self.v[self.i] == "sealed" and self.k[self.i + 1] in ("class", "interface", "abstract", "public", "static", "private", "protected", "strictfp")):
                self.i += 1
            elif k == "I" and self.v[self.i] == "non" and self.k[self.i + 1] == "-" and self.v[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.dotted()
        if self.eat("("):
            if not self.eat(")"):
                while True:
                    if self.k[self.i] == "I" and self.k[self.i + 1] == "=":
                        self.i += 2
                    self.annotation_value()
                    if not self.eat(","):
                        break
                self.need(")")

    def annotation_value(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.eat("{"):
            while not self.eat("}"):
                self.annotation_value()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            self.expression()

    def begins_type(self) -> bool:
        k = self.k[self.i]
        if k in ("class", "interface", "enum") or k == "@" and self.k[self.i + 1] == "interface":
            return True
        return k == "I" and self.v[self.i] == "record" and self.k[self.i + 1] == "I" and self.k[self.i + 2] in ("(", "<")

    def declared_type(self) -> None:
        if not self.begins_type():
            raise self.fail("instead of a type declaration")
        kind = "@" if self.eat("@") else self.v[self.i]
        self.i += 1
        self.classes.append(self.v[self.i])
        self.name()
        if self.k[self.i] == "<":
            self.type_parameters()
        if kind == "record":
            self.parameters()
        if self.eat("extends"):
            self.types() if kind == "interface" else self.type()
        if self.eat("implements"):
            self.types()
        if self.eat_word("permits"):
            self.types()
        self.need("{")
        if kind == "enum":
            self.constants()
        while not self.eat("}"):
            self.member()
        self.classes.pop()

    def constants(self) -> None:
        while self.k[self.i] not in (";", "}"):
            while self.k[self.i] == "@":
                self.annotation()
            self.name()
            if self.k[self.i] == "(":
                self.arguments()
            if self.k[self.i] == "{":
                self.class_body()
            if self.k[self.i] not in (";", "}"):
                self.need(",")
        self.eat(";")

    def class_body(self) -> None:
        self.need("{")
        self.classes.append("")
        while not self.eat("}"):
            self.member()
        self.classes.pop()

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.i = self.past_annotations(self.i)
            self.name()
            if self.eat("extends"):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.modifiers()
            self.type()
            self.i = self.past_annotations(self.i)
            self.eat("...")
            if self.k[self.i] == "I" and self.k[self.i + 1] == ".":
                self.i += 2
            if not self.eat("this"):
                self.variable_name()
            self.dimensions()
            if self.k[self.i] != ")":
                self.need(",")
                if self.k[self.i] == ")":
                    raise self.fail("after a comma")

    def variable_name(self) -> None:
        if not self.eat("_"):
            self.name()

    def dimensions(self) -> None:
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            self.i += 2

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.k[self.i] == "{" or self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.eat("static")
            self.block()
            return
        self.modifiers()
        if self.begins_type():
            self.declared_type()
            return
        if self.k[self.i] == "<":
            self.type_parameters()
        if self.k[self.i] == "I" and self.k[self.i + 1] in ("(", "{"):
            if self.v[self.i] != self.classes[-1]:
                raise self.fail("is no constructor and has no type")
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        if not self.eat("void"):
            self.type()
        self.name()
        if self.k[self.i] == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.eat("default"):
                self.annotation_value()
            if not self.eat(";"):
                self.block()
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.types()

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.eat("="):
                self.initial()
            if not self.eat(","):
                return
            self.variable_name()

    def initial(self) -> None:
        if self.eat("{"):
            while not self.eat("}"):
                self.initial()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            self.expression()

    # -- statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement(True)

    def declares(self) -> bool:
        """Whether a local variable is declared here."""
        k = self.k[self.i]
        if k != "I" and k not in PRIMITIVES:
            return False
        i = self.past_type(self.i)
        return i > 0 and self.k[i] in ("I", "_") and self.k[i + 1] in ("=", ";", ",", ":", "[")

    def statement(self, declarations: bool = False) -> None:
        k = self.k[self.i]
        if k == "I" or k in PRIMITIVES:
            if k == "I" and self.k[self.i + 1] == ":":
                self.i += 2
                self.statement()
                return
            if declarations and self.declares():
                self.type()
                self.variable_name()
                self.declarators()
                self.need(";")
                return
            if k == "I" and self.v[self.i] == "yield" and self.k[self.i + 1] not in ("=", ".", "(", "[", "++", "--", "+=", "-="):
                self.i += 1
                self.expression()
                self.need(";")
                return
            if declarations and self.begins_type() or k == "I" and self.v[self.i] == "sealed":
                self.modifiers()
                self.declared_type()
                return
            self.effect()
            self.need(";")
            return
        rule = _STATEMENTS.get(k)
        if rule:
            self.i += 1
            rule(self)
        elif k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif declarations and (k in ("final", "abstract", "static", "strictfp", "class", "interface", "enum") or k == "@"):
            self.modifiers()
            if self.begins_type():
                self.declared_type()
            else:
                self.type()
                self.variable_name()
                self.declarators()
                self.need(";")
        else:
            self.effect()
            self.need(";")

    def effect(self) -> None:
        """An expression that may stand as a statement."""
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
        at = self.i
        self.modifiers()
        if self.i > at or self.declares():
            self.type()
            self.variable_name()
            if self.eat(":"):
                self.expression()
                self.need(")")
                self.statement()
                return
            self.declarators()
        elif self.k[self.i] != ";":
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

    def switch(self) -> None:
        self.condition()
        self.cases()

    def cases(self) -> None:
        self.need("{")
        while not self.eat("}"):
            while True:
                if self.eat("default"):
                    pass
                else:
                    self.need("case")
                    while True:
                        if not self.eat("default"):
                            self.label()
                        if not self.eat(","):
                            break
                    if self.eat_word("when"):
                        self.expression()
                if self.eat("->"):
                    k = self.k[self.i]
                    if k == "{":
                        self.block()
                    elif k == "throw":
                        self.statement()
                    else:
                        self.expression()
                        self.need(";")
                    break
                self.need(":")
                while self.k[self.i] not in ("case", "default", "}"):
                    self.statement(True)
                break

    def label(self) -> None:
        i = self.past_type(self.past_annotations(self.i + (self.k[self.i] == "final")))
        if i > 0 and (self.k[i] in ("I", "_") and self.v[i] != "when" or self.k[i] == "(" and self.k[self.pair[i] + 1] in ("->", ":", ",", "I") and self.k[self.i] == "I"):
            self.pattern()
        else:
            self.ternary()

    def pattern(self) -> None:
        self.modifiers()
        if self.eat("_"):
            return
        self.type()
        if self.eat("("):
            while not self.eat(")"):
                self.pattern()
                if self.k[self.i] != ")":
                    self.need(",")
            if self.k[self.i] == "I" and self.v[self.i] != "when":
                self.i += 1
        else:
            self.variable_name()

    def jump(self) -> None:
        self.eat("I")
        self.need(";")

    def return_(self) -> None:
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.expression()
        self.need(";")

    def try_(self) -> None:
        resources = self.eat("(")
        if resources:
            while True:
                at = self.i
                self.modifiers()
                if self.i > at or self.declares():
                    self.type()
                    self.variable_name()
                    self.need("=")
                self.expression()
                if not self.eat(";") or self.k[self.i] == ")":
                    break
            self.need(")")
        self.block()
        some = resources
        while self.eat("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.variable_name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not some:
            raise self.fail("instead of catch")

    def synchronized(self) -> None:
        self.condition()
        self.block()

    def assert_(self) -> None:
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    # -- expressions: each says whether it may stand as a statement

    def expression(self) -> bool:
        effect = self.ternary()
        while self.k[self.i] in ASSIGN or self.k[self.i] == ">" and self.shift_assigns():
            while self.k[self.i] == ">":
                self.i += 1
            self.i += 1
            self.ternary()
            effect = True
        return effect

    def shift_assigns(self) -> bool:
        return self.k[self.i + 1] == ">=" or self.k[self.i + 1] == ">" and self.k[self.i + 2] == ">="

    def ternary(self) -> bool:
        effect = self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            if not self.lambda_():
                self.ternary()
            return False
        return effect

    def lambda_(self) -> bool:
        i = self.i
        if self.k[i] in ("I", "_") and self.k[i + 1] == "->":
            self.i += 2
        elif self.k[i] == "(" and self.k[self.pair[i] + 1] == "->":
            if self.k[i + 1] in ("I", "_") and self.k[i + 2] in (",", ")") or self.k[i + 1] == ")":
                self.i += 1
                while not self.eat(")"):
                    self.variable_name()
                    if self.k[self.i] != ")":
                        self.need(",")
                        if self.k[self.i] == ")":
                            raise self.fail("after a comma")
            else:
                self.parameters()
            self.i += 1
        else:
            return False
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()
        return True

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
                self.unary()
            elif k == "instanceof":
                self.i += 1
                at = self.i
                self.modifiers()
                i = self.past_type(self.i)
                if i > 0 and (self.k[i] == "(" or self.k[i] == "I"):
                    self.i = at
                    self.pattern()
                else:
                    self.type()
            else:
                return effect
            effect = False

    def unary(self) -> bool:
        k = self.k[self.i]
        if k in ("++", "--"):
            self.i += 1
            self.unary()
            return True
        if k in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return False
        if k == "(":
            after = self.pair[self.i] + 1
            if self.k[after] == "->":
                self.lambda_()
                return False
            if self.cast(after):
                self.i = after
                if not self.lambda_():
                    self.unary()
                return False
        return self.postfix()

    def cast(self, after: int) -> bool:
        i = self.past_type(self.i + 1)
        primitive = self.k[self.past_annotations(self.i + 1)] in PRIMITIVES
        while i > 0 and self.k[i] == "&":
            i = self.past_type(i + 1)
        if i != after - 1:
            return False
        return self.k[after] in OPERAND or primitive and self.k[i - 1] != "]" and self.k[after] in ("+", "-", "++", "--")

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.expression()
            if self.k[self.i] != ")":
                self.need(",")
                if self.k[self.i] == ")":
                    raise self.fail("after a comma")

    def postfix(self) -> bool:
        effect = self.primary()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.k[self.i] == "<":
                    self.i = self.past_arguments(self.i)
                    if self.i < 0:
                        raise Reject("type arguments")
                if self.eat("new"):
                    self.creation()
                    effect = True
                    continue
                self.need_in(("I", "this", "class", "super"))
                effect = False
            elif k == "(":
                if self.k[self.i - 1] not in ("I", "this", "super"):
                    raise self.fail("after what cannot be called")
                self.arguments()
                effect = True
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                effect = False
            elif k in ("++", "--"):
                self.i += 1
                effect = True
            elif k == "::":
                self.i += 1
                if self.k[self.i] == "<":
                    self.i = self.past_arguments(self.i)
                self.need_in(("I", "new"))
                effect = False
            else:
                return effect

    def primary(self) -> bool:
        k = self.k[self.i]
        if k == "I":
            if self.k[self.i + 1] == "->":
                self.lambda_()
                return False
            if self.k[self.i + 1] in ("<", "[", "@"):
                i = self.past_type(self.i)
                if i > 0 and (self.k[i] == "::" or self.k[i - 1] == "]" and self.k[i] == "." and self.k[i + 1] == "class"):
                    self.i = i
                    return False
            self.i += 1
            return False
        if k in ("N", "S", "C", "true", "false", "null", "this", "super"):
            self.i += 1
            return False
        if k == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return False
        if k == "new":
            self.i += 1
            self.creation()
            return True
        if k == "switch":
            self.i += 1
            self.switch()
            return False
        if k in PRIMITIVES or k == "void":
            if k == "void":
                self.i += 1
            else:
                self.type()
            if self.k[self.i] not in (".", "::") or self.k[self.i + 1] not in ("class", "new"):
                raise self.fail("after a type")
            return False
        if k == "_" and self.k[self.i + 1] == "->":
            self.lambda_()
            return False
        raise self.fail("instead of an operand")

    def creation(self) -> None:
        if self.k[self.i] == "<":
            self.i = self.past_arguments(self.i)
        self.type(False)
        if self.k[self.i] == "(":
            self.arguments()
            if self.k[self.i] == "{":
                self.class_body()
            return
        if self.k[self.i] != "[":
            raise self.fail("after new")
        sized = False
        while self.k[self.i] == "[":
            if self.k[self.i + 1] == "]":
                self.i += 2
            elif self.k[self.i - 1] == "]" and not sized:
                raise self.fail("a size after an open dimension")
            else:
                sized = True
                self.i += 1
                self.expression()
                self.need("]")
        if self.k[self.i] == "{":
            if sized:
                raise self.fail("a size and values")
            self.initial()
        elif not sized:
            raise self.fail("neither size nor values")


_STATEMENTS = {
    "if": Java.if_, "while": Java.while_, "do": Java.do, "for": Java.for_, "switch": Java.switch, "break": Java.jump, "continue": Java.jump, "return": Java.return_, "throw": Java.throw,
    "try": Java.try_, "synchronized": Java.synchronized, "assert": Java.assert_,
}


def java(text: str) -> None:
    Java(text).unit()
