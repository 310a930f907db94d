"""What the grammars share: rejection, token cursors, bracket matching."""

from __future__ import annotations


class Reject(Exception):
    """The text is not a sentence of the grammar."""


OPEN = {"(": ")", "[": "]", "{": "}", "${": "}$"}
CLOSE = frozenset(OPEN.values())


def partners(kinds: list[str]) -> list[int]:
    """For every opening bracket the index of its partner; rejects what does not pair up."""
    found, stack = [0] * len(kinds), []
    for i, k in enumerate(kinds):
        if k in OPEN:
            stack.append(i)
        elif k in CLOSE:
            if not stack or OPEN[kinds[stack[-1]]] != k:
                raise Reject(f"unpaired {k}")
            found[stack.pop()] = i
    if stack:
        raise Reject(f"{kinds[stack[-1]]} never closed")
    return found


class Cursor:
    """A position in a token list. ``k``: kinds ("I" names, "N" numbers, "S" strings, keywords and signs themselves); ``v``: texts."""

    def __init__(self, kinds: list[str], texts: list[str]):
        self.pair = partners(kinds)
        self.k, self.v, self.i = [*kinds, "", "", "", ""], [*texts, "", "", "", ""], 0

    def fail(self, what: str = "") -> Reject:
        return Reject(f"token {self.i} {self.v[self.i]!r} {what}")

    def eat(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise self.fail(f"instead of {kind}")
        self.i += 1

    def need_in(self, kinds) -> None:
        if self.k[self.i] not in kinds:
            raise self.fail()
        self.i += 1

    def word(self, text: str) -> bool:
        """Whether the token is this name (of a word that is a keyword in some places only)."""
        return self.k[self.i] == "I" and self.v[self.i] == text

    def eat_word(self, text: str) -> bool:
        if self.k[self.i] == "I" and self.v[self.i] == text:
            self.i += 1
            return True
        return False

    def attempt(self, rule, *args) -> bool:
        """Runs a rule; if it rejects, steps back and says so."""
        at = self.i
        try:
            # spelled out, as calls with unpacked arguments would take the interpreter's own stack, which is short
            rule() if not args else rule(args[0]) if len(args) == 1 else rule(*args)
        except Reject:
            self.i = at
            return False
        return True
