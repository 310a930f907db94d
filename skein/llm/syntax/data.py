"""Python and data formats, by the parsers that come with Python."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from xml.parsers import expat

from skein.llm.syntax.base import Reject


def _constant(name: str) -> None:
    raise Reject(f"{name} is no JSON")


def json_(text: str) -> None:
    """RFC 8259: no comments, no NaN, nothing after the value; numbers of any length, nesting of any depth."""
    text = text.removeprefix("\ufeff")
    try:
        json.loads(text, parse_constant=_constant, parse_int=str, parse_float=str)
    except ValueError as e:
        raise Reject(str(e)) from None
    except RecursionError:
        deep_json(text)


_JSON = re.compile(r'[ \t\n\r]*(?:(?P<value>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<sign>[{}\[\],:]))')


def deep_json(text: str) -> None:
    """The same with a stack of its own. ``wait``: what may come next, v a value, k a key, c a colon, a comma or the end of the innermost."""
    stack, wait, at, n = [], "v", 0, len(text.rstrip(" \t\n\r"))
    fresh = False  # the innermost bracket was opened just now and may close
    while at < n:
        m = _JSON.match(text, at)
        if not m:
            raise Reject(f"character {at}")
        at, sign = m.end(), m["sign"]
        if wait == "k" and sign is None and m["value"][0] == '"':
            wait, fresh = "c", False
        elif wait == "c" and sign == ":":
            wait = "v"
        elif wait == "v" and (sign is None or sign in "[{"):
            if sign is None:
                wait, fresh = ",", False
            else:
                stack.append("]" if sign == "[" else "}")
                wait, fresh = "v" if sign == "[" else "k", True
        elif sign is not None and stack and sign == stack[-1] and (wait == "," or fresh):
            stack.pop()
            wait, fresh = ",", False
        elif wait == "," and sign == "," and stack:
            wait = "v" if stack[-1] == "]" else "k"
        else:
            raise Reject(f"character {at}")
    if stack or wait != ",":
        raise Reject("unfinished")


_KEPT = re.compile("[\ud800-\udfff]")


def xml(text: str) -> None:
    """XML 1.0 well-formedness, whatever encoding the declaration names (the text is decoded already)."""
    try:
        expat.ParserCreate("utf-8").Parse(_KEPT.sub("\ufffe", text.removeprefix("\ufeff")).encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        raise Reject(str(e)) from None


def toml(text: str) -> None:
    try:
        tomllib.loads(text.removeprefix("\ufeff"))
    except ValueError as e:
        raise Reject(str(e)) from None


def python(text: str) -> None:
    """What CPython parses, with its own limit of nesting (200 brackets); a tree too deep to be built has been parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("\ufeff"))
    except RecursionError:
        pass
    except (SyntaxError, ValueError, MemoryError) as e:
        raise Reject(str(e)) from None
