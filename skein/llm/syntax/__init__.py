"""Grammars of the languages that files are checked against."""

from __future__ import annotations

import re
import sys
from collections import Counter

from skein.llm.syntax import csharp, data, golang, java, script, yaml12
from skein.llm.syntax.base import Reject

GRAMMARS = {
    "python": data.python, "json": data.json_, "xml": data.xml, "toml": data.toml, "yaml": yaml12.yaml, "typescript": script.typescript, "javascript": script.javascript,
    "go": golang.go, "java": java.java, "csharp": csharp.csharp,
}

# Other spellings of the languages' names.
ALIASES = {"py": "python", "python3": "python", "yml": "yaml", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "golang": "go", "c#": "csharp", "cs": "csharp"}

# Tokens that tell languages apart, with their weights.
TELLING = {
    "python": {"def": 3, "self": 2, "elif": 3, "None": 3, "import": 1, "from": 1, "lambda": 2, "True": 2, "False": 2, "pass": 1, "except": 2, ":": 0.2},
    "json": {'"': 0.3, ":": 0.3, "{": 0.2, "}": 0.2, ",": 0.1},
    "xml": {"<": 1.5, ">": 1.2, "xml": 3, "xmlns": 3},
    "toml": {"[": 0.6, "]": 0.6, "=": 0.7},
    "yaml": {"-": 0.6, ":": 0.6},
    "typescript": {"export": 2, "import": 1, "const": 1.5, "unknown": 2, "interface": 1, "readonly": 2, "string": 1, "number": 1, "=>": 1, "let": 1, "await": 1},
    "javascript": {"require": 3, "function": 3, "const": 1.5, "module": 2, "=>": 1, "var": 1, "let": 1, "await": 1, "console": 1},
    "go": {"func": 4, "package": 2, ":=": 3, "nil": 3, "range": 2, "err": 1, "chan": 3, "defer": 2},
    "java": {"public": 1.5, "package": 1, "import": 1, "Object": 2, "String": 2, "final": 1, "extends": 1, "class": 1, "void": 1, ";": 0.2},
    "csharp": {"using": 3, "namespace": 4, "public": 1.5, "sealed": 2, "foreach": 3, "string": 1, "object": 2, "class": 1, "var": 0.5, ";": 0.2},
}
_KEYS = re.compile(r"^\s*(?:- |[\w\"'.-]+\s*:(?:\s|$))", re.M)
#: Calls within each other that a grammar may make; they live on the heap, some 100 bytes each, and only while a text nests so deep.
FRAMES = 4_000_000
_TOKENS = re.compile(r":=|=>|\w+|[^\w\s]")


def language_name(language: str | None) -> str:
    """The grammar's name of a language; the language in lower case where there is no grammar."""
    name = (language or "").strip().lower()
    return ALIASES.get(name, name)


def accepts(language: str, text: str) -> bool:
    """Whether the text as a whole file is a sentence of the language, however deep it nests (up to some 400,000 levels, beyond that it is none)."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, FRAMES))
    try:
        GRAMMARS[language](text)
    except (Reject, RecursionError):
        return False
    finally:
        sys.setrecursionlimit(limit)
    return True


def ranked_languages(text: str) -> list[str]:
    """All languages with a grammar, the one whose telling tokens weigh most first."""
    counts = Counter(_TOKENS.findall(text))
    total = sum(counts.values()) or 1
    score = {name: sum(weight * counts[token] for token, weight in telling.items()) / total for name, telling in TELLING.items()}
    return sorted(score, key=lambda name: (-score[name], name))


def judge(language: str, text: str) -> tuple[bool | None, str | None]:
    """(whether the text is a sentence of the language, null without a grammar; the first of all grammars that accepts it, None if none does).

    Grammars are tried in the order that the tokens suggest; those behind the first that accepts cannot change the
    result and are left out, but for the language's own. Almost any prose is a YAML scalar and an empty text a sentence of several
    languages, so foreign YAML counts only if it has keys or items, and texts without a token have no foreign language.
    """
    own, first = None, None
    blank = not text.strip()
    for name in [language] * (language in GRAMMARS) if blank else ranked_languages(text):
        if name != language and (first or name == "yaml" and not _KEYS.search(text)):
            continue
        good = accepts(name, text)
        if name == language:
            own = good
        if good and not first:
            first = name
        if first and (own is not None or language not in GRAMMARS):
            break
    return own, first
