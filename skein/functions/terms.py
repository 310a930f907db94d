"""Stems and numeric ids of tokens, vectorised over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWEL, _DOUBLE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# The exceptions and suffix lists of the published English stemming algorithm (Porter2).
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _region(word: str) -> int:
    m = re.search(f"[{_VOWEL}][^{_VOWEL}]", word)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$", word)) or bool(re.fullmatch(rf"[{_VOWEL}][^{_VOWEL}]", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The English stem of a lower-case word (Porter2)."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(rf"(^y|(?<=[{_VOWEL}])y)", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w) if r1 is None else r1
    r2 = r1 + _region(w[r1:])
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + "ee"
            break
    else:
        for suffix in ("ingly", "edly", "ing", "ed"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if re.search(f"[{_VOWEL}]", base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif _short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for suffix, other in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + other
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l" or w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
            w = w[:-1] if w.endswith("ogi") else w[:-2]
    for suffix, other in _STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + other
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in "st":
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, 32 bits, as an unsigned number."""
    mask = 0xFFFFFFFF
    h = seed
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(data) > whole:
        k = int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


@lru_cache(maxsize=200_000)
def token_number(token: str) -> int:
    """The absolute value of the signed hash; the one value without a positive counterpart becomes 2**31."""
    h = murmur3(token.encode())
    return h if h < 2**31 else 2**32 - h


@F.pandas_udf(T.StringType())
def stem_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem, na_action="ignore")


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems_udf(tokens: pa.Array) -> pa.Array:
    """The stems of arrays of tokens; every distinct token of a batch is stemmed once."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    sizes = tokens.value_lengths().fill_null(0).to_numpy()
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], type=pa.string()).take(words.indices)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stems, mask=tokens.is_null())


@F.pandas_udf(T.LongType())
def token_id_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(token_number, na_action="ignore")
