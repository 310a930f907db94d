"""Generated, minified or vendored source files, and data blobs saved as code.

Each file becomes a token sequence, and a Re-Pair grammar is inferred over it: round by round, every pair of symbols that
is locally the most frequent of its file is replaced by a rule, until no pair repeats. How little of the sequence is
left tells how much its rules are reused; what cannot be compressed and stands in literals is data; and rules that
files of several repositories share are copied code. As a rule needs a repetition within its file, content-defined
segments of the sequence are compared between repositories as well. Marks that tools leave in comments, file names and folders are read
as further evidence. Whole batches of files are worked on as flat numpy arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.distinctive import SLICE, _powers, mix64
from skein.operators.incremental import clean_path
from skein.session import cut, spread

#: Rules that stand for at least so many tokens are compared between repositories.
LONG_RULE = 32
#: A file is machine-made if its grammar is smaller than this part of its tokens.
REUSE, REUSE_TOKENS = 0.13, 250
#: A file is a blob if this part of its visible characters is literal data, and there are so many of them.
DATA_SHARE, DATA_CHARS = 0.72, 1_200
#: A file is also a blob if literals are the same part of it and this part of their grammar is left when their characters are in order (see noise).
#: Random letters or digits gave 0.963 and more, shuffled words 0.952 and less, prose 0.908 and less, from NOISE_CHARS characters on.
NOISE, NOISE_CHARS = 0.957, 600
#: A file is minified if its lines are this long on average and this part of it is blank.
LINE, BLANK = 180, 0.1
#: A file is a copy if shared rules and segments together cover this part of its tokens.
SHARED = 0.5

# Folders that package managers and developers keep other projects' code in.
VENDOR_FOLDERS = (
    "node_modules bower_components jspm_packages site-packages dist-packages third_party third-party thirdparty 3rdparty vendor _vendor vendored "
    "pods carthage godeps _workspace extern external externals subprojects"
).split()
# Files that package managers write.
LOCK_FILES = (
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock cargo.lock gemfile.lock poetry.lock pipfile.lock uv.lock go.sum packages.lock.json podfile.lock mix.lock flake.lock gradle.lockfile"
).split()

_GENERATED_NAME = re.compile(r"(_pb2(_grpc)?\.pyi?|\.pb(\.gw)?\.(go|cc|h|js)|\.pb\.\w+|_pb\.(js|ts)|\.g\.(cs|dart|ts|js)|\.designer\.cs|\.generated\.\w+|\.gen\.\w+|_generated\.\w+|(^|/)__generated__/.*|(^|/)zz_generated[^/]*)$", re.I)
_MINIFIED_NAME = re.compile(r"[.\-](min|bundle)\.(js|css|mjs|cjs|ts)$", re.I)
_VERSIONED_FOLDER = re.compile(r"(^|/)[a-z][\w\-]*[@.\-]v?\d+\.\d+(\.\d+)?(/|$)", re.I)
_VENDOR = re.compile(r"(^|/)(" + "|".join(map(re.escape, VENDOR_FOLDERS)) + r")/", re.I)

_COMMENT = re.compile(r"^\s*(?://+!?|#+!?(?!include|define|if|endif|pragma)|/\*+!?|\*+(?!/)|<!--|--|;+|%+)[ \t]?(.*?)\s*(?:\*/|-->)?\s*$")
_MADE = re.compile(
    r"<auto-?generated|@generated\b|^\W*(?:this (?:file|code|source) (?:was|is|has been) )?(?:automatically |auto-?|machine[ -])?(?:generated|created|emitted|produced|derived)\b(?=.*\b(?:by|from|on build|see|using|with)\b)"
    r"|^\W*(?:auto|machine|code)[ -]?generated\b|^\W*generated (?:source|code|file|on|at|by|from|using|with)\b|^\W*code generated\b|^\W*(?:this (?:file|code)) (?:was|is) (?:automatically|auto-?|machine)"
    r"|^\W*this (?:file|code) (?:was|is) (?:generated|emitted|produced|created) by\b|^\W*do not (?:edit|modify|change) this file\b|\bmanual edits (?:are|will be) (?:overwritten|lost)|\bchanges will be lost\b|\bdo not (?:edit|modify) by hand\b"
    r"|\bregenerate with\b.*\binstead of\b|\bis derived from\b.*\bby\b|^\W*output of:? \S+ --?\w"
    r"|^\W*(?:diese datei (?:wurde|ist) )?(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|^\W*(?:(?:ce )?fichier )?(?:a été |est )?(?:g[ée]n[ée]r[ée]|produit|cr[ée][ée])(?: automatiquement)? (?:automatiquement|par)\b"
    r"|^\W*(?:(?:este )?(?:archivo|fichero) )?(?:fue |es )?(?:generado|producido|creado)(?: autom[áa]ticamente)? (?:autom[áa]ticamente|por)\b|^\W*auto-?generated\b.*\brun\b",
    re.I,
)
_FOREIGN = re.compile(
    r"@licen[cs]e\s+[\w.\-]+\s+v?\d+\.\d+|^\W*[\w.\-]+\s+v?\d+\.\d+(?:\.\d+)?\b.*(?:\(c\)|©|copyright|licen[cs]e|copied|verbatim|contributors)|\bcopied verbatim\b|\b(?:bundled|vendored) (?:third[- ]party|copy|from)\b|\bthird[- ]party source\b"
    r"|^\W*(?:part|portions) of [\w.\-]+, release\b.*\bcopyright\b|\bimported from \S+ ?@ ?v?\d|\b(?:taken|copied|imported|vendored) from (?:upstream|https?://)|\bkeep in sync with upstream\b|^\W*[\w.\-]+ v\d+\.\d+(?:\.\d+)?\s*$"
    r"|^\W*(?:jquery|bootstrap|react|vue|angular|lodash|underscore|moment|d3|three)(?:\.js)? v?\d",
    re.I,
)
_SOURCE_MAP = re.compile(r"^[ \t]*/[/*][#@] ?sourceMappingURL=", re.M)
# numbers in lists, long runs of encoded bytes, escapes, dates
_DATA = re.compile(
    r"[A-Za-z0-9+/=_\-]{32,}|(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[lLfFuUdD]?(?=\s*[,;|\]\)\}\t\n\r])[ \t]*[,;|\t]?|\b\d{4}-\d\d-\d\d\b|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"
)
_ROW = re.compile(r"^[^\n;|\t(){}]*(?:[;|\t][^\n;|\t(){}]*){3,}$", re.M)
# comments; else strings with their quotes, and numbers, each with the sign that divides it from the next
_LITERAL = re.compile(
    r"//[^\n]*|/\*.*?\*/|#[^\n]*|(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3}|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`|(?<![\w.])([-+]?\d[\w.]*))[ \t]*[,;:|+]?", re.S
)
# lines that say or do something: neither data, nor brackets and quotes alone, nor comments
_SAYS = re.compile(r"^(?!\s*(?://|#|/\*|\*))(?=.*[A-Za-z_]{2}).*$", re.M)
_IMPORTS = re.compile(r"^\s*(?:import\b|from\s+\S+\s+import\b|using\s+\w|#include\b|package\s+\w+\.|.*\brequire\s*\()", re.M)
# Suffixes of files that are data by their kind.
_DATA_FILES = re.compile(r"\.(json|ya?ml|xml|toml|properties|md|txt|csv|tsv|svg|html?|ini|cfg|lock)$", re.I)


def is_data(path: str, text: str, visible: int) -> bool:
    """Whether a code file is nothing but literal data: no imports, at most three lines that are not data."""
    if visible < DATA_CHARS or _DATA_FILES.search(path) or _IMPORTS.search(text):
        return False
    rest = _DATA.sub("", _ROW.sub("", text))
    if len(rest) - sum(map(rest.count, " \t\r\n")) > (1 - DATA_SHARE) * visible:
        return False
    return len(_SAYS.findall(rest)) <= 3


def literals(path: str, text: str) -> str:
    """The contents of a code file's strings and numbers one after another, if they are DATA_SHARE of it, NOISE_CHARS or more, and it imports nothing; else empty."""
    visible = len(text) - sum(map(text.count, " \t\r\n"))
    if visible < DATA_CHARS or _DATA_FILES.search(path) or _IMPORTS.search(text):
        return ""
    found, size = [], 0
    for m in _LITERAL.finditer(text):
        if m.lastindex:
            found.append(m[m.lastindex])
            size += len(m[0]) - sum(map(m[0].count, " \t\r\n"))
    out = "".join("".join(found).split())
    return out if size >= DATA_SHARE * visible and len(out) >= NOISE_CHARS else ""


def noise(texts: list[str]) -> np.ndarray:
    """The size of each text's Re-Pair grammar over its characters, as a part of what it is with the characters shuffled; 0 for no text.

    Letters that follow each other at random stay at about 1, words and regular tables do not.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    count = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(points)) - (np.cumsum(count) - count)[owner]
    symbols = mix64(points + np.uint64(1))
    mixed = symbols[np.lexsort((mix64(place.astype(np.uint64) + np.uint64(9)), owner))]
    size, most = (grammars(x, owner, len(texts))[1] for x in (symbols, mixed))
    return np.where(most > 0, size / np.maximum(most, 1), 0)


def head_comments(text: str) -> list[str]:
    """The text of the comments before the first code."""
    found, seen, at, inside = [], 0, 0, False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].rstrip("\r")
        at = end + 1
        if not line.strip():
            continue
        seen += 1
        if inside:
            body = line.split("*/")[0].strip().lstrip("*").strip()
            inside = "*/" not in line
        else:
            m = _COMMENT.match(line)
            if not m:
                if seen == 1 and line.startswith(("#!", "<?xml", "\ufeff")):
                    continue
                break
            body = m[1]
            inside = line.lstrip().startswith("/*") and "*/" not in line
        if body:
            found.append(body)
    return found


def evidence(path: str, text: str) -> list[str]:
    """What name, folder, opening comments and layout say: of generated, vendored, minified, blob."""
    p = (path or "").replace("\\", "/")
    p = p[2:] if p.startswith("./") else p
    name = p.rpartition("/")[2].lower()
    found = []
    comments = head_comments(text)
    if name in LOCK_FILES or _GENERATED_NAME.search(p) or any(_MADE.search(c) for c in comments):
        found.append("generated")
    if _VENDOR.search(p) or _VERSIONED_FOLDER.search(p.rpartition("/")[0] + "/") or any(_FOREIGN.search(c) for c in comments):
        found.append("vendored")
    visible = len(text) - sum(map(text.count, " \t\r\n"))
    lines = text.count("\n") + 1
    dense = len(text) >= 300 and len(text) / lines >= LINE and 1 - visible / len(text) <= BLANK
    code = dense and text.count("{") + text.count("(") >= len(text) / 120
    if _MINIFIED_NAME.search(p) or _SOURCE_MAP.search(text) or code:
        found.append("minified")
    if "minified" not in found and is_data(p, text, visible):
        found.append("data")
    return found


def code_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, file): runs of letters, runs of digits in words (all alike), and single other characters.

    Blanks are left out, and so are numbers and the commas between them: a table is no repeated code.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.full(len(points), 3, dtype=np.int8)
    lower = points | np.uint32(32)
    kind[((lower >= 97) & (lower <= 122)) | (points == 95) | (points == 36) | (points > 191)] = 1
    kind[(points >= 48) & (points <= 57)] = 2
    kind[(points <= 32) | (points == 0xA0)] = 0
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 3)]))
    end = np.append(start[1:], len(points))
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    number = kind[start] == 2
    if len(start) > 1:
        number[1:] &= (end[:-1] != start[1:]) | (kind[start[:-1]] != 1)
        comma = points[start] == 44
        comma[1:] &= number[:-1]
        comma[0] = False
        keep = ~(number | comma)
        start, end = start[keep], end[keep]
    up, down = _powers(1 << int(len(points)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])])
    symbols = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    symbols[kind[start] == 2] = np.uint64(7)
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return symbols, np.searchsorted(bounds, start, side="right")


def segments(symbols: np.ndarray, owner: np.ndarray, files: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(file, name, start, tokens) of the segments that each file's sequence falls into.

    A segment begins where the hash of the next four tokens is the least of LONG_RULE - 1 places on either side, so that equal
    code is cut alike wherever it stands. Segments have LONG_RULE tokens or more, files of fewer none.
    """
    count = np.bincount(owner, minlength=files)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n, reach = len(symbols), LONG_RULE - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    gram = symbols.copy()
    for k in (1, 2, 3):
        gram[:-k] = mix64(gram[:-k] * np.uint64(0x9E3779B97F4A7C15) + symbols[k:])
    place = np.arange(n) - first[owner]
    left = count[owner] - place
    gram[left < 4] = most
    # files lie LONG_RULE - 1 places apart: no window sees another file
    at = np.arange(n) + reach * (owner + 1)
    wide = np.full(n + reach * (files + 2), most)
    wide[at] = gram
    least = wide
    span = 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    cuts = (gram < least[at - reach]) & (gram <= least[at + 1]) & (place >= LONG_RULE) & (left >= LONG_RULE)
    cuts |= (place == 0) & (left >= LONG_RULE)
    start = np.flatnonzero(cuts)
    file = owner[start]
    end = np.append(start[1:], n)
    end = np.minimum(end, (first + count)[file])
    up, down = _powers(1 << int(n).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((mix64(symbols) | np.uint64(1)) * up[:n])])
    return file, mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), place[start], end - start


def grammars(symbols: np.ndarray, owner: np.ndarray, files: int, places: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(tokens, grammar size, (file, rule, covered)) of each file's Re-Pair grammar.

    A round replaces, file by file, every pair that occurs at least twice and more often than the pairs it overlaps
    with (ties by the pair's hash); rules are named by what they stand for. The grammar's size is what is left of the
    sequence plus two for every rule. The rules listed stand for at least LONG_RULE tokens; ``covered`` is how many
    tokens of the file they stand for together. With ``places`` every use of such a rule is listed instead: (file, rule, start, tokens).
    """
    tokens = np.bincount(owner, minlength=files)
    size = np.zeros(files, np.int64)
    long_file, long_rule, long_cover, long_start = [], [], [], []
    start = np.arange(len(symbols)) - (np.cumsum(tokens) - tokens)[owner]
    span = np.ones(len(symbols), np.int64)
    while len(symbols) > 1:
        name = mix64(symbols[:-1] * np.uint64(0x9E3779B97F4A7C15) + (symbols[1:] ^ (symbols[1:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
        same = owner[:-1] == owner[1:]
        key = name ^ mix64(owner[:-1].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        sorted_key = key[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        sizes = np.diff(np.append(edge, len(key)))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(sizes, sizes)
        good = same & (count > 1)
        if not good.any():
            break
        rank = np.where(good, (count.astype(np.uint64) << np.uint64(40)) | (name >> np.uint64(24)), np.uint64(0))
        left = np.concatenate([[np.uint64(0)], rank[:-1]])
        right = np.concatenate([rank[1:], [np.uint64(0)]])
        hit = np.flatnonzero(good & (rank >= left) & (rank >= right))
        first = np.append(True, np.diff(hit) != 1)
        run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        used, at, times = np.unique(key[hit], return_index=True, return_counts=True)
        single = times == 1  # an overlap took the others: no rule
        if single.any():
            hit = hit[~np.isin(key[hit], used[single])]
            used, at, times = np.unique(key[hit], return_index=True, return_counts=True)
            if not len(hit):
                break
        rules = hit[at]
        np.add.at(size, owner[rules], 2)
        whole = span[rules] + span[rules + 1]
        long = whole >= LONG_RULE
        if places:
            uses = hit[span[hit] + span[hit + 1] >= LONG_RULE]
            long_file.append(owner[uses])
            long_rule.append(name[uses])
            long_cover.append(span[uses] + span[uses + 1])
            long_start.append(start[uses])
        else:
            long_file.append(owner[rules[long]])
            long_rule.append(name[rules[long]])
            long_cover.append((whole * times)[long])
        symbols[hit] = name[hit]
        span[hit] += span[hit + 1]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, owner, span, start = symbols[keep], owner[keep], span[keep], start[keep]
    size += np.bincount(owner, minlength=files)
    none = np.zeros(0, np.int64)
    found = (np.concatenate([none, *long_file]), np.concatenate([none.view(np.uint64), *long_rule]), np.concatenate([none, *long_cover]))
    return tokens, size, (*found[:2], np.concatenate([none, *long_start]), found[2]) if places else found


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= SLICE:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def file_grammars(files: DataFrame) -> DataFrame:
    """record_id, collection, tokens, grammar (its size), noise (of its literals), evidence array<string>, rules array<(rule, start, span)> of every row: uses of rules, and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in _slices(texts):
                part = texts[a:b]
                symbols, owner = code_tokens(part)
                whole = segments(symbols, owner, b - a)
                tokens, size, uses = grammars(symbols, owner, b - a, places=True)
                random = noise([literals(p or "", t) for p, t in zip(paths[a:b], part)])
                at, rule, start, span = map(np.concatenate, zip(whole, uses))
                order = np.argsort(at, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=b - a))]).astype(np.int32)
                rules = pa.StructArray.from_arrays([pa.array(rule[order].view(np.int64)), pa.array(start[order].astype(np.int32)), pa.array(span[order].astype(np.int32))], names=["rule", "start", "span"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(tokens), pa.array(size), pa.array(random), pa.array([evidence(p, t) for p, t in zip(paths[a:b], part)], type=pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), rules)],
                    names=["record_id", "collection", "tokens", "grammar", "noise", "evidence", "rules"],
                )

    rows = files.where(F.col("content").isNotNull()).select("record_id", "collection", clean_path(F.col("rel_path")).alias("path"), "content")
    kind = files.schema["record_id"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"record_id {kind}, collection string, tokens bigint, grammar bigint, noise double, evidence array<string>, rules array<struct<rule bigint, start int, span int>>")


def classify_files(files: DataFrame) -> DataFrame:
    """record_id, tokens, grammar, shared (part of its tokens under shared rules and segments), evidence, kinds, other (not hand-written), by_grammar (its grammars alone say so).

    ``kinds``: generated (a mark, or a grammar below REUSE of at least REUSE_TOKENS tokens), minified, vendored (a mark, or
    rules and segments shared by several collections together cover SHARED of it), blob (literals that a grammar over
    their characters hardly shortens, or nothing but numbers, encoded bytes and table rows). Rows with null content give no row, an empty content has no kind; a null path is an empty one;
    repeated rows count once. Other columns are ignored.
    """
    found = cut(file_grammars(files))
    uses = found.select("record_id", "collection", "tokens", F.explode("rules").alias("r")).select("record_id", "collection", "tokens", "r.*")
    common = uses.select("rule", "collection").distinct().groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("rule")
    spans = uses.join(common, "rule", "left_semi").select("record_id", "tokens", "start", (F.col("start") + F.col("span")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("record_id", "tokens").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))
    copied = spans.withColumn("before", before).groupBy("record_id", "tokens").agg((F.sum(fresh) / F.col("tokens")).alias("shared")).groupBy("record_id").agg(F.max("shared").alias("shared"))
    rows = found.drop("rules", "collection").groupBy("record_id").agg(F.max("tokens").alias("tokens"), F.max("grammar").alias("grammar"), F.max("noise").alias("noise"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"))
    rows = rows.join(copied, "record_id", "left").na.fill(0.0, ["shared"])
    has = lambda kind: F.array_contains("evidence", kind)
    blob = has("data") | ((F.col("noise") >= NOISE) & ~has("minified"))
    reused = (F.col("tokens") >= REUSE_TOKENS) & (F.col("grammar") < REUSE * F.col("tokens")) & ~blob
    kinds = F.filter(
        F.array(F.when(has("generated") | reused, "generated"), F.when(has("minified"), "minified"), F.when(has("vendored") | (F.col("shared") >= SHARED), "vendored"), F.when(blob, "blob")), lambda x: x.isNotNull()
    )
    random = (F.col("noise") >= NOISE) & ~has("minified")
    alone = reused | random | (F.col("shared") >= SHARED)
    return rows.select("record_id", "tokens", "grammar", "shared", "evidence", kinds.alias("kinds"), (F.size(kinds) > 0).alias("other"), alone.alias("by_grammar"))
