"""Abusive, hateful or sexual content: a linear classifier over character n-grams.

Texts are taken apart into sentences, and spelling tricks are undone (look-alike letters, digits for letters, spaced or
stretched words, hidden characters). Binary n-gram features are scaled by naive Bayes log-count ratios and weighed by
logistic regression, trained on labelled documents: of a document labelled abusive, the sentence that scores highest
stands for it, of one labelled otherwise every sentence does. A document scores as its highest sentence. Labelled samples
hold more abuse than a corpus does, so the share of abusive documents is estimated from the scores of the whole corpus, and
the scores are probabilities under that share.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.distinctive import mix64
from skein.llm.mixing import source_name
from skein.session import cut, spread

#: Greek and Cyrillic letters and signs that stand for Latin letters of the same look.
ALIKE = str.maketrans("аеосрхуікѕјһԁԛԝвнмтαοερνικτυ", "aeocpxyiksjhdqwbhmtaoepviktu")
#: Digits and signs used for letters within words.
DIGITS = str.maketrans("0134578@$!|", "oieastbasil")

#: Documents that score at least this count as abusive.
THRESHOLD = 0.5
BUCKETS = 1 << 18
ORDERS = (2, 3, 4, 5)
#: Sentences beyond this length are cut at a word's end.
LONGEST = 240
#: Sentences of more words also count by windows of so many words, every so many words: run-on sentences hide others.
WINDOW, STRIDE = 10, 5

_SENTENCE = re.compile(r"(?<=[.!?])[\s)\"'>]+|\s*[\r\n]+\s*")
# words with an inner capital or underscore, names of users, quoted code, addresses
_CODE = re.compile(r"\b(?=\w*?[a-z0-9](?:[A-Z]|_\w))(?:[a-z]+(?:[A-Z][a-z0-9]*)+|(?:[A-Z][a-z0-9]+){2,}|\w*[a-z0-9]_\w+)\b|<?@?user\d+>?|`[^`]*`|https?://\S+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){2,}[^\W\d_](?!\w)")
_MIXED = re.compile(r"(?<![\w@$!|])(?=[\w@$!|]*[a-z])(?=[\w@$!|]*[0134578@$!|][\w@$])[a-z0134578@$!|]+(?![\w@$|])")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_MASKED = re.compile(r"\*{2,}")
_REPEAT = re.compile(r"(\D)\1+")
_OTHER = re.compile("[^\\w*\u00a7\x01]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_LONG = re.compile(rf".{{1,{LONGEST}}}(?:\s|$)|.{{1,{LONGEST}}}", re.S)


# hidden characters: formats, joiners, variation selectors
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_OTHER_LETTERS = re.compile("[\u0370-\u03ff\u0400-\u052f]")


def plain(text: str) -> str:
    """The text in one spelling: lower-case Latin letters without marks, code and numbers masked, tricks undone.

    Sentences are kept apart by U+0001; nothing else but words, blanks and masks is left.
    """
    s = text
    if not s.isascii():
        s = unicodedata.normalize("NFKC", _HIDDEN.sub("", s))
    s = _CODE.sub(" \u00a7 ", s).lower()
    if not s.isascii():
        s = s.translate(ALIKE) if _OTHER_LETTERS.search(s) else s  # the table is looked into character by character
        s = _MARKS.sub("", unicodedata.normalize("NFD", s)).replace("\u00df", "ss")
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), s)
    s = _MIXED.sub(lambda m: m[0].translate(DIGITS), s)
    s = _SENTENCE.sub("\x01", _MASKED.sub("**", _NUMBER.sub("0", s)))
    return _OTHER.sub(" ", _REPEAT.sub(r"\1", s)).strip()


def sentences(text: str) -> list[str]:
    """The distinct sentences of a text in plain spelling, none longer than LONGEST, and windows of long ones."""
    out: dict[str, None] = {}
    for p in plain(text).split("\x01"):
        for piece in _LONG.findall(p) if len(p) > LONGEST else (p,):
            piece = piece.strip()
            if len(piece) > 2:
                out[piece] = None
                words = piece.split()
                if len(words) > WINDOW + STRIDE:
                    for i in range(0, len(words) - STRIDE, STRIDE):
                        out[" ".join(words[i : i + WINDOW])] = None
    return list(out)


def ngrams(lines: list[str], at_once: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the distinct n-gram buckets of each line, which is framed by blanks."""
    parts = [_ngrams(lines[i : i + at_once]) for i in range(0, len(lines), at_once)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate([b for b, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])


def _ngrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many each line has)."""
    framed = [f" {s} " for s in lines]
    sizes = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    rolling, parts = points, []
    for n in range(2, max(ORDERS) + 1):
        rolling = rolling[:-1] * np.uint64(1_000_003) + points[n - 1 :]
        if n in ORDERS and len(rolling):
            own = owner[: len(rolling)]
            whole = own == owner[n - 1 :]
            bucket = (mix64(rolling[whole] + np.uint64(n) * np.uint64(0x51ED2701)) >> np.uint64(46)).astype(np.int64)
            parts.append((own[whole] * BUCKETS + bucket).astype(np.int32))  # at_once lines of 2**18 buckets stay below 2**31
    keys = np.sort(np.concatenate(parts))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys % BUCKETS, np.bincount(keys // BUCKETS, minlength=len(lines))


@dataclass(frozen=True)
class Model:
    """Weights by n-gram bucket (log-count ratio times regression weight), the bias, and what it was trained on."""

    weights: np.ndarray
    bias: float
    share: float = 0.5  # of abusive documents among those it was trained on
    abusive: int = 0  # how many these were

    def scores(self, lines: list[str]) -> np.ndarray:
        """Probability that each line is abusive."""
        buckets, offsets = ngrams(lines)
        return 1 / (1 + np.exp(-self.margins(buckets, offsets)))

    def margins(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sizes = np.diff(offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(sizes, 1)) + self.bias


def _ratios(buckets: np.ndarray, offsets: np.ndarray, share: np.ndarray, smooth: float = 4.0) -> np.ndarray:
    """Log ratio of how often each bucket occurs in abusive and in other lines; ``share`` is each line's abusive part.

    Smoothing is in proportion to the kinds' masses, so that a bucket which occurs in neither says nothing.
    """
    per = np.repeat(share, np.diff(offsets))
    p, q = np.bincount(buckets, weights=per, minlength=BUCKETS), np.bincount(buckets, weights=1 - per, minlength=BUCKETS)
    part = min(max(p.sum() / max(p.sum() + q.sum(), 1e-9), 1e-9), 1 - 1e-9)
    return np.log(smooth + p / part) - np.log(smooth + q / (1 - part))


def _regress(buckets, offsets, ratios, target, weight, decay: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features by mini-batches with per-weight step sizes."""
    sizes = np.diff(offsets)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    w, b = np.ones(BUCKETS), 0.0
    gw, gb = np.full(BUCKETS, 1e-3), 1e-3
    order, rng = np.arange(len(sizes)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for part in np.array_split(order, max(1, len(order) // 1024)):
            n = sizes[part]
            at = np.repeat(offsets[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            f = buckets[at]
            value = ratios[f] * np.repeat(scale[part], n)
            line = np.repeat(np.arange(len(part)), n)
            z = np.bincount(line, weights=w[f] * value, minlength=len(part)) + b
            e = (1 / (1 + np.exp(-z)) - target[part]) * weight[part]
            g = np.bincount(f, weights=e[line] * value, minlength=BUCKETS)
            touched = np.flatnonzero(g)
            g = g[touched] + decay * (w[touched] - 1) * len(part)
            gw[touched] += g * g
            w[touched] -= 0.5 * g / np.sqrt(gw[touched])
            gb += e.sum() ** 2
            b -= 0.5 * e.sum() / np.sqrt(gb)
    return w, b


@dataclass(frozen=True)
class _Bags:
    """Documents as bags of lines with their n-gram buckets, and a label per document."""

    buckets: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, docs: list[list[str]], label: np.ndarray) -> _Bags:
        buckets, offsets = ngrams([s for d in docs for s in d])
        sizes = np.array([len(d) for d in docs])
        return cls(buckets, offsets, np.cumsum(sizes) - sizes, label)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.label)), np.diff(np.append(self.starts, len(self.offsets) - 1)))

    def lines(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(self.offsets)[used]
        at = np.repeat(self.offsets[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.buckets[at], np.concatenate([[0], np.cumsum(n)])

    def fit(self, docs: np.ndarray, rounds: int, decay: float, epochs: int, seed: int) -> Model:
        """A model from the documents of the mask ``docs``."""
        owner = self.owner
        of_line = self.label[owner]
        used = np.flatnonzero(docs[owner])
        b, o = self.lines(used)
        # at first every line of an abusive document may be the one; common ones occur in the others as well
        share = (of_line / np.bincount(owner)[owner])[used]
        model = Model(_ratios(b, o, share, smooth=2.0), 0.0)
        for _ in range(rounds):
            margin = model.margins(self.buckets, self.offsets)
            top = np.maximum.reduceat(margin, self.starts)
            used = np.flatnonzero(docs[owner] & ((of_line == 0) | (margin >= top[owner])))
            b, o = self.lines(used)
            ratios = _ratios(b, o, of_line[used])
            w, bias = _regress(b, o, ratios, of_line[used], np.ones(len(used)), decay, epochs, seed)
            model = Model(w * ratios, bias)
        return model

    def score(self, model: Model) -> np.ndarray:
        return 1 / (1 + np.exp(-np.maximum.reduceat(model.margins(self.buckets, self.offsets), self.starts)))


def train(texts: list[str], abusive: list[float], rounds: int = 3, decay: float = 1e-4, epochs: int = 4, rater_error: float = 0.15, seed: int = 5) -> Model:
    """A model from texts and their labels (0 to 1; 0.5 says nothing). Without both kinds of label it scores all texts 0.

    Raters err: two models, each trained on half of the documents, judge the other half, and labels that they firmly
    contradict are left out of the final model, of either label at most the part ``rater_error``.
    """
    docs, labels = [], []
    for t, y in zip(texts, abusive):
        s = sentences(t) if t else []
        if s and y != 0.5:
            docs.append(s)
            labels.append(float(y > 0.5))
    label = np.array(labels)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS), -30.0)
    bags = _Bags.of(docs, label)
    half = np.zeros(len(docs), bool)
    for y in (0.0, 1.0):
        half[np.flatnonzero(label == y)[::2]] = True
    other = np.zeros(len(docs))
    for part in (half, ~half):
        if part.any() and 0 < label[part].sum() < part.sum():
            other[~part] = bags.score(bags.fit(part, 2, decay, epochs, seed))[~part]
        else:
            other[~part] = label[~part]
    wrong = np.abs(other - label)
    keep = np.ones(len(docs), bool)
    for y in (0.0, 1.0):
        mine = np.flatnonzero((label == y) & (wrong > 0.95))
        keep[mine[np.argsort(-wrong[mine], kind="stable")][: int(rater_error * (label == y).sum())]] = False
    model = bags.fit(keep, rounds, decay, epochs, seed)
    return Model(model.weights, model.bias, float(label.mean()), int(label.sum()))


def corpus_share(margins: np.ndarray, counts: np.ndarray, trained: float, rounds: int = 500) -> float:
    """The share of abusive documents in a corpus, by expectation maximisation over its margins (values and how often).

    The model's probabilities hold for the share ``trained`` of its training set; a share is sought that their mean under it is equal to.
    """
    odds = np.exp(np.clip(margins, -30, 30)) * (1 - trained) / trained
    share = trained
    for _ in range(rounds):
        mean = float(np.average(odds * share / (odds * share + 1 - share), weights=counts))
        if abs(mean - share) < 1e-9:
            break
        share = min(max(mean, 1e-6), 1 - 1e-6)
    return share


def labelled(docs: DataFrame, labels: DataFrame, at_most: int, characters: int) -> DataFrame:
    """doc_id, text, abusive (mean over raters) of labelled documents, taken whole and by a hash of the id: ``at_most`` rows and ``characters`` in all."""
    mean = labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "rater", F.col("abusive").cast("double").alias("abusive")).distinct()
    mean = mean.groupBy("doc_id").agg(F.avg("abusive").alias("abusive")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    rows = texts.join(F.broadcast(mean), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("abusive").alias("abusive"))  # at_most rows
    size = F.sum(F.length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at_most rows
    return rows.withColumn("_size", size).where(F.col("_size") <= characters).drop("_size")


def score_abuse(docs: DataFrame, labels: DataFrame, train_rows: int = 8_000, train_characters: int = 40_000_000, least_abusive: int = 50) -> DataFrame:
    """Every document with its score: doc_id, source, score (0 to 1, the probability that it is abusive).

    The model is trained on at most ``train_rows`` labelled documents of ``train_characters`` together, all of them whole (the
    bounds of the driver's memory). Raters who disagree evenly say nothing; null labels are none. Null, empty and blank texts score 0.
    One row per document: repeated rows count once, with their greatest score. ``source`` is in one spelling, null if it is null.
    Without labels of both kinds every score is 0. A model of fewer than ``least_abusive`` documents labelled abusive
    orders documents for review but flags none: all its scores stay below THRESHOLD.
    """
    sample = labelled(docs, labels, train_rows, train_characters).orderBy("doc_id").toPandas()
    model = train(sample.text.tolist(), sample.abusive.tolist())
    weights, bias = model.weights.astype(np.float32), model.bias
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, known = Model(weights.astype(np.float64), bias), {}
        for batch in batches:
            split = [sentences(t) if t else [] for t in batch.column(2).to_pylist()]
            if len(known) > 200_000:
                known.clear()
            new = list({s: None for d in split for s in d if s not in known})
            for i in range(0, len(new), 5000):
                part = new[i : i + 5000]
                known.update(zip(part, mine.margins(*ngrams(part)).tolist()))
            margins = [max((known[s] for s in d), default=None) for d in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margins, type=pa.float64())], names=["doc_id", "source", "margin"])

    rows = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    scored = spread(rows).mapInArrow(run, f"doc_id {kind}, source string, margin double")
    scored = cut(scored.groupBy("doc_id").agg(F.max(F.struct("margin", "source")).alias("b")).select("doc_id", "b.source", "b.margin"))
    if not model.abusive:
        return scored.select("doc_id", "source", F.lit(0.0).alias("score"))
    # margins to two places between -30 and 30: at most 6,001 rows
    seen = scored.where(F.col("margin").isNotNull()).groupBy(F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "margin")), 2).alias("m")).agg(F.count("*").alias("n")).toPandas()
    share = corpus_share(seen.m.to_numpy(), seen.n.to_numpy(), model.share) if len(seen) else model.share
    shift = math.log(share / (1 - share)) - math.log(model.share / (1 - model.share))
    score = F.coalesce(1 / (1 + F.exp(-(F.col("margin") + shift))), F.lit(0.0))
    if model.abusive < least_abusive:
        score = score * (THRESHOLD * 0.999)
    return scored.select("doc_id", "source", score.alias("score"))


def abuse_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (in one spelling; null is its own): documents, abusive (those at or above the threshold), rate."""
    hit = (F.col("score") >= threshold).cast("bigint")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("abusive"), F.avg(hit.cast("double")).alias("rate"))
