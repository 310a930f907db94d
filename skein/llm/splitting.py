"""Splitting oversized items at natural boundaries.

One regular expression takes the text apart. Its alternatives stand in order of boundary strength, each a bounded
quantifier that consumes as much as it may and then backs up to its boundary: a blank line before an unindented line,
any blank line, the end of a line before an unindented one, the end of any line, a statement or word end, and at last
any character. Overlap is looked back for from the end of the piece before. All of it is SQL array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_pattern(most: int) -> str:
    """The pattern whose matches, put together, are the text; no match is longer than ``most`` code points."""
    strong, fair = max(1, most // 2), max(1, most // 4)
    ends = [
        rf".{{1,{most}}}\z",
        rf".{{{strong},{most}}}(?<=\n[ \t]{{0,40}}\r?\n)(?=[^\s])",
        rf".{{{strong},{most}}}(?<=\n[ \t]{{0,40}}\r?\n)(?=[ \t]*[^\s])",
        rf".{{{strong},{most}}}(?<=\n)(?=[^\s)\]}}])",
        rf".{{1,{most}}}(?<=\n)",
        rf".{{{fair},{most}}}(?<=[;,{{}}])",
        rf".{{{fair},{most}}}(?<=\s)(?<!\r(?=\n))",
        rf".{{1,{most}}}(?<!\r(?=\n))",
        r".",
    ]
    return "(?s)" + "|".join(ends)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def running_sums(counts: Column, block: int = 256) -> Column:
    """For every entry of an array of int the sum of those before it: within blocks of entries, shifted by the sums of earlier blocks, so that long arrays do not cost their square."""

    def sums(values: Column, start: Column) -> Column:
        empty = F.struct(F.array().cast("array<int>").alias("at"), start.alias("n"))
        return F.aggregate(values, empty, lambda a, x: F.struct(F.concat(a["at"], F.array(a["n"])).alias("at"), (a["n"] + x).alias("n")))["at"]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / block).cast("int")), lambda b: F.slice(counts, b * block + 1, block))
    starts = sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(parts, starts, lambda p, s: sums(p, s)))


def split_oversized(chunks: DataFrame, limit: int = 2400, overlap_lines: int = 3, core: int | None = None) -> DataFrame:
    """The consecutive pieces of every chunk: point_id, piece (from 1), pieces, start_line, end_line, symbol_name, content, lead.

    A chunk of at most ``limit`` characters (code points) is its own single piece. Larger ones are cut into cores of
    at most ``core`` characters (five sixths of the limit), and each core but the first is led by the last
    ``overlap_lines`` lines of the core before, or as many of them as fit into the limit; ``lead`` is the length of
    that overlap. Without leads the pieces put together are the content. Lines count from the chunk's start_line by
    the line feeds before each piece, so a wrong end_line of the chunk does not matter; a null start_line gives null lines.
    Null and empty contents give no piece. Repeated rows of a point count once; a point with several contents
    keeps each, and other columns are ignored.
    """
    if limit < 2 or overlap_lines < 0:
        raise ValueError("limit must be at least 2, overlap_lines at least 0")
    core = core or max(1, limit * 5 // 6)
    rows = chunks.select("point_id", "content", "start_line", "symbol_name").where(F.length("content") > 0)
    small = rows.where(F.length("content") <= limit).distinct()
    large = rows.where(F.length("content") > limit).distinct()

    one = small.select(
        "point_id", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), "start_line",
        (F.col("start_line") + _count(F.col("content"), "\n") - F.endswith("content", F.lit("\n")).cast("int")).cast("int").alias("end_line"), "symbol_name", "content", F.lit(0).alias("lead"),
    )

    cores = large.withColumn("cores", F.regexp_extract_all("content", F.lit(boundary_pattern(core)), F.lit(0)))
    lines = F.transform("cores", lambda x: _count(x, "\n"))
    before = running_sums(lines)
    tails = [F.lit("")]
    whole = F.col("cores")
    cut = cores.select("point_id", "start_line", "symbol_name", F.size("cores").alias("pieces"), whole.alias("cores"), before.alias("before"))
    cut = cut.select("point_id", "start_line", "symbol_name", "pieces", F.posexplode(F.arrays_zip(F.col("cores"), F.concat(F.array(F.lit("")), F.slice("cores", 1, F.greatest(F.size("cores") - 1, F.lit(0)))).alias("last"), F.col("before"))).alias("i", "p"))
    text, last = F.col("p.cores"), F.col("p.last")
    for n in range(overlap_lines, 0, -1):
        tails.append(F.regexp_extract(last, rf"(?s)(?:\A|(?<=\n))((?:[^\n]*\n){{{n - 1}}}(?:[^\n]*\n|[^\n]+))\z", 1))
    fits = [F.when((F.length(t) + F.length(text)) <= limit, F.when(F.length(t) > 0, t)) for t in tails[1:]]
    lead = F.coalesce(*fits, F.lit("")) if fits else F.lit("")
    cut = cut.select("point_id", (F.col("i") + 1).alias("piece"), "pieces", "start_line", "symbol_name", text.alias("text"), F.col("p.before").alias("before"), lead.alias("tail"))
    start = F.col("start_line") + F.col("before") - _count(F.col("tail"), "\n")
    cut = cut.select(
        "point_id", "piece", "pieces", start.cast("int").alias("start_line"),
        (F.col("start_line") + F.col("before") + _count(F.col("text"), "\n") - F.endswith("text", F.lit("\n")).cast("int")).cast("int").alias("end_line"),
        "symbol_name", F.concat("tail", "text").alias("content"), F.length("tail").alias("lead"),
    )
    return one.unionByName(cut)
