"""Source files that do not parse.

Every file is parsed by all grammars in the order that its tokens suggest, up to the first that accepts it, and by its own
language's. A file that its own rejects and another accepts has a wrong extension; one that all reject is damaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import syntax
from skein.session import spread


def check_files(files: DataFrame) -> DataFrame:
    """record_id, collection, language, valid, parses_as of every file with content.

    ``valid``: whether the content as a whole file is syntax of its language; null where the language is null,
    unknown or without a grammar (markdown, properties). ``parses_as``: the language that accepts the file, of several the one that
    its tokens speak for most; null if none does (damage), and for files of a named language without a grammar. Another than its own is a wrong extension where the file
    is invalid, and a doubt where it is valid. An empty file is judged like any other. Files with null content give no row, repeated rows
    count once, other columns are ignored.
    """
    kind = files.schema["record_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[bool, str | None]] = {}
        size = 0
        for batch in batches:
            valid, other = [], []
            for language, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                name = syntax.language_name(language)
                if name not in syntax.GRAMMARS and name not in ("", "unknown"):
                    valid.append(None)
                    other.append(None)
                    continue
                result = known.get((name, text))
                if result is None:
                    result = syntax.judge(name, text)
                    size += len(text)
                    if size > 20_000_000:  # what a task remembers stays small
                        known.clear()
                        size = 0
                    known[name, text] = result
                valid.append(result[0])
                other.append(result[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(valid, type=pa.bool_()), pa.array(other, type=pa.string())], names=["record_id", "collection", "language", "valid", "parses_as"])

    rows = files.where(F.col("content").isNotNull()).select("record_id", "collection", "language", "content")
    return spread(rows).mapInArrow(run, f"record_id {kind}, collection string, language string, valid boolean, parses_as string").distinct()


def invalid_rates(checked: DataFrame) -> DataFrame:
    """Per collection and language: files judged, invalid, wrong_extension and damaged (of the invalid), rate. Nulls are groups of their own."""
    judged = checked.where(F.col("valid").isNotNull())
    bad = (~F.col("valid")).cast("bigint")
    wrong = bad * F.col("parses_as").isNotNull().cast("bigint")
    return judged.groupBy("collection", "language").agg(
        F.count("*").alias("files"), F.sum(bad).alias("invalid"), F.sum(wrong).alias("wrong_extension"), F.sum(bad - wrong).alias("damaged"), F.avg(bad.cast("double")).alias("rate")
    )
