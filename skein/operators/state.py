"""Stored state: change detection, upsert, delete, schema checks, collection flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MTIME_TOLERANCE = 0.001


def classify_changes(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """collection, path, change of every file scanned (hash, mtime) or stored (hash, mtime): new, modified, unchanged, stale.

    Unchanged: modification times differ by less than a millisecond (a null or zero time proves nothing), or hashes agree.
    """
    a = scanned.select("collection", "path", F.lower("hash").alias("hash"), "mtime", F.lit(True).alias("seen"))
    b = stored.select("collection", "path", F.lower("hash").alias("old_hash"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("kept"))
    both = a.join(b, ["collection", "path"], "full")
    touched = (F.col("mtime") != 0) & (F.col("old_mtime") != 0) & (F.abs(F.col("mtime") - F.col("old_mtime")) < MTIME_TOLERANCE)
    same = F.coalesce(touched, F.lit(False)) | F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False))
    change = F.when(F.col("seen").isNull(), "stale").when(F.col("kept").isNull(), "new").when(same, "unchanged").otherwise("modified")
    return both.select("collection", "path", change.alias("change"))


def stale_paths(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored files that the scan did not see."""
    return stored.select("collection", "path").distinct().join(scanned.select("collection", "path").distinct(), ["collection", "path"], "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` put in place of those with the same keys; equal incoming keys count once."""
    fresh = incoming.select(*existing.columns).dropDuplicates(keys)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def delete_paths(existing: DataFrame, paths: DataFrame) -> DataFrame:
    """``existing`` without the files of ``paths`` (collection, rel_path)."""
    return existing.join(paths.select("collection", "rel_path").distinct(), ["collection", "rel_path"], "left_anti")


def first_metadata(chunks: DataFrame) -> DataFrame:
    """collection, rel_path, file_sha256 of every file, by its chunk with the smallest id; blank paths are left out."""
    rows = chunks.where(F.length("rel_path") > 0)
    return rows.groupBy("collection", "rel_path").agg(F.min_by("file_sha256", F.struct("chunk_id", "point_id")).alias("file_sha256"))


def schema_decision(stored: dict | None, wanted: dict, force: bool = False) -> str:
    """create, keep or recreate: a collection is made anew if its vectors' sizes, kinds or quantization are not the wanted ones."""
    if stored is None:
        return "create"
    fields = ("dense_size", "sparse", "multivector", "multivector_size", "quantization")
    return "recreate" if force or any(stored.get(f) != wanted.get(f) for f in fields) else "keep"


def with_flags(collections: DataFrame, flags: DataFrame) -> DataFrame:
    """The collection table with the flags (collection, flag, value) set; flags not named stay."""
    wide = flags.groupBy("collection").agg(*[F.max(F.when(F.col("flag") == f, F.col("value"))).alias(f"_{f}") for f in ("graph_call_sites", "graph_enabled")])
    out = collections.join(wide, "collection", "left")
    return out.select("collection", *[F.coalesce(f"_{f}", F.col(f)).alias(f) for f in ("graph_call_sites", "graph_enabled")])
