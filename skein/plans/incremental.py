"""Queries of incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.incremental import ManifestStore, committed_manifest, newest_records, pending_records
from skein.session import checkpoint_dir, table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """What a run of a manifest store puts out: the earlier runs are its history, the newest records its listing.

    The tables have no sizes; a null size is equal to a null one. The store lies in the shared folder.
    """
    store = ManifestStore(spark, f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}", ("collection", "path"))
    no_size = F.lit(None).cast("bigint").alias("size")
    history = committed_manifest(table(spark, d, "file_metadata"), table(spark, d, "index_runs"))
    store.adopt(history.select("collection", "path", no_size, F.col("hash").alias("checksum")))
    listing = newest_records(table(spark, d, "file_records")).select("collection", "path", no_size, F.col("hash").alias("checksum"), "record_id")
    batch = store.run(listing, lambda todo: todo.select("record_id"), once=False)
    return store.output(batch).select("record_id") if batch else listing.limit(0).select("record_id")


def p7_pending(spark: SparkSession, d: str) -> DataFrame:
    """The same as one lazy plan, with collection, path and hash."""
    return pending_records(table(spark, d, "file_records"), table(spark, d, "file_metadata"), table(spark, d, "index_runs"))


P7 = r"""
WITH newest AS (
  SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY scanned_at DESC NULLS LAST, record_id DESC) AS n FROM (
    SELECT DISTINCT record_id, collection, regexp_replace(replace(rel_path, '\', '/'), '^\./', '') AS path, lower(sha256_hash) AS hash, scanned_at
    FROM file_records WHERE sha256_hash IS NOT NULL)),
done AS (SELECT run_id, max(finished_at) AS finished_at FROM index_runs WHERE status = 'completed' AND finished_at IS NOT NULL GROUP BY run_id),
committed AS (
  SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY finished_at DESC, run_id DESC, recorded_at DESC NULLS LAST, hash DESC NULLS LAST) AS n FROM (
    SELECT m.collection, regexp_replace(replace(m.rel_path, '\', '/'), '^\./', '') AS path, lower(m.sha256) AS hash, m.run_id, m.recorded_at, d.finished_at
    FROM file_metadata m JOIN done d USING (run_id)))
SELECT {columns} FROM newest r WHERE n = 1 AND NOT EXISTS (
  SELECT 1 FROM committed c WHERE c.n = 1 AND c.collection IS NOT DISTINCT FROM r.collection AND c.path IS NOT DISTINCT FROM r.path AND c.hash = r.hash)
"""

QUERIES = {"p7_found": p7_found, "p7_pending": p7_pending}
SQL = {"p7_found": P7.format(columns="record_id"), "p7_pending": P7.format(columns="record_id, collection, path, hash")}
