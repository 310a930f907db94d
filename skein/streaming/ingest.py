"""Structured Streaming: incremental ingestion, and windows over events."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import chunking, incremental, state
from skein.session import cut


class ChunkTable:
    """A chunk table below a root: files fall into buckets by the hash of their path, and a batch rewrites only the buckets it touches.

    ``v<batch>.json``, written last, is the table after a batch: the folder that each bucket is read from. A batch writes folders of its own number,
    so a repeated one replaces what it wrote; folders that neither of the last two versions reads are removed.
    """

    COLUMNS = "collection string, path string, language string, start_line int, end_line int, content string, chunk_id string, sha256 string, scanned_at timestamp"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self.jvm, self.path = jvm, jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def folders(self, version: int | None) -> dict[int, str]:
        """The folder of every bucket in a version."""
        if version is None:
            return {}
        stream = self.fs.open(self.path(f"{self.root}/v{version}.json"))
        held = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return {int(k): v for k, v in held.items()}

    def bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("collection", "path"), F.lit(self.buckets)).cast("int"))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table as of a version (the last one), of the buckets ``only``."""
        version = self.versions()[-1] if version is None and self.versions() else version
        held = self.folders(version)
        paths = [f"{self.root}/{f}" for b, f in held.items() if only is None or b in only]
        return self.spark.read.schema(self.COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], self.COLUMNS)

    def publish(self, rows: DataFrame, touched: list[int], version: int, base: int | None) -> None:
        """Version ``version``: ``rows`` are all there is in the buckets ``touched``; the others are as in ``base``."""
        folder = f"data/v{version}"
        self.bucket(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        held = {b: f for b, f in self.folders(base).items() if b not in touched}
        held |= {b: f"{folder}/bucket={b}" for b in touched if self.fs.exists(self.path(f"{self.root}/{folder}/bucket={b}"))}
        out = self.fs.create(self.path(f"{self.root}/v{version}.json"), True)
        out.write(json.dumps(held).encode())
        out.close()
        self._clean()

    def _clean(self) -> None:
        *old, _, _ = [None, None, *self.versions()]
        used = {f for v in self.versions()[-2:] for f in self.folders(v).values()}
        for version in filter(lambda v: v is not None, old):
            self.fs.delete(self.path(f"{self.root}/v{version}.json"), False)
        at = self.path(f"{self.root}/data")
        for status in self.fs.listStatus(at) if self.fs.exists(at) else []:
            version = status.getPath().getName()
            for part in self.fs.listStatus(status.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and f"data/{version}/{name}" not in used:
                    self.fs.delete(part.getPath(), True)


def ingest_batch(tables: ChunkTable, files: DataFrame, batch: int) -> None:
    """Puts the chunks of new and modified files in place of what is stored of them.

    A record that was scanned before the one that is stored changes nothing, in whatever batch it arrives.
    """
    seen = files.where(F.col("sha256_hash").isNotNull() & F.col("content").isNotNull())
    state = F.struct("scanned_at", "record_id", F.lower("sha256_hash").alias("sha256"), "language", "content")
    rows = seen.select("collection", incremental.clean_path(F.col("rel_path")).alias("path"), state.alias("s")).groupBy("collection", "path").agg(F.max("s").alias("s")).select("collection", "path", "s.*")
    done = [v for v in tables.versions() if v < batch]
    base = done[-1] if done else None
    rows = cut(tables.bucket(rows))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
    stored = tables.spark.createDataFrame([], tables.COLUMNS) if base is None else tables.read(base, touched)
    known = stored.groupBy("collection", "path").agg(F.max("sha256").alias("_hash"), F.max("scanned_at").alias("_scanned"))
    fresh = rows.join(known, ["collection", "path"], "left")
    fresh = fresh.where(F.col("_hash").isNull() | ((F.col("sha256") != F.col("_hash")) & (F.coalesce(F.col("scanned_at") >= F.col("_scanned"), F.col("_scanned").isNull())))).drop("_hash", "_scanned")
    made = chunking.windows(fresh).join(fresh.select("collection", "path", "sha256", "scanned_at"), ["collection", "path"])
    kept = stored.join(fresh.select("collection", "path"), ["collection", "path"], "left_anti")
    tables.publish(kept.unionByName(made.select(*kept.columns)), touched, batch, base)


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """A stream that ingests the Parquet files of ``source`` (file records) as they arrive, then stops."""
    schema = spark.read.parquet(source).schema
    tables = ChunkTable(spark, target)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, batch: ingest_batch(tables, df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling windows; the same plan over a table and over a stream (with a watermark)."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """user_id, start, finish, n of sessions: events of a user with less than ``gap`` between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def delta(files: DataFrame, metadata: DataFrame, runs: DataFrame) -> DataFrame:
    """What one refresh has to do: the change class of every file (see :func:`skein.operators.state.classify_changes`)."""
    scanned = incremental.newest_records(files).select("collection", "path", "hash", F.lit(0.0).alias("mtime"))
    stored = incremental.committed_manifest(metadata, runs).select("collection", "path", "hash", F.lit(0.0).alias("mtime"))
    return state.classify_changes(scanned, stored)
