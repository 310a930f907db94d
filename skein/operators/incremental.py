"""Processing only new or changed records.

A *manifest* says which input was committed and with which size and checksum. A run lists its input, anti-joins the listing
against the manifest's newest entry of every path, writes what is left under a batch identifier that depends only on that input
and on the commits before it (so a repeated run overwrites its own output instead of adding to it), and commits last. What
no commit names does not count: neither as processed nor as output.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """One spelling of a relative path: ``\\`` read as ``/``, a leading ``./`` dropped."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def newest_records(files: DataFrame) -> DataFrame:
    """The newest record with a hash of every file: greatest ``scanned_at``, then ``record_id``.

    Records without a hash are no evidence of content and never count. A null ``scanned_at`` is older than any other.
    Repeated rows change nothing; columns other than the five used are ignored.
    """
    seen = files.where(F.col("sha256_hash").isNotNull()).select(
        "collection", clean_path(F.col("rel_path")).alias("path"), F.struct("scanned_at", "record_id", F.lower("sha256_hash").alias("hash")).alias("state")
    )
    return seen.groupBy("collection", "path").agg(F.max("state").alias("state")).select("collection", "path", "state.record_id", "state.hash")


def committed_manifest(metadata: DataFrame, runs: DataFrame) -> DataFrame:
    """collection, path, hash as the last *completed* run left them.

    Rows stored by a run that failed, was cancelled or still runs are not committed. Of several completed runs the one
    with the greatest ``finished_at`` counts (then run_id, then recorded_at). A null stored hash means: nothing committed.
    """
    done = runs.where((F.col("status") == "completed") & F.col("finished_at").isNotNull()).groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    stored = metadata.select("collection", clean_path(F.col("rel_path")).alias("path"), F.lower("sha256").alias("hash"), "run_id", "recorded_at")
    state = F.struct("finished_at", "run_id", "recorded_at", "hash").alias("state")
    last = stored.join(done, "run_id").select("collection", "path", state).groupBy("collection", "path").agg(F.max("state").alias("state"))
    return last.select("collection", "path", "state.hash").where(F.col("hash").isNotNull())


def pending_records(files: DataFrame, metadata: DataFrame, runs: DataFrame) -> DataFrame:
    """record_id, collection, path, hash of exactly the records the next run has to process, each once.

    The listing (newest record per file) is anti-joined against the committed manifest on file and checksum, null-safe,
    so a file whose collection or path is null is compared like any other. Empty tables give no or all files.
    """
    listing, manifest = newest_records(files), committed_manifest(metadata, runs)
    same = listing["collection"].eqNullSafe(manifest["collection"]) & listing["path"].eqNullSafe(manifest["path"]) & (listing["hash"] == manifest["hash"])
    return listing.join(manifest, same, "left_anti")


def _all_equal(keys: tuple[str, ...]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return same


class ManifestStore:
    """A manifest and the output of its runs below a folder of the shared file system.

    ``commits/<number>.json`` names one batch; it is created last, by an operation that fails if the number is taken, and only
    batches that a commit names count. ``entries/batch=<id>`` holds the manifest's rows of a batch (the keys, size, checksum),
    ``out/batch=<id>`` what was made of it. Of several entries of a path the one of the last commit is what was processed last, so content
    that comes back after a change is processed again. A run that died before its commit leaves folders that nobody
    reads; the next run removes them. One run at a time: the second of two that end together fails on its commit.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("path",), snapshot_every: int = 50):
        self.spark, self.root, self.keys, self.snapshot_every = spark, root.rstrip("/"), keys, snapshot_every
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def commits(self) -> list[dict]:
        """What each commit says, oldest first: number, batch, rows, whole (its entries are the whole manifest)."""
        found = []
        for name in self._names("commits"):
            if name.endswith(".json"):
                stream = self.fs.open(self._path(f"commits/{name}"))
                found.append(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        return found

    def _commit(self, number: int, batch: str, rows: int, whole: bool) -> None:
        out = self.fs.create(self._path(f"commits/{number:012d}.json"), False)  # fails if another run has committed meanwhile
        out.write(json.dumps({"number": number, "batch": batch, "rows": rows, "whole": whole}).encode())
        out.close()

    def manifest(self) -> DataFrame:
        """The keys, size, checksum and batch_id of the newest committed entry of every path; empty before the first commit."""
        commits = self.commits()
        last = max((i for i, c in enumerate(commits) if c["whole"]), default=0)
        commits = [c for c in commits[last:] if c["rows"] or c["whole"]]
        if not commits:
            return self.spark.createDataFrame([], ", ".join([*(f"`{k}` string" for k in self.keys), "size long, checksum string, batch_id string"]))
        parts = [self.spark.read.parquet(f"{self.root}/entries/batch={c['batch']}").withColumn("_commit", F.lit(c["number"])) for c in commits]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1:
            return rows.drop("_commit")  # the paths of one batch are distinct
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("_commit", "size", "checksum", "batch_id")).alias("e"))
        return newest.select(*self.keys, "e.size", "e.checksum", "e.batch_id")

    def pending(self, listing: DataFrame, once: bool = True) -> DataFrame:
        """Rows of ``listing`` (the keys, size, checksum, ...) whose path was never committed, or last with another size or checksum.

        Compared null-safe: a null size or checksum is equal to a null one alone. A path that is listed several times counts
        once, with its greatest checksum, then size; ``once=False`` says that no path is.
        """
        columns = (*self.keys, "size", "checksum")
        known = self.manifest().select(*[F.col(c).alias(f"_{c}") for c in columns])
        if once:
            rest = F.struct(*[F.col(c) for c in listing.columns if c not in self.keys])
            listing = listing.groupBy(*self.keys).agg(F.max_by(rest, F.struct("checksum", "size")).alias("_r")).select(*self.keys, "_r.*")
        return listing.join(known, _all_equal(columns), "left_anti")

    def output(self, batch: str | None = None) -> DataFrame | None:
        """What committed batches (or one of them) gave, with batch_id; None if there is none."""
        done = [c["batch"] for c in self.commits() if c["rows"] and (batch is None or c["batch"] == batch) and self.fs.exists(self._path(f"out/batch={c['batch']}"))]
        parts = [self.spark.read.parquet(f"{self.root}/out/batch={b}").withColumn("batch_id", F.lit(b)) for b in done]
        rows = parts[0] if parts else None
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows

    def adopt(self, entries: DataFrame) -> None:
        """Commits ``entries`` (the keys, size, checksum; a path once) as processed elsewhere: the history of runs before this store."""
        self._clean()
        commits = self.commits()
        batch = f"adopted-{len(commits):06d}-{uuid.uuid4().hex[:8]}"
        entries.select(*self.keys, "size", "checksum", F.lit(batch).alias("batch_id")).write.mode("overwrite").parquet(f"{self.root}/entries/batch={batch}")
        self._commit(len(commits), batch, 1, False)

    def _clean(self) -> None:
        """Removes what runs left that died before their commit."""
        held = {c["batch"] for c in self.commits()}
        for folder in ("entries", "out"):
            for name in self._names(folder):
                if name.removeprefix("batch=") not in held:
                    self.fs.delete(self._path(f"{folder}/{name}"), True)
        self.fs.delete(self._path("work"), True)

    def run(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame], once: bool = True) -> str | None:
        """Process what is pending with ``process(DataFrame) -> DataFrame``; returns the batch id, None if nothing was.

        What is pending is found once and written down; output and manifest come from what was written, so that a listing
        that moves meanwhile changes neither. ``once``: see :meth:`pending`.
        """
        self._clean()
        commits = self.commits()
        work = f"{self.root}/work/{uuid.uuid4().hex}"
        self.pending(listing, once).write.parquet(work)
        todo = self.spark.read.parquet(work)
        columns = [*self.keys, "size", "checksum"]
        n, low, high = todo.select(F.count("*"), *(F.bit_xor(F.xxhash64(F.lit(i), *columns)) for i in (1, 2))).first()
        if not n:
            self.fs.delete(self._path("work"), True)
            return None
        batch = f"{len(commits):06d}-{n:x}-{low & (2**64 - 1):016x}-{high & (2**64 - 1):016x}"
        process(todo.select(*listing.columns)).write.mode("overwrite").parquet(f"{self.root}/out/batch={batch}")
        since = next((i for i, c in enumerate(reversed(commits)) if c["whole"]), len(commits))
        whole = since + 1 >= self.snapshot_every  # so that no reader has more than so many folders to read
        entries = todo.select(*columns, F.lit(batch).alias("batch_id"))
        if whole:
            entries = self.manifest().join(todo.select(*[F.col(k).alias(f"_{k}") for k in self.keys]), _all_equal(self.keys), "left_anti").unionByName(entries)
        entries.write.mode("overwrite").parquet(f"{self.root}/entries/batch={batch}")
        self._commit(len(commits), batch, n, whole)
        self.fs.delete(self._path("work"), True)
        return batch
