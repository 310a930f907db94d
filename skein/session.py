"""Session helpers: settings every plan of this package relies on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTC = "spark.sql.session.timeZone"


def get_session(app: str = "skein", cores: int | str = "*") -> SparkSession:
    """A local session with the settings that the package expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config(UTC, "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. The cluster's own setting wins; one is made only in local mode (tests, benches), and removed at its end.

    On a cluster without one this is an error: executors could not share a folder of the driver's.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        configured = f"file://{folder}"
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def _importable(spark: SparkSession) -> bool:
    """Whether the executors' workers find this package by themselves."""

    def probe(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("skein") is not None]})

    rows = spark.range(0, spark.sparkContext.defaultParallelism, 1, spark.sparkContext.defaultParallelism).mapInArrow(probe, "found boolean").collect()  # one row a core
    return all(r.found for r in rows)


def ship(spark: SparkSession) -> None:
    """Makes sure, once per application, that the executors can import this package: sends it to them if they cannot."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if _importable(spark):
        return
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="skein-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the archive as long as it lives
    archive = Path(folder) / "skein-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))


#: Bytes of input that one task of a shuffle is meant to take.
TASK_BYTES = 128 << 20


def width(spark: SparkSession) -> int:
    """Partitions for little data that costs much CPU a row: the session's shuffle width, at least two waves of its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def input_bytes(df: DataFrame) -> int:
    """What the plan's leaves hold by the optimizer's statistics (of files: their sizes); leaves that tell none count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)


def parts(df: DataFrame) -> int:
    """Partitions of a shuffle of ``df``: as many as its input needs at TASK_BYTES each, at least :func:`width`."""
    return max(width(df.sparkSession), -(-input_bytes(df) // TASK_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least :func:`width` partitions. A scan that has as many splits stays as it is: nothing is shuffled.

    Rows are dealt out by their place in the input, so that neither a null nor a hot key gathers anywhere.
    """
    n = width(df.sparkSession)
    if input_bytes(df) >= n * int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()):
        return df
    return df.repartition(n, F.monotonically_increasing_id())
