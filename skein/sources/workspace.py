"""Reading workspaces, golden query files, candidate registries; writing results."""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text

FILE_SCHEMA = "path string, language string, content string, sha256_hash string, mtime double, binary boolean"
GOLDEN_SCHEMA = (
    "query_id string, query_text string, collection string, tags array<string>, ground_truth string, hop2_query_text string, labels map<string,int>, aliases map<string,int>, "
    "anchors array<struct<rel_path string, symbol string, line int, grade int>>"
)


def listed_files(spark: SparkSession, root: str, excluded: list[str]) -> tuple[str, list[str]]:
    """(the root's address, relative paths of all files below it); folders of the names ``excluded`` are not entered."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/")
    todo, found = [top], []
    while todo:
        for status in fs.listStatus(todo.pop()):
            if not status.isDirectory():
                found.append(status.getPath().toString()[len(base) + 1 :])
            elif (name := status.getPath().getName()) not in excluded and not name.startswith(".venv"):
                todo.append(status.getPath())
    return base, sorted(found)


def _escaped(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def scan_workspace(spark: SparkSession, root: str, ignore: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """path, language, content, sha256_hash, mtime, binary of the files below ``root`` that a run would index.

    Excluded folders, ignored paths, files without a language and binary files (a NUL among the first 512 bytes) are left
    out; paths are relative to the root. Excluded folders are never entered, and paths are chosen before any content is read.
    """
    base, paths = listed_files(spark, root, excluded or text.EXCLUDED)
    wanted = spark.createDataFrame([(p,) for p in paths], "rel string").withColumn("language", text.language_of(F.col("rel")))
    wanted = wanted.where(~text.excluded(F.col("rel"), excluded or text.EXCLUDED) & F.col("language").isNotNull())
    patterns = [p for p in map(text.ignore_pattern, ignore or []) if p]
    if patterns:
        wanted = wanted.where(~F.col("rel").rlike("|".join(patterns)))
    kept = [r.rel for r in wanted.select("rel").toLocalIterator()]  # the names of one workspace's files, which the listing holds anyway
    if not kept:
        return spark.createDataFrame([], FILE_SCHEMA)
    files = spark.read.format("binaryFile").load([f"{base}/{_escaped(p)}" for p in kept])
    full = F.regexp_replace("path", "^file:/+", "/")
    rows = files.withColumn("rel", F.substring(full, F.lit(len(base.removeprefix("file:")) + 2), F.length(full))).withColumn("language", text.language_of(F.col("rel")))
    head = F.substring(F.hex(F.substring("content", 1, 512)), 1, 1024)
    binary = F.regexp_like(head, F.lit("^(?:..)*?00"))
    return rows.where(~binary).select(
        F.col("rel").alias("path"), "language", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256_hash"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.lit(False).alias("binary"),
    )


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The golden queries of a file of JSON lines; blank lines and those that begin with ``#`` are none."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#|$)"))
    return lines.select(F.from_json("value", GOLDEN_SCHEMA).alias("q")).select("q.*")


def read_candidates(path: str, status: str | None = None) -> list[dict]:
    """Model candidates of a JSON or (where a YAML reader is installed) YAML registry, by status."""
    content = Path(path).read_text(encoding="utf-8")
    try:
        entries = json.loads(content)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML reader is needed for this registry") from e
        entries = yaml.safe_load(content)
    entries = entries.get("candidates", []) if isinstance(entries, dict) else entries
    return [e for e in entries if status is None or e.get("status") == status]


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def envelope(df: DataFrame) -> DataFrame:
    """Each row as the JSON body of a successful response."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("body"))


_BODIES = {
    "py": "def work_{i}(x):\n    return x + {i}\n\n\nclass Part{i}:\n    def run(self):\n        return work_{i}(1)\n",
    "ts": "export function work{i}(x: number): number {{\n  return x + {i};\n}}\n",
    "go": "package p{i}\n\nfunc Work{i}(x int) int {{\n\treturn x + {i}\n}}\n",
    "java": "package p;\n\npublic class Part{i} {{\n    public int run(int x) {{\n        return x + {i};\n    }}\n}}\n",
    "yaml": "name: part-{i}\nsteps:\n  - id: {i}\n    run: work\n",
}


def generate_corpus(root: str, n_files: int, seed: int = 1234) -> dict[str, int]:
    """Writes a small corpus of five languages (30, 25, 15, 15 and 15 parts of 100); the same for the same seed. Returns files by suffix."""
    rng, counts = random.Random(seed), dict.fromkeys(_BODIES, 0)
    for i in range(n_files):
        ext = rng.choices(["py", "ts", "go", "java", "yaml"], weights=[30, 25, 15, 15, 15])[0]
        at = Path(root) / f"pkg_{i % 12}" / f"mod_{(i // 12) % 5}" / f"file_{i}.{ext}"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(_BODIES[ext].format(i=i))
        counts[ext] += 1
    return counts
