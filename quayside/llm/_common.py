"""Shared helpers: tables kept in the cluster's shared folder, and bounded blocks of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, one on this machine, if all of Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return qualified(spark, f"{(root or tempfile.mkdtemp(prefix='quayside-')).rstrip('/')}/quayside-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's default file system has it, for readers and writers that aren't Spark's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", full)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than its own tasks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """``df`` written and read again. Its number of rows and further metrics are taken while it is written."""
        self.n += 1
        path, seen = f"{self.root}/{self.n:03d}-{name}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._quayside_path, kept._quayside_seen = path, seen.get
        return kept

    @staticmethod
    def rows(kept: DataFrame) -> int:
        """The number of rows of a kept table."""
        return kept._quayside_seen.get("rows") or 0

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if t is not None:
                path = jvm.org.apache.hadoop.fs.Path(t._quayside_path)
                path.getFileSystem(conf).delete(path, True)


def text_of(name: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about ``max_bytes`` of text; a longer text is a block of its own."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def row_id() -> Column:
    """Tells rows apart that are alike in every column; stable over re-reads of the same files."""
    return F.monotonically_increasing_id()


SALTS = 32


def salt(key: str) -> Column:
    """Deals the rows of a hot group into ``SALTS`` parts."""
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")


def salts() -> Column:
    """An aggregate of ``salt``: the parts that a group has rows in, a bit for each."""
    return F.expr("bit_or(shiftleft(1L, salt))").alias("salts")


def each_salt() -> Column:
    """A row for each part in ``salts``, so that what was aggregated over a group meets the group's rows part by part."""
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    return F.explode(used).alias("salt")


def free_name(docs: DataFrame) -> str:
    """A name for a column that ``docs`` doesn't have yet."""
    name, known = "_quayside_row", {c.lower() for c in docs.columns}
    while name in known:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a number for each row that is the same however often it is read.

    A plan without a shuffle gives each partition the same rows in the same order when it is computed again. Behind a
    shuffle rows can come in another order, so there the numbered rows are written first.
    """
    out = docs.withColumn(name, row_id())
    shuffled = "Exchange" in docs._jdf.queryExecution().executedPlan().toString()
    return Scratch(docs.sparkSession).keep(out, "numbered") if shuffled else out
