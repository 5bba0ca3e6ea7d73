"""Session helpers: shared scratch tables, heavy-key handling, table access."""

from __future__ import annotations

import atexit
import itertools
import math
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A key is heavy when it fills at least this share of the rows, so there are never more than 1/HEAVY_SHARE of them.
HEAVY_SHARE = 1e-3
#: Below this many rows one key cannot hold up a task (``kgweave.heavy.rows`` in the session's settings overrides it).
HEAVY_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where set, else (tests, local mode) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="kgweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where


_ROOTS: list[str] = []


@atexit.register
def _clean_up() -> None:
    """Scratch tables of a local shared folder go with the process; on other file systems its owner's rules hold."""
    for root in _ROOTS:
        if root.startswith("file:") or "://" not in root:
            shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"scratch-{uuid.uuid4().hex}")
        self._ids = itertools.count(1)  # operators may save from several threads
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        path = f"{self.root}/t{next(self._ids)}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``save`` with the number of rows, counted while they are written."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")))
        n = seen.get.get("n")
        return out, out.count() if n is None else n

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a query that ends in here go at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def heavy_rows(spark: SparkSession) -> int:
    """HEAVY_ROWS, or the session's ``kgweave.heavy.rows``."""
    return int(spark.conf.get("kgweave.heavy.rows", str(HEAVY_ROWS)))


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, min_rows: int | None = None) -> list:
    """Values of ``key`` that fill at least ``share`` of the rows; about ``1/share`` values at most, whatever the size.

    One job: a frequent-items sketch of fixed size a task, merged without shuffling the keys. Its error is a fifth of the
    share at most, and it never misses a heavy key; a key too many costs nothing but its place in a broadcast.
    """
    least = heavy_rows(df.sparkSession) if min_rows is None else min_rows
    top, tracked = math.ceil(1 / share), 1 << (16 / share).__ceil__().bit_length()
    got = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {top}, {min(tracked, 1_000_000)})").alias("top")).first()
    return [x[0] for x in got["top"] or [] if x[1] >= max(least, math.ceil(got["n"] * share))]


def join_unique(big: DataFrame, unique: DataFrame, key: str, how: str = "left", heavy: list | None = None) -> DataFrame:
    """Join ``big`` to ``unique`` (one row a key) when a few keys hold much of ``big``.

    Rows of the heavy keys meet a broadcast of just those keys' rows (``len(heavy)`` rows at most); the long tail is
    shuffled as usual. ``heavy`` comes from ``heavy_keys``; none means one plain join.
    """
    if not heavy:
        return big.join(unique, key, how)
    # nulls go with the tail: isin() of null is null
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    tail = big.where(~is_heavy).join(unique, key, how)
    hot = big.where(is_heavy).join(F.broadcast(unique.where(F.col(key).isin(heavy))), key, how)
    return tail.unionByName(hot)


#: Tasks that the rows of one heavy key are spread over in a join of many rows to many.
SALTS = 64


def join_salted(left: DataFrame, right: DataFrame, key: str, heavy: list) -> DataFrame:
    """Inner join of many rows to many: left rows of heavy keys are spread over SALTS parts, their right rows copied to each."""
    if not heavy:
        return left.join(right, key)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    spread = F.when(is_heavy, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", spread).join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")


def clean_relation(c: Column | str = "relation") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def not_blank(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the row's 0-based position in the order of ``order``, by sorted ranges rather than in one window."""
    scratch = Scratch(df.sparkSession)
    ranged = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_at", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
