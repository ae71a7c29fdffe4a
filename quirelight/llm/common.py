"""Helpers shared by the corpus operators: tables, the shared folder, materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def remembered(f, most: int = 4096):
    """f with its latest results kept by arguments. Unlike functools' caches it travels to workers by value."""
    kept: dict = {}

    def call(*args):
        if args not in kept:
            if len(kept) >= most:
                kept.clear()
            kept[args] = f(*args)
        return kept[args]

    call.__doc__ = f.__doc__
    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is unset and all runs on one machine (tests, a notebook) is a temporary folder made and
    kept in the session; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quirelight.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirelight-")
        spark.conf.set("quirelight.shared.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; letters beyond ASCII stay as they are."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def row_hash(*cols: str) -> Column:
    """A hash of columns in which nulls count: Spark's own skips them, so (null, 1) and (1, null) would be the same."""
    return F.xxhash64(*(x for c in cols for x in (F.isnull(c), F.col(c))))


def unlike(columns: list[str], taken: list[str]) -> list[str]:
    """The columns whose names aren't among those taken, whatever their letter case."""
    names = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in names]


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, rows: int, of: int) -> DataFrame:
    """Up to rows rows of df (which has ``of`` rows) by the hash of key: the same rows wherever they lie.

    Hashes above what can be needed are left out before the sort, so that no task gathers more than a few times rows.
    """
    h = free_name(df, "_hash")
    df = df.withColumn(h, F.xxhash64(key))
    share = (2 * rows + 50) / max(of, 1)
    if share < 1:
        df = df.where(F.col(h) < int(-(1 << 63) + share * (1 << 64)))
    return df.orderBy(h, key).limit(rows).drop(h)


def bounded_samples(df: DataFrame, key: Column, group: str, rows: int, of: dict[str, int]) -> DataFrame:
    """bounded_sample() of each group (which have ``of`` rows by value), in one pass over df."""
    h, place = free_name(df, "_hash"), free_name(df, "_place")
    share = {v: min(1.0, (2 * rows + 50) / max(n, 1)) for v, n in of.items()}
    limits = F.create_map(*(x for v, p in share.items() for x in (F.lit(v), F.lit(int(-(1 << 63) + p * ((1 << 64) - 2049))))))
    df = df.withColumn(h, F.xxhash64(key)).where(F.col(h) <= F.element_at(limits, F.col(group)))
    first = F.row_number().over(W.partitionBy(group).orderBy(h, key))
    return df.withColumn(place, first).where(F.col(place) <= rows).drop(h, place)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row even where use() refers to it many times or inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)
