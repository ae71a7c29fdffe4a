"""Sharding by proportional stratified interleaving.

Rows of each stratum (source) are shuffled by a seeded hash and ranked; row ``r`` of ``n`` gets the fractional rank
``(2r - 1) / 2n``. All rows sorted by that rank form a sequence of which every stretch has the mixture of the whole;
cut into equal stretches, shard sizes differ by one row at most and every shard matches the mixture.

No window ever holds a whole stratum. Ranks are made in two steps: rows are dealt by (stratum, hash prefix), a small
table of counts gives each prefix its offset, and row_number runs inside one prefix. Hashes are uniform, so a stratum
that holds a third of all rows is spread like the others. The global order is made likewise, from prefixes of the
fractional rank.

Cases: null strata are a stratum of their own; null ids and texts are hashed as such; repeated rows get places of
their own; shards may stay empty if there are fewer rows than shards; an empty table gives an empty result; columns
of the input stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialise, table, unlike

#: Hash digits (hexadecimal) of a shuffle key.
DIGITS = 13


def shuffle_key(doc_id: Column, seed: int = 11) -> Column:
    """Seeded 52-bit hash of an id; the same in any engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str, total: str) -> DataFrame:
    """Add rank (from 1, by group) and total (rows of the group); bucket must grow with order."""
    b, n, before = (free_name(df, x) for x in ("_bucket", "_in_bucket", "_before"))
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*group, b).agg(F.count("*").alias(n))
    w = W.partitionBy(*group)
    counts = counts.select(*group, b, F.coalesce(F.sum(n).over(w.orderBy(b).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum(n).over(w).alias(total))
    place = F.row_number().over(W.partitionBy(*group, b).orderBy(*order))
    return df.join(counts, [*group, b]).withColumn(rank, F.col(before) + place).drop(b, before)


def interleave(docs: DataFrame, shards: int = 16, stratum: str = "source", id_col: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 11, rows_per_bucket: int = 16384) -> DataFrame:
    """docs with columns shard (int) and slot (long, gapless from 0 in each shard) added.

    Input columns of these two names, in any letter case, are replaced; all others stay.

    ties: columns that order rows of equal ids. Give narrow rows where texts aren't needed: rows are shuffled twice.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in unlike(docs.columns, ["shard", "slot"])))
    total = docs.count()
    bits = max(0, -(-total // rows_per_bucket) - 1).bit_length()
    s, key, rank, n, part, pos, rows = (free_name(docs, x) for x in ("_stratum", "_key", "_rank", "_rows", "_part", "_pos", "_total"))
    keyed = docs.withColumn(s, F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    keyed = keyed.withColumn(key, shuffle_key(F.col(id_col), seed))
    by = _ranked(keyed, [s], F.shiftright(F.col(key), 4 * DIGITS - bits), [key, id_col, *ties], rank, n)
    by = by.withColumn(part, (2.0 * F.col(rank) - 1) / (2.0 * F.col(n))).drop(rank, n, key)
    by = materialise(by, "interleave-ranks")
    one = free_name(by, "_one")
    by = _ranked(by.withColumn(one, F.lit(0)), [one], F.floor(F.col(part) * (1 << bits)), [part, s], pos, rows)
    at = F.col(pos) - 1
    out = by.withColumn("shard", F.expr(f"(`{pos}` - 1) * {shards} div `{rows}`").cast("int"))
    first = F.expr(f"(shard * `{rows}` + {shards - 1}) div {shards}")
    return out.withColumn("slot", (at - first).cast("long")).drop(s, part, pos, rows, one)


def sized(docs: DataFrame) -> DataFrame:
    """Rows of ids, sources and digests of the texts, which is all that sharding needs."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def op8(spark, sf_dir: str) -> DataFrame:
    placed = interleave(materialise(sized(table(spark, sf_dir, "documents")), "interleave-sized"), ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP8_SQL = """
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents
), e AS (
  SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS u, coalesce('=' || source, '') AS s
  FROM d, tab
), f AS (
  SELECT *, (2.0::DOUBLE * row_number() OVER (PARTITION BY s ORDER BY u, doc_id, text_crc32, size) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY s)) AS part FROM e
), g AS (SELECT *, row_number() OVER (ORDER BY part, s) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // n)::INTEGER AS shard, pos - ((pos * 16 // n) * n + 15) // 16 AS slot, NULL::INTEGER AS grown_shard
FROM g
"""
