"""A page view over the test tables: every document is laid out as one printed page of a bounded volume.

A volume is a source's documents of one block of 500 ids. A page has a running head (left out on every 13th), body
lines of 60 letters with words broken by hyphens, notes on every third document (the middle marker is misread on every
seventh) and a folio ten above its position (left out on every 13th page, misread on every 17th). The view makes
deterministic pages whose truth is known; ``SQL`` says the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Misreadings of the digits 1 to 9 as printed by the view.
GLYPHS = "lzBASbT&g"
WIDTH = 60


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (volume_id, pos, doc_id, lines array<string>)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    volume = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string"))
    docs = docs.select(volume.alias("volume_id"), "doc_id", "text")
    docs = docs.withColumn("pos", F.row_number().over(W.partitionBy("volume_id").orderBy("doc_id", "text")))
    n = F.lit(3) * (F.col("pos") % 2) + 1

    def cut(para):
        def piece(i):
            both = F.substr(para, i * WIDTH + WIDTH, F.lit(2)).rlike(r"^\p{L}\p{L}$")
            return F.concat(F.substr(para, i * WIDTH + 1, F.lit(WIDTH)), F.when(both, "-").otherwise(""))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(para) - 1) / WIDTH), F.lit(0)).cast("int")), piece)

    body = F.flatten(F.transform(F.split("text", "\n"), cut))
    noted = F.col("doc_id") % 3 == 0
    misread = (F.col("doc_id") % 7 == 0) & noted

    def marked(line, i):
        number = F.when(misread & (i == 1), F.substr(F.lit(GLYPHS), n + i, F.lit(1))).otherwise((n + i).cast("string"))
        return F.when(noted & (i < 3), F.regexp_replace(line, F.lit(r"^(\p{L}+)([ .,])"), F.concat(F.lit("$1"), number, F.lit("$2")))).otherwise(line)

    head = F.when(F.col("pos") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("STUDIES IN "), F.upper("volume_id"))))
    notes = F.when(noted, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat((n + i).cast("string"), F.lit(") Note "), (n + i).cast("string"), F.lit(" of document "), F.col("doc_id").cast("string"), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    folio = F.when(F.col("pos") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("pos") + 10 + F.when(F.col("pos") % 17 == 0, 100).otherwise(0)).cast("string")))
    return docs.withColumn("body", body).select("volume_id", "pos", "doc_id", F.concat(head, F.transform("body", marked), notes, folio).alias("lines"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (volume_id, pos, ln, line), ln from 0."""
    return pages(spark, sf_dir).select("volume_id", "pos", F.posexplode("lines").alias("ln", "line"))


#: Common tables for DuckDB: src, pg, body and page_lines.
SQL = rf"""
src AS (SELECT doc_id, coalesce(source, 'none') || '-' || (doc_id // 500) AS volume_id, coalesce(text, '') AS text FROM documents),
pg AS (SELECT volume_id, doc_id, text, row_number() OVER (PARTITION BY volume_id ORDER BY doc_id, text) AS pos, 3 * (row_number() OVER (PARTITION BY volume_id ORDER BY doc_id, text) % 2) + 1 AS n FROM src),
para AS (SELECT volume_id, pos, doc_id, n, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS k FROM pg),
cut AS (SELECT *, unnest(range(greatest((length(p) - 1) // {WIDTH} + 1, 1))) AS i FROM para),
laid AS (SELECT volume_id, pos, doc_id, n, row_number() OVER (PARTITION BY volume_id, pos ORDER BY k, i) - 1 AS b,
  substr(p, {WIDTH} * i + 1, {WIDTH}) || CASE WHEN regexp_matches(substr(p, {WIDTH} * i + {WIDTH}, 2), '^\p{{L}}\p{{L}}$') THEN '-' ELSE '' END AS line FROM cut),
body AS (SELECT volume_id, pos, b, CASE WHEN doc_id % 3 = 0 AND b < 3 THEN regexp_replace(line, '^(\p{{L}}+)([ .,])', '\1' || CASE WHEN doc_id % 7 = 0 AND b = 1 THEN substr('{GLYPHS}', (n + b)::INT, 1) ELSE (n + b)::VARCHAR END || '\2') ELSE line END AS line FROM laid),
parts AS (
  SELECT volume_id, pos, 0 AS part, 0 AS b, 'STUDIES IN ' || upper(volume_id) AS line FROM pg WHERE pos % 13 <> 0
  UNION ALL SELECT volume_id, pos, 1, b, line FROM body
  UNION ALL SELECT volume_id, pos, 2, i, (n + i) || ') Note ' || (n + i) || ' of document ' || doc_id || '.' FROM pg, range(3) t(i) WHERE doc_id % 3 = 0
  UNION ALL SELECT volume_id, pos, 3, 0, (pos + 10 + CASE WHEN pos % 17 = 0 THEN 100 ELSE 0 END)::VARCHAR FROM pg WHERE pos % 13 <> 0
),
page_lines AS MATERIALIZED (SELECT volume_id, pos::INT AS pos, (row_number() OVER (PARTITION BY volume_id, pos ORDER BY part, b) - 1)::INT AS ln, line FROM parts)
"""
