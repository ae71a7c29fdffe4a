"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The table of cell weights is raked: each round scales it to the
target marginal of sources, then languages, then topics, until a round changes no weight by more than ``tolerance``.
Sampling probabilities are the smallest common multiple of weight over tokens that keeps ``share`` of all tokens, at
most 1 for a cell; a document stays if the seeded hash of its id is below its cell's probability. All of it is
DataFrame operations: partial sums before the only shuffle of the corpus, raking on the table of cells alone.

A share that the cells with a weight above zero can't give is met as far as they go: all of their documents stay. Targets
that no weights can meet leave raking unsettled after its rounds; it then warns and goes on with the last weights.

Cases: null sources and languages are values of their own (a cell's values carry "=" before those that aren't null); texts without words count no tokens, and cells
without tokens keep their documents; repeated rows share their decision; an empty table gives an empty result;
columns of the input stay, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialise, table
from .interleave import DIGITS, shuffle_key

#: Exponents of the default targets: a marginal's share is its token count to this power, normalised.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
SHARE, SEED = 0.5, 23


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the form of the text: table, note, article or book."""
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(" | ")), "table").when(tokens < 100, "note").when(tokens < 2000, "article").otherwise("book")


def targets(cells: DataFrame, column: str, power: float) -> DataFrame:
    """Default target: shares of a marginal, tempered."""
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("_t"))
    sums = sums.withColumn("_t", F.when(F.col("_t") > 0, F.pow(F.col("_t").cast("double"), F.lit(power))).otherwise(0.0))
    total = sums.agg(F.sum("_t").alias("_all"))
    return sums.join(F.broadcast(total)).select(column, (F.col("_t") / F.col("_all")).alias(f"_target_{column}"))


def rake(cells: DataFrame, given: dict[str, DataFrame], tolerance: float = 1e-10, rounds: int = 240, at_once: int = 4) -> DataFrame:
    """cells (columns of ``given`` and tokens) with a column weight that meets each target marginal.

    given: by column, a table (column, _target_<column>) of shares. at_once: rounds between two looks at convergence.
    """
    for column, shares in given.items():
        cells = cells.join(shares, column, "left").fillna(0.0, [f"_target_{column}"])
    cells = materialise(cells.withColumn("weight", F.col("tokens").cast("double")).withColumn("_old", F.col("weight")), "rake")
    for _ in range(0, rounds, at_once):
        for _ in range(at_once):
            cells = cells.withColumn("_old", F.col("weight"))
            for column in given:
                total = F.sum("weight").over(W.partitionBy(column))
                cells = cells.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"_target_{column}") / total).otherwise(0.0))
        cells = materialise(cells, "rake")
        moved = cells.agg(F.max(F.abs(F.col("weight") - F.col("_old")))).first()[0]
        if moved is None or moved <= tolerance:
            break
    else:
        warnings.warn(f"raking has not settled after {rounds} rounds: the last one moved a weight by {moved}", stacklevel=2)
    return cells.drop("_old", *(f"_target_{c}" for c in given))


def calibrated(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """cells with p: min(1, c * weight / tokens), c such that the expected tokens are share of all.

    If the cells of a weight above zero hold fewer tokens than that, p is 1 for them and 0 for the others.
    """
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    order = W.orderBy(F.col("_rate").desc(), *(F.col(c) for c in ("source", "lang", "topic")))
    cells = cells.withColumn("_rate", rate)
    above = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    budget = F.sum("tokens").over(W.partitionBy()) * F.lit(share)
    cells = cells.withColumn("_c", F.when(below > 0, (budget - above) / below))
    fits = (F.col("_c") >= 0) & (F.col("_c") * F.col("_rate") <= 1 + 1e-12)
    cells = cells.withColumn("_scale", F.max(F.when(fits, F.col("_c"))).over(W.partitionBy()))
    reachable = F.when(F.col("_rate") > 0, 1.0).otherwise(0.0)
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.when(F.col("_scale").isNull(), reachable).otherwise(F.least(F.lit(1.0), F.col("_scale") * F.col("_rate"))))
    return cells.withColumn("p", p).drop("_rate", "_c", "_scale")


def keyed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with the columns of a cell and the token count, under the names given."""
    none = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    docs = docs.withColumn(names["tokens"], n_tokens(F.col("text")))
    return docs.withColumns({names["source"]: none("source"), names["lang"]: none("lang"), names["topic"]: topic_of(F.col("text"), F.col(names["tokens"]))})


def probabilities(cells: DataFrame, share: float = SHARE, temper: dict[str, float] = TEMPER) -> DataFrame:
    cells = materialise(cells, "cells")
    raked = rake(cells, {c: targets(cells, c, power) for c, power in temper.items()})
    return materialise(calibrated(raked, share).withColumn("p", F.round("p", 6)), "cells-p")


def cells_of(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    by = [F.col(names[c]).alias(c) for c in ("source", "lang", "topic")]
    return rows.groupBy(*by).agg(F.sum(names["tokens"]).alias("tokens"), F.count("*").alias("documents"))


def chosen(doc_id: Column, p: Column, seed: int = SEED) -> Column:
    return shuffle_key(doc_id, seed) / F.lit(float(16**DIGITS)) < p


def mix(docs: DataFrame, share: float = SHARE, seed: int = SEED, temper: dict[str, float] = TEMPER) -> DataFrame:
    """The sampled documents, with the columns of docs."""
    names = {c: free_name(docs, f"_{c}") for c in ("source", "lang", "topic", "tokens")}
    p = free_name(docs, "_p")
    rows = keyed(docs, names)
    cells = probabilities(cells_of(rows, names), share, temper).select(*(F.col(c).alias(names[c]) for c in ("source", "lang", "topic")), F.col("p").alias(p))
    out = rows.join(cells, [names[c] for c in ("source", "lang", "topic")])
    return out.where(chosen(F.col("doc_id"), F.col(p), seed)).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document with its cell, its sampling probability and whether it was sampled."""
    names = {"source": "_source", "lang": "_lang", "topic": "topic", "tokens": "n_tokens"}
    rows = keyed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), names).drop("text")
    rows = materialise(rows, "mixing-rows")
    cells = probabilities(cells_of(rows, names)).select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", "p")
    return rows.join(cells, ["_source", "_lang", "topic"]).select("doc_id", "source", "lang", "topic", "n_tokens", "p", chosen(F.col("doc_id"), F.col("p")).alias("kept"))


def _op7_sql(rounds: int = 40) -> str:
    """The same in DuckDB: the rounds written out as materialised tables."""
    steps, last = [], "r0"
    for i in range(rounds):
        for column in TEMPER:
            name = f"r{i}_{column}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE weight, CASE WHEN sum(weight) OVER (PARTITION BY {column}) > 0 THEN weight * t_{column} / sum(weight) OVER (PARTITION BY {column}) ELSE 0.0::DOUBLE END AS weight FROM {last})")
            last = name
    shares = ", ".join(f"s_{c} AS MATERIALIZED (SELECT {c}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {power}) ELSE 0.0::DOUBLE END AS t FROM cells GROUP BY {c})" for c, power in TEMPER.items())
    joins = " ".join(f"JOIN (SELECT {c}, t / sum(t) OVER () AS t_{c} FROM s_{c}) USING ({c})" for c in TEMPER)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source AS src, lang AS lng, coalesce('=' || source, '') AS source, coalesce('=' || lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, contains(coalesce(text, ''), ' | ') AS bars FROM documents
), e AS MATERIALIZED (
  SELECT doc_id, src, lng, source, lang, n_tokens, CASE WHEN bars THEN 'table' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 2000 THEN 'article' ELSE 'book' END AS topic FROM d
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM e GROUP BY ALL),
{shares},
r0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM cells {joins}),
{", ".join(steps)},
q AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0.0::DOUBLE END AS rate FROM {last}),
b AS (
  SELECT *, ({SHARE} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(weight) OVER (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c FROM q
), k AS (SELECT *, max(CASE WHEN c >= 0 AND c * rate <= 1 + 1e-12 THEN c END) OVER () AS scale FROM b),
p AS (SELECT source, lang, topic, round(CASE WHEN tokens = 0 THEN 1.0::DOUBLE ELSE CASE WHEN scale IS NULL THEN (rate > 0)::INT::DOUBLE ELSE least(1.0::DOUBLE, scale * rate) END END, 6) AS p FROM k)
SELECT doc_id, src AS source, lng AS lang, topic, n_tokens, p, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)!r}::DOUBLE < p AS kept
FROM e JOIN p USING (source, lang, topic)
"""


OP7_SQL = _op7_sql()
