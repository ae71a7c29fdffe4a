"""Benchmark decontamination by winnowing.

Words of documents and benchmark items are hashed in k-grams (5 words). Of every ``window - k + 1`` consecutive k-grams
the smallest hash is a fingerprint; a span of ``window`` words that a document shares with an item has the same
smallest k-gram in both, so a join on fingerprints misses none. Documents with a common fingerprint are looked at
again: each common k-gram gives a diagonal (document position minus item position), the item is laid along it, and the
hit is extended over all its equal words; what has ``window`` consecutive equal words is a hit. Items shorter than the
window count as one window; their n-grams are fingerprints of their own.

All of it is DataFrame expressions. Fingerprints of a document stay inside its row and are combined again before the
only shuffle of the corpus if the benchmark's fingerprints are few enough to broadcast (their number is looked up);
beyond that, fingerprints are joined by shuffle.

Cases: null texts have no words; items without words match nothing; repeated documents get a row each; repeated items
count once by id; a null item id is the empty id; an empty benchmark leaves every document clean; an empty document
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialise, row_hash, table

#: A word, as a pattern: no ASCII but letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, WINDOW = 5, 10
#: Rows of a table that may be broadcast at most (a fingerprint or key each).
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of all k-grams of an array of word hashes."""
    return F.transform(_upto(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k))))


def grams_of(wordlist: str, k: int) -> Column:
    return let(F.transform(wordlist, lambda w: F.xxhash64(w)), lambda h: _grams(h, k))


def _smallest(grams: Column, w: int) -> Column:
    return F.transform(_upto(F.size(grams) - (w - 1)), lambda i: F.least(*(F.get(grams, i + j) for j in range(w))))


def fingerprints(wordlist: Column, lengths: list[int], k: int = K, window: int = WINDOW) -> Column:
    """Distinct winnowed fingerprints of a text, and all its n-grams of the given lengths."""

    def of(h: Column) -> Column:
        out = let(_grams(h, k), lambda g: _smallest(g, window - k + 1))
        return F.array_distinct(F.concat(out, *(_grams(h, n) for n in lengths)) if lengths else out)

    return let(F.transform(wordlist, lambda w: F.xxhash64(w)), of)


def _bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, key, n_words, n_hit, n_items, items), one a document; key is a hash of id and text.

    docs: doc_id and text; benchmark: item_id and text.
    """
    # The benchmark: words, and the position of each fingerprint's k-grams.
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    items = materialise(items.withColumn("item_key", F.xxhash64("item", F.to_json("iw"))), "decontam-items")
    lengths = sorted(r[0] for r in items.where(F.size("iw") < window).select(F.size("iw")).distinct().collect())  # fewer than window values
    picked = items.select("item_key", fingerprints(F.col("iw"), [], k, window).alias("fps"), "iw", F.size("iw").alias("n"))
    every = F.transform(grams_of("iw", k), lambda g, i: F.struct(g.alias("h"), i.alias("q")))
    long = picked.where(F.col("n") >= window).select("item_key", F.explode(F.filter(every, lambda g: F.array_contains(F.col("fps"), g["h"]))).alias("g"))
    grams = long.select("item_key", "g.h", "g.q")
    for n in lengths:
        short = picked.where(F.col("n") == n).select("item_key", F.explode(grams_of("iw", n)).alias("h"))
        grams = grams.unionByName(short.withColumn("q", F.lit(0)))
    grams = materialise(grams, "decontam-grams")
    n_grams, n_items = grams.count(), items.count()

    # All documents once: words, fingerprints, and whether one of them is the benchmark's.
    key = row_hash("doc_id", "text").alias("key")
    every = docs.select("doc_id", key, words(F.col("text")).alias("w"))
    every = every.select("doc_id", "key", F.col("w"), F.size("w").alias("n_words"))
    prints = every.select("doc_id", "key", "n_words", F.posexplode_outer(fingerprints(F.col("w"), lengths, k, window)).alias("pos", "h"))
    known = grams.select("h", F.lit(1).alias("known")).distinct()
    seen = prints.join(_bounded(known, n_grams), "h", "left").groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max(F.coalesce("known", F.lit(0))).alias("known"),
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).cast("int").alias("copies"),
    )
    seen = materialise(seen, "decontam-seen")

    # Documents that share a fingerprint: positions, diagonals, extension.
    marked = seen.where("known = 1").select("key").distinct()
    cand = every.select("key", "w").join(_bounded(marked, marked.count(), 1_000_000), "key", "left_semi")
    cand = materialise(cand, "decontam-candidates")
    places = None
    for n in [k, *lengths]:
        at = cand.select("key", F.posexplode(grams_of("w", n)).alias("p", "h"))
        places = at if places is None else places.unionByName(at)
    lanes = places.join(_bounded(grams, n_grams), "h").select("key", "item_key", (F.col("p") - F.col("q")).alias("d")).distinct()
    lanes = lanes.join(_bounded(items, n_items, 100_000), "item_key")
    lanes = materialise(lanes, "decontam-lanes").join(cand, "key")
    from_ = F.greatest(F.col("d"), F.lit(0))
    skip = F.greatest(-F.col("d"), F.lit(0))
    there = F.slice("w", from_ + 1, F.greatest(F.size("iw") - skip, F.lit(0)))
    along = F.arrays_zip(F.slice("iw", skip + 1, F.size("iw")).alias("a"), there.alias("b"))
    equal = F.transform(along, lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    need = F.least(F.size("iw"), F.lit(window))
    starts = let(equal, lambda e: F.filter(_upto(F.size(e) - need + 1), lambda s: F.forall(F.slice(e, s + 1, need), lambda x: x)))
    runs = lanes.select("key", "item", need.alias("need"), from_.alias("from"), F.explode(starts).alias("s"))
    runs = runs.select("key", "item", (F.col("from") + F.col("s")).alias("p"), "need").distinct()
    runs = materialise(runs, "decontam-runs")
    hit = runs.select("key", "p", "need").distinct().select("key", F.explode(F.sequence("p", F.col("p") + F.col("need") - 1)).alias("p")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = runs.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))

    out = seen.join(hit.join(named, "key"), "key", "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def op3(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), m AS (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM m)),
lens AS (SELECT DISTINCT n FROM m),
dw AS (SELECT k, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens)),
hits AS (SELECT k, item, dw.n, s FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
cover AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hits) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (k) LEFT JOIN named USING (k)
"""
