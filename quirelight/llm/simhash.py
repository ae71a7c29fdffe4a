"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance, closed to components.

Fingerprints are made in Arrow batches (one XXH64 a shingle); all else is DataFrame operations on distinct
fingerprints. A fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at most ``distance`` bits
agree in at least ``blocks - distance`` of them, so each choice of that many blocks makes a join key, and every close
pair meets under one of them. Buckets of up to ``bucket`` fingerprints are compared pair by pair. A larger bucket never
is: there every member emits itself and its one-bit neighbours (outside the key), and members that share such a
neighbour are linked in a star. Two fingerprints at distance 1 or 2 always share one, no more than 65 fingerprints can,
and any two that do are at most 2 apart, so this is exact and linear in the bucket (it needs ``distance <= 2``).

Cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any other; repeated
rows are rows of their own; an empty table gives an empty result; other columns are ignored or kept by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, row_hash


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text as a signed 64-bit integer. Lower-cases A-Z, splits at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    joined = [b" ".join(words)] if n < 1 else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, seed) for x in joined), dtype="<u8", count=max(n, 1))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t, shingle, seed) for t in s], dtype="int64")

    return of(docs[text])


def _spans(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_links(fps: DataFrame, distance: int = 2, blocks: int = 4, bucket: int = 32) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints of column ``fp`` at Hamming distance up to ``distance``.

    In buckets of more than ``bucket`` members only stars are returned that connect the same fingerprints.
    """
    assert 1 <= distance <= 2 < blocks, "large buckets are handled exactly for distances of 1 and 2"
    spans = _spans(blocks)
    keys = []
    for kept in combinations(range(blocks), blocks - distance):
        keys.append(_signed(sum(((1 << (hi - lo)) - 1) << lo for lo, hi in (spans[i] for i in kept))))
    masks = F.array(*(F.lit(m) for m in keys))
    rows = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    counts = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(counts, ["t", "key"]), "simhash-buckets")

    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    small = shared.where(F.col("n") <= bucket)
    left, right = small.select("t", "key", F.col("fp").alias("u")), small.select("t", "key", F.col("fp").alias("v"))
    pairs = left.join(right, ["t", "key"]).where("u < v").where(near).select("u", "v")

    ones = F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(64)))
    mask = F.element_at(masks, F.col("t") + 1)
    flipped = F.filter(ones, lambda b: b.bitwiseAND(mask) == 0)
    around = shared.where(F.col("n") > bucket).select("t", "fp", F.explode(flipped).alias("bit"))
    around = around.select("t", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("variant"))
    stars = around.groupBy("t", "variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v").where(near)
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v): rows (node, root) for every node that has a link.

    Each round hooks every node to its smallest neighbour, follows parents twice and contracts the graph. The minimum
    is combined before each shuffle, so a node with many neighbours costs no more than its partial minima.
    """
    edges = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "cc-edges")
    found = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root"))
        up = materialise(up, "cc-parents")
        for _ in range(2):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = up.join(over, "root").select("node", F.col("above").alias("root"))
        up = materialise(up, "cc-parents")
        a = up.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = up.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = edges.join(a, "u").join(b, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        edges = materialise(edges.where("u < v").distinct(), "cc-edges")
        if found is None:
            found = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = found.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            found = materialise(found, "cc-roots")
    else:
        raise RuntimeError(f"components not closed after {rounds} rounds")
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Rows (id, fp, component_id): the fingerprint and the smallest id reachable over links, one row a document."""
    made = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprints(docs, text, shingle, seed).alias("fp")), "simhash-fingerprints")
    distinct = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(close_links(distinct.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    labelled = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of = labelled.join(least, "root").select("fp", "component_id")
    return made.join(of, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- wide fingerprints, for similarity thresholds

#: Bits of a wide fingerprint: products of two of the 64 signs of a shingle's hash.
PAIRS = np.triu_indices(64, 1)
WIDE = len(PAIRS[0])
#: Words of 64 bits that are full of them.
WORDS = WIDE // 64


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else {b" ".join(words)} if words else set()
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined), dtype="<u8", count=len(joined))


def wide_fingerprint(h: np.ndarray) -> tuple[int, bytes]:
    """A 64-bit SimHash and one of 2016 bits, of the hashes of a whole text's distinct shingles.

    Bit (a, b) of the wide one is the sign of the sum, over shingles, of the product of bits a and b of the hash as
    signs; the products are pairwise independent, and one matrix product finds all sums. Ties take the sign of the
    shingle with the smallest hash. Texts without words have zeros.
    """
    if not len(h):
        return 0, bytes(WIDE // 8)
    total, gram = np.zeros(64, np.float64), np.zeros((64, 64), np.float64)
    for at in range(0, len(h), 1 << 13):
        signs = np.unpackbits(h[at : at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        signs *= 2
        signs -= 1
        total += signs.sum(0)
        gram += signs.T @ signs
    least = np.unpackbits(h.min().reshape(1).view(np.uint8), bitorder="little") * 1.0 - 0.5
    small = np.packbits(total + least > 0, bitorder="little").view("<i8")[0]
    return int(small), np.packbits(gram[PAIRS] + least[PAIRS[0]] * least[PAIRS[1]] > 0, bitorder="little").tobytes()


def bits_apart(similarity: float) -> float:
    """Share of bits in which SimHashes of two sets of shingles with this Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


#: Blocks that fingerprints are joined on: so many tables, and in each so many bits of the fingerprint and so many minima of shingle hashes.
TABLES, BITS, MINIMA = 24, 2, 5


def block_recall(similarity: float, tables: int = TABLES, bits: int = BITS, minima: int = MINIMA) -> float:
    """Probability that two texts of this similarity share a block. It doesn't depend on the size of the corpus."""
    return 1 - (1 - (1 - bits_apart(similarity)) ** bits * similarity**minima) ** tables


def _drawn(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


#: Which bits a table takes, and the constants that give each minimum an order of shingles of its own.
_ORDER = np.concatenate([np.random.default_rng(i).permutation(WIDE)[: WIDE // BITS * BITS] for i in range(-(-TABLES // (WIDE // BITS)))])[: TABLES * BITS]
_FLIPS, _FACTORS = _drawn(101, TABLES * MINIMA), _drawn(102, TABLES * MINIMA) | np.uint64(1)


def block_keys(h: np.ndarray, wide: bytes) -> np.ndarray:
    """A key for each table: a hash of the table's number, its bits of the wide fingerprint and its minima of the shingle hashes h."""
    least = np.full(TABLES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 11):
        mixed = (h[at : at + (1 << 11), None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, mixed.min(0))
    bits = np.unpackbits(np.frombuffer(wide, np.uint8), bitorder="little")[_ORDER].reshape(TABLES, BITS)
    key = np.arange(1, TABLES + 1, dtype=np.uint64) << np.uint64(32) | np.packbits(bits, axis=1)[:, 0].astype(np.uint64)
    for x in least.reshape(TABLES, MINIMA).T:
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view("<i8")


#: Blocks of further bits that the rest of a large bucket is joined on.
SUBTABLES, SUBWIDTH = 12, 10
#: Narrow rows (ids, at most two a row) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def lightly(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A kept table of narrow rows, to be broadcast if it has no more than ``most``: what it is joined to then stays where it is."""
    return F.broadcast(df) if df.count() <= most else df


def similar_links(docs: DataFrame, similarity: float = 0.8, bucket: int = 512) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) between nodes whose sets of word shingles are as similar or more, and membership (row, node).

    docs: row (long) and text. A node is a distinct wide fingerprint, named by its smallest row. Nodes are joined on blocks:
    BITS bits of the wide fingerprint together with MINIMA minima of shingle hashes under orders of their own. A pair at the
    similarity shares one of the TABLES blocks with a probability of block_recall() (0.998 at 0.8) at each size of the
    corpus; the minima keep apart what is not alike, which bits alone can only do by growing wider, and rarer, with the
    corpus. What meets in a block is held to a Hamming distance of 64 bits first, then of all 2016 (three standard
    deviations beyond the expected one), then to the sets of shingles.

    Buckets of more than ``bucket`` open nodes are never paired out. All nodes of such a bucket are compared, by all bits and then
    by their sets of shingles, to its leader, the open node nearest to the majority of the bucket's bits (of copies with
    small changes, the original or one like it). A node that links to leaders connect with its own is no longer open: it
    needs no pair with others of the kind, but stays as long as an open node of the bucket may be near it (by the triangle
    inequality over the distances to the leader). Where no more than ``bucket`` nodes are open, those are compared with all
    that stay, so that no node meets more than ``bucket`` others; the rest is joined on further blocks within the bucket,
    and so on until no such bucket is left (a leader leaves its bucket, so each step shrinks each bucket). Then each bucket's
    nodes are compared to its smallest open one, and pairs are made last, of nodes that no link so far connects.
    """

    @F.pandas_udf("struct<fp: bigint, words: array<bigint>, keys: array<bigint>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for t in s:
                h = shingle_hashes(t)
                fp, wide = wide_fingerprint(h)
                rows.append((fp, np.frombuffer(wide + bytes(-len(wide) % 8), "<i8"), block_keys(h, wide)))
            yield pd.DataFrame(rows, columns=["fp", "words", "keys"])

    made = docs.select("row", of("text").alias("x"))
    made = made.select("row", F.monotonically_increasing_id().alias("at"), "x.fp", "x.words", "x.keys", F.xxhash64("x.words").alias("hash"))
    made = materialise(made, "wide-fingerprints")
    nodes = materialise(made.groupBy("fp", "hash").agg(F.min("row").alias("node"), F.min_by("at", "row").alias("first")), "wide-nodes")
    members = made.select("row", "at", "fp", "hash").join(nodes, ["fp", "hash"])
    members = materialise(members.select("row", "at", "node", "first"), "wide-members")
    copies = materialise(members.where("at <> first").select("at"), "wide-copies")
    firsts = made.join(lightly(copies), "at", "left_anti").select(F.col("row").alias("node"), "fp", "words", "keys")
    members = members.select("row", "node")
    wide = firsts.select("node", "words")
    apart = bits_apart(similarity)
    near64 = int(64 * apart + 3 * (64 * apart * (1 - apart)) ** 0.5)
    spread = (WIDE * apart * (1 - apart)) ** 0.5
    near = int(WIDE * apart + 3 * spread)
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= near64

    @F.pandas_udf("array<bigint>")
    def hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([shingle_hashes(t).view("<i8") for t in s], dtype=object)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Rows (node, set) of the kept nodes (node): the hashes of the distinct shingles."""
        of_nodes = docs.select(F.col("row").alias("node"), "text").join(lightly(nodes), "node", "left_semi")
        return of_nodes.dropDuplicates(["node"]).select("node", hashes("text").alias("set"))

    def alike(a: str, b: str) -> Column:
        common = F.size(F.array_intersect(a, b))
        return common >= similarity * (F.size(a) + F.size(b) - common)

    def counted(keyed: DataFrame) -> DataFrame:
        """Rows (key, node, fp, open, n, opened) of keys that have several nodes, one of them open."""
        counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("open").alias("opened")).where("n > 1 and opened > 0")
        return materialise(keyed.join(counts, "key"), "wide-blocks")

    def paired(rows: DataFrame, most: int = 4096) -> DataFrame:
        """Pairs (u, v), near by all bits, of the open nodes of each key with its others of another comp; the others are dealt over parts of about ``most``."""
        rows = rows.join(wide.join(lightly(materialise(rows.select("node").distinct(), "wide-wanted")), "node", "left_semi"), "node")
        parts = F.ceil(F.col("n") / most).cast("int")
        mate = [F.col(x).alias(y) for x, y in (("node", "v"), ("fp", "other"), ("open", "too"), ("comp", "apart"), ("words", "others"))]
        mate = rows.select("key", F.pmod(F.hash("node"), parts).alias("part"), *mate)
        opened = rows.where("open").select("key", "node", "fp", "comp", "words", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        pairs = opened.join(mate, ["key", "part"]).where("comp <> apart and (node < v or not too)").where(close).where(bits_between("words", "others") <= near)
        return pairs.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))

    def labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """rows with comp, the root that links to leaders give to the node."""
        if roots is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(lightly(roots), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def bits_between(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    open_ = counted(firsts.select("node", "fp", F.lit(True).alias("open"), F.explode("keys").alias("key")))
    meeting, linked, roots = [], [], None
    for step in count():
        meeting.append(open_.where(F.col("opened") <= bucket).select("key", "node", "fp", "open", "n"))
        large = open_.where(F.col("opened") > bucket)
        if large.isEmpty():
            break
        if step == 0:
            of_large = materialise(large.select("node").distinct(), "wide-wanted")
            hot = materialise(wide.join(lightly(of_large), "node", "left_semi").join(sets_of(of_large), "node"), "wide-hot")
        bits = [F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
        middle = reduce(Column.bitwiseOR, (F.when(2 * F.col(f"b{i}") > F.col("size"), F.lit(_signed(1 << i))).otherwise(0) for i in range(64)))
        middle = large.where("open").groupBy("key").agg(F.count("*").alias("size"), *bits).select("key", middle.alias("middle"))
        from_middle = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
        lead = large.where("open").join(middle, "key").groupBy("key").agg(F.min_by("node", F.struct(from_middle, F.xxhash64("node"))).alias("lead"))
        large = materialise(large.join(materialise(lead, "wide-leads"), "key").where("node <> lead").select("key", "node", "fp", "open", "lead"), "wide-large")
        leaders = hot.join(large.select(F.col("lead").alias("node")).distinct(), "node", "left_semi")
        leaders = materialise(leaders.select(F.col("node").alias("lead"), F.col("words").alias("b"), F.col("set").alias("of_lead")), "wide-leaders")
        held = large.select("node", "lead").distinct().join(hot, "node").join(leaders, "lead")
        held = held.select("node", "lead", "set", "of_lead", bits_between("words", "b").alias("d"))
        held = materialise(held.select("node", "lead", "d", F.when(F.col("d") <= near, alike("set", "of_lead")).otherwise(False).alias("hit")), "wide-held")
        linked.append(held.where("hit").select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")))
        roots = materialise(components(reduce(DataFrame.unionByName, linked)), "wide-roots")
        of_lead = labelled(leaders.select(F.col("lead").alias("node")), roots).select(F.col("node").alias("lead"), F.col("comp").alias("lead_comp"))
        large = labelled(large.join(held, ["node", "lead"]), roots).join(of_lead, "lead")
        large = large.select("key", "node", "fp", "d", (F.col("open") & (F.col("comp") != F.col("lead_comp"))).alias("open"))
        large = materialise(large, "wide-large")
        of_open = F.when(F.col("open"), F.col("d"))
        ring = large.groupBy("key").agg(F.count("*").alias("n"), F.count_if("open").alias("opened"), F.min(of_open).alias("lo"), F.max(of_open).alias("hi"))
        rest = large.join(ring.where("opened > 0"), "key").where(F.col("open") | F.col("d").between(F.col("lo") - near, F.col("hi") + near))
        rest = materialise(rest.select("key", "node", "fp", "open", "n", "opened"), "wide-rest")
        meeting.append(rest.where(F.col("opened") <= bucket).select("key", "node", "fp", "open", "n"))
        place = [step * SUBTABLES + i for i in range(SUBTABLES)]
        bits = [F.shiftright(F.col("words")[n % WORDS], n // WORDS * SUBWIDTH % (64 - SUBWIDTH)).bitwiseAND(F.lit((1 << SUBWIDTH) - 1)) for n in place]
        sub = F.array(*(F.xxhash64("key", F.lit(i), x) for i, x in enumerate(bits)))
        rest = rest.where(F.col("opened") > bucket).join(hot.select("node", "words"), "node")
        open_ = counted(rest.select("node", "fp", "open", F.explode(sub).alias("key")))

    def compared(pairs: DataFrame) -> DataFrame:
        """Those of the kept pairs (u, v) that are as similar by their sets of shingles."""
        sets = materialise(sets_of(materialise(ends(pairs), "wide-wanted")), "wide-sets")
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
        return materialise(both.where(alike("a", "b")).select("u", "v"), "wide-links")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()

    def starred(rows: DataFrame) -> DataFrame:
        """Pairs (u, v), near by all bits, of each key's smallest open node with its others of another comp: no more pairs than rows."""
        hub = rows.where("open").groupBy("key").agg(F.min("node").alias("hub"), F.min_by("fp", "node").alias("hub_fp"), F.min_by("comp", "node").alias("hub_comp"))
        pairs = rows.join(hub, "key").where("node <> hub and comp <> hub_comp").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= near64)
        pairs = materialise(pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct(), "wide-pairs")
        wanted = wide.join(lightly(materialise(ends(pairs), "wide-wanted")), "node", "left_semi")
        a, b = (wanted.select(F.col("node").alias(x), F.col("words").alias(y)) for x, y in (("u", "a"), ("v", "b")))
        return pairs.join(a, "u").join(b, "v").where(bits_between("a", "b") <= near).select("u", "v")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of keys whose nodes links so far don't all connect."""
        apart = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        return rows.join(apart.select("key"), "key", "left_semi")

    met = materialise(reduce(DataFrame.unionByName, meeting), "wide-meeting") if len(meeting) > 1 else meeting[0]
    linked.append(compared(materialise(starred(labelled(met, roots)), "wide-near")))
    roots = materialise(components(reduce(DataFrame.unionByName, linked)), "wide-roots")
    left = materialise(mixed(labelled(met, roots)), "wide-mixed")
    links = compared(materialise(paired(left).distinct(), "wide-near"))
    return reduce(DataFrame.unionByName, linked, links), members


def representatives(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs with one row of each group of near-duplicates left: that with the smallest id, then the smallest row hash.

    A group is a component over links of similar_links(). Null ids come last; of rows equal in all columns one is left.
    Row hashes are broadcast up to ``broadcast_rows`` of them (8 bytes each), beyond that rows are joined by shuffle.
    """
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, row_hash(*docs.columns))
    rows = materialise(keyed.groupBy(row).agg(F.min(id_col).alias("id"), F.count("*").alias("copies")), "simhash-rows")
    texts = keyed.select(F.col(row).alias("row"), F.col(text).alias("text"))
    links, members = similar_links(texts, similarity)
    roots = components(links)
    members = materialise(members.distinct(), "simhash-members")
    grouped = members.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root")).join(rows.select(F.col(row).alias("row"), "id"), "row")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    kept = grouped.groupBy("root").agg(F.min_by("row", order).alias("row"))
    gone = materialise(rows.select(F.col(row).alias("row")).join(kept, "row", "left_anti").select(F.col("row").alias(row)), "simhash-gone")
    out = keyed.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, row, "left_anti")
    repeated = materialise(rows.where("copies > 1").join(kept, F.col(row) == F.col("row"), "left_semi").select(row), "simhash-repeated")
    n = repeated.count()
    if not n:
        return out.drop(row)
    few = F.broadcast(repeated) if n <= broadcast_rows else repeated
    twice = out.join(few, row, "left_semi").dropDuplicates([row])
    return out.join(few, row, "left_anti").unionByName(twice).drop(row)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
