import random
import re

import xxhash

from quirelight.llm.simhash import components, fingerprint, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    joined = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in joined]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def closure(ids, fps, d):
    up = {i: i for i in range(len(ids))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= d:
                up[find(i)] = find(j)
    least = {}
    for i, n in enumerate(ids):
        least[find(i)] = min(n, least.get(find(i), n))
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprint_matches_plain():
    for text in (None, "", " \n", "One", "One TWO", "a b c", "Ünder ÉTÉ\tTHE\x0bthe\x0cend  x", "w " * 5000, "a b c d e"):
        assert fingerprint(text) == plain(text)


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    texts = [None, "", " "]
    for b in base:
        for _ in range(9):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0]] * 5
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    got = near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    fps = [plain(t) for t in texts]
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == dict(zip(ids, zip(fps, closure(ids, fps, 2))))


def test_hot_bucket_is_exact(spark):
    """Hundreds of fingerprints in one bucket: no pairs, the same components."""
    from quirelight.llm.simhash import close_links

    rng = random.Random(5)
    fps = {rng.getrandbits(6) << 40 | rng.getrandbits(5) << 3 for _ in range(600)} | {1 << i | 1 << j for i in range(64) for j in range(i)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = close_links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket=8)
    got = {r.node: r.root for r in components(links).collect()}
    want = closure(fps, fps, 2)
    assert [got.get(x, x) for x in fps] == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 1000: 1000, 1001: 1000}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def half_similar(seed, families, copies, words=300):
    """Texts some 0.65 alike by one base, each with copies that are 0.82 like it."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]

    def changed(w, n):
        w = list(w)
        for i in rng.sample(range(len(w)), n):
            w[i] = f"x{rng.randrange(10**9)}"
        return w

    out = []
    for _ in range(families):
        a = changed(base, 6)
        out += [a, *(changed(a, 6) for _ in range(copies))]
    return [" ".join(w) for w in out]


def test_near_copies_in_blocks_of_half_similar_texts(spark):
    """Near copies among hundreds of texts that are half like each block's leader, against all pairs."""
    from quirelight.llm.simhash import similar_links

    texts = half_similar(7, 200, 1)
    sets = [shingles(t) for t in texts]
    alike = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links, _ = similar_links(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    root = {r.node: r.root for r in components(links).collect()}
    assert len(alike) >= 180
    assert sum(root.get(i, i) == root.get(j, j) for i, j in alike) >= 0.99 * len(alike)


def test_blocks_find_pairs_as_often_as_the_formula_says():
    """Blocks are the same at every size of the corpus: pairs at the threshold, measured on texts."""
    from quirelight.llm.simhash import block_keys, block_recall, shingle_hashes, wide_fingerprint

    assert block_recall(0.8) >= 0.997
    rng, met, sims = random.Random(13), [], []
    for _ in range(400):
        w = [f"v{rng.randrange(10**9)}" for _ in range(300)]
        x = list(w)
        for k in rng.sample(range(5, 295), 6):
            x[k] = f"x{rng.randrange(10**9)}"
        a, b = shingle_hashes(" ".join(w)), shingle_hashes(" ".join(x))
        common = len(set(a.tolist()) & set(b.tolist()))
        sims.append(common / (len(a) + len(b) - common))
        ka, kb = (block_keys(h, wide_fingerprint(h)[1]) for h in (a, b))
        met.append(bool((ka == kb).any()))
    assert sum(sims) / len(sims) < 0.84
    assert sum(met) / len(met) >= 0.99


def test_links_are_held_to_shingle_sets(spark):
    """Pairs on both sides of the threshold: all of 0.8 and more, none below."""
    from quirelight.llm.simhash import similar_links

    rng = random.Random(11)
    texts = []
    for i in range(120):
        w = [f"v{rng.randrange(10**9)}" for _ in range(300)]
        texts.append(" ".join(w))
        for k in rng.sample(range(2, 290), 6 + i % 2):  # 0.82 and 0.79
            w[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    alike = {(i, i + 1) for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    links, _ = similar_links(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert {(r.u, r.v) for r in links.collect()} == alike


def test_small_blocks_of_near_copies_are_not_paired_out(spark, monkeypatch):
    """Fifty copies with one change each: compared with one of them, not all with all, and all linked."""
    from quirelight.llm import simhash

    rng, seen = random.Random(17), []
    base = [f"v{rng.randrange(10**9)}" for _ in range(300)]
    texts = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in rng.sample(range(10, 290), 50)]
    real = simhash.materialise

    def counting(df, tag, *rest):
        out = real(df, tag, *rest)
        if tag == "wide-near":
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counting)
    links, _ = simhash.similar_links(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert len({r.root for r in components(links).collect()}) == 1 and components(links).count() == 50
    assert sum(seen) < 50 * 10


def test_few_nodes_are_compared_without_moving_all_texts(spark, monkeypatch):
    """Blocks, sets and links of a table in which few texts have near copies: what is shuffled is narrow, and blocks below the bound aren't split."""
    from quirelight.llm import simhash

    rng, tags = random.Random(19), {}
    texts = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(60)) for _ in range(40)]
    texts += half_similar(23, 100, 1, 60)
    real = simhash.materialise

    def noting(df, tag, *rest):
        if tag in ("wide-sets", "wide-blocks"):
            tags.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, tag, *rest)

    monkeypatch.setattr(simhash, "materialise", noting)
    simhash.similar_links(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert len(tags["wide-blocks"]) == 1 and tags["wide-sets"]
    assert all("broadcast" in plan for plan in tags["wide-sets"])


def test_large_blocks_by_leaders(spark):
    """The steps of blocks beyond the bound, against all pairs; repeated rows and copies are nodes once."""
    from quirelight.llm.simhash import similar_links

    texts = half_similar(29, 90, 1)
    sets = [shingles(t) for t in texts]
    alike = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0]), (1000, texts[1]), (1001, texts[1])]
    links, members = similar_links(spark.createDataFrame(rows, "row long, text string"), bucket=16)
    root = {r.node: r.root for r in components(links).collect()}
    assert sum(root.get(i, i) == root.get(j, j) for i, j in alike) >= 0.99 * len(alike)
    of = {r.row: r.node for r in members.collect()}
    assert of[0] == 0 and of[1000] == of[1001] == of[1] == 1 and len(set(of.values())) == len(texts)
