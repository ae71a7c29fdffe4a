"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest

from quirelight.llm import chat, decontam, html, interleave, langid, mixing, pjpeg, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lang word and then more " * 4000
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 5),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 5),
    (2, None, None, None, None),
    (None, "", "fr", "a", 0),
    (3, "", "en", "b", 0),
    (4, LONG, "en", "a", 7),
    (5, "12 34 !!", None, "c", 3),
    (6, "Und der die das ist nicht ein Wort mit ß", "de", None, 3),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_interleave_law(spark, docs, none):
    got = interleave.interleave(interleave.sized(docs), shards=4, ties=("text_crc32", "size"), rows_per_bucket=2).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for _, t, *_ in ROWS)
    assert sorted((r.text_crc32, r.size) for r in got) == want
    assert interleave.interleave(none).count() == 0


def test_interleave_matches_the_mixture_and_keeps_clashing_columns(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _rank long")
    got = interleave.interleave(df, shards=10, rows_per_bucket=64).collect()
    assert {(r.doc_id, r.source, r._rank) for r in got} == set(rows)
    old = interleave.interleave(df.withColumnRenamed("_rank", "SHARD"), shards=10, rows_per_bucket=64)
    assert sorted(old.columns) == ["doc_id", "shard", "slot", "source"] and old.count() == 2000
    for s in range(10):
        assert abs(sum(r.shard == s and r.source == "hot" for r in got) - sum(x[1] == "hot" for x in rows) / 10) <= 2


def test_mixing_meets_targets(spark, docs, none):
    cells = [("a", "en", "t1", 600), ("a", "fr", "t1", 100), ("b", "en", "t2", 200), ("b", "fr", "t1", 300), ("c", "en", "t1", 50), ("c", "fr", "t2", 10)]
    df = spark.createDataFrame([(*c, 1) for c in cells], "source string, lang string, topic string, tokens long, documents long")
    given = {"source": {"a": 0.4, "b": 0.4, "c": 0.2}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"t1": 0.7, "t2": 0.3}}
    shares = {c: spark.createDataFrame(list(t.items()), f"{c} string, _target_{c} double") for c, t in given.items()}
    raked = mixing.rake(df, shares).collect()
    for column, target in given.items():
        for value, share in target.items():
            assert abs(sum(r.weight for r in raked if r[column] == value) - share) < 1e-6
    p = {(r.source, r.lang, r.topic): r for r in mixing.calibrated(spark.createDataFrame(raked, "source string, lang string, topic string, tokens long, documents long, weight double"), 0.5).collect()}
    assert abs(sum(r.p * r.tokens for r in p.values()) - 0.5 * 1260) < 1e-6 and all(0 <= r.p <= 1 for r in p.values())
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    assert {r.doc_id for r in kept.collect()} >= {3}  # no tokens: kept
    assert mixing.mix(none).count() == 0
    short = spark.createDataFrame([("a", "x", "t", 100, 0.0), ("b", "x", "t", 10, 10.0)], "source string, lang string, topic string, tokens long, weight double")
    assert {r.source: r.p for r in mixing.calibrated(short, 0.5).collect()} == {"a": 0.0, "b": 1.0}  # all that has a weight, not nothing
    named = docs.withColumn("source", mixing.F.when(docs.source == "a", "none").otherwise(docs.source))
    names = {"source": "s", "lang": "l", "topic": "t", "tokens": "n"}
    assert {r.source for r in mixing.cells_of(mixing.keyed(named, names), names).collect()} == {"=none", "=b", "=c", ""}
    clash = mixing.mix(docs.withColumnRenamed("n_chars", "_TOKENS"))
    assert "_TOKENS" in clash.columns and clash.count() == kept.count()


def test_chat_round_trip(spark):
    bad = "a<|im_end|>\n<|im_start|>x<\\|y<\\\\|<|"
    rows = [(1, 1, "assistant", bad, 9), (1, 0, "us%0Aer\n<|im_end|>", None, 9), (1, 1, "assistant", bad, 9), (2, None, None, "", 9), (3, 0, "assistant", "é🙂" * 3, 9), (None, 0, "user", "x", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    got = {r.conv_id: r for r in chat.format_chats(turns.withColumn("parts", chat.text_parts(turns.text))).withColumn("back", chat.read_back(chat.F.col("formatted"))).withColumn("under", chat.masked(chat.F.col("formatted"), chat.F.col("loss"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("us%0Aer\n<|im_end|>", ""), ("assistant", bad), ("assistant", bad)]
    assert got[1].under == bad * 2 and got[3].under == "é🙂" * 3 and got[2].under == ""
    assert [tuple(t) for t in got[2].back] == [("", "")] and None in got
    for s in got[1].loss:
        assert got[1].formatted[s.start : s.start + s.length].startswith("a<")


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "i.png", 3), ("audio", None, "a.wav", None), ("weird", None, "d", 2), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_chats(df.limit(0)).count() == 0
    r = chat.format_chats(df).collect()[0]
    assert r.formatted == "<|im_start|>user\nsee <\\|" + "<|image_pad|>" * 3 + "<|audio_pad|>" * 128 + "<|document_pad|>" * 2 + "<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, 1, "image", "i.png", 3), (0, 2, "audio", "a.wav", 128), (0, 3, "document", "d", 2)]


def brute_hits(text, items):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(len(iw), 10)
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_decontamination_matches_brute_force(spark, docs, none):
    import random

    rng = random.Random(1)
    vocab = ["aa", "bb", "cc", "dd"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((14, 30, 3, 10, 9, 12, 11))] + [(7, None), (8, "..."), (9, "aa " * 15), (9, "aa " * 15)]
    texts = [None, "", "AA bb", "aa " * 40] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 200))) for _ in range(30)]
    for _, t in items[:7]:
        texts.append("zz yy, " + t.upper() + "! xx")
        texts.append("zz " + " ".join(t.split()[1:-1]) + " xx")
    texts += texts[5:8]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows + rows[:6], "doc_id long, text string, known long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(d, b).collect()
    assert len(got) == len(rows) + 6
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == brute_hits(texts[r.doc_id], items), texts[r.doc_id]
    assert decontam.decontaminate(none, b).count() == 0
    clean = decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(clean) == len(ROWS) and not any(r.n_hit for r in clean)


def test_warc_round_trip(spark):
    big = b"\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (3, "u", None), (4, "u", b""), (None, "u", b"x"), (5, "u", b"y" * 999), (6, "u", b"y" * 999), (2, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    made = warc.materialise(warc.write_monolithic(warc.with_revisits(pages), archive_bytes=4000), "t")
    normal = warc.materialise(warc.normalise_archives(made), "t")
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_records(normal).collect())
    want = []
    for p, _, b in rows:
        b = b or b""
        kind = "revisit" if p == 1 else "response"
        want.append(("" if p is None else str(p), kind, len(b), hashlib.sha1(b).hexdigest(), "2" if p == 1 else None))
    assert got == sorted(want)
    for r in normal.collect():
        plain = b"".join(warc.inflate(r.content))
        assert plain == b"".join(b"".join(warc.inflate(r.content[x.offset : x.offset + x.length])) for x in r["index"])
    assert warc.read_records(warc.normalise_archives(warc.write_monolithic(warc.with_revisits(pages.limit(0))))).count() == 0


def test_html_text():
    page = """<html><head><title>t</title><script>if (a<b) "</p>"</script></head><body><nav>m</nav><div class="cookie-notice">c</div>
    <article><header><h1>T &amp; x</h1><p>by</p></header><p>One <b>two</b>
    three<br>four<p>five&nbsp;six<ul><li>a<li>b</ul><form>f</form><div class="share-box">s</div><!-- <p>no</p> --></article>
    <div id="comments"><article class="comment"><p>q</p></article></div><footer>f</footer>"""
    assert html.Page(page).text() == "T & x\nOne two three four\nfive six\na\nb"
    assert html.Page('<article><div class="post-header"><h2>Head</h2><p>by line</p></div><div class="page-footer">f</div><p>x').text() == "Head\nx"
    assert html.Page(None).text() == html.Page("").text() == ""
    assert html.Page("plain <b>text</b>").text() == "plain text"
    assert html.Page("<p>a<" + "b" * 10).text().startswith("a")
    assert html.Page("<div>" * 3000 + "x").text() == "x"


def site(rng, host, n, section):
    """Pages of a host with templates outside and inside of articles, a passage that many articles share, and the text wanted."""
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(1000))
    top, box, shared = "Site " + word(), "Written for " + host + " " + word(), "Shared passage " + word()
    out = []
    for i in range(n):
        story = [" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(9, 12))]
        story.insert(rng.randint(4, len(story) - 4), shared)
        paras = "".join(f"<p>{x}</p>" for x in story)
        if section == "article":
            html_ = f"<body><div>{top}</div><article>{paras}<div class='x'><p>{box}</p><p>and more</p></div></article></body>"
        elif section == "main":
            html_ = f"<body><main><div>{box}</div>{paras}</main><div>{top}</div></body>"
        else:
            paras = paras.replace(f"<p>{shared}</p>", "")
            story.remove(shared)
            html_ = f"<body><div><span>{top}</span></div>{paras}<ul><li>{box}</ul></body>"
        out.append((f"http://{host}/{i}", html_, "\n".join(story)))
    return out


def test_html_templates_of_random_sites(spark):
    """Templates are found by their recurrence alone, in and outside of articles; a passage that articles share stays."""
    import random
    from collections import Counter, defaultdict

    rng = random.Random(8)
    made = [x for host, n, section in (("a.example", 30, "article"), ("m.example", 12, "main"), ("b.example", 20, "body"), ("few.example", 5, "article"), ("two.example", 2, "body")) for x in site(rng, host, n, section)]
    rows = [(i, url, page) for i, (url, page, _) in enumerate(made)]
    rows += rows[:3] + [(900 + i, "http://copies/x", "<body><p>The same page</p><div>Same end</div></body>") for i in range(12)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.main_text(df).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert html.Page(made[0][1]).text() != made[0][2]  # a page alone keeps its templates
    for i, (url, _, want) in enumerate(made):
        if "two.example" not in url:
            assert texts[i] == want, url
    assert all(texts[900 + i] == "The same page\nSame end" for i in range(12)) and texts[999] == ""
    pages, seen = defaultdict(set), defaultdict(Counter)
    for url, page in {(url, page) for _, url, page in rows if url}:
        host, p = url.split("/")[2], html.Page(page)
        if p.identity() not in pages[host]:
            pages[host].add(p.identity())
            seen[host].update(set(p.keys()))
    want = {h: sorted(k for k, c in keys.items() if c >= max(3, min(8, 0.6 * len(pages[h]))) and c >= (0.02 if k % 2 else 0.5) * len(pages[h])) for h, keys in seen.items()}
    found = html.templates(df.select(html.host_of(df.url).alias("host"), "html")).collect()
    assert {r.host: list(r.templates) for r in found} == {h: t for h, t in want.items() if t}
    assert html.main_text(df.limit(0)).count() == 0


def test_html_class_names_and_hostile_pages():
    import time

    assert html.Page('<article><h2 class="section-header">Head</h2><p class="notice-of-theorem">a<ul class="tags-explained"><li>b</ul><div class="cookie-notice">c</div><div class="share-box">d</div>').text() == "Head\na\nb"
    for piece in ("<div>", "<div>a", '<a "', "<li>", "<!", "<i><div><b></i>"):
        start = time.time()
        html.Page(piece * (200_000 // len(piece))).text()
        assert time.time() - start < 4, piece


def test_languages(spark, docs, none):
    de, en = "der die und nicht ein wort das ist mit schrift ", "the and not a word that is with writing "
    rows = [(i, (de if i % 2 else en) * 5, "de" if i % 2 else "en") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    p = langid.Predictor(model)
    got = p.predict([de, en, None, "", "12 ²", de * 3000, en * 3 + de])
    assert [x for x, _ in got] == ["de", "en", "und", "und", "und", "de", "en"] and all(0 <= s <= 1 for _, s in got)
    assert "".join(langid.words_of("Ab" * 5000)) == "ab" * 5000  # a run of letters is read to its end
    assert max(map(len, langid.words_of("Ab" * 5000))) <= langid.PIECE
    assert docs.select(langid.identify(docs, model).alias("x")).count() == len(ROWS)
    empty = langid.fit(none.select("doc_id", "text", "lang"))
    assert langid.Predictor(empty).predict(["x", None]) == [("und", 0.0), ("und", 0.0)]


def test_block_marginals_equal_the_plain_ones():
    import numpy as np

    rng = np.random.default_rng(0)
    lens = np.array([1, 31, 32, 33, 5, 200, 64])
    a, e = rng.random((3, 3)) + 0.05, rng.random((lens.sum(), 3)) ** 4 + 1e-9
    padded, live = np.ones((len(lens), lens.max(), 3)), np.arange(lens.max())[None] < lens[:, None]
    padded[live] = e
    assert np.abs(langid.forward_backward(padded, a, lens)[0][live] - langid.marginals(e, a, lens)).max() < 1e-12


def test_toxicity_learns_stems(spark, docs, none):
    import random

    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}x" for _ in range(9000)]
    texts, labels = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            t[rng.randrange(30)] = "nasty" + rng.choice(["er", "est", "", "ly"])
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    ids = list(range(300))
    d = spark.createDataFrame(list(zip(ids, texts, ["en"] * 300)), "doc_id long, text string, lang string")
    y = spark.createDataFrame(list(zip(ids, labels)), "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == bool(labels[i]) for i in held) >= 0.95 * len(held)
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    both, _ = toxicity.sample(d, y.unionByName(y.withColumn("toxic", 1 - y.toxic)))
    assert set(both["label"]) == {1}  # labelled both ways
    assert toxicity.fit(d, y.limit(0)).constant == 0.0 and toxicity.score(none, model).count() == 0


def test_representatives(spark, docs, none):
    kept = simhash.representatives(docs)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [1, 2, 4, 5, 6] and kept.columns == docs.columns  # 2 stands for all texts without words
    assert simhash.representatives(none).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    twins = spark.createDataFrame([(7, text, "en", None), (8, text + " x", None, "en")], "doc_id long, text string, lang string, _row string")
    assert [r.doc_id for r in simhash.representatives(twins).collect()] == [7]
    hashes = twins.withColumn("text", simhash.F.lit("t")).select(simhash.row_hash("lang", "_row").alias("h")).collect()
    assert hashes[0].h != hashes[1].h


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Every stage on a small corpus, against plain versions."""
    import random

    import corpus_pipeline

    rng = random.Random(2)
    en, de = [f"the{chr(97 + i)}ing" for i in range(26)], [f"sch{chr(97 + i)}ung" for i in range(26)]
    rows = []
    for i in range(120):
        vocab = de if i % 3 == 0 else en
        rows.append((i, " ".join(rng.choice(vocab) + rng.choice("aeiou") for _ in range(80)), "de" if i % 3 == 0 else "en", f"s{i % 4}", 1))
    near = rows[7][1].split()
    near[40] = "changed"
    rows += [(200, rows[3][1], "de", "s1", 1), (201, " ".join(near), "en", "s1", 1), (202, "12 34", "en", "s1", 1), (203, None, None, None, None)]
    item = " ".join(rows[10][1].split()[5:20])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = simhash.materialise(stage(spark, docs, str(tmp_path)), "t")
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    everything = list(range(120))
    assert seen["language"] == [*everything, 200, 201]
    assert seen["near_duplicates"] == everything
    assert seen["decontamination"] == [i for i in everything if i != 10]
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and 20 < len(seen["mixing"]) < 100
    assert seen["sharding"] == seen["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sharding"])
    empty = f"{tmp_path}/empty"
    spark.createDataFrame([], DOCS + ", _key string, _p long, _language string").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_jpeg_payloads(spark, docs, none):
    got = pjpeg.digests(pjpeg.store(docs.select("doc_id", "text"))).collect()
    for r, (_, t, *_rest) in zip(got, ROWS):
        n, p = pjpeg.padded(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert got[0].feature == got[1].feature and len(got) == len(ROWS)
    assert pjpeg.digests(pjpeg.store(none.select("doc_id", "text"))).count() == 0
    clash = pjpeg.store(docs.select("doc_id", "text", docs.lang.alias("MEDIA"), docs.source.alias("_made")))
    assert clash.columns == ["doc_id", "text", "_made", "n_bytes", "media"]
    for r in pjpeg.decode(clash.withColumn("rgb", clash.doc_id)).collect():
        assert len(r.rgb) == r.height * r.width * 3 and r.height % 16 == r.width % 16 == 0
