"""Relational operators on small cases with known answers."""

import json
import random
import zipfile
from datetime import date
from itertools import product

import pytest
from pyspark.sql import functions as F

from quirelight.operators import characters, doubt, evaluate, layout, notes, pagination, structure, translate
from quirelight.sources import documents, pages


def test_plan_is_the_best_of_all():
    """The search against every cut and every reading of each stretch."""
    from quirelight.config import DEFAULT as c

    def value(said, start, stop, first, style, kind):
        total = 0.0
        for pos, group in said.items():
            if start <= pos < stop:
                own = [w for s, v, w in group if kind == "counted" and s == style and v == first + pos - start]
                total += max(own) if own else -c.mu * max(w for _, _, w in group)
        return total - (c.rho if kind == "counted" and first % 2 == 0 else 0)

    def score(said, plan, last):
        ends = [*(p[0] for p in plan[1:]), last + 1]
        return sum(value(said, p[0], e, p[1], p[2], p[3]) for p, e in zip(plan, ends)) - c.lam * (len(plan) - 1)

    rng = random.Random(1)
    for _ in range(40):
        last = 6
        said = {p: [("arabic", rng.choice([p, p + 3, 9]), 1.0)] for p in range(1, last + 1) if rng.random() < 0.8}
        got = pagination.best_plan(said, list(range(1, last + 1)), last)
        best = -1e9
        for cuts in product([0, 1], repeat=last - 1):
            starts = [1, *(i + 2 for i, x in enumerate(cuts) if x)]
            stops = [*starts[1:], last + 1]
            total = -c.lam * (len(starts) - 1)
            for a, b in zip(starts, stops):
                options = [value(said, a, b, 1, "arabic", "uncounted")]
                for offset in {v - p for p, g in said.items() if a <= p < b for _, v, _ in g}:
                    hits = sum(any(v - p == offset for _, v, _ in g) for p, g in said.items() if a <= p < b)
                    if offset + a >= 1 and hits >= c.min_attested:
                        options.append(value(said, a, b, offset + a, "arabic", "counted"))
                total += max(options)
            best = max(best, total)
        assert score(said, got, last) >= best - 1e-9


def test_misreading_keeps_the_run():
    said = {p: [("arabic", v, 1.0)] for p, v in ((1, 11), (2, 2020), (3, 13), (4, 14))}
    assert pagination.best_plan(said, [1, 2, 3], 4) == [(1, 11, "arabic", "counted")]


def test_verdict_fills_gaps_only(spark):
    said = spark.createDataFrame([("v", p, str(p + 10), "printed-bottom", 1.0) for p in (2, 3, 5, 6)], "volume_id string, pos int, label string, source string, weight double")
    pgs = spark.createDataFrame([("v", p) for p in range(1, 9)], "volume_id string, pos int")
    plan = spark.createDataFrame([("v", 1, 11, "arabic", "counted")], "volume_id string, start_pos int, start_value int, style string, kind string")
    got = {r.pos: (r.label, r.label_source) for r in pagination.verdict(said, pgs, plan).collect()}
    assert got[4] == ("14", "computed") and got[2] == ("12", "printed") and got[1][0] is None and got[7][0] is None


def test_other_witnesses(spark):
    links = spark.createDataFrame([("v", 1, 5, "Chapter .... 12"), ("v", 1, 1, "7"), ("v", 2, 6, "x")], "volume_id string, pos int, target int, text string")
    assert [(r.pos, r.label) for r in pagination.link_observations(links).collect()] == [(5, "12")]
    seen = spark.createDataFrame([("v", "bottom", 0.9 + i / 1000) for i in range(21)] + [("v", "top", 0.1)], "volume_id string, edge string, height double")
    band = pagination.folio_band(seen).collect()[0]
    assert band.edge == "bottom" and abs(band.lo - (0.901 - 0.015)) < 1e-9 and abs(band.hi - (0.919 + 0.015)) < 1e-9


def test_continuations(spark):
    defs = spark.createDataFrame([("v", 1, 1, "one"), ("v", 1, 2, "two be-")], "volume_id string, pos int, num int, text string")
    more = spark.createDataFrame([("v", 2, "gins"), ("v", 3, "and ends")], "volume_id string, pos int, text string")
    assert {r.num: r.text for r in notes.attach_continuations(defs, more).collect()} == {1: "one", 2: "two begins and ends"}


def test_decisions(spark):
    lines = ["[x] p. 12  fn 6  cand 1  '&'  conf 0.8  [seen 2x]  ctx: a", "[ ] p. 12  fn 6  cand 2  'b'  conf 0.6  [seen 0x]  ctx: b", "# note"]
    df = doubt.read_decisions(spark.createDataFrame([("s", x) for x in lines], "source string, line string"))
    assert [(r.page, r.fn, r.cand) for r in doubt.accepted(df).collect()] == [("12", 6, 1)]
    assert {r.glyph: (r.accepted, r.rejected) for r in doubt.learn_profile(df).collect()} == {"&": (1, 0), "b": (0, 1)}
    twice = df.withColumn("marked", F.lit(True))
    with pytest.raises(Exception, match="ambiguous"):
        doubt.accepted(twice).collect()


def test_regions_and_modes(spark):
    rows = [("v", i + 1, m, None, None, False, o, None, p) for i, (m, o, p) in enumerate([("frontmatter", None, False), ("main", None, True), ("main", "bibliography", False), ("main", None, False), ("main", None, True), ("main", None, True), ("main", None, True), ("main", None, True)] + [("main", None, True)] * 20)]
    df = spark.createDataFrame(rows, "volume_id string, pos int, mode string, label string, head string, ubiquitous boolean, opened string, heading string, prose boolean")
    got = [r.region for r in structure.assign_regions(df).orderBy("pos").collect()]
    assert got[:8] == ["front-matter", "main", "bibliography", "bibliography", "main", "main", "main", "main"]
    marks = structure.region_markers(structure.assign_regions(df)).orderBy("pos").collect()
    assert [(r.pos, r.marker) for r in marks] == [(1, "[region: front-matter]"), (2, "[region: main]"), (3, "[region: bibliography]"), (5, "[region: main]")]
    heads = spark.createDataFrame([("v", p, "H" if p in (1, 9) else "x" if p == 5 else None) for p in range(1, 11)], "volume_id string, pos int, head string")
    assert [r.head for r in structure.ubiquitous_heads(heads).collect()] == ["H"]


def test_outline(spark):
    outline = spark.createDataFrame([("v", 1, 1, "Of Paper", 3), ("v", 2, 1, "Of Ink", 5), ("v", 3, 2, "Of Types", 5)], "volume_id string, ord int, level int, title string, page int")
    lines = spark.createDataFrame([("v", 3, 0, "Of"), ("v", 3, 1, "Paper"), ("v", 5, 0, "OF INK"), ("v", 4, 0, "x")], "volume_id string, pos int, ln int, line string")
    got = structure.confirmed_starts(structure.credible_outline(outline), lines).collect()
    assert {(r.pos, r.title, r.n_lines) for r in got} == {(3, "Of Paper", 2), (5, "Of Ink", 1)}
    assert structure.principal_rank(outline).collect()[0].level == 1
    df = spark.createDataFrame([([3, 1, 2, 9, 4, 4],)], "n array<int>")
    assert df.select(structure.longest_rise(F.col("n"))).first()[0] == [1, 2, 4, 4]


def test_links_and_headings(spark):
    frags = spark.createDataFrame([("v", 1, 0, "Paper ... 12", 50.0, 90.0, 120.0, 102.0, 100.0, 10.0, 400.0, 600.0), ("v", 1, 1, "Ink", 50.0, 110.0, 80.0, 122.0, 120.0, 10.0, 400.0, 600.0)], "volume_id string, pos int, frag int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, width double, height double")
    links = spark.createDataFrame([("v", 1, 0, 7, 40.0, 88.0, 130.0, 104.0)], "volume_id string, pos int, link int, target int, lx0 double, ly0 double, lx1 double, ly1 double")
    assert [(r.target, r.text) for r in layout.linked_lines(frags, links).collect()] == [(7, "Paper ... 12")]
    lines = spark.createDataFrame([("v", 1, 0, "1.2 Of Ink It was", 10.0, 10), ("v", 1, 1, "BIG", 14.0, 3), ("v", 1, 2, "plain", 10.0, 0)], "volume_id string, pos int, ln int, line string, size double, run int")
    got = [(r.line, r.marked) for r in layout.split_headings(lines, spark.createDataFrame([("v", 10.0)], "volume_id string, size double")).orderBy("ln", "part").collect()]
    assert got == [("1.2 Of Ink", True), ("It was", False), ("BIG", True), ("plain", False)]


def test_characters(spark):
    rows = [("v", 1, 0, "first stone last"), ("v", 1, 1, "fir one la so­"), ("v", 1, 2, "a​b")]
    lines = spark.createDataFrame(rows, "volume_id string, pos int, ln int, line string")
    glyphs = characters.learned_glyphs(characters.glyph_votes(lines))
    assert [(r.ch, r.ligature) for r in glyphs.collect()] == [("", "st")]
    got = {r.ln: (r.line, r.soft_hyphens, r.zero_width, r.dropped) for r in characters.resolved(lines, glyphs).collect()}
    assert got[1] == ("first stone last so-", 1, 0, 0) and got[2] == ("ab", 0, 1, 1)


def test_references(spark):
    said = ["Text", "References", "[1] Alpha be-", "ta 1999.", "HEAD", "[2] Gamma 2001.", "NEXT PART", "more"]
    sizes = [10, 10, 9, 9, 12, 9, 14, 10]
    lines = spark.createDataFrame([("v", 1, i, s, float(z)) for i, (s, z) in enumerate(zip(said, sizes))], "volume_id string, pos int, ln int, line string, size double")
    got = [(r.line, r.is_entry) for r in characters.merged_references(lines).orderBy("ln").collect()]
    assert got == [("Text", False), ("References", False), ("[1] Alpha beta 1999.", True), ("HEAD", False), ("[2] Gamma 2001.", True), ("NEXT PART", False), ("more", False)]


def test_translation(spark):
    md = "See [1, 2] and [3] at https://a.b/c.\n[1] Alpha, A. 1999.\n[2] Beta, B. 2001.\n[^1]: „Ein Zitat“ und mehr [?FN:2|z]"
    got = spark.createDataFrame([(md,)], "t string").select(translate.prepare_translation(F.col("t")).alias("x"), translate.protect_urls(translate.protect_urls(F.col("t"))).alias("y"), translate.protect_urls(F.col("t")).alias("z")).first()
    assert got.x.split("\n") == ["See [[1](#^ref-1), [2](#^ref-2)] and [3] at <dnt>https://a.b/c</dnt>.", '<span id="^ref-1"></span><dnt>[1] Alpha, A. 1999.</dnt> ^ref-1', '<span id="^ref-2"></span><dnt>[2] Beta, B. 2001.</dnt> ^ref-2', "[^1]: <dnt>„Ein Zitat“</dnt> und mehr"]
    assert got.y == got.z


def test_evaluation(spark):
    text = "---\nformat_version: 0\n---\n[region: main]\n[p. 1] Ein Satz[^1] und[?FN:2] mehr. [a 1]{.cit type=r3 ref=x}\n\n[region: index]\n[p. 2] A, B\n\n[^1]: Erste Note.\n[^3]: Dritte."
    docs = evaluate.parsed(spark.createDataFrame([("v", text)], "volume_id string, text string"))
    places = evaluate.located(docs)
    assert {(r.kind, r.page, r.region) for r in places.where("kind in ('anchor', 'flag', 'cit')").collect()} == {("anchor", "1", "main"), ("flag", "1", "main"), ("cit", "1", "main")}
    truth = spark.createDataFrame([("v", "1", 1, "Erste", "Ein Satz", "intact"), ("v", "1", 2, "Zweite", None, "damaged"), ("v", "1", 3, "Dritte", None, "intact")], "volume_id string, page string, num int, definition_starts string, anchor_after string, status string")
    got = {r.num: r.status for r in evaluate.anchor_status(docs, truth).collect()}
    assert got == {1: "anchored_exact", 2: "lost", 3: "preserved_unanchored"}
    pgs = spark.createDataFrame([("v", 0, "1"), ("v", 1, "2"), ("v", 2, "3")], "volume_id string, ord int, label string")
    f = evaluate.flag_precision(places, truth, pgs).first()
    assert (f.justified, f.noise, f.precision) == (1, 0, 1.0)
    assert evaluate.label_fidelity(places, pgs).first()["found"] == 2
    regions = spark.createDataFrame([("v", "main", "1"), ("v", "index", "2")], "volume_id string, name string, from_page string")
    assert {(r.name, r.named, r.as_apparatus) for r in evaluate.region_blocks(places, regions).collect()} == {("main", 1, 0), ("index", 1, 1)}
    cits = spark.createDataFrame([("v", "A  1", "1", "r3"), ("v", "b", "1", "r3")], "volume_id string, text string, page string, regime string")
    assert evaluate.citation_metrics(places, cits).first()["recall"] == 0.5
    plain = evaluate.parsed(spark.createDataFrame([("v", "12\nText[^1]\n1. A note of some length here\n")], "volume_id string, text string"), plain=True).first()
    assert {(p.kind, p.num, p["name"]) for p in plain.parts} == {("page", None, "12"), ("anchor", 1, None), ("note", 1, "A note of some length here")}


def test_prepared_text():
    text = "[p. 3] Eins (1) und (*).\n--\n(1) Note\neins\n(*) Stern\n(2) Lose\n---\n(3) Folgt\n---\n[4] Zwei (1) hier\n\nNeu\n--\n(1) Andere"
    md, hung = documents.prepared_markdown(text)
    assert md == "[p. 3] Eins [^1] und [^2]. [p. 4] Zwei [^3] hier [^5]\n\nNeu\n\n[^1]: Note eins\n\n[^2]: Stern\n\n[^3]: Andere\n\n[^4]: Lose\n\n[^5]: Folgt\n".replace("hier [^5]", "hier [^4] [^5]")
    assert hung == [(3, "2"), (3, "3")]


def test_clippings():
    md, n, missing = documents.clipping_markdown("---\ntitle: x\n---\nEin Satz.1 Und noch2 einer\n\n<sup>1</sup> Eins\nweiter\n<sup>2</sup> Zwei\n<sup>3</sup> Drei", date(2020, 1, 2).isoformat())
    assert (n, missing) == (3, [3]) and "Satz.[^1] Und noch[^2] einer" in md and "[^1]: Eins weiter\n[^2]: Zwei\n[^3]: Drei" in md
    assert md.startswith("---\ntitle: x\npandoc_compatible: true\nupdated: 2020-01-02\n---\n")


def test_sources(spark, tmp_path):
    (tmp_path / "vol").mkdir()
    for i in (2, 10):
        (tmp_path / "vol" / f"{i}.txt").write_text(f"Seite {i}\n\x0cEnde\n")
    got = pages.read_text_pages(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.volume_id, r.pos, r.lines) for r in got] == [("vol", 1, ["Seite 2", "", "Ende"]), ("vol", 2, ["Seite 10", "", "Ende"])]
    page = {"version": 1, "index": 1, "width": 300.0, "lines": [{"spans": [{"text": "ab", "size": 9.0}, {"text": "c", "size": 7.0, "bold": True}], "box": [1, 2, 3, 4], "baseline": 3.5}]}
    (tmp_path / "j" / "w").mkdir(parents=True)
    (tmp_path / "j" / "w" / "00000001.json").write_text(json.dumps(page))
    (tmp_path / "j" / "w" / "outline.json").write_text(json.dumps([{"level": 1, "title": "T", "page": 1}]))
    measured = pages.read_json_pages(spark, str(tmp_path / "j"))
    f = pages.fragments(measured).first()
    assert (f.volume_id, f.pos, f.text, f.size, f.baseline, f.x1) == ("w", 1, "abc", 9.0, 3.5, 3.0)
    assert json.loads(pages.page_json(measured).first().content) == {**page, "lines": [{**page["lines"][0], "box": [1.0, 2.0, 3.0, 4.0]}]}
    assert pages.read_outline(spark, str(tmp_path / "j")).first().title == "T"
    (tmp_path / "j" / "w" / "00000002.json").write_text(json.dumps({**page, "version": 2}))
    with pytest.raises(Exception, match="schema version"):
        pages.read_json_pages(spark, str(tmp_path / "j")).collect()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in (("b/p10.txt", "zehn"), ("b/p9.txt", "neun é"), ("__MACOSX/p1.txt", "x"), ("b_meta.xml", "x"), ("b/x_thumb.txt", "x")):
            z.writestr(name, data)
        z.writestr("b/p11.txt", "caf\xe9 et th\xe9 pr\xe8s de la for\xeat".encode("latin-1"))
    got = pages.archive_pages(pages.archive_members(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.file, r.member, r.fallback) for r in got] == [("00000001.txt", "b/p9.txt", False), ("00000002.txt", "b/p10.txt", False), ("00000003.txt", "b/p11.txt", True)]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, up=False: f"<w:r>{'<w:rPr><w:vertAlign w:val=%ssuperscript%s/></w:rPr>' % (chr(34), chr(34)) if up else ''}<w:t>{t}</w:t></w:r>"
    body = "".join(f"<w:p>{p}</w:p>" for p in (run("Ein Satz") + run("1", True), run("Noch") + run("1", True), run("1) Die Note"), run("2) Lose")))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    runs = documents.read_docx(spark, str(tmp_path))
    got = notes.bind_preceding(documents.docx_references(runs), documents.docx_definitions(runs)).orderBy("note_at").collect()
    assert [(r.number, r.note_at // 10000, None if r.ref_at is None else r.ref_at // 10000) for r in got] == [(1, 2, 1), (2, 3, None)]


def test_truth():
    text = 'pages = ["1", "2"]\n[[footnotes]]\npage = "1"\nnum = 1\ndefinition_starts = "a"\nstatus = "intact"\n'
    assert documents.read_truth(text)["footnotes"][0]["num"] == 1
    for bad in (text.replace("intact", "odd"), text.replace('page = "1"', 'page = "9"'), "nonsense = 1\n"):
        with pytest.raises(ValueError):
            documents.read_truth(bad)
    assert documents.sampled_pages(list("abcdef"), 3, 1) == documents.sampled_pages(list("abcdef"), 3, 1)


def test_decided_and_unmatched(spark):
    paras = spark.createDataFrame([("v", 1, "aS b [4] cz d")], "volume_id string, para int, text string")
    scores = spark.createDataFrame([("v", 1, 5, 1, "S", 0.8, "9"), ("v", 1, 2, 10, "z", 0.7, "9"), ("v", 1, 2, 3, "b", 0.6, "9")], "volume_id string, para int, num int, at int, glyph string, confidence double, page string")
    choices = spark.createDataFrame([("v", "9", 5, 1), ("v", "9", 2, 1), ("v", "9", 7, 1)], "volume_id string, page string, fn int, cand int")
    assert doubt.decided(paras, scores, choices).first().text == "a[5] b [4] c[2] d"
    assert [r.fn for r in doubt.unmatched(scores, choices).collect()] == [7]


def test_nearby_notes_and_chapter_numbers(spark):
    defs = spark.createDataFrame([("v", 1, 1), ("v", 2, 2), ("v", 4, 9)], "volume_id string, pos int, num int")
    assert {r.pos: r.nums for r in notes.nearby_numbers(defs).collect()} == {1: [1, 2], 2: [1, 2], 4: [9]}
    labels = spark.createDataFrame([("v", p, x) for p, x in ((1, "7"), (3, "1"), (9, "2"), (14, "3"), (20, "1700"))], "volume_id string, pos int, label string")
    assert sorted((r.pos, r.value) for r in pagination.chapter_number_run(labels).collect()) == [(3, 1), (9, 2), (14, 3)]


def test_chapters_from_contents(spark):
    entries = spark.createDataFrame([("v", 1, "Of Paper"), ("v", 2, "Of Paper"), ("v", 3, "Of Ink")], "volume_id string, ord int, title string")
    lines = spark.createDataFrame([("v", 1, 0, "Of Paper"), ("v", 2, 0, "OF PAPER"), ("v", 3, 0, "12 Of Paper"), ("v", 3, 1, "text"), ("v", 5, 0, "Of Paper"), ("v", 6, 0, "Of Ink")], "volume_id string, pos int, ln int, line string")
    contents = spark.createDataFrame([("v", 1)], "volume_id string, pos int")
    found = structure.title_starts(entries, lines, contents)
    assert sorted((r.pos, r.ord) for r in found.collect()) == [(2, 1), (5, 2), (6, 3)]
    known = spark.createDataFrame([("v", 2, "Of Paper"), ("v", 6, "Of Ink")], "volume_id string, pos int, title string")
    assert structure.fresh_starts(found, known).count() == 3
    left = {(r.pos, r.line) for r in structure.without_running_titles(lines, known).collect()}
    assert left == {(1, "Of Paper"), (2, "OF PAPER"), (3, "12"), (3, "text"), (6, "Of Ink")}


def test_reports(spark):
    r = evaluate.report(spark.createDataFrame([("b", 2), ("a", None)], "volume_id string, n int")).first()
    assert r.markdown == "| volume_id | n |\n|---|---|\n| a | – |\n| b | 2 |" and r.json.split("\n")[1] == '{"volume_id":"b","n":2}'
    o = pages.outline_json(spark.createDataFrame([("v", 2, 1, "B", 5), ("v", 1, 1, "A", 3)], "volume_id string, ord int, level int, title string, page int")).first()
    assert json.loads(o.content) == [{"level": 1, "title": "A", "page": 3}, {"level": 1, "title": "B", "page": 5}]
