"""Commands over folders, and DOCX files written back."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from quirelight.cli import main
from quirelight.sources import documents, docx_out

W = documents.WORD
XMLNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="urn:mc" xmlns:w14="urn:w14" mc:Ignorable="w14"'
UP = '<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>{}</w:t></w:r>'


def docx(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {XMLNS}><w:body>{''.join(f'<w:p>{p}</w:p>' for p in paragraphs)}<w:sectPr/></w:body></w:document>")
    return out.getvalue()


def body(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read("word/document.xml").decode(), z.read("[Content_Types].xml")


def said(text: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in ElementTree.fromstring(text).iter(f"{W}p")]


def test_bound_documents(spark, tmp_path):
    run = "<w:r><w:t>{}</w:t></w:r>".format
    (tmp_path / "a.docx").write_bytes(docx(run("First") + UP.format(1) + UP.format(2), run("Second") + UP.format(5), run("2) two"), '<w:pPr><w:jc w:val="left"/></w:pPr>' + run("1) one"), run("9) nine")))
    (tmp_path / "b.docx").write_bytes(docx(run("No notes")))

    def bound(folder):
        files = spark.read.format("binaryFile").load(str(folder))
        return {r["path"].rsplit("/")[-1]: r for r in docx_out.bound_documents(files, documents.read_docx(spark, str(folder))).collect()}

    rows = bound(tmp_path)
    text, other = body(rows["a.docx"]["content"])
    assert other == b"<Types/>" and 'xmlns:w14="urn:w14"' in text
    assert said(text) == ["First12", "2) two", "1) one", "Second5 [?FN:5: keine Definition]", "9) nine [?FN:9: keine Referenz gefunden]"]
    props = list(ElementTree.fromstring(text).iter(f"{W}pPr"))
    assert [[c.tag.removeprefix(W) for c in p] for p in props] == [["ind"], ["ind", "jc"]]
    assert [(x["kind"], x["para"], x["number"]) for x in rows["a.docx"]["log"]] == [("bound", 0, 1), ("bound", 0, 2), ("no note", 1, 5), ("no reference", 4, 9)]
    assert said(body(rows["b.docx"]["content"])[0]) == ["No notes"] and rows["b.docx"]["log"] == []
    again = tmp_path / "again"
    again.mkdir()
    (again / "a.docx").write_bytes(rows["a.docx"]["content"])
    assert said(body(bound(again)["a.docx"]["content"])[0]) == said(text)


def test_reflow_writes_volumes(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / "in" / "book").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "book" / f"{n}.txt").write_text(f"Some words stand on page {n}.\nAnd some more of them.\n")
    for kind, part in (("txt", "page 2."), ("md", "format_version")):
        assert main(["reflow", str(tmp_path / "in"), "--out", str(tmp_path / kind), "--format", kind], spark) == 0
        (file,) = (tmp_path / kind / "volume_id=book").glob("*.txt")
        assert part in file.read_text()


@pytest.mark.parametrize("verb", ["reflow", "prepared", "learn", "bind-footnotes"])
def test_no_source(spark, tmp_path, verb):
    assert main([verb, str(tmp_path / "none"), "--out", str(tmp_path / "out")], spark) == 2


def test_contradicting_decisions(spark, tmp_path):
    line = "[{}] p. 3  fn 1  cand {}  'l'  conf 0.5  [seen 2x]  ctx: some"
    (tmp_path / "a.decisions.txt").write_text("\n".join(line.format("x", i) for i in (1, 2)))
    assert main(["learn", str(tmp_path), "--out", str(tmp_path / "out")], spark) == 2
    (tmp_path / "a.decisions.txt").write_text("\n".join(line.format(m, i) for m, i in (("x", 1), (" ", 2))))
    assert main(["learn", str(tmp_path), "--out", str(tmp_path / "out")], spark) == 0
    (row,) = spark.read.json(str(tmp_path / "out")).collect()
    assert (row["num"], row["glyph"], row["accepted"], row["rejected"]) == (1, "l", 1, 1)
