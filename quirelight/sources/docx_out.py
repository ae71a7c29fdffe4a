"""DOCX files written back with their notes bound: assignment by joins, the edit of each file in Arrow batches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.notes import bind_preceding
from .documents import WORD, docx_definitions, docx_references

# Fixed values of the format: the left indent of a bound note, what follows w:ind in a paragraph's properties, the flags.
BOUND_INDENT = 720
AFTER_INDENT = "contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange".split()
NO_REFERENCE = "[?FN:{}: keine Referenz gefunden]"
NO_NOTE = "[?FN:{}: keine Definition]"
BODY = "word/document.xml"
SNIPPET = 60
LOG = "array<struct<kind: string, para: int, number: int, snippet: string>>"


def assignment(runs: DataFrame) -> DataFrame:
    """(doc, notes array<(note, number, ref_para, ref_at, placed)>, loose array<(para, run, number)>) of (read_docx()) runs.

    A note takes the last reference before it that is free; placed notes (indented already) take theirs but don't move;
    loose references have no note.
    """
    refs, defs = docx_references(runs), docx_definitions(runs)
    bound = bind_preceding(refs, defs)
    indented = runs.groupBy("doc", F.col("para").alias("note")).agg(F.max(F.col("indent") == BOUND_INDENT).alias("placed"))
    rows = bound.withColumn("note", (F.col("note_at") / 10000).cast("int")).join(indented, ["doc", "note"], "left")
    note = F.struct("note", "number", (F.col("ref_at") / 10000).cast("int").alias("ref_para"), "ref_at", F.coalesce("placed", F.lit(False)).alias("placed"))
    notes = rows.groupBy("doc").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    taken = bound.where("ref_at is not null").select("doc", "number", F.col("ref_at").alias("at"))
    free = refs.join(taken, ["doc", "number", "at"], "left_anti")
    loose = F.struct((F.col("at") / 10000).cast("int").alias("para"), (F.col("at") % 10000).cast("int").alias("run"), "number")
    return notes.join(free.groupBy("doc").agg(F.array_sort(F.collect_list(loose)).alias("loose")), "doc", "full")


def _said(p: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{WORD}t"))


def _indent(p: ElementTree.Element) -> None:
    """Sets the left indent of a bound note, at the place the schema wants."""
    props = p.find(f"{WORD}pPr")
    if props is None:
        props = ElementTree.Element(f"{WORD}pPr")
        p.insert(0, props)
    ind = props.find(f"{WORD}ind")
    if ind is None:
        ind = ElementTree.Element(f"{WORD}ind")
        later = [i for i, c in enumerate(props) if c.tag.removeprefix(WORD) in AFTER_INDENT]
        props.insert(later[0] if later else len(props), ind)
    ind.set(f"{WORD}left", str(BOUND_INDENT))


def _yellow(run: ElementTree.Element) -> None:
    props = run.find(f"{WORD}rPr")
    if props is None:
        props = ElementTree.Element(f"{WORD}rPr")
        run.insert(0, props)
    mark = props.find(f"{WORD}highlight")
    if mark is None:
        mark = ElementTree.SubElement(props, f"{WORD}highlight")
    mark.set(f"{WORD}val", "yellow")


def _flag(p: ElementTree.Element, flag: str) -> None:
    """A highlighted flag at the end of a paragraph that has none."""
    if "[?FN:" not in _said(p):
        run = ElementTree.SubElement(p, f"{WORD}r")
        _yellow(run)
        text = ElementTree.SubElement(run, f"{WORD}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
        text.text = f" {flag}"


def _written(root: ElementTree.Element, names: list[tuple[str, str]]) -> bytes:
    """The tree under the prefixes of its source; those that only attribute values name are declared too."""
    for prefix, uri in names:
        try:
            ElementTree.register_namespace(prefix, uri)
        except ValueError:  # prefixes such as ns1 are the writer's own
            continue
    text = ElementTree.tostring(root, encoding="unicode")
    end = text.index(">")
    start = text[:end].removesuffix("/")
    extra = "".join(f' xmlns:{p}="{u}"' for p, u in dict(names).items() if p and f"xmlns:{p}=" not in start)
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{start}{extra}{text[len(start):]}'.encode()


def bound_file(content: bytes, notes: list[dict], loose: list[dict]) -> tuple[bytes, list[dict]]:
    """A DOCX file with its notes behind the paragraphs of their references, doubts flagged; and the log, by paragraph.

    Binding a bound file again changes nothing. A file without notes and references keeps its text.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
    names = [x for _, x in ElementTree.iterparse(io.BytesIO(parts[BODY]), events=["start-ns"])]
    root = ElementTree.fromstring(parts[BODY])
    paras = list(root.iter(f"{WORD}p"))
    parent = {child: node for node in root.iter() for child in node}
    log, behind = [], {}

    def entry(kind: str, para: int, number: int) -> dict:
        return {"kind": kind, "para": para, "number": number, "snippet": " ".join(_said(paras[para]).split())[:SNIPPET]}

    for n in sorted((n for n in notes if n["ref_at"] is not None and not n["placed"]), key=lambda n: (n["ref_para"], n["note"])):
        p, at = paras[n["note"]], behind.get(n["ref_para"], paras[n["ref_para"]])
        log.append(entry("bound", n["ref_para"], n["number"]))
        if p is not at:
            parent[p].remove(p)
            home = parent[at]
            home.insert(list(home).index(at) + 1, p)
            parent[p] = home
        _indent(p)
        behind[n["ref_para"]] = p
    lost = [(n["note"], n["number"]) for n in notes if n["ref_at"] is None]
    log += [entry("no reference", para, number) for para, number in lost] + [entry("no note", r["para"], r["number"]) for r in loose]
    for para, number in lost:
        _flag(paras[para], NO_REFERENCE.format(number))
    for r in loose:
        _yellow(list(paras[r["para"]].iter(f"{WORD}r"))[r["run"]])
        _flag(paras[r["para"]], NO_NOTE.format(r["number"]))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, _written(root, names) if name == BODY else data)
    return out.getvalue(), sorted(log, key=lambda x: (x["para"], x["number"], x["kind"]))


def bound_documents(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, content binary, log): files (path, content) with their notes bound as assignment(runs) says."""
    of = assignment(runs).withColumnRenamed("doc", "path")
    rows = files.select("path", "content").join(of, "path", "left")

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content, notes, loose in pdf.itertuples(index=False):
                some = [[{k: None if pd.isna(v) else int(v) for k, v in x.items()} for x in found] if found is not None else [] for found in (notes, loose)]
                done, log = bound_file(content, *some)
                yield pd.DataFrame({"path": [path], "content": [done], "log": [log]})

    return rows.select("path", "content", "notes", "loose").mapInPandas(edit, f"path string, content binary, log {LOG}")
