"""Prepared text, journal clippings, DOCX files, decision files and human-made truth."""

from __future__ import annotations

import io
import re
import tomllib
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze

# ---------------------------------------------------------------- prepared text


def read_whole(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, text) of files of a kind, line ends made line feeds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))


NOTE = r"^\((\*|[0-9]{1,3})\)\s*(.*)$"


def prepared_markdown(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Markdown of prepared text, and the notes (page, key) that nothing in the body refers to.

    Pages are parted by ``---``, a page's notes follow ``--``. A page of notes alone goes on with the page before.
    Markers are numbered over the whole text in the order of first use; notes of numbered pages without a marker hang at
    the end of the last paragraph of their page.
    """
    pages: list[tuple[int | None, str, dict[str, str]]] = []
    for raw in re.split(r"\n---[ \t]*\n", text.strip("\n")):
        if not raw.strip():
            continue
        body, *rest = re.split(r"\n--[ \t]*\n", raw, maxsplit=1)
        block = rest[0] if rest else ""
        first = next((x for x in body.split("\n") if x.strip()), "")
        if not block and re.match(NOTE, first):
            body, block = "", body
        number = re.match(r"^\s*\[(?:p\.?\s*|S\.?\s*)?(\d+)\]", body)
        if number:
            body = f"{body[: number.start()]}[p. {number[1]}]{body[number.end() :]}"
        notes: dict[str, list[str]] = {}
        key = None
        for line in block.split("\n"):
            m = re.match(NOTE, line)
            if m:
                key = m[1]
                notes.setdefault(key, []).append(m[2].strip())
            elif key is not None:
                notes[key].append(line.strip())
        joined = {k: " ".join(x for x in v if x) for k, v in notes.items()}
        if pages and not number and not body.strip() and joined:
            pages[-1][2].update(joined)
        else:
            pages.append((int(number[1]) if number else None, body, joined))
    index: dict[int, int] = {}
    for i, (n, _, _) in enumerate(pages):
        if n is not None:
            index.setdefault(n, i)
    lines = "\n".join(b for _, b, _ in pages).split("\n")
    paragraphs, held = [], []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line.strip())
        elif held:
            paragraphs.append(" ".join(held))
            held = []
    numbers: dict[tuple[int, str], int] = {}
    at: int | None = None

    def put(m: re.Match) -> str:
        nonlocal at
        if m[1]:
            at = index.get(int(m[1]), at)
            return f"[p. {int(m[1])}]"
        if at is None or m[2] not in pages[at][2]:
            return m[0]
        return f"[^{numbers.setdefault((at, m[2]), len(numbers) + 1)}]"

    out = [re.sub(r"\[p\.\s*(\d+)\]|\((\*|\d{1,3})\)", put, p) for p in paragraphs]
    hung: list[tuple[int, str]] = []
    claimed = set(numbers)
    for i, (n, _, notes) in enumerate(pages):
        for key in notes:
            if n is not None and (i, key) not in claimed and out:
                numbers[i, key] = len(numbers) + 1
                to = max((k for k, p in enumerate(out) if f"[p. {n}]" in p), default=len(out) - 1)
                out[to] = f"{out[to].rstrip()} [^{numbers[i, key]}]"
                hung.append((n, key))
    defs = [f"[^{g}]: {pages[i][2][k]}" for (i, k), g in sorted(numbers.items(), key=lambda x: x[1])]
    return "\n\n".join([*out, *defs]).rstrip() + "\n", hung


def prepared(texts: DataFrame) -> DataFrame:
    """(path, markdown, hung array<struct<page, key>>) of (path, text)."""

    @F.pandas_udf("struct<markdown: string, hung: array<struct<page: int, key: string>>>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = [prepared_markdown(t or "") for t in s]
            yield pd.DataFrame({"markdown": [m for m, _ in rows], "hung": [[{"page": p, "key": k} for p, k in h] for _, h in rows]})

    return texts.select("path", of("text").alias("x")).select("path", "x.markdown", "x.hung")


# ---------------------------------------------------------------- clippings


def clipping_markdown(text: str, today: str) -> tuple[str, int, list[int]]:
    """A clipping with its glued note digits as Pandoc notes; how many notes there are, and those not found in the body."""
    front = re.match(r"\A---\n(.*?)\n---\n", text, re.S)
    rest = text[front.end() :] if front else text
    wanted = {"updated": today, "pandoc_compatible": "true"}
    head = front[1].split("\n") if front else []
    head = [next((f"{k}: {v}" for k, v in wanted.items() if re.match(rf"{k}\s*:", x)), x) for x in head]
    order = ("pandoc_compatible", "updated") if front else ("updated", "pandoc_compatible")
    head += [f"{k}: {wanted[k]}" for k in order if not any(x.startswith(f"{k}:") for x in head)]
    first = re.search(r"^<sup>1</sup>\s", rest, re.M)
    body, block = (rest[: first.start()], rest[first.start() :]) if first else (rest, "")
    pieces = re.split(r"^<sup>(\d+)</sup>\s*", block, flags=re.M)[1:]
    notes = {int(n): t.rstrip() for n, t in zip(pieces[::2], pieces[1::2])}
    out, at, missing = [], 0, []
    for n in sorted(notes):
        m = re.compile(rf"(?<=[a-zA-ZÀ-ſ.,;:!?)\]\"“”'‘’»]){n}(?!\d)").search(body, at)
        if m:
            out += [body[at : m.start()], f"[^{n}]"]
            at = m.end()
        else:
            missing.append(n)
    body = "".join([*out, body[at:]]).rstrip()
    defs = "\n".join(f"[^{n}]: {' '.join(notes[n].split())}" for n in sorted(notes))
    return "---\n" + "\n".join(head) + f"\n---\n{body}\n\n{defs}\n", len(notes), missing


def clippings(texts: DataFrame, today: str) -> DataFrame:
    """(path, markdown, notes, missing array<int>) of (path, text)."""

    @F.pandas_udf("struct<markdown: string, notes: int, missing: array<int>>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = [clipping_markdown(t or "", today) for t in s]
            yield pd.DataFrame(rows, columns=["markdown", "notes", "missing"])

    return texts.select("path", of("text").alias("x")).select("path", "x.*")


# ---------------------------------------------------------------- DOCX

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_runs(content: bytes) -> list[tuple]:
    """(paragraph, run, text, superscript, style, left indent) of a DOCX file's body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for i, p in enumerate(root.iter(f"{WORD}p")):
        style, indent = p.find(f"{WORD}pPr/{WORD}pStyle"), p.find(f"{WORD}pPr/{WORD}ind")
        left = indent.get(f"{WORD}left") if indent is not None else None
        named = style.get(f"{WORD}val") if style is not None else None
        runs = list(p.iter(f"{WORD}r")) or [None]
        for j, r in enumerate(runs):
            text = "".join(t.text or "" for t in r.iter(f"{WORD}t")) if r is not None else ""
            raised = r.find(f"{WORD}rPr/{WORD}vertAlign") if r is not None else None
            out.append((i, j, text, raised is not None and raised.get(f"{WORD}val") == "superscript", named, int(left) if left and left.lstrip("-").isdigit() else None))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc, para, run, text, superscript, style, indent) of DOCX files."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "para", "run", "text", "superscript", "style", "indent"]
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                out = pd.DataFrame([(name, *r) for r in docx_runs(content)], columns=names)
                yield out.astype({"indent": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(runs, "doc string, para int, run int, text string, superscript boolean, style string, indent int")


def docx_references(runs: DataFrame) -> DataFrame:
    """(doc, number, at): superscript digits."""
    rows = runs.where(F.col("superscript") & F.trim("text").rlike("^[0-9]{1,3}$"))
    return rows.select("doc", F.trim("text").cast("int").alias("number"), (F.col("para").cast("long") * 10000 + F.col("run")).alias("at"))


def docx_definitions(runs: DataFrame) -> DataFrame:
    """(doc, number, at): paragraphs that begin ``n)``; they come after all references of their paragraph."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "")
    paras = runs.groupBy("doc", "para").agg(text.alias("text"))
    number = F.regexp_extract("text", r"^([0-9]{1,3})\.?\)\s", 1)
    return paras.where(number != "").select("doc", number.cast("int").alias("number"), (F.col("para").cast("long") * 10000 + 9999).alias("at"))


# ---------------------------------------------------------------- truth and corpus files

STATUSES, REGIMES, LICENCES = ("intact", "marker_lost", "damaged"), ("r3", "r4", "none"), ("free", "restricted", "protected")


def read_truth(text: str) -> dict[str, list[dict]]:
    """Rows of a truth file (TOML) by relation: pages, footnotes, citations, bibliography, regions; strict."""
    data = tomllib.loads(text)
    unknown = set(data) - {"pages", "footnotes", "citations", "bibliography", "regions", "meta", "empty_pages"}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    for row in data.get("footnotes", []):
        if row.get("status", "intact") not in STATUSES:
            raise ValueError(f"unknown status {row['status']!r}")
        if row["page"] not in data.get("pages", []):
            raise ValueError(f"note on page {row['page']!r} that isn't listed")
    for row in data.get("citations", []):
        if row.get("regime") not in REGIMES:
            raise ValueError(f"unknown regime {row.get('regime')!r}")
    pages = [{"ord": i, "label": str(x)} for i, x in enumerate(data.get("pages", []))]
    return {"pages": pages, **{k: data.get(k, []) for k in ("footnotes", "citations", "bibliography", "regions")}}


def sampled_pages(labels: list[str], n: int, seed: int) -> list[str]:
    """A reproducible sample, in page order."""
    import random

    picked = sorted(random.Random(seed).sample(range(len(labels)), min(n, len(labels))))
    return [labels[i] for i in picked]


def verified(files: DataFrame, sums: DataFrame) -> DataFrame:
    """(name, ok): whether contents (name, content) have the SHA-256 given in (name, sha256)."""
    return files.join(sums, "name").select("name", (F.sha2("content", 256) == F.lower("sha256")).alias("ok"))


def first_line(text: Column, most: int = 60) -> Column:
    """The first line with text, cut."""
    return F.substring(squeeze(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))), 1, most)
