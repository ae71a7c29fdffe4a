"""Pages from files: text and JSON pages, archives of pages, outlines; and the same written back.

All reading goes through Spark's readers, so paths may lie in any store. Archives are taken apart in Arrow batches, one
file at a time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import natural_key

BOX = "array<double>"
PAGE_SCHEMA = (
    f"version int, index int, source string, width double, height double, label string, links array<struct<box: {BOX}, target: int>>, "
    f"lines array<struct<spans: array<struct<text: string, box: {BOX}, size: double, bold: boolean, italic: boolean>>, box: {BOX}, baseline: double, confidence: double, glyphs: array<struct<char: string, box: {BOX}, confidence: double>>>>"
)
VERSION = 1
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _place(path: Column) -> tuple[Column, Column]:
    """Folder and name without its ending."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def split_lines(text: Column) -> Column:
    """Lines as printed: every kind of line break counts, a last empty piece doesn't."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, pos, lines) of ``<volume>/<number>.txt``; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.txt").option("recursiveFileLookup", "true").load(path)
    volume, stem = _place(F.col("path"))
    rows = files.select(volume.alias("volume_id"), stem.alias("stem"), F.decode("content", "UTF-8").alias("text"))
    pos = F.row_number().over(W.partitionBy("volume_id").orderBy(natural_key(F.col("stem")), "stem"))
    return rows.select("volume_id", pos.alias("pos"), split_lines(F.col("text")).alias("lines"))


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Measured pages of ``<volume>/<number>.json`` in the page schema; another version is an error."""
    rows = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "[0-9]*.json").option("recursiveFileLookup", "true").json(path)
    volume, stem = _place(F.input_file_name())
    ok = F.assert_true(F.coalesce(F.col("version") == VERSION, F.lit(False)), F.lit("page schema version is not 1"))
    return rows.withColumn("volume_id", volume).withColumn("stem", stem).where(ok.isNull())


def clashing(text_pages: DataFrame, json_pages: DataFrame) -> DataFrame:
    """(volume_id, stem) that are there both as text and JSON; must be empty."""
    return text_pages.select("volume_id", "stem").intersect(json_pages.select("volume_id", "stem"))


def fragments(pages: DataFrame) -> DataFrame:
    """A row for each measured line of JSON pages: what the layout operators take."""
    rows = pages.select("volume_id", F.col("index").alias("pos"), "width", "height", F.posexplode("lines").alias("frag", "l"))
    text = F.array_join(F.transform("l.spans", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    sizes = F.transform(F.filter("l.spans", lambda s: s["size"].isNotNull()), lambda s: F.struct(F.aggregate(F.filter("l.spans", lambda t: t["size"] == s["size"]), F.lit(0), lambda a, t: a + F.length(t["text"])).alias("w"), s["size"].alias("size")))
    box = [F.get("l.box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("volume_id", "pos", "frag", text.alias("text"), *box, F.col("l.baseline").alias("baseline"), F.array_max(sizes).getField("size").alias("size"), "width", "height")


def page_json(pages: DataFrame) -> DataFrame:
    """(volume_id, index, content): JSON pages, what is unmeasured left out."""
    def spans(line: Column) -> Column:
        on = lambda c: F.when(c, F.lit(True))
        return F.transform(line["spans"], lambda s: F.struct(s["text"].alias("text"), s["box"].alias("box"), s["size"].alias("size"), on(s["bold"]).alias("bold"), on(s["italic"]).alias("italic")))

    lines = F.transform("lines", lambda n: F.struct(spans(n).alias("spans"), n["box"].alias("box"), n["baseline"].alias("baseline"), n["confidence"].alias("confidence"), n["glyphs"].alias("glyphs")))
    links = F.when(F.size("links") > 0, F.col("links"))
    out = F.struct(F.lit(VERSION).alias("version"), "index", F.nullif("source", F.lit("")).alias("source"), "width", "height", "label", links.alias("links"), lines.alias("lines"))
    return pages.select("volume_id", "index", F.to_json(out).alias("content"))


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, ord, level, title, page) of ``<volume>/outline.json``."""
    rows = spark.read.schema("level int, title string, page int").option("multiLine", True).option("pathGlobFilter", "outline.json").option("recursiveFileLookup", "true").json(path)
    rows = rows.withColumn("volume_id", _place(F.input_file_name())[0]).withColumn("_n", F.monotonically_increasing_id())
    return rows.select("volume_id", F.row_number().over(W.partitionBy("volume_id").orderBy("_n")).alias("ord"), "level", "title", "page")


def is_page_file(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    skip = r"(?i)(__ia_thumb|_thumb|metadata|^_meta|scandata|(?:^|[._-])marc\.txt$)"
    return F.lower(base).endswith(".txt") & ~name.rlike(r"(?i)__MACOSX|\.DS_Store") & ~base.rlike(skip)


def decoded(data: bytes) -> tuple[str, bool]:
    """Text and whether UTF-8 didn't fit: then a guess, where a guesser is installed, else Latin-1."""
    try:
        return data.decode("utf-8"), False
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None:
            return str(best), True
    except ImportError:
        pass
    return data.decode("latin-1"), True


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text, fallback) of all files in ZIP archives."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            text, fallback = decoded(z.read(info)) if info.filename.lower().endswith(".txt") else ("", False)
                            yield pd.DataFrame([(name, info.filename, text, fallback)], columns=["archive", "member", "text", "fallback"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(members, "archive string, member string, text string, fallback boolean")


def archive_pages(members: DataFrame) -> DataFrame:
    """(archive, pos, member, text, fallback): the members that are pages, in natural order of their names."""
    kept = members.where(is_page_file(F.col("member")))
    pos = F.row_number().over(W.partitionBy("archive").orderBy(natural_key(F.col("member")), "member"))
    return kept.select("archive", pos.alias("pos"), "member", "text", "fallback", F.concat(F.lpad(pos.cast("string"), 8, "0"), F.lit(".txt")).alias("file"))


def write_rendered(rendered: DataFrame, path: str) -> None:
    """Rows (volume_id, kind, content) as Parquet, a folder for each kind."""
    rendered.write.mode("overwrite").partitionBy("kind").parquet(path)


def outline_json(outline: DataFrame) -> DataFrame:
    """(volume_id, content): outlines as JSON; a volume without entries has none."""
    entries = F.array_sort(F.collect_list(F.struct("ord", "level", "title", "page")))
    rows = outline.groupBy("volume_id").agg(entries.alias("e"))
    return rows.select("volume_id", F.to_json(F.transform("e", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page")))).alias("content"))
