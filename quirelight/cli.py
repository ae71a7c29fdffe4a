"""Commands over folders of any store: ``python -m quirelight VERB SOURCE --out FOLDER``.

Each verb reads a folder and writes one: texts in folders named by volume or path, tables as Parquet or JSON. Volumes of
a source are worked on together. Status 2: a source that isn't there, or decisions that contradict each other.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import doubt, translate
from .plans.reflow import Reflow
from .sources import documents, docx_out, pages

CONTRADICTIONS = ("ambiguous decision", "two marks for one note")


def _texts(rows: DataFrame, key: str, out: str) -> None:
    """Rows (key, content) as one text file each, in a folder named by the key."""
    rows.select(F.regexp_replace(key, "^.*/", "").alias(key), F.col("content").alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(out)


def reflow(spark: SparkSession, args: argparse.Namespace) -> None:
    """Pages of text (or ZIP archives of them) to reconstructed volumes."""
    if args.verb == "pages-zip":
        members = pages.archive_pages(pages.archive_members(spark, args.source))
        source = members.select(F.col("archive").alias("volume_id"), "pos", pages.split_lines(F.col("text")).alias("lines"))
    else:
        source = pages.read_text_pages(spark, args.source)
    volumes = Reflow(source)
    made = {"md": volumes.markdown, "txt": volumes.text, "review": volumes.review, "audit": volumes.audit, "pagination": volumes.pagination_report}
    _texts(made[args.format](), "volume_id", args.out)


def prepared(spark: SparkSession, args: argparse.Namespace) -> None:
    """Prepared texts to Markdown."""
    _texts(documents.prepared(documents.read_whole(spark, args.source, ".txt")).withColumnRenamed("markdown", "content"), "path", args.out)


def clippings(spark: SparkSession, args: argparse.Namespace) -> None:
    """Journal clippings to Markdown with notes."""
    found = documents.clippings(documents.read_whole(spark, args.source, ".md"), args.today)
    _texts(found.withColumnRenamed("markdown", "content"), "path", args.out)


def translation(spark: SparkSession, args: argparse.Namespace) -> None:
    """Markdown made ready for translation."""
    texts = documents.read_whole(spark, args.source, ".md")
    _texts(texts.select("path", translate.prepare_translation(F.col("text")).alias("content")), "path", args.out)


def learn(spark: SparkSession, args: argparse.Namespace) -> None:
    """Decisions to a profile of which glyphs stand for which digits."""
    texts = documents.read_whole(spark, args.source, ".decisions.txt")
    lines = texts.select(F.col("path").alias("source"), F.explode(F.split("text", "\n")).alias("line"))
    doubt.learn_profile(doubt.read_decisions(lines)).write.mode("overwrite").json(args.out)


def bind_notes(spark: SparkSession, args: argparse.Namespace) -> None:
    """DOCX files with their notes bound: rows (path, content, log)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(args.source)
    docx_out.bound_documents(files, documents.read_docx(spark, args.source)).write.mode("overwrite").parquet(args.out)


VERBS = {"reflow": reflow, "pages-zip": reflow, "prepared": prepared, "clippings": clippings, "translate-prep": translation, "learn": learn, "bind-footnotes": bind_notes}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirelight", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("source")
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=("md", "txt", "review", "audit", "pagination"), default="md", help="of reflow and pages-zip")
    p.add_argument("--today", default=datetime.date.today().isoformat(), help="the day that clippings name")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quirelight").getOrCreate()
    try:
        VERBS[args.verb](spark, args)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"not found: {args.source}", file=sys.stderr)
        return 2
    except PySparkException as e:
        found = [x for x in CONTRADICTIONS if x in str(e)]
        if not found:
            raise
        print(found[0], file=sys.stderr)
        return 2
    return 0
