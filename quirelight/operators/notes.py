"""Footnotes of pages: definitions, their text, markers in the body, continuations and notes nobody refers to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MARKER, dehyphenate_join, match_definition, normalise_superscripts, substitute_markers

PAGE = ["volume_id", "pos"]


def split_notes(lines: DataFrame) -> DataFrame:
    """lines with role (body or note), note number and its place: notes begin at the first ``n)`` line of a page."""
    lines = lines.withColumn("line", F.regexp_replace(normalise_superscripts(F.col("line")), r"(?U)\s+$", ""))
    number, text = match_definition(F.col("line"))
    w = W.partitionBy(*PAGE).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("num", number).withColumn("text", text)
    rows = rows.withColumn("nth", F.count("num").over(w)).withColumn("note", F.last("num", ignorenulls=True).over(w))
    return rows.withColumn("role", F.when(F.col("nth") > 0, "note").otherwise("body"))


def _joined(lines: Column, mend: bool) -> Column:
    """Lines as one, words broken at line ends mended or all left as they stand."""
    return dehyphenate_join(lines) if mend else F.array_join(lines, " ")


def definitions(split: DataFrame, mend: bool = True) -> DataFrame:
    """(volume_id, pos, num, text): lines of a note joined; of equal numbers on a page the last counts."""
    rows = split.where("role = 'note'").groupBy(*PAGE, "nth").agg(F.first("note").alias("num"), F.array_sort(F.collect_list(F.struct("ln", F.coalesce("text", "line").alias("line")))).alias("l"))
    rows = rows.select(*PAGE, "nth", "num", F.btrim(_joined(F.transform("l", lambda x: x["line"]), mend)).alias("text"))
    return rows.groupBy(*PAGE, "num").agg(F.max_by("text", "nth").alias("text"))


def bodies(split: DataFrame, defs: DataFrame) -> DataFrame:
    """(volume_id, pos, body): body lines joined by line feeds, each note's marker set in brackets."""
    body = split.where("role = 'body'").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    body = body.select(*PAGE, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
    numbers = defs.groupBy(*PAGE).agg(F.array_sort(F.collect_set("num")).alias("nums"))
    rows = body.join(numbers, PAGE, "left")
    return rows.select(*PAGE, F.when(F.col("nums").isNull(), F.col("body")).otherwise(substitute_markers(F.col("body"), F.col("nums"))).alias("body"))


def marker_occurrences(pages: DataFrame) -> DataFrame:
    """(volume_id, pos, nth, num): bracketed markers in the order they stand in."""
    found = F.regexp_extract_all("body", F.lit(MARKER), F.lit(1))
    return pages.select(*PAGE, F.posexplode(found).alias("nth", "num")).select(*PAGE, "nth", F.col("num").cast("int").alias("num"))


def unclaimed(defs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Definitions whose marker isn't on their page."""
    return defs.join(occurrences.select(*PAGE, "num").distinct(), [*PAGE, "num"], "left_anti")


def attach_continuations(defs: DataFrame, continuations: DataFrame, mend: bool = True) -> DataFrame:
    """defs with each page's leading note text joined to the highest note of the nearest earlier page that has notes.

    continuations: (volume_id, pos, text). Several continuations of one note are joined in page order.
    """
    pages = defs.groupBy(*PAGE).agg(F.max("num").alias("num")).withColumn("kind", F.lit(0))
    both = pages.select(*PAGE, "kind", "num", F.lit(None).cast("string").alias("more")).unionByName(continuations.select(*PAGE, F.lit(-1).alias("kind"), F.lit(None).cast("int").alias("num"), F.col("text").alias("more")))
    w = W.partitionBy("volume_id").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, -1)
    target = F.last(F.when(F.col("num").isNotNull(), F.struct("pos", "num")), ignorenulls=True).over(w)
    found = both.withColumn("to", target).where("more is not null and to is not null")
    found = found.groupBy("volume_id", F.col("to.pos").alias("pos"), F.col("to.num").alias("num")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "more"))).alias("m"))
    rows = defs.join(found, [*PAGE, "num"], "left")
    joined = _joined(F.concat(F.array("text"), F.transform("m", lambda x: x["more"])), mend)
    return rows.select(*PAGE, "num", F.when(F.col("m").isNull(), F.col("text")).otherwise(joined).alias("text"))


def bind_preceding(references: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, number, note_at, ref_at): each note takes the last reference before it with its number that is still free.

    references (doc, number, at), notes (doc, number, at). Numbers are independent, so each (doc, number) is one group.
    """

    def bind(pdf: pd.DataFrame) -> pd.DataFrame:
        free: list[int] = []
        out = []
        for at, is_note in sorted(zip(pdf["at"], pdf["note"])):
            if not is_note:
                free.append(int(at))
            else:
                out.append((pdf["doc"].iloc[0], int(pdf["number"].iloc[0]), int(at), free.pop() if free else None))
        return pd.DataFrame(out, columns=["doc", "number", "note_at", "ref_at"])

    both = references.withColumn("note", F.lit(False)).unionByName(notes.withColumn("note", F.lit(True)))
    return both.groupBy("doc", "number").applyInPandas(bind, "doc string, number int, note_at long, ref_at long")


def nearby_numbers(defs: DataFrame) -> DataFrame:
    """(volume_id, pos, nums): note numbers of a page and of the pages before and after it."""
    per = defs.groupBy(*PAGE).agg(F.collect_set("num").alias("own"))
    w = W.partitionBy("volume_id").orderBy("pos").rangeBetween(-1, 1)
    return per.select(*PAGE, F.array_sort(F.array_distinct(F.flatten(F.collect_list("own").over(w)))).alias("nums"))
