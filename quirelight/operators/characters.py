"""Broken, invisible and soft characters; reference lists set over many lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import strip
from ..functions.text import dehyphenate_join

SOFT, ZERO_WIDTH = "­", "​‌‍﻿"
# Fixed values.
LIGATURES = ("fi", "fl", "ff", "ffi", "ffl", "ft", "st")
BROKEN = rf"[\p{{Cc}}\p{{Cf}}\p{{Co}}&&[^\n\t\r{SOFT}{ZERO_WIDTH}]]"
PAGE = ["volume_id", "pos"]


def glyph_votes(lines: DataFrame) -> DataFrame:
    """(volume_id, ch, ligature, votes): ligatures that turn broken word forms into words of the volume."""
    words = lines.select("volume_id", F.explode(F.regexp_extract_all("line", F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("w"))
    intact = words.select("volume_id", F.lower("w").alias("word")).distinct()
    forms = lines.select("volume_id", F.explode(F.regexp_extract_all("line", F.lit(r"(\S+)"), F.lit(1))).alias("w"))
    forms = forms.where(F.col("w").rlike(BROKEN) & F.col("w").rlike(rf"^(?:\p{{L}}|{BROKEN})+$")).select("volume_id", F.lower("w").alias("form")).distinct()
    marks = forms.select("volume_id", "form", F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit(f"({BROKEN})"), F.lit(1)))).alias("ch"))
    tries = marks.select("volume_id", "form", "ch", F.explode(F.array(*map(F.lit, LIGATURES))).alias("ligature"))
    tries = tries.withColumn("word", F.replace(F.col("form"), F.col("ch"), F.col("ligature"))).where(F.length("word") > F.length("ligature"))
    return tries.join(intact, ["volume_id", "word"], "left_semi").groupBy("volume_id", "ch", "ligature").agg(F.count("*").alias("votes"))


def learned_glyphs(votes: DataFrame) -> DataFrame:
    """(volume_id, ch, ligature): winners with two votes, and twice those of the next."""
    order = W.partitionBy("volume_id", "ch").orderBy(F.desc("votes"), "ligature")
    rows = votes.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("votes").over(order))
    return rows.where("rank = 1 and votes >= 2 and votes >= 2 * greatest(coalesce(next, 1), 1)").select("volume_id", "ch", "ligature")


def resolved(lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """lines with soft hyphens at ends as hyphens, invisible marks dropped, broken glyphs read or dropped.

    Adds soft_hyphens, zero_width and dropped, counted by line.
    """
    table = glyphs.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("ch", "ligature"))).alias("g"))
    rows = lines.join(table, "volume_id", "left")
    at_end = F.col("line").rlike(rf"{SOFT}\s*$")
    line = F.regexp_replace(F.regexp_replace("line", rf"{SOFT}(\s*)$", "-$1"), SOFT, "")
    invisible = F.length(line) - F.length(F.regexp_replace(line, f"[{ZERO_WIDTH}]", ""))
    bare = F.regexp_replace(line, f"[{ZERO_WIDTH}]", "")
    read = F.aggregate(F.coalesce("g", F.array().cast("array<struct<ch: string, ligature: string>>")), bare, lambda t, x: F.replace(t, x["ch"], x["ligature"]))
    rows = rows.withColumn("read", read).withColumn("soft_hyphens", at_end.cast("int")).withColumn("zero_width", invisible)
    return rows.select(*(F.regexp_replace("read", BROKEN, "").alias("line") if c == "line" else F.col(c) for c in lines.columns), "soft_hyphens", "zero_width", (F.length("read") - F.length(F.regexp_replace("read", BROKEN, ""))).alias("dropped"))


HEADING = r"(?i)^(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?(references|bibliography|works cited|literature|literatur(?:verzeichnis)?|bibliographie|bibliografie)\s*:?\s*$"


def merged_references(lines: DataFrame, digits: int = 3) -> DataFrame:
    """lines (volume_id, pos, ln, line, size) with the entries of a reference list on one line each.

    An entry begins with its number of up to ``digits`` digits in brackets.

    The list starts at the first entry within four lines after its heading. It ends at type larger by 12 % with no entry
    in the next 40 lines; other large type inside it (heads of pages) is left out of entries.
    """
    v = W.partitionBy("volume_id").orderBy("pos", "ln")
    rows = lines.withColumn("entry", strip(F.col("line")).rlike(rf"^\[[0-9]{{1,{digits}}}\]\s")).withColumn("head", strip(F.col("line")).rlike(HEADING)).withColumn("at", F.row_number().over(v))
    near = F.max(F.when(F.col("head"), F.col("at"))).over(v.rowsBetween(-4, -1))
    rows = rows.withColumn("starts", F.col("entry") & near.isNotNull())
    rows = rows.withColumn("start", F.min(F.when(F.col("starts"), F.col("at"))).over(W.partitionBy("volume_id")))
    rows = rows.withColumn("block", F.max(F.when(F.col("at") == F.col("start"), F.col("size"))).over(W.partitionBy("volume_id")))
    large = F.coalesce((F.col("at") >= F.col("start")) & (F.col("size") > 1.12 * F.col("block")), F.lit(False))
    more = F.coalesce(F.max(F.col("entry").cast("int")).over(v.rowsBetween(1, 40)), F.lit(0)) > 0
    rows = rows.withColumn("large", large).withColumn("ends", F.col("large") & ~more)
    rows = rows.withColumn("end", F.min(F.when(F.col("ends"), F.col("at"))).over(W.partitionBy("volume_id")))
    inside = F.coalesce((F.col("at") >= F.col("start")) & (F.col("at") < F.coalesce("end", F.lit(1 << 31))) & ~F.col("large"), F.lit(False))
    rows = rows.withColumn("inside", inside).withColumn("nth", F.sum((F.col("inside") & F.col("entry")).cast("int")).over(v.rowsBetween(W.unboundedPreceding, 0)))
    joined = rows.where("inside").groupBy("volume_id", "nth").agg(F.array_sort(F.collect_list(F.struct("pos", "ln", strip(F.col("line")).alias("t")))).alias("l"))
    joined = joined.select("volume_id", F.col("l")[0]["pos"].alias("pos"), F.col("l")[0]["ln"].alias("ln"), dehyphenate_join(F.transform("l", lambda x: x["t"])).alias("line"), F.lit(True).alias("is_entry"))
    return rows.where("not inside").select(*PAGE, "ln", "line", F.lit(False).alias("is_entry")).unionByName(joined)
