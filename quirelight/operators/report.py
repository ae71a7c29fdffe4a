"""What a run reports: why observations were turned down, totals, the order of an audit, samples of pages, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import ordinal_of, strip
from .pagination import chapter_number_run
from .structure import ENTRY

PAGE = ["volume_id", "pos"]
# How far a rescued number may be from a note's, characters of a sample and of a heading, positions at which a reading may recur.
NOTE_REACH = 2
SAMPLE = 60
HEADING = 50
RECURRING = 2
#: A printed page number in reconstructed text.
PAGE_MARK = r"\[p\. ([^\]]+)\]"


def reasons(turned_down: DataFrame, modes: DataFrame, defs: DataFrame) -> DataFrame:
    """turned_down (volume_id, pos, label, source, why) with why in full: the first rule that holds.

    contents-page: the page lists contents (modes: volume_id, pos, mode); then what ``pagination.rejected`` found;
    footnote-number: rescued from a foot, and near the number of a note (defs: volume_id, pos, num) of the page or of one
    beside it; chapter-number: in the volume's longest run of rejected labels that count up; else unknown.
    """
    listed = modes.where("mode = 'toc'").select(*PAGE).distinct().withColumn("_listed", F.lit(True))
    around = F.explode(F.array(*(F.col("pos") + i for i in (-1, 0, 1)))).alias("pos")
    near = defs.select("volume_id", around, "num").groupBy(*PAGE).agg(F.collect_set("num").alias("_nums"))
    run = chapter_number_run(turned_down).select(*PAGE).distinct().withColumn("_counts", F.lit(True))
    rows = turned_down.join(listed, PAGE, "left").join(near, PAGE, "left").join(run, PAGE, "left")
    n = ordinal_of(F.col("label"))
    rows = rows.withColumn("_n", n)
    noted = (F.col("source") == "printed-footer") & F.coalesce(F.exists("_nums", lambda x: F.abs(x - F.col("_n")) <= NOTE_REACH), F.lit(False))
    why = F.when(F.col("_listed"), "contents-page").when(F.col("why") != "unknown", F.col("why")).when(noted, "footnote-number")
    why = why.when(F.col("_counts"), "chapter-number").otherwise("unknown")
    return rows.select(*PAGE, "label", "source", why.alias("why"))


def run_totals(classes: DataFrame, defs: DataFrame) -> DataFrame:
    """(volume_id, certain, uncertain, several): notes without doubt, in doubt, and in doubt with several candidates.

    classes: one row a doubt, with n_candidates; defs: one row a note. Volumes of either are reported.
    """
    doubts = classes.groupBy("volume_id").agg(F.count("*").alias("u"), F.count_if(F.col("n_candidates") > 1).alias("m"))
    rows = defs.groupBy("volume_id").agg(F.count("*").alias("d")).join(doubts, "volume_id", "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in "dum"}
    return rows.select("volume_id", F.greatest(n["d"] - n["u"], F.lit(0)).alias("certain"), n["u"].alias("uncertain"), n["m"].alias("several"))


def audit_places(doubts: DataFrame, label: str = "label", num: str = "num") -> DataFrame:
    """doubts with their place in a volume's audit: by the value of the page's label, roman ones too, then by number.

    Labels without a value come first; equal rows are ordered by the label itself.
    """
    order = W.partitionBy("volume_id").orderBy(F.coalesce(ordinal_of(F.col(label)), F.lit(-1)), num, label)
    return doubts.withColumn("place", F.row_number().over(order))


def samples(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(volume_id, pos, sample): the beginning of each page's first line that isn't blank; empty if it has none."""
    full = lines.select(*PAGE, "ln", strip(F.col("line")).alias("s")).where("s <> ''")
    first = full.groupBy(*PAGE).agg(F.substring(F.min_by("s", "ln"), 1, SAMPLE).alias("s"))
    return pages.select(*PAGE).join(first, PAGE, "left").select(*PAGE, F.coalesce("s", F.lit("")).alias("sample"))


def printed_heading(lines: DataFrame) -> DataFrame:
    """(volume_id, heading) of contents lines (volume_id, pos, ln, line): what stands above the entries, or null.

    That is the first line of the first page that isn't blank, if it is no entry, short and has two letters.
    """
    first = lines.groupBy("volume_id").agg(F.min("pos").alias("pos"))
    full = lines.join(first, PAGE).select("volume_id", "ln", strip(F.col("line")).alias("s")).where("s <> ''")
    s = F.col("s")
    heads = ~s.rlike(ENTRY) & (F.length(s) <= HEADING) & s.rlike(r"\p{L}.*\p{L}")
    found = full.groupBy("volume_id").agg(F.min_by("s", "ln").alias("s")).select("volume_id", F.when(heads, s).alias("heading"))
    return first.select("volume_id").join(found, "volume_id", "left")


def with_anchors(paragraphs: DataFrame, targets: DataFrame) -> DataFrame:
    """paragraphs (volume_id, para, text) with ``{#p-LABEL}`` behind the first mark of each target (volume_id, label)."""
    seen = paragraphs.select("volume_id", "para", F.posexplode(F.regexp_extract_all("text", F.lit(PAGE_MARK), F.lit(1))).alias("i", "label"))
    seen = seen.join(targets.select("volume_id", "label").distinct(), ["volume_id", "label"], "left_semi")
    first = seen.groupBy("volume_id", "label").agg(F.min(F.struct("para", "i")).alias("at"))
    at = first.select("volume_id", "at.para", "at.i").groupBy("volume_id", "para").agg(F.collect_set("i").alias("_at"))
    rows = paragraphs.join(at, ["volume_id", "para"], "left")
    marks, labels = (F.regexp_extract_all("text", F.lit(PAGE_MARK), F.lit(i)) for i in (0, 1))
    rows = rows.withColumn("_marks", marks).withColumn("_labels", labels)

    def piece(text, i):
        anchor = F.when(F.array_contains("_at", i), F.concat(F.lit("{#p-"), F.get("_labels", i), F.lit("}")))
        return F.concat(text, F.coalesce(F.get("_marks", i), F.lit("")), F.coalesce(anchor, F.lit("")))

    text = F.array_join(F.transform(F.split("text", PAGE_MARK), piece), "")
    return rows.withColumn("text", F.when(F.col("_at").isNull(), F.col("text")).otherwise(text)).drop("_at", "_marks", "_labels")


def without_furniture(readings: DataFrame, most: int = RECURRING) -> DataFrame:
    """readings (volume_id, pos, label) less those of labels that are read at more than ``most`` places of their volume."""
    kinds = readings.groupBy("volume_id", "label").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return readings.join(kinds, ["volume_id", "label"], "left_anti").select(*readings.columns)
