"""Modes and regions of pages, contents, chapters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.labels import strip
from ..functions.regions import region_of_heading, region_of_running_head
from ..functions.text import edge_page_number, normalise_header, squeeze

PAGE = ["volume_id", "pos"]
ENTRY = r"^(.*?\S)[\s.]*\s([0-9]{1,4})$"
STANDS_ALONE = r"(?iU)^\s*(?:cap[íi]tulo|chapter|kapitel|hoofdstuk|capitolo|chapitre|parte|part|teil|deel|libro|book|buch|tomo|volume|band)[\s.:—–-]*[IVXLCDM0-9]*\s*$"
ROMAN_PREFIX = r"^(?=[MDCLXVI])(M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\.\s+(\S.*)$"
NUMBER_PREFIX = r"^([0-9]+(?:\.[0-9]+)*)\.?\s+(.*)$"
BULLET_PREFIX = r"^\s*[•▪◦‣*]\s*(\S.*)$"
#: Headings that start a mode of their own.
TRIGGERS = ((r"^[0-9]+\.\s+Literatur\s*$", "entries-versal"), (r"^[0-9]+\.\s+(Abkürzungsverzeichnis|Quellen|Personenregister|Sachregister|Ortsregister)\s*$", "raw"))
CLOSEABLE = ("bibliography", "index", "abbreviations", "notes", "appendix", "contents")


def _volume():
    return W.partitionBy("volume_id").orderBy("pos")


def page_opening(lines: DataFrame) -> DataFrame:
    """(volume_id, pos, region, trigger): what the headings on a page's first lines say.

    region: of the first six lines, pairs of neighbours first; trigger: the mode that one of the first ten sets.
    """
    rows = lines.where(strip(F.col("line")) != "").withColumn("line", strip(F.col("line"))).withColumn("nth", F.row_number().over(W.partitionBy(*PAGE).orderBy("ln"))).where("nth <= 10")
    rows = rows.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("l"))
    six = F.slice("l", 1, 6)
    pairs = F.transform(F.slice(six, 2, 5), lambda b, i: F.concat(F.get(six, i), F.lit(" "), b))
    names = F.filter(F.transform(F.concat(pairs, six), lambda x: region_of_heading(x)), lambda n: n.isNotNull())

    def trigger(line: Column) -> Column:
        out = F.when(region_of_heading(line) == "contents", "toc")
        for pattern, mode in TRIGGERS:
            out = out.when(line.rlike(pattern), mode)
        return out

    modes = F.filter(F.transform("l", trigger), lambda m: m.isNotNull())
    return rows.select(*PAGE, F.get(names, F.lit(0)).alias("region"), F.get(modes, F.lit(0)).alias("trigger"))


def assign_modes(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(volume_id, pos, mode): frontmatter until prose or page 1 begins the main text; contents and lists by headings.

    pages: (volume_id, pos, trigger, toc_like, prose, is_first) with is_first: the printed label is 1. A trigger or a
    contents page sets the mode for what follows; prose ends front matter and contents. Each page thus maps the mode
    before it to one after it, and the last page that maps all modes to one decides: windows, no state machine.
    """
    rows = pages.withColumn("nth", F.row_number().over(_volume()) - 1).withColumn("total", F.count("*").over(W.partitionBy("volume_id")))
    early = F.col("nth") < F.greatest(F.lit(1), F.floor(F.col("total") * config.front_fraction))
    toc, prose = F.coalesce("toc_like", F.lit(False)), F.coalesce("prose", F.lit(False)) | F.coalesce("is_first", F.lit(False))
    # What a page makes of each of the modes before it that can still change: frontmatter, toc, and any other.
    from_front = F.coalesce("trigger", F.when(toc, "toc").when(prose, "main"))
    from_toc = F.coalesce("trigger", F.when(toc & early, "toc").when(prose, "main"))
    from_other = F.coalesce("trigger", F.when(toc & early, "toc"))
    rows = rows.select(*PAGE, "nth", from_front.alias("a"), from_toc.alias("b"), from_other.alias("c"))
    steps = F.array_sort(F.collect_list(F.struct("nth", "pos", "a", "b", "c")))
    by = rows.groupBy("volume_id").agg(steps.alias("s"))
    start = F.struct(F.lit("frontmatter").alias("m"), F.array().cast("array<struct<pos: int, mode: string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        mode = F.coalesce(F.when(acc["m"] == "frontmatter", p["a"]).when(acc["m"] == "toc", p["b"]).otherwise(p["c"]), acc["m"])
        return F.struct(mode.alias("m"), F.concat(acc["out"], F.array(F.struct(p["pos"].cast("int").alias("pos"), mode.alias("mode")))).alias("out"))

    out = by.select("volume_id", F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("x"))
    return out.select("volume_id", "x.pos", "x.mode")


def mode_islands(pages: DataFrame, columns: tuple[str, ...] = ("mode",)) -> DataFrame:
    """pages with island: the number of its run of pages with equal columns."""
    key = F.struct(*columns)
    change = ~F.coalesce(F.lag(key).over(_volume()).eqNullSafe(key), F.lit(False))
    return pages.withColumn("island", F.sum(change.cast("int")).over(_volume().rowsBetween(W.unboundedPreceding, 0)))


def region_markers(pages: DataFrame) -> DataFrame:
    """(volume_id, pos, marker): where the region changes; a first ``main`` needs none."""
    before = F.coalesce(F.lag("region").over(_volume()), F.lit("main"))
    return pages.withColumn("before", before).where("region <> before").select(*PAGE, F.concat(F.lit("[region: "), "region", F.lit("]")).alias("marker"))


def ubiquitous_heads(heads: DataFrame, share: float = 0.4) -> DataFrame:
    """(volume_id, head): running heads (volume_id, pos, head) that reach over so much of the volume."""
    total = heads.groupBy("volume_id").agg(F.countDistinct("pos").alias("n"))
    reach = heads.where("head is not null").groupBy("volume_id", "head").agg((F.max("pos") - F.min("pos") + 1).alias("reach"))
    return reach.join(total, "volume_id").where(F.col("reach") >= share * F.col("n")).select("volume_id", "head")


def assign_regions(pages: DataFrame, prose_to_close: int = 2, tail: float = 0.25, front: float = 0.1) -> DataFrame:
    """(volume_id, pos, region).

    pages: (volume_id, pos, mode, label, head, ubiquitous, opened, heading, prose): narrow features. Closing a region
    takes two pages of prose that are then given back to the main text, so this is a function per volume.
    """
    rows = pages.withColumn("by_head", region_of_running_head(F.col("head"))).withColumn("heading_region", region_of_heading(F.col("heading")))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        clean = lambda c: [None if pd.isna(x) else x for x in pdf[c]]
        modes, labels, heads, by_head, opened, headings, heading_regions = map(clean, ("mode", "label", "head", "by_head", "opened", "heading", "heading_region"))
        prose, everywhere = pdf["prose"].fillna(False).tolist(), pdf["ubiquitous"].fillna(False).tolist()
        n, out = len(pdf), []
        zone = _front_zone(labels, modes, opened, by_head, max(1, int(n * front)))
        now, run, in_tail = "main", [], False
        for i in range(n):
            head = None if by_head[i] is None and everywhere[i] else heads[i]
            begins = opened[i]
            if begins == "preface" and i >= zone:
                begins = None
            if by_head[i] is not None:
                now, run, in_tail = by_head[i], [], i >= n * (1 - tail)
            elif begins is None and now in ("main", "preface") and modes[i] in ("frontmatter", "toc"):
                out.append("front-matter" if modes[i] == "frontmatter" else "contents")
                now, run = "main", []
                continue
            elif begins is not None:
                now, run, in_tail = begins, [], i >= n * (1 - tail)
            elif (now == "preface" and i >= zone) or (now == "contents" and modes[i] == "main"):
                now, run = "main", []
            elif now in CLOSEABLE:
                if (headings[i] and heading_regions[i] is None) or (head is not None and prose[i]):
                    now, run = "main", []
                elif in_tail or not prose[i]:
                    run = []
                else:
                    run.append(i)
                    if len(run) >= prose_to_close:
                        for k in run[:-1]:
                            out[k] = "main"
                        now, run = "main", []
            out.append(now)
        return pd.DataFrame({"volume_id": pdf["volume_id"], "pos": pdf["pos"], "region": out})

    return rows.groupBy("volume_id").applyInPandas(assign, "volume_id string, pos int, region string")


def _front_zone(labels: list, modes: list, opened: list, by_head: list, limit: int) -> int:
    """Pages of front matter: up to the first arabic label after a roman one, else what lists stand in front."""
    import re

    roman = False
    for i, label in enumerate(labels):
        s = (label or "").strip()
        if len(s) >= 2 and re.fullmatch(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", s.lower()):
            roman = True
        elif roman and s.isdigit():
            return i
    end = 0
    for i in range(min(limit, len(modes))):
        names = {opened[i], by_head[i]}
        if modes[i] in ("frontmatter", "toc") or names & {"contents", "abbreviations"} or ("preface" in names and i == end):
            end = i + 1
    return end


# ---------------------------------------------------------------- contents


def toc_entries(lines: DataFrame) -> DataFrame:
    """(volume_id, ord, title, page, level): entries of contents lines (volume_id, pos, ln, line).

    A line without a number is the first half of the next entry if it is directly above it on the page and can't stand
    alone.
    """
    rows = lines.withColumn("s", strip(F.col("line"))).where("s <> ''")
    rows = rows.withColumn("is_entry", F.col("s").rlike(ENTRY))
    alone = F.contains("s", F.lit("|")) | F.col("s").rlike("^[#>-]") | (F.length("s") > 90) | F.col("s").rlike(STANDS_ALONE) | F.coalesce(region_of_heading(F.col("s")) == "contents", F.lit(False))
    half = F.when(~F.col("is_entry") & ~alone, F.col("s"))
    rows = rows.withColumn("above", F.lag(half).over(W.partitionBy(*PAGE).orderBy("ln")))
    title = F.btrim(F.regexp_extract("s", ENTRY, 1), F.lit(" .·|–—…\t"))
    rows = rows.where("is_entry").select("volume_id", "pos", "ln", F.btrim(F.concat_ws(" ", "above", title)).alias("title"), F.regexp_extract("s", ENTRY, 2).cast("int").alias("page"))
    rows = rows.where("title <> ''").withColumn("roman", F.count_if(F.col("title").rlike(ROMAN_PREFIX)).over(W.partitionBy("volume_id")) >= 2)
    bullet = F.regexp_extract("title", BULLET_PREFIX, 1)
    inner = F.when(bullet != "", bullet).otherwise(F.col("title"))
    is_roman, number = F.col("roman") & inner.rlike(ROMAN_PREFIX), F.regexp_extract(inner, NUMBER_PREFIX, 1)
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1 + F.col("roman").cast("int")
    level = F.when(is_roman, 1).when(number != "", depth).otherwise(1)
    rest = F.when(is_roman, F.regexp_extract(inner, ROMAN_PREFIX, 2)).when(number != "", F.regexp_extract(inner, NUMBER_PREFIX, 2)).otherwise(inner)
    rows = rows.select("volume_id", F.row_number().over(W.partitionBy("volume_id").orderBy("pos", "ln")).alias("ord"), strip(rest).alias("title"), "page", (level + (bullet != "").cast("int")).alias("level"))
    return rows.where("title <> ''")


def toc_confidence(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(volume_id, confidence): share of lines that are entries, less where page numbers fall."""
    total = lines.where(strip(F.col("line")) != "").groupBy("volume_id").agg(F.count("*").alias("lines"))
    steps = entries.withColumn("before", F.lag("page").over(W.partitionBy("volume_id").orderBy("ord")))
    per = steps.groupBy("volume_id").agg(F.count("*").alias("n"), F.count("before").alias("steps"), F.count_if(F.col("page") >= F.col("before")).alias("up"))
    rows = total.join(per, "volume_id", "left").na.fill(0)
    order = F.when(F.col("steps") > 0, 0.5 + 0.5 * F.col("up") / F.col("steps")).otherwise(1.0)
    return rows.select("volume_id", F.round(F.col("n") / F.col("lines") * order, 6).alias("confidence"))


def rendered_toc(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(volume_id, content): a list with links to pages whose label is in labels (volume_id, label)."""
    known = labels.select("volume_id", F.col("label").alias("key")).distinct().withColumn("known", F.lit(True))
    rows = entries.withColumn("key", F.col("page").cast("string")).join(known, ["volume_id", "key"], "left")
    linked = F.concat(F.lit("["), "title", F.lit("](#p-"), "key", F.lit(")"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.when(F.col("known"), linked).otherwise(F.col("title")), F.lit(" — p. "), "key")
    return rows.groupBy("volume_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("x")))), lambda r: r["x"]), "\n").alias("content"))


# ---------------------------------------------------------------- outline and chapters


def credible_outline(outline: DataFrame) -> DataFrame:
    """outline (volume_id, ord, level, title, page) of volumes whose outline has three entries, two pages and few junk titles."""
    junk = F.col("title").rlike(r"(?i)^\s*$|\.(pdf|indd|docx?)$|^(untitled|page|seite|blank)?\s*[0-9]*$")
    per = outline.groupBy("volume_id").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.avg(junk.cast("int")).alias("junk"))
    return outline.join(per.where("n >= 3 and pages > 1 and junk <= 0.5").select("volume_id"), "volume_id", "left_semi")


def bare(text: str) -> str:
    return "".join(c for c in text if c.isalnum()).lower()


def spelled_out(title: str, lines: list[str], limit: float = 0.85, most: int = 5) -> int:
    """How many leading lines spell the title; 0 if none do."""
    want, got = bare(title), ""
    for i, line in enumerate(lines[:most]):
        got += bare(line)
        if len(got) > 1.2 * len(want):
            return 0
        if want and (got == want or SequenceMatcher(None, want, got).ratio() >= limit):
            return i + 1
    return 0


def confirmed_starts(outline: DataFrame, lines: DataFrame) -> DataFrame:
    """(volume_id, pos, title, level, n_lines): outline entries that their page's first lines spell out, coarsest first."""
    first = lines.where(strip(F.col("line")) != "").withColumn("nth", F.row_number().over(W.partitionBy(*PAGE).orderBy("ln"))).where("nth <= 5")
    first = first.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("l"))

    @F.pandas_udf("int")
    def spells(titles: pd.Series, some: pd.Series) -> pd.Series:
        return pd.Series([spelled_out(t, list(x)) for t, x in zip(titles, some)], dtype="int32")

    rows = outline.withColumnRenamed("page", "pos").join(first, PAGE).withColumn("n_lines", spells("title", "l")).where("n_lines > 0")
    return rows.groupBy(*PAGE).agg(F.min_by(F.struct("title", "level", "n_lines"), F.struct("level", "ord")).alias("x")).select(*PAGE, "x.*")


def title_starts(entries: DataFrame, lines: DataFrame, contents: DataFrame) -> DataFrame:
    """(volume_id, pos, title, ord): of each contents entry the first free page whose first lines spell its title.

    contents: pages (volume_id, pos) that list contents. A page is compared only if one of its first four lines holds the
    title's first word; pages are taken in the order of entries, so that is a function per volume on the few pairs left.
    """
    first = lines.where(strip(F.col("line")) != "").withColumn("nth", F.row_number().over(W.partitionBy(*PAGE).orderBy("ln"))).where("nth <= 5")
    first = first.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("l"))
    first = first.join(contents.select(*PAGE), PAGE, "left_anti")
    word = F.lower(F.regexp_extract("title", r"(\p{L}+)", 1))
    gate = F.contains(F.lower(F.array_join(F.slice("l", 1, 4), " ")), F.col("word")) & (F.col("word") != "")
    pairs = entries.select("volume_id", "ord", "title", word.alias("word")).join(first, "volume_id").where(gate)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        done: set[int] = set()
        out = []
        for n, pos, title, some in sorted(zip(pdf["ord"], pdf["pos"], pdf["title"], pdf["l"]), key=lambda r: r[:2]):
            if n not in done and pos not in taken and spelled_out(title, list(some)):
                taken.add(pos)
                done.add(n)
                out.append((pdf["volume_id"].iloc[0], int(pos), title, int(n)))
        return pd.DataFrame(out, columns=["volume_id", "pos", "title", "ord"])

    return pairs.select("volume_id", "ord", "title", "pos", "l").groupBy("volume_id").applyInPandas(take, "volume_id string, pos int, title string, ord int")


def fresh_starts(found: DataFrame, known: DataFrame) -> DataFrame:
    """known chapter starts and those found on pages where none is known."""
    fresh = found.join(known.select(*PAGE), PAGE, "left_anti")
    return known.select(*PAGE, "title").unionByName(fresh.select(*PAGE, "title"))


def without_running_titles(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """lines without chapter titles that head later pages of their chapter; a page number beside one stays.

    starts: (volume_id, pos, title). Only the first three lines of a page after the start are looked at.
    """
    marks = starts.select("volume_id", "pos", "title", F.lit(0).alias("o"))
    pages = lines.select(*PAGE).distinct().select("volume_id", "pos", F.lit(None).cast("string").alias("title"), F.lit(1).alias("o"))
    before = F.last("title", ignorenulls=True).over(W.partitionBy("volume_id").orderBy("pos", "o").rowsBetween(W.unboundedPreceding, -1))
    at = marks.unionByName(pages).withColumn("chapter", before).where("o = 1").join(starts.select(*PAGE).distinct(), PAGE, "left_anti").select(*PAGE, "chapter")
    full = strip(F.col("line")) != ""
    rows = lines.join(at, PAGE, "left").withColumn("nth", F.count_if(full).over(W.partitionBy(*PAGE).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)))
    is_title = full & (F.col("nth") <= 3) & (normalised_title(F.col("line")) == normalised_title(F.col("chapter")))
    number = edge_page_number(F.col("line"))
    rows = rows.withColumn("gone", F.coalesce(is_title, F.lit(False)))
    return rows.where(~F.col("gone") | number.isNotNull()).select(*PAGE, "ln", F.when(F.col("gone"), number).otherwise(F.col("line")).alias("line"))


def principal_rank(starts: DataFrame) -> DataFrame:
    """(volume_id, level): the outline level that most chapters open on; packaging and subsections don't count."""
    wrap = F.col("title").rlike(r"(?i)^(cover|title( page)?|isbn.*|copyright|imprint|half.?title|inhalt|contents)$")
    sub = F.col("title").rlike(r"^(?:[IVXLC]+|[0-9]+)\.[0-9]+")
    per = starts.groupBy("volume_id", "level").agg(F.count("*").alias("n"), F.min(wrap.cast("int")).alias("wrap"), F.avg(sub.cast("int")).alias("sub"))
    return per.where("wrap = 0 and sub <= 0.5").groupBy("volume_id").agg(F.min_by("level", F.struct(-F.col("n"), "level")).alias("level"))


def longest_rise(numbers: Column) -> Column:
    """The longest run of an array of numbers, in order, that never falls; the earliest of equal ones."""

    @F.pandas_udf("array<int>")
    def of(s: pd.Series) -> pd.Series:
        from bisect import bisect_right

        out = []
        for values in s:
            tails: list[int] = []
            at: list[int] = []
            before: list[int] = []
            values = [] if values is None else [int(v) for v in values]
            for i, v in enumerate(values):
                k = bisect_right(tails, v)
                before.append(at[k - 1] if k else -1)
                tails[k : k + 1] = [v]
                at[k : k + 1] = [i]
            best, i = [], at[-1] if at else -1
            while i >= 0:
                best.append(values[i])
                i = before[i]
            out.append(best[::-1])
        return pd.Series(out)

    return of(numbers)


def normalised_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(squeeze(normalise_header(title)), r"[^\p{L}\p{N}]", ""))
