"""Line and paragraph scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import strip

# Fixed values.
HARD_HYPHEN = r"(?iU)^\s*(und|oder|bis|sowie|wie|als|zur?|zum?|noch|aber)\b"
NUMBERED_HEADING = r"^(?:([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.|([0-9]{1,2}(?:\.[0-9]{1,2}){1,3}))\s+[A-ZÄÖÜ]"
MARKED_HEADING = r"(?U)^(?:([0-9]{1,2}(?:\.[0-9]{1,2}){1,3})\.?|([0-9]{1,2}))\s+\p{L}"
BULLET = r"^[•▪◦‣]\s*\S"
SENTENCE_END = r"[.!?»“”\"’']$"
TRAILING_MARKERS = r"(\s*\[[0-9]{1,3}\])+$"
MARKER = r"\[([0-9]{1,3})\]"
MARKED_SPAN = r"\[p\. [^\]]+\]|\[\^?[0-9]{1,3}\]"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def normalise_superscripts(text: Column) -> Column:
    return F.translate(text, SUPERSCRIPTS, DIGITS)


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_header(line: Column) -> Column:
    """A line without page numbers at its ends."""
    return F.regexp_replace(F.regexp_replace(squeeze(line), r"^[0-9]+\s*", ""), r"\s*[0-9]+$", "")


def edge_page_number(line: Column) -> Column:
    """One to four digits beside other text, in front first; else null."""
    s = strip(line)
    lead, trail = F.regexp_extract(s, r"^([0-9]{1,4})\s+\S", 1), F.regexp_extract(s, r"\S\s+([0-9]{1,4})$", 1)
    return F.coalesce(F.nullif(lead, F.lit("")), F.nullif(trail, F.lit("")))


def heading_level(line: Column, marked: Column | None = None) -> Column:
    """Depth of a numbered heading, 1 for an unnumbered one that is marked, 0 for what is none or over 80 letters."""

    def depth(pattern: str) -> Column:
        number = F.concat(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))
        return F.when(line.rlike(pattern), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)

    plain = F.coalesce(depth(NUMBERED_HEADING), F.lit(0))
    if marked is None:
        return F.when(F.length(line) > 80, 0).otherwise(plain)
    shown = F.coalesce(depth(MARKED_HEADING), F.when(line.rlike("^[0-9]"), 0).otherwise(1))
    return F.when(F.length(line) > 80, 0).when(marked, shown).otherwise(plain)


def ends_hyphenated(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s+$", "").rlike(r"\p{L}-$")


def is_hard_hyphen(next_line: Column) -> Column:
    return next_line.rlike(HARD_HYPHEN)


def dehyphenate_join(lines: Column) -> Column:
    """Lines as one: a hyphen between letters at a line's end goes, unless the next line starts with a joining word."""

    def step(acc: Column, line: Column) -> Column:
        joins = acc.rlike(r"\p{L}-$") & line.rlike(r"^\p{L}") & ~is_hard_hyphen(line)
        bare = F.regexp_replace(line, r"(?U)^\s+", "")
        return F.when(joins, F.concat(F.regexp_replace(acc, "-$", ""), bare)).otherwise(F.concat(acc, F.lit(" "), bare))

    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(lines) > 0, F.aggregate(rest, F.get(lines, F.lit(0)), step)).otherwise("")


def escape_md(text: Column) -> Column:
    return F.regexp_replace(text, r"([*_])", r"\\$1")


def mask_markers(text: Column) -> Column:
    """Markers as spaces of the same length."""
    pieces, marks = F.split(text, MARKED_SPAN), F.regexp_extract_all(text, F.lit(f"({MARKED_SPAN})"), F.lit(1))
    spaces = F.transform(marks, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.coalesce(F.get(spaces, i - 1), F.lit("")), p)), "")


def context(text: Column, start: Column, end: Column, radius: int = 30) -> Column:
    """What stands around a span (from 0, end excluded), white space squeezed."""
    lo = F.greatest(start - radius, F.lit(0))
    return squeeze(F.substring(text, (lo + 1).cast("int"), (F.least(F.length(text), end + radius) - lo).cast("int")))


def snippet(text: Column, most: int = 70) -> Column:
    """The beginning up to a word boundary, flags hidden."""
    s = squeeze(F.regexp_replace(text, r"\[\?\??FN:[^\]]*\]", ""))
    cut = F.regexp_extract(F.substring(s, 1, most + 1), r"^(.*)\s", 1)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(s, 1, most)), F.lit("…")))


def natural_key(name: Column) -> Column:
    """A string that sorts names by the values of their digit runs, letters in lower case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 18, "0")).otherwise(r)), "")


def match_definition(line: Column, verified: Column | None = None) -> tuple[Column, Column]:
    """Number and text of a note definition; ``n.`` and bare ``n`` only where the block's type size vouches for it."""
    paren, dot, bare = r"^([0-9]{1,3})\)\s?(.*)$", r"^([0-9]{1,3})\.\s+(\S.*)$", r"^([0-9]{1,3})\s+(\S.*)$"

    def part(i: int) -> Column:
        out = F.when(line.rlike(paren), F.regexp_extract(line, paren, i))
        if verified is not None:
            for p in (dot, bare):
                out = F.coalesce(out, F.when(verified & line.rlike(p), F.regexp_extract(line, p, i)))
        return out

    return part(1).cast("int"), part(2)


def substitute_markers(body: Column, numbers: Column) -> Column:
    """Body with a note's first digit run as ``[n]``: glued ones first, then those after white space, each number once.

    body: lines joined by line feeds; numbers: distinct note numbers.
    """
    ordered = F.array_sort(numbers)
    start = F.struct(body.alias("body"), F.array().cast("array<int>").alias("done"))

    def glued(acc: Column, n: Column) -> Column:
        return _place(acc, n, F.concat(F.lit(r"(?s)^(.*?[^\s0-9])"), n.cast("string"), F.lit(r"(?![\p{L}\p{N}_])")), "$1 [")

    def spaced(acc: Column, n: Column) -> Column:
        return F.when(F.array_contains(acc["done"], n), acc).otherwise(_place(acc, n, F.concat(F.lit(r"(?s)^(.*?\s)"), n.cast("string"), F.lit(r"(?![\p{L}\p{N}_])")), "$1["))

    first = F.aggregate(ordered, start, glued)
    return F.aggregate(ordered, first, spaced, lambda a: a["body"])


def _place(acc: Column, n: Column, pattern: Column, before: str) -> Column:
    new = F.regexp_replace(acc["body"], pattern, F.concat(F.lit(before), n.cast("string"), F.lit("]")))
    return F.when(new != acc["body"], F.struct(new.alias("body"), F.concat(acc["done"], F.array(n)).alias("done"))).otherwise(acc)
