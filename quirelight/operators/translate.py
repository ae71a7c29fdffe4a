"""Preparing Markdown for translation: flags off, what must not be translated fenced, citations linked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG = r" ?\[\?\??FN:[^\]]*\]"
FENCE = r"(?s)<dnt>.*?</dnt>"
URL = r"(?i)((?:https?://|www\.)[^\s<]*[^\s<.,;:!?)\]])"
QUOTED = r"(„[^“]*“|\"[^\"]*\"|»[^«]*«)"
ENTRY = r"^\[([0-9]{1,3})\]\s+[A-ZÄÖÜ].*\b(?:1[5-9][0-9][0-9]|20[0-9][0-9]|21[0-9][0-9])\b"
CITATION = r"\[([0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*)\]"
DEFINITION = r"^\[\^[0-9]+\]:"


def strip_flags(text: Column) -> Column:
    return F.regexp_replace(text, FLAG, "")


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, "</?dnt>", "")


def outside_fences(text: Column, change) -> Column:
    """text with change() applied to what isn't fenced yet."""
    pieces, fenced = F.split(text, FENCE), F.regexp_extract_all(text, F.lit(f"({FENCE})"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.coalesce(F.get(fenced, i - 1), F.lit("")), change(p))), "")


def protect_urls(text: Column) -> Column:
    return outside_fences(text, lambda s: F.regexp_replace(s, URL, "<dnt>$1</dnt>"))


def protect_quoted(text: Column) -> Column:
    return outside_fences(text, lambda s: F.regexp_replace(s, QUOTED, "<dnt>$1</dnt>"))


def link_citations(line: Column, listed: Column) -> Column:
    """``[n, m]`` as links to their entries, if all of them are listed (array of strings)."""
    pieces, cited = F.split(line, CITATION), F.regexp_extract_all(line, F.lit(CITATION), F.lit(1))

    def linked(c: Column) -> Column:
        numbers = F.transform(F.split(c, ","), lambda n: F.trim(n))
        links = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n, F.lit("](#^ref-"), n, F.lit(")"))), ", ")
        return F.concat(F.lit("["), F.when(F.forall(numbers, lambda n: F.array_contains(listed, n)), links).otherwise(c), F.lit("]"))

    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.coalesce(linked(F.get(cited, i - 1)), F.lit("")), p)), "")


def prepare_translation(markdown: Column) -> Column:
    """A whole Markdown text made ready; doing it twice changes nothing in what is fenced."""
    lines = F.split(strip_flags(markdown), "\n")
    listed = F.transform(F.filter(lines, lambda x: x.rlike(ENTRY)), lambda x: F.regexp_extract(x, ENTRY, 1))

    def line(x: Column) -> Column:
        ref = F.concat(F.lit("^ref-"), F.regexp_extract(x, ENTRY, 1))
        entry = F.concat(F.lit('<span id="'), ref, F.lit('"></span><dnt>'), x, F.lit("</dnt> "), ref)
        urls = protect_urls(link_citations(x, listed))
        return F.when(x.rlike(ENTRY), entry).when(x.rlike(DEFINITION), protect_quoted(urls)).otherwise(urls)

    return F.array_join(F.transform(lines, line), "\n")
