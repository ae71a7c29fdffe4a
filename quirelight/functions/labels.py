"""Printed page labels: reading, classing and writing arabic and roman numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC = r"^[0-9]{1,4}$"
ROMAN = r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
TOKEN = r"[0-9]{1,4}|[mdclxvi]{2,}"
RELAXED = r"[0-9]{1,3}|[mdclxvi]+|[MDCLXVI]+"
ORNAMENT = " \t.,-–—·•*_()[]"
SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, SPACE, "")


def let(value: Column, use) -> Column:
    """use(value), value being worked out once however often use() refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def roman_value(text: Column) -> Column:
    """Value of a lower-case roman number: letters from the right, less where a larger one stood."""
    digits = F.transform(F.reverse(F.split(text, "")), lambda c: F.coalesce(*(F.when(c == k, v) for k, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000))), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(digits, start, lambda a, d: F.struct((a["total"] + F.when(d < a["last"], -d).otherwise(d)).alias("total"), d.alias("last")), lambda a: a["total"])


def _arabic(text: Column) -> Column:
    n = F.when(text.rlike(ARABIC), text).cast("int")
    return F.when(n.between(1, 9999), n)


def _is_roman(text: Column) -> Column:
    return text.rlike(ROMAN) & (F.length(text) > 0)


def decode_label(label: Column) -> Column:
    """Ordinal of an arabic label or a lower-case roman one of two letters or more; else null."""
    return let(strip(label), lambda s: F.coalesce(_arabic(s), F.when(_is_roman(s) & (F.length(s) >= 2), roman_value(s))))


def ordinal_of(label: Column) -> Column:
    """Ordinal of a label in any letter case; single roman letters count."""
    return let(F.lower(strip(label)), lambda s: F.coalesce(_arabic(s), F.when(_is_roman(s), roman_value(s))))


def style_of(label: Column) -> Column:
    """arabic, roman-lower or roman-upper (mixed case is upper); null for what is no label."""
    roman = lambda s: F.when(s == F.lower(s), "roman-lower").otherwise("roman-upper")
    return let(strip(label), lambda s: F.when(_arabic(s).isNotNull(), "arabic").when(_is_roman(F.lower(s)), roman(s)))


def encode_label(value: Column, style: Column) -> Column:
    """A number written in a style; null below 1 or for an unknown style."""
    hundreds, tens, ones = (["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c] for a, b, c in (("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x")))
    digit = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 10 + 1).cast("int"))
    whole = lambda n: F.floor(n).cast("int")

    def written(x: Column) -> Column:
        v = x["v"]
        roman = F.concat(F.repeat(F.lit("m"), whole(v / 1000)), digit(hundreds, whole(v / 100)), digit(tens, whole(v / 10)), digit(ones, v))
        return F.when(v >= 1, F.when(x["s"] == "arabic", v.cast("string")).when(x["s"] == "roman-lower", roman).when(x["s"] == "roman-upper", F.upper(roman)))

    return let(F.struct(value.cast("int").alias("v"), style.alias("s")), written)


def strip_ornament(text: Column) -> Column:
    return F.btrim(strip(text), F.lit(ORNAMENT))


def _letters(text: Column, kind: str = "L") -> Column:
    return F.length(F.regexp_replace(text, rf"[^\p{{{kind}}}]", ""))


def is_running_head_like(text: Column) -> Column:
    """At least two letters, 70 % of them capitals."""
    n = _letters(text)
    return (n >= 2) & (_letters(text, "Lu") >= 0.7 * n)


def reads_as_a_head(text: Column) -> Column:
    words = F.size(F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != ""))
    return (F.length(text) <= 60) & (words <= 6) & (_letters(text) >= 2) & ~text.rlike(r"[,;()\[\]0-9]")


def detect_page_label(line: Column) -> Column:
    """The label that a line consists of, or bears at one end of a head in capitals; else null."""

    def at(s: Column, pattern: str, token: int, text: int) -> Column:
        both = F.struct(F.regexp_extract(s, pattern, token).alias("t"), F.regexp_extract(s, pattern, text).alias("x"))
        return let(both, lambda m: F.when((m["t"] != "") & is_running_head_like(m["x"]) & decode_label(m["t"]).isNotNull(), m["t"]))

    def found(s: Column) -> Column:
        return F.when(decode_label(s).isNotNull(), s).otherwise(F.coalesce(at(s, rf"^({TOKEN})\s+(.+)$", 1, 2), at(s, rf"^(.+?)\s+({TOKEN})$", 2, 1)))

    return let(strip(line), found)


def read_label_relaxed(line: Column) -> Column:
    """A label where the place of the line vouches for it: up to three digits, roman in any case, beside a short head."""

    def at(s: Column, pattern: str, token: int, text: int) -> Column:
        both = F.struct(F.regexp_extract(s, pattern, token).alias("t"), F.btrim(F.regexp_extract(s, pattern, text), F.lit(ORNAMENT)).alias("x"))
        return let(both, lambda m: F.when((m["t"] != "") & ordinal_of(m["t"]).isNotNull() & reads_as_a_head(m["x"]), m["t"]))

    def found(s: Column) -> Column:
        beside = F.coalesce(at(s, rf"^({RELAXED})\s+(.+)$", 1, 2), at(s, rf"^(.+?)\s+({RELAXED})$", 2, 1))
        return F.when(s.rlike(rf"^({RELAXED})$"), F.when(ordinal_of(s).isNotNull(), s)).otherwise(beside)

    return let(strip_ornament(line), found)
