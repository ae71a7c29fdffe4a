"""Scalar functions against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from quirelight.functions import labels, text
from quirelight.functions.regions import region_of_heading, region_of_running_head
from quirelight.operators.pagination import written


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_roman_numbers_both_ways(spark):
    values = list(range(1, 4000))
    for style in ("arabic", "roman-lower", "roman-upper"):
        made = column(spark, values, lambda x: labels.encode_label(x, F.lit(style)), "int")
        assert made == [written(v, style) for v in values]
        assert column(spark, made, labels.ordinal_of) == values
        assert set(column(spark, made, labels.style_of)) == {style}
    assert column(spark, [0, -3], lambda x: labels.encode_label(x, F.lit("arabic")), "int") == [None, None]


def test_labels(spark):
    assert column(spark, ["12", " xii ", "i", "XII", "0", "99999", "iiii", "", None], labels.decode_label) == [12, 12, None, None, None, None, None, None, None]
    assert column(spark, ["A HISTORY OF PRINTING 12", "xiv CONTENTS", "in the year 1234", "17", "Only text", "THE END"], labels.detect_page_label) == ["12", "xiv", None, "17", None, None]
    assert column(spark, ["— 12 —", "[iv]", "Kapitel 3 12", "Ein Kopf 44", "one, two 3", "1234"], labels.read_label_relaxed) == ["12", "iv", None, "44", None, None]


def test_lines(spark):
    assert column(spark, ["12  A  Head 13", "Head", "7", "x 5"], text.normalise_header) == ["A Head", "Head", "", "x"]
    assert column(spark, ["12 Head", "Head 13", "Head", "12"], text.edge_page_number) == ["12", "13", None, None]
    assert column(spark, ["1. Eins", "2.3 Zwei", "3.1.2. Drei", "1 Vier", "1. klein", "x"], text.heading_level) == [1, 2, 3, 0, 0, 0]
    lines = [["ge-", "trennt"], ["Haus-", "und Hof"], ["a", " b"], ["A1-", "b"], [], ["x"]]
    assert column(spark, lines, text.dehyphenate_join, "array<string>") == ["getrennt", "Haus- und Hof", "a b", "A1- b", "", "x"]
    assert column(spark, ["a [p. 12] b [3] c [^4]"], text.mask_markers) == ["a         b     c     "]
    assert column(spark, ["p10.txt", "p9.txt", "P2.txt"], text.natural_key) == sorted(column(spark, ["p10.txt", "p9.txt", "P2.txt"], text.natural_key), reverse=True)
    assert column(spark, ["short", "word " * 30], text.snippet)[0] == "short"
    assert column(spark, [1, 2], lambda x: text.plural(x, "page"), "int") == ["1 page", "2 pages"]
    assert column(spark, ["a²b¹⁰"], text.normalise_superscripts) == ["a2b10"] and column(spark, ["a*b_c"], text.escape_md) == ["a\\*b\\_c"]


def plain_markers(body, numbers):
    done = set()
    for before, put in ((r"(?<=[^\s\d])", " ["), (r"(?<=\s)", "[")):
        for n in sorted(numbers):
            if n not in done:
                new, k = re.subn(rf"(?m){before}{n}(?=$|[^\w])", f"{put}{n}]", body, count=1)
                if k:
                    body = new
                    done.add(n)
    return body


@pytest.mark.parametrize("seed", range(3))
def test_markers_against_plain(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [("".join(rng.choice(["a", "b.", " ", "\n", "1", "2", "12", "3", "[", "é"]) for _ in range(30)), rng.sample([1, 2, 3, 12], 3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "b string, n array<int>")
    got = [r[0] for r in df.select(text.substitute_markers(F.col("b"), F.col("n"))).collect()]
    assert got == [plain_markers(b, n) for b, n in rows]


def test_regions(spark):
    heads = ["Literaturverzeichnis", "LITERATUR", "3. Bibliografía", "Índice onomástico", "Оглавление", "Preface.", "Anhang", "Personenregister", "INDEX OF THINGS SEEN", "Index of things seen", "Chapter One", "указатель имён", "x" * 60, None]
    assert column(spark, heads, region_of_heading) == ["bibliography", "bibliography", "bibliography", "index", "contents", "preface", "appendix", "index", "index", None, None, "index", None, None]
    assert column(spark, ["Notes. Chapter 3", "A Tale | of Two"], region_of_running_head) == ["notes", None]
