"""Registered queries against their SQL on pages whose body has lines like notes, and on long volumes."""

import pytest

import __spark_entry__ as entry
from test_entry import rows

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda "
#: (doc_id, text): body lines that begin like a definition, with words broken at line ends after them.
STRAY = [
    (3, f"{LONG}\n79) 555-1339 {LONG * 3}\nomega. {LONG}"),
    (4, f"415) 555-0000 {LONG * 2}\nlast line."),
    (6, f"Alpha, beta.\n{LONG}"),
    (9, f"{LONG}\n8) begins {LONG}"),
]


@pytest.fixture
def differs(spark, tmp_path):
    """Rows of a query and of its SQL over documents (doc_id, text)."""
    import duckdb

    def run(name, documents):
        made = spark.createDataFrame([(i, t, "src") for i, t in documents], "doc_id long, text string, source string")
        made.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        return rows(got), rows(want)

    return run


def test_footnote_definitions_of_several_lines(differs):
    got, want = differs("footnote_definitions", STRAY)
    assert got == want and any("- " in str(r) for r in got)


def test_note_continuations_of_several_lines(differs):
    got, want = differs("note_continuations", STRAY)
    assert got == want and any("- " in str(r) for r in got)


def test_small_type_in_the_body(differs):
    got, want = differs("small_type_notes", STRAY)
    assert got == want and len(got) > 9


def test_small_type_apart_from_the_notes(spark):
    """What is small in the body has a role of its own; the block at the foot is the same with and without."""
    from quirelight.operators import layout

    said = ["Text", "415) 555", "body goes on", "1) Note", "12"]
    lines = spark.createDataFrame([("v", 1, i, s, z) for i, (s, z) in enumerate(zip(said, (11.0, 9.0, 11.0, 9.0, 11.0)))], "volume_id string, pos int, ln int, line string, size double")
    sizes = spark.createDataFrame([("v", 11.0)], "volume_id string, size double")
    roles = lambda **x: [r.role for r in layout.small_type_notes(lines, sizes, **x).orderBy("ln").collect()]
    assert roles() == ["body", "body", "body", "note", "body"]
    assert roles(apart=True) == ["body", "small", "body", "note", "body"]


def test_references_beyond_999(differs):
    got, want = differs("merged_references", [(1, "\n".join(f"line {i}" for i in range(3100)))])
    assert got == want and len(got) > 1000
