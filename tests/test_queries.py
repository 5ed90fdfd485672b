"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from pagemill import registry
from pagemill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0


def test_boxes_follow_the_shift_of_blank_lines(spark):
    rows = {(r.doc_id, r.field_type): r for r in registry.queries()["ext5_boxes"](spark, SF).collect()}
    plain_doc, shifted = rows[11, "invoice_number"], rows[55, "invoice_number"]
    assert plain_doc.y == plain_doc.source_line * 12 + 11 % 7
    assert shifted.source_line == 1 and shifted.y == 1 * 12 + 55 % 7


def test_fixtures_have_every_type_and_field(spark):
    types = lambda name: {r.document_type for r in registry.queries()[name](spark, SF).select("document_type").distinct().collect()}
    assert types("typ1_doctype") == {*catalog.KEYWORDS["standard"], "unknown"}
    assert types("typ2_doctype_lite") == {*catalog.KEYWORDS["lite"], "unknown"}
    for name, profile in (("ext1_all_fields", "standard"), ("ext8_all_fields_lite", "lite")):
        found = {r.field_type for r in registry.queries()[name](spark, SF).select("field_type").distinct().collect()}
        assert found == {f.name for f in catalog.PROFILES[profile] if f.patterns}


def test_header_and_footer_differ(spark):
    ids = lambda name: {r.doc_id for r in registry.queries()[name](spark, SF).collect()}
    assert ids("lay3_header") - ids("lay4_footer") and ids("lay4_footer") - ids("lay3_header")


def test_fields_are_worked_out_once(spark):
    """In the optimized plan: two runs of a pattern at most, on the text and on its match."""
    for name in ("ext1_fields_long", "ext1_summary", "ext6_get_field"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        patterns = sum(len(f.patterns) for f in catalog.STANDARD if any(f.name in r for r in catalog.ROUTES["standard"].values()))
        assert patterns <= plan.count("regexp_extract(") <= 2 * patterns, name


def test_lines_are_stripped_once_for_value_boxes(spark):
    """In the plan: one strip binds the lines' texts, and none stands below it for a field, a line or a side of the box."""
    from pagemill.operators import extract

    pages = spark.createDataFrame([], "lines array<struct<text string, x int, y int, w int, h int>>, fields array<struct<field_type string, value string>>")
    plan = pages.select(extract.value_boxes(pages).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1


def test_value_boxes_of_odd_lines(spark):
    from pagemill.operators import extract

    def box(lines, value):
        """The reference's way: a dict of stripped texts to boxes, read in order."""
        seen = {}
        for text, *sides in lines or []:
            if text is not None:
                seen[text.strip()] = tuple(sides)
        return next((b for t, b in seen.items() if value in t or t in value), (None,) * 4) if value is not None else (None,) * 4

    cases = [
        ([("a 12", 1, 2, 3, 4), ("\u3000a 12 ", 5, 6, 7, 8), ("12", 9, 9, 9, 9)], ["12", "a 12 b", "x", None]),
        ([("a 12", 1, 2, 3, 4), ("12", 9, 9, 9, 9), ("a 12", 5, 6, 7, 8)], ["12", "a"]),
        ([(" ", 1, 1, 1, 1), ("b", 2, 2, 2, 2), ("", 3, 3, 3, 3)], ["b", "q"]),
        ([(None, 1, 1, 1, 1), ("b", 2, None, 2, 2), (None, 4, 4, 4, 4)], ["b", "q"]),
        ([], ["b"]),
        (None, ["b"]),
    ]
    pages = spark.createDataFrame([(i, lines, [(str(k), v) for k, v in enumerate(values)]) for i, (lines, values) in enumerate(cases)], "i int, lines array<struct<text string, x int, y int, w int, h int>>, fields array<struct<field_type string, value string>>")
    got = {r.i: [tuple(b) for b in r.b] for r in pages.select("i", extract.value_boxes(pages).alias("b")).collect()}
    assert got == {i: [(str(k), *box(lines, v)) for k, v in enumerate(values)] for i, (lines, values) in enumerate(cases)}


def test_pages_without_an_exchange_are_the_pages_of_lines(spark):
    from pagemill.sources import files

    ours, theirs = registry._paged(spark, SF), files.pages_of_lines(registry._lined(spark, SF))
    rows = lambda pages: {(r.doc_id, r.full_text, *r.lines) for r in pages.select("doc_id", "full_text", "lines").collect()}
    assert rows(ours) == rows(theirs) and rows(ours)


def test_nothing_else_needs_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['pagemill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'ext1_fields_long' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True).returncode == 0
