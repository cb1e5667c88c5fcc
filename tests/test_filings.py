"""Normalization, calendar, values and reconciliation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators import filings as f
from tests.conftest import dicts


def test_cik_quarter_and_date_functions(spark):
    one = spark.range(1)
    row = one.select(
        v.cik10(F.lit("42")).alias("a"), v.cik10(F.lit("12345678901")).alias("b"), v.cik10(F.lit("x1")).alias("c"),
        v.filing_date(F.lit("03-JAN-2023")).alias("d"), v.filing_date(F.lit("3-jan-2023")).alias("e"),
        v.filing_date(F.lit("")).alias("f"), v.previous_quarter(F.lit(202301)).alias("g"),
        v.next_quarter(F.lit(202304)).alias("h"), v.quarter_label(F.lit(202302)).alias("i"),
        v.quarter_end(F.lit(202301)).alias("j"), v.quarter_end(F.lit(202302)).alias("k"),
        v.normalized_text(F.lit("  a\t b  c ")).alias("l"),
    ).first()
    assert row.a == "0000000042" and row.b == "12345678901" and row.c is None
    assert row.d == row.e == dt.date(2023, 1, 3) and row.f is None
    assert (row.g, row.h, row.i) == (202204, 202401, "2023Q2")
    assert (row.j, row.k) == (dt.date(2023, 3, 31), dt.date(2023, 6, 30))
    assert row.l == "A B C"


def test_calendar_is_dense_and_links_back(spark):
    dates = spark.createDataFrame([(dt.date(2022, 9, 30),), (dt.date(2023, 6, 30),), (None,)], "d date")
    rows = dicts(f.dense_calendar(dates, "d"), "quarter_id")
    assert [(r["quarter_id"], r["previous_quarter_id"]) for r in rows] == [
        (202203, None), (202204, 202203), (202301, 202204), (202302, 202301)
    ]
    assert rows[1]["quarter_label"] == "2022Q4" and rows[1]["quarter_end_date"] == dt.date(2022, 12, 31)


def raw(spark, filing_date="14-FEB-2023", amendment="n"):
    submission = spark.createDataFrame(
        [("a", filing_date, "13F-HR", "7", "31-DEC-2022")],
        "accession_number string, filing_date string, submissiontype string, cik string, periodofreport string",
    )
    cover = spark.createDataFrame(
        [("a", "31-DEC-2022", "13F HOLDINGS REPORT", amendment, None, None, "028-1")],
        """accession_number string, reportcalendarorquarter string, reporttype string, isamendment string,
           amendmentno int, amendmenttype string, form13ffilenumber string""",
    )
    page = spark.createDataFrame([("a", "y")], "accession_number string, isconfidentialomitted string")
    lines = f.line_totals(spark.createDataFrame([("a", 5)], "accession_number string, value bigint"))
    return submission, cover, page, lines


def test_normalized_filing(spark):
    row = f.normalize_filings(*raw(spark)).first()
    assert (row.manager_cik, row.quarter_id, row.is_amendment) == ("0000000007", 202204, 0)
    assert (row.is_confidential_omitted, row.has_information_table) == (1, 1)
    assert f.normalize_filings(*raw(spark, amendment="y")).first().is_amendment == 1


def test_missing_required_date_fails(spark):
    with pytest.raises(Exception, match="missing filing_date for a"):
        f.normalize_filings(*raw(spark, filing_date=None)).collect()


def test_cik_that_is_no_number_fails(spark):
    submission, *others = raw(spark)
    with pytest.raises(Exception, match="invalid cik for a"):
        f.normalize_filings(submission.withColumn("cik", F.lit("0001-x")), *others).collect()


def test_values_turn_to_dollars_on_the_cutoff(spark):
    days = spark.createDataFrame([(dt.date(2023, 1, 2),), (dt.date(2023, 1, 3),)], "d date")
    assert [r[0] for r in days.select(v.value_multiplier("d")).collect()] == [1000, 1]


@pytest.mark.parametrize(
    "held,stated,label",
    [
        (100, None, "NO_SUMMARY"), (100, 100, "MATCH"), (100, 101, "ROUNDING_DIFFERENCE"), (100, 0, "SUMMARY_ZERO"),
        (1, 0, "ROUNDING_DIFFERENCE"), (100000, 100, "HOLDINGS_APPROX_1000X_SUMMARY"),
        (100, 100000, "SUMMARY_APPROX_1000X_HOLDINGS"), (100, 50, "MISMATCH"), (100, 100101, "MISMATCH"),
        (5, 9_200_000_000_000_000_000, "MISMATCH"),
    ],
)
def test_reconciliation_labels(spark, held, stated, label):
    components = spark.createDataFrame([("a", 1), ("b", 0)], "accession_number string, is_effective int")
    lines = spark.createDataFrame([("a", held), ("b", 9)], "accession_number string, value bigint")
    page = spark.createDataFrame([("a", stated)], "accession_number string, tablevaluetotal bigint")
    rows = dicts(f.reconcile_values(components, f.line_totals(lines), page))
    assert [(r["accession_number"], r["reconciliation_status"]) for r in rows] == [("a", label)]


def test_lines_wait_for_late_headers(spark):
    """Lines arrive before their cover and submission: kept without a quarter, and found again when headers come."""
    lines = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30), ("c", 1, 40)], "accession_number string, infotable_sk long, value long")
    sent = spark.createDataFrame([("a", "7", "03-JAN-2023", "13F-HR", "31-DEC-2022"), ("b", "8", "04-JAN-2023", "13F-HR", "31-DEC-2022")], "accession_number string, cik string, filing_date string, submissiontype string, periodofreport string")
    cover = spark.createDataFrame([("a", "31-DEC-2022", "R", None, "M"), ("b", "31-DEC-2022", "R", None, "M")], "accession_number string, reportcalendarorquarter string, reporttype string, form13ffilenumber string, filingmanager_name string")
    effective = spark.createDataFrame([("a", "0000000007", 202204, 1, 0, "MATCH", 1), ("b", "0000000008", 202204, 1, 0, "MATCH", 1)], "accession_number string, manager_cik string, quarter_id int, is_analytics_ready int, has_confidential_omission int, value_reconciliation_status string, value_multiplier bigint")
    early = f.enriched_lines(lines, f.filing_headers(sent, cover.filter("accession_number = 'a'"), effective.filter("accession_number = 'a'")))
    assert {(r.accession_number, r.quarter_id, r.is_effective, r.has_submission) for r in early.collect()} == {("a", 202204, 1, 1), ("b", None, None, 1), ("c", None, None, None)}
    late = f.with_late_headers(early, f.filing_headers(sent, cover, effective))
    assert {(r.accession_number, r.quarter_id, r.is_effective, r.value) for r in late.collect()} == {("b", 202204, 1, 30), ("c", None, None, 40)}
    assert late.columns == early.columns
