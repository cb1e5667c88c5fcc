"""Manager dimension, listings and industries."""

import pytest
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators import managers as m
from tests.conftest import dicts

SUB = "accession_number string, filing_date string, cik string, periodofreport string"
OM = """accession_number string, othermanager_sk bigint, cik string, form13ffilenumber string, crdnumber string,
    secfilenumber string, name string"""
LIST = "cik bigint, name string, ticker string, exchange string, pos bigint"


def cover(spark, *rows):
    """(accession, name, file number, crd)"""
    schema = ", ".join(f"{c} string" for c in ["accession_number", "filingmanager_name", *m.ADDRESS, *m.REGISTRATION])
    return spark.createDataFrame([(a, n, *[None] * 5, f, c, None) for a, n, f, c in rows], schema)


def om2(df):
    return df.withColumnRenamed("othermanager_sk", "sequencenumber")


def test_newest_cover_page_wins_and_mentions_only_fill_gaps(spark):
    submission = spark.createDataFrame(
        [("01", "d1", "5", "p"), ("09", "d9", "0000000005", "p"), ("03", "d3", "6", "p")], SUB
    )
    covers = cover(spark, ("01", "OLD", "028-1", "CRD1"), ("09", "NEW", "028-1", None))
    others = spark.createDataFrame([("10", 1, "5", "X", "CRD-OM", None, "MENTIONED"), ("02", 1, "8", "Y", None, None, "ONLY OM")], OM)
    included = om2(spark.createDataFrame([("04", 1, "", None, None, None, "NO CIK"), ("04", 2, "8", "Z", None, None, "LATER OM2")], OM))
    listings = spark.createDataFrame([(7, "LISTED", "T", None, 1), (8, "CO 8", "T8", "N", 2)], LIST)
    d = {r["cik"]: r for r in dicts(m.manager_dimension(submission, covers, others, included, listings))}
    assert sorted(d) == [f"000000000{i}" for i in (5, 6, 7, 8)]
    five = d["0000000005"]
    assert (five["manager_name"], five["form13ffilenumber"], five["crdnumber"]) == ("NEW", "028-1", "CRD-OM")
    assert (five["latest_related_accession_number"], five["latest_filing_date"]) == ("10", "d9")
    assert (five["submission_count"], five["other_manager_mention_count"]) == (2, 1)
    six = d["0000000006"]  # a filing without cover page still makes a row
    assert (six["manager_name"], six["submission_count"]) == (None, 0)
    assert d["0000000007"]["manager_name"] == "LISTED"
    eight = d["0000000008"]
    assert (eight["manager_name"], eight["other_manager_mention_count"], eight["ticker"]) == ("LATER OM2", 2, "T8")
    assert eight["latest_related_accession_number"] == "04"


def test_same_filing_prefers_the_first_list(spark):
    a = spark.createDataFrame([("1", 1, "8", None, None, None, "LOW SK"), ("1", 2, "8", None, None, None, "HIGH SK")], OM)
    b = om2(spark.createDataFrame([("1", 9, "8", None, None, None, "SECOND LIST")], OM))
    row = m.latest_other_manager(a, b).first()
    assert (row.name, row.mention_count) == ("HIGH SK", 3)


def test_ticker_list_is_distinct_but_exchange_list_is_not(spark):
    rows = [(1, "ACME", "B", "NYSE", 1), (1, "ACME2", "A", None, 2), (1, "ACME", "B", "OTC", 3)]
    row = m.ticker_lists(spark.createDataFrame(rows, LIST)).first()
    assert (row.ticker, row.exchange, row.sec_company_name) == ("B, A", "NYSE, , OTC", "ACME")


@pytest.mark.parametrize(
    "sic,division",
    [("6770", "Finance, Insurance, and Real Estate"), ("0000", None), ("9000", None), ("9100", "Public Administration"),
     (None, None), ("7", None), ("x1", None), ("0900", "Agriculture, Forestry, and Fishing")],
)
def test_sic_division(spark, sic, division):
    assert spark.range(1).select(v.sic_division(F.lit(sic).cast("string"))).first()[0] == division


def test_sic_refresh_clears_companies_that_vanished(spark):
    listings = spark.createDataFrame([(1, "A", "T1", None, 1), (2, "B", "T2", None, 2)], LIST)
    sic = spark.createDataFrame([(1, "2000", "Food"), (2, "", "x")], "cik bigint, sic string, sicdescription string")
    first = m.listing_dimension(listings, sic, "2024-01-01")
    assert {r["ticker"]: r["sic"] for r in dicts(first)} == {"T1": "2000", "T2": None}
    second = {r["ticker"]: r for r in dicts(m.refresh_sic(first, sic.filter("cik = 2"), "2024-02-01"))}
    assert second["T1"]["sic_source"] is None and second["T2"]["sic_as_of_date"] == "2024-02-01"
