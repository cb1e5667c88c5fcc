"""File formats."""

import json
import os

import pytest

from holdfast.operators import lineage
from holdfast.sources import filings_tsv as tsv
from holdfast.sources import side_json as sj
from tests.conftest import dicts

HEADER = "ACCESSION_NUMBER\tOTHERMANAGER_SK\tCIK\tFORM13FFILENUMBER\tCRDNUMBER\tSECFILENUMBER\tNAME"


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return path


def test_bom_quotes_and_blanks(spark, folder):
    path = put(folder, "OTHERMANAGER.tsv", "﻿" + HEADER + '\na\t1\t7\t\t""\tx\t"Say ""hi""\tthere"\n')
    row = tsv.read_filing_table(spark, path, "othermanager").first()
    assert row.asDict() == {
        "accession_number": "a", "othermanager_sk": 1, "cik": "7", "form13ffilenumber": None, "crdnumber": None,
        "secfilenumber": "x", "name": 'Say "hi"\tthere',
    }


def test_issuer_name_keeps_its_blank(spark, folder):
    header = "\t".join(f.name.upper() for f in tsv.RAW_SCHEMAS["infotable"].fields)
    path = put(folder, "INFOTABLE.tsv", header + "\na\t1\t\tCOM\tC1\t\t5\t6\tSH\t\tSOLE\t\t0\t0\t0\n")
    row = tsv.read_filing_table(spark, path, "infotable").first()
    assert row.nameofissuer == "" and row.figi is None and row.value == 5


@pytest.mark.parametrize(
    "text",
    [HEADER.replace("CRDNUMBER", "CRD") + "\na\t1\t7\t\t\t\tn\n", HEADER + "\na\tone\t7\t\t\t\tn\n", HEADER + "\na\t1\t7\n"],
)
def test_wrong_header_number_or_width_fails(spark, folder, text):
    path = put(folder, "OTHERMANAGER.tsv", text)
    with pytest.raises(Exception):
        tsv.read_filing_table(spark, path, "othermanager").collect()


def test_malformed_lines_are_listed(spark, folder):
    path = put(folder, "OTHERMANAGER.tsv", HEADER + "\na\tone\t7\t\t\t\tn\nb\t2\t7\t\t\t\tn\n")
    assert [r["accession_number"] for r in dicts(tsv.malformed_lines(spark, path, "othermanager"))] == ["a"]


def test_missing_table_fails(spark, folder):
    put(folder, "SUBMISSION.tsv", "x\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tsv.read_filing_tables(spark, folder)


def test_listings_document(spark, folder):
    document = {"fields": list(sj.LISTING_FIELDS), "data": [[7, "A", "T1", None], [7, "A", "T2", "NYSE"]]}
    path = put(folder, "listings.json", json.dumps(document, indent=1))
    rows = dicts(sj.read_listings(spark, path), "pos")
    assert [(r["cik"], r["ticker"], r["exchange"], r["pos"]) for r in rows] == [
        ("0000000007", "T1", None, 0), ("0000000007", "T2", "NYSE", 1)
    ]


@pytest.mark.parametrize(
    "document",
    [
        {"fields": ["cik", "name", "ticker"], "data": [[7, "A", "T1"]]},
        {"fields": ["cik", "name", "ticker", "exchange"]},
        {"fields": list(sj.LISTING_FIELDS), "data": [[7, "A", "T1"]]},
        {"fields": list(sj.LISTING_FIELDS), "data": [["x", "A", "T1", None]]},
        {"fields": list(sj.LISTING_FIELDS), "data": [[7, "A", "", None]]},
        {"fields": list(sj.LISTING_FIELDS), "data": [[7, "A", "T", ""]]},
    ],
)
def test_bad_listings_fail(spark, folder, document):
    path = put(folder, "listings.json", json.dumps(document))
    with pytest.raises(Exception, match="listing"):
        sj.read_listings(spark, path).collect()


def test_sic_documents(spark, folder):
    document = {"as_of_date": "2024-01-31", "data": {"0000000007": {"sic": "6770", "sicDescription": ""}}}
    path = put(folder, "sic.json", json.dumps(document))
    assert dicts(sj.read_sic(spark, path)) == [
        {"cik": "0000000007", "sic": "6770", "sicdescription": None, "as_of_date": "2024-01-31"}
    ]
    companies = folder + "/companies"
    put(companies, "CIK0000000007.json", json.dumps({"sic": "6770", "sicDescription": "Blank checks", "x": 1}, indent=1))
    put(companies, "CIK0000000009.json", json.dumps({"sic": "", "sicDescription": None}))
    wanted = spark.createDataFrame([("7",), ("8",), ("9",)], "cik string")
    rows = {r["cik"][-1]: (r["sic"], r["sicdescription"]) for r in dicts(sj.extract_sic(spark, companies, wanted))}
    assert rows == {"7": ("6770", "Blank checks"), "8": (None, None), "9": (None, None)}


def test_company_documents_are_written_by_many_tasks(spark, folder):
    from pyspark.sql import functions as F

    documents = spark.range(300).select(
        F.format_string("CIK%010d", "id").alias("company"), F.lit("2511").alias("sic"), F.col("id").cast("string").alias("sicDescription")
    )
    sj.write_companies(documents, folder)
    files = spark.read.text(f"{folder}/company=*").select(F.col("_metadata.file_name").alias("f")).distinct()
    writers = files.select(F.regexp_extract("f", r"part-(\d+)-", 1)).distinct().count()
    assert files.count() >= writers > 32  # not the one or two tasks that the bytes would ask for
    found = sj.extract_sic(spark, folder, spark.range(301).select(F.col("id").cast("string").alias("cik")))
    assert {(r.cik, r.sicdescription) for r in found.collect()} == {(f"{i:010d}", str(i) if i < 300 else None) for i in range(301)}
