"""Tables that are read or written many times are told apart, stored and exchanged once."""

import hashlib
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from holdfast.operators import audit, lineage, securities
from holdfast.plans import catalog, loading
from holdfast.schemas import RAW_SCHEMAS, RAW_TABLES
from holdfast.sources import store
from tests.test_plans import plan_of

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def test_rows_get_their_batch_without_an_exchange(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "dataset string, n int")
    spark.conf.set(THRESHOLD, "-1")
    found = loading._of_sets(rows, {"a": 7, "c": 8})
    spark.conf.unset(THRESHOLD)
    assert "hashpartitioning" not in plan_of(found)
    assert {(r.dataset, r.n, r.etl_batch_id) for r in found.collect()} == {("a", 1, 7), ("c", 3, 8)}
    assert loading._of_sets(rows, {}).count() == 0


def test_batches_are_written_where_their_rows_are(spark, folder):
    rows = spark.range(40).select(F.col("id").alias("n"), (F.col("id") % 2).alias("etl_batch_id")).repartition(4)
    for _ in range(2):  # a replay replaces the batches
        store.overwrite_partitions(rows, folder, "etl_batch_id")
    back = spark.read.parquet(folder)
    assert back.count() == 40 and len(back.inputFiles()) == 8
    assert {(r.n, r.etl_batch_id) for r in back.collect()} == {(n, n % 2) for n in range(40)}
    store.overwrite_partitions(store.gathered(rows, "etl_batch_id"), folder, "etl_batch_id")
    few = spark.read.parquet(folder)
    assert few.count() == 40 and len(few.inputFiles()) < 8


def test_deliveries_are_stored_by_data_set(spark):
    schemas = {t: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMAS[t].fields) for t in RAW_TABLES}
    tables = {t: spark.createDataFrame([(a, *[None] * (len(RAW_SCHEMAS[t].fields) - 1)) for a in "ab"], schemas[t]) for t in RAW_TABLES}
    w = SimpleNamespace(table=tables.get, spark=spark)
    listed = spark.createDataFrame([("a", "2021q1", ""), ("b", "2021q2", ""), ("a", "2021q2", "X")], "accession_number string, dataset string, suffix string")
    out = catalog.deliveries(w, listed)
    for t, df in out.items():
        assert {(r.dataset, r.accession_number) for r in df.collect()} == {("2021q1", "a"), ("2021q2", "b"), ("2021q2", "aX")}, t
        assert df.columns == ["dataset", *RAW_SCHEMAS[t].names]
        assert re.search(r"PartitionFilters: \[.*dataset.*2021q1", plan_of(df.filter("dataset = '2021q1'")))


def test_fingerprints_are_summed_as_whole_numbers(spark):
    texts = [("x", "a"), ("x", None), ("x", "a"), ("y", "")]
    rows = spark.createDataFrame(texts, "dataset string, name string")
    parts = lineage.table_fingerprints({"t": rows})
    assert "sum(cast(conv" in plan_of(parts) and "as decimal(20,0)))" not in plan_of(parts)
    expected = {}
    for dataset, text in texts:
        digest = hashlib.md5(("~" if text is None else f"{len(text)}:{text}").encode()).hexdigest()
        n, one, two = expected.get(dataset, (0, 0, 0))
        expected[dataset] = (n + 1, one + int(digest[:15], 16), two + int(digest[15:30], 16))
    assert {r.dataset: (r.row_count, int(r.part_1), int(r.part_2)) for r in parts.collect()} == expected


def test_late_filings_are_told_apart_once(spark):
    schemas = {t: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMAS[t].fields) for t in RAW_TABLES}
    tables = {
        t: spark.createDataFrame([(a, *[None] * (len(RAW_SCHEMAS[t].fields) - 1)) for a in ("a", "b", "b", None)], schemas[t]) for t in RAW_TABLES
    }
    w = SimpleNamespace(table=tables.get, spark=spark)
    late = spark.createDataFrame([("b",), ("b",), (None,)], "accession_number string")
    first, delivered = catalog.parted(w, late)
    for t in RAW_TABLES:
        assert first[t].dtypes == delivered[t].dtypes == tables[t].dtypes
        assert sorted(str(r.accession_number) for r in first[t].collect()) == ["None", "a"]
        assert [r.accession_number for r in delivered[t].collect()] == ["b", "b"]
        assert "Join" not in plan_of(first[t]) + plan_of(delivered[t])  # read as stored


def test_references_of_all_children_are_counted_in_one_exchange(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    tables = {"parent": parent, **{c: spark.createDataFrame([(x, y) for x in ("a", "z", "z", None) for y in ("b", c)], "x string, y string") for c in ("c1", "c2", "c3")}}
    references = [audit.Reference(c, (column,), "parent", ("id",)) for c in ("c1", "c2", "c3") for column in "xy"]
    report = audit.reference_audit(tables.get, references)
    counted = [x for x in plan_of(report).splitlines() if "Exchange hashpartitioning(reference" in x and "key" in x]
    assert len(counted) == 1
    assert {(r.child_table, r.child_columns, r.violations) for r in report.collect()} == {(c, k, 4) for c in ("c1", "c2", "c3") for k in "xy"}


def test_lines_meet_names_after_their_spellings(spark, folder):
    """Names are measured while lines are exchanged by spelling, and need no exchange of lines if they are few."""
    key = {"cusip": "C", "reportcalendarorquarter": "31-DEC-2020", "nameofissuer": "N", "titleofclass": "T", "figi": None}
    n = F.col("id")
    lines = spark.range(5_000).select(
        F.format_string("%010d", n % 50).alias("manager_cik"), F.lit("cover").alias("filingmanager_name"), n.alias("infotable_sk"),
        F.lit(1).alias("has_submission"), F.lit(1).alias("has_cover"), F.concat(F.lit("C"), (n % 100).cast("string")).alias("cusip"),
        *[F.lit(v).cast("string").alias(c) for c, v in key.items() if c != "cusip"],
    )
    managers = spark.range(40).select(
        F.format_string("%010d", n).alias("cik"), F.concat(F.lit("M"), n.cast("string")).alias("manager_name"),
        *[F.sha2(F.concat(n.cast("string"), F.lit(f"{c}")), 512).alias(f"other_{c}") for c in range(20)],
    )
    lines, managers = store.write_table(lines, f"{folder}/lines"), store.write_table(managers, f"{folder}/managers")
    variants = store.write_table(securities.security_variants(lines), f"{folder}/variants")
    w = SimpleNamespace(spark=spark, manager_dim=managers, variants=variants)
    w.lines = lines.withColumns({c: F.lit(None).cast("string") for c in ("accession_number", "filing_date", "submissiontype", "reporttype")}).withColumn("value", F.lit(1))
    spark.conf.set(THRESHOLD, "-1")
    rows = catalog.holding_variant(w)
    found = {r.infotable_sk: (r.filing_manager_cik, r.filing_manager_name, r.variant_occurrence_count) for r in rows.collect()}
    plan = plan_of(catalog.holding_variant(w))
    spark.conf.unset(THRESHOLD)
    assert found == {i: (f"{i % 50:010d}", f"M{i % 50}" if i % 50 < 40 else "cover", 50) for i in range(5_000)}
    by_manager, by_spelling = (plan.index(f"Exchange hashpartitioning({c}") for c in ("manager_cik", "cusip"))
    assert by_manager < by_spelling  # above it
