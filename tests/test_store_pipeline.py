"""Stored versions, reruns, rollup refresh and incremental ingest."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators.filings import holdings_filings, resolve_amendments
from holdfast.plans import pipeline
from holdfast.plans.warehouse import INPUTS, TABLES, Warehouse, sample_warehouse
from holdfast.schemas import RAW_SCHEMAS
from holdfast.sources import filings_tsv, store
from holdfast.sources.sample import sample_tables
from holdfast.sources.store import write_table
from holdfast.streaming import ingest
from tests.conftest import dicts


def same(a, b):
    columns = sorted(a.columns)
    rounded = [
        [F.round(c, 9).alias(c) if dict(x.dtypes)[c] == "double" else F.col(c) for c in columns] for x in (a, b)
    ]
    a, b = a.select(rounded[0]), b.select(rounded[1])
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_runs_are_versioned_repeatable_and_resumable(spark, warehouse, folder):
    inputs = {n: warehouse.table(n) for n in INPUTS}
    with pytest.raises(LookupError):
        pipeline.run_pipeline(spark, inputs, folder, "instruments")
    accepted = (("unique", "infotable"),)  # the sample repeats line numbers
    with pytest.raises(pipeline.NotPublished, match="unique infotable accession_number,infotable_sk"):
        pipeline.run_pipeline(spark, inputs, folder)
    assert pipeline.current_paths(spark, folder) == {}  # nothing is served
    pipeline.run_pipeline(spark, inputs, folder, accept=accepted)
    first = pipeline.current_paths(spark, folder)
    broken = inputs | {"signature": inputs["signature"].union(inputs["signature"].limit(1).withColumn("accession_number", F.lit("no such filing")))}
    with pytest.raises(pipeline.NotPublished, match="reference signature accession_number of submission: 1"):
        pipeline.run_pipeline(spark, broken, folder, "instruments", accept=accepted)
    assert pipeline.current_paths(spark, folder) == first
    pipeline.run_pipeline(spark, inputs, folder, "instruments", accept=accepted)
    second = pipeline.current_paths(spark, folder)
    assert first["filings"] == second["filings"] and first["positions"] != second["positions"]
    for name in ("positions", "changes", "manager_summary", "security_activity", "instruments"):
        assert same(store.read_table(spark, first[name]), store.read_table(spark, second[name])), name
    served = pipeline.open_warehouse(spark, inputs, folder)
    assert served.positions.count() == warehouse.positions.count()
    with pytest.raises(ValueError):
        pipeline.run_pipeline(spark, inputs, folder, "nowhere")


def test_plans_without_a_folder_give_the_same_rows(spark, warehouse):
    lazy = Warehouse(spark, {n: warehouse.table(n) for n in INPUTS}, None)
    for name in ("positions", "manager_summary", "manager_activity"):
        assert same(lazy.table(name), warehouse.table(name)), name


def test_rollup_refresh(spark, warehouse, folder):
    changes = warehouse.changes
    quarters = [r[0] for r in changes.select("to_quarter_id").distinct().orderBy("to_quarter_id").collect()]
    pipeline.rebuild_rollup(changes, "security_activity", folder)
    pipeline.rebuild_rollup(changes.filter(F.col("action") == "NEW"), "security_activity", folder, quarters[1])
    stored = store.read_table(spark, folder)
    assert stored.filter(F.col("quarter_id") == quarters[1]).agg(F.sum("exited_investor_count")).first()[0] == 0
    assert stored.filter(F.col("quarter_id") == quarters[2]).agg(F.sum("exited_investor_count")).first()[0] > 0
    pipeline.rebuild_rollup(changes.filter(F.col("to_quarter_id") != quarters[0]), "security_activity", folder)
    left = {r[0] for r in store.read_table(spark, folder).select("quarter_id").distinct().collect()}
    assert left == set(quarters[1:])


def lines(spark, *rows):
    names = RAW_SCHEMAS["othermanager"].names
    return spark.createDataFrame([(a, n, "1", None, None, None, text) for a, n, text in rows], RAW_SCHEMAS["othermanager"]).select(*names)


def test_stream_keeps_each_filing_of_its_first_data_set(spark, folder):
    source, out, state = f"{folder}/in", f"{folder}/out", f"{folder}/state"

    def load():
        ingest.stream_append(spark, source, out, state, "othermanager", files_per_batch=1).awaitTermination()
        return sorted((r["accession_number"], r["name"]) for r in dicts(store.read_table(spark, ingest.data_path(out))))

    # filing "a" is spread over two files of one data set, which arrive in two batches
    filings_tsv.write_filing_table(lines(spark, ("a", 1, "x")).coalesce(1), f"{source}/q1/p0", "othermanager")
    assert load() == [("a", "x")]
    spark.read.option("header", True).option("sep", "\t").csv(f"{source}/q1/p0").count()
    more = lines(spark, ("a", 2, "y"), ("b", 1, "z")).coalesce(1)
    header = [F.col(c).alias(c.upper()) for c in more.columns]
    more.select(*header).write.mode("append").option("sep", "\t").option("header", True).csv(f"{source}/q1/p0")
    assert load() == [("a", "x"), ("a", "y"), ("b", "z")]
    filings_tsv.write_filing_table(lines(spark, ("b", 9, "again"), ("c", 1, "w")).coalesce(1), f"{source}/q2/p0", "othermanager")
    expected = [("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")]
    assert load() == expected
    assert load() == expected


def test_a_replayed_batch_changes_nothing(spark, folder):
    schema = ingest.with_batch(RAW_SCHEMAS["othermanager"])
    rows = lines(spark, ("a", 1, "x"), ("b", 1, "y")).withColumn("dataset", F.lit("d1"))
    for batch in (0, 1, 1, 0):
        ingest._append(rows if batch == 0 else rows.withColumn("dataset", F.lit("d2")), batch, folder, RAW_SCHEMAS["othermanager"])
    stored = store.read_table(spark, ingest.data_path(folder), schema)
    assert sorted((r["accession_number"], r["etl_batch_id"]) for r in dicts(stored)) == [("a", 0), ("b", 0)]


def test_rows_of_a_batch_are_read_twice(spark, folder):
    """Once for the pairs of filing and data set, once for the rows; text is costly to parse."""
    read = spark.sparkContext.accumulator(0)

    def counted(name):
        read.add(1)
        return name

    rows = lines(spark, ("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), (None, 1, "n")).withColumn("dataset", F.lit("d"))
    rows = rows.withColumn("dataset", F.udf(counted)("dataset").alias("dataset"))
    ingest._append(rows, 0, folder, RAW_SCHEMAS["othermanager"])
    assert read.value == 2 * 4
    stored = store.read_table(spark, ingest.data_path(folder))
    assert sorted(str(r["accession_number"]) for r in dicts(stored)) == ["None", "a", "b", "b"]
    assert sorted(str(r["accession_number"]) for r in dicts(store.read_table(spark, ingest.lineage_path(folder)))) == ["None", "a", "b"]


def test_only_untouched_groups_are_staged(spark, warehouse, folder):
    filings = warehouse.filings.drop("etl_batch_id").filter("quarter_id = 202301")
    late = filings.filter("is_amendment = 1").orderBy("accession_number").limit(1).localCheckpoint()  # one fixed filing
    touched = late.select("manager_cik")
    for part in (filings.exceptAll(late), late):
        part.write.mode("append").parquet(f"{folder}/in")
        ingest.stream_reresolve(
            spark, f"{folder}/in", f"{folder}/raw", f"{folder}/resolved", f"{folder}/state", filings.schema
        ).awaitTermination()
    expected = resolve_amendments(holdings_filings(filings))
    assert same(spark.read.parquet(f"{folder}/resolved"), expected)
    staged = spark.read.parquet(f"{folder}/resolved-staging/untouched")
    kept = expected.join(touched, "manager_cik", "left_anti")
    assert same(staged, kept) and kept.count() > 0


def test_late_amendment_reopens_only_its_group(spark, warehouse, folder):
    filings = warehouse.filings.drop("etl_batch_id")
    source = f"{folder}/in"
    late = filings.filter("is_amendment = 1 AND quarter_id = 202301")
    assert late.count() > 0
    filings.exceptAll(late).write.parquet(source)

    def run():
        ingest.stream_reresolve(
            spark, source, f"{folder}/raw", f"{folder}/resolved", f"{folder}/state", filings.schema
        ).awaitTermination()
        return spark.read.parquet(f"{folder}/resolved")

    before = run()
    assert same(before, resolve_amendments(holdings_filings(filings.exceptAll(late))))
    late.write.mode("append").parquet(source)
    assert same(run(), resolve_amendments(holdings_filings(filings)))


def test_joined_tables_are_written_where_their_rows_are(spark, folder):
    """Rows that a join has just exchanged are not exchanged once more by quarter."""
    assert not TABLES["lines"].exchange and not TABLES["positions"].exchange
    rows = spark.range(600).repartition(3).selectExpr("id", "CAST(IF(id % 3 = 0, NULL, 202100 + id % 2 + 1) AS INT) AS quarter_id")
    left = write_table(rows, f"{folder}/left", "quarter_id", "id", exchange=False)
    assert sorted(map(str, left.collect())) == sorted(map(str, rows.collect()))
    assert len(left.inputFiles()) == 9  # three tasks, two quarters and the unknown one
    assert len(write_table(rows, f"{folder}/moved", "quarter_id", "id").inputFiles()) == 3


def test_summary_pages_come_from_stored_lines(spark, sf):
    w = sample_warehouse(spark, f"{sf}/.")
    stated = w.summarypage.select("accession_number", "tableentrytotal", "tablevaluetotal", "isconfidentialomitted")
    assert "infotable" in w._frames
    plain = sample_tables(spark, sf)["summarypage"]
    assert stated.exceptAll(plain).isEmpty() and plain.exceptAll(stated).isEmpty() and plain.count() > 0
