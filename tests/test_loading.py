"""The load driver: decisions, counts, crashes at every step, and fingerprints of content."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import lineage
from holdfast.plans import loading
from holdfast.schemas import RAW_SCHEMAS, RAW_TABLES
from holdfast.sources import filings_tsv
from tests.conftest import dicts


def delivery(spark, sets, lines=2):
    """Seven tables: one row per filing, ``lines`` holdings of each."""
    out = {}
    for t in RAW_TABLES:
        schema = RAW_SCHEMAS[t]
        rows = []
        for dataset, filings in sets.items():
            for a in filings:
                for k in range(lines if t == "infotable" else 1):
                    values = {"accession_number": a, "infotable_sk": k, "cusip": f"C{k}", "value": 10 * k, "cik": "1", "name": f"n{a}"}
                    rows.append((dataset, *(values.get(f.name) for f in schema.fields)))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        out[t] = spark.createDataFrame(rows, f"dataset string, {fields}")
    return out


def decisions(report):
    return {r["dataset"]: (r["decision"], r["status"]) for r in dicts(report)}


def content(spark, out):
    tables = loading.raw_tables(spark, out)
    return {t: sorted(map(str, df.drop("etl_batch_id").collect())) for t, df in tables.items()}


def lineage_rows(spark, out):
    return sorted((r.etl_batch_id, r.accession_number) for r in loading.batch_accessions(spark, out).collect())


def test_decisions_over_several_loads(spark, folder):
    first = delivery(spark, {"2021q1": ["a", "b"], "2021q2": ["c"]})
    assert decisions(loading.load_datasets(spark, first, folder)) == {"2021q1": ("APPEND", "COMPLETED"), "2021q2": ("APPEND", "COMPLETED")}
    assert decisions(loading.load_datasets(spark, first, folder)) == {"2021q1": ("SKIP", "COMPLETED"), "2021q2": ("SKIP", "COMPLETED")}
    before = content(spark, folder)
    more = delivery(spark, {
        "2021q3": ["d", "e"], "again": ["a", "b"], "partly": ["e", "f"], "registered": ["a", "c"], "twice": ["g", "g"], "changed": ["c"],
    })
    more["infotable"] = more["infotable"].filter("dataset <> 'changed' or infotable_sk = 0")
    report = loading.load_datasets(spark, more, folder)
    assert decisions(report) == {
        "2021q3": ("APPEND", "COMPLETED"), "again": ("SKIP", "COMPLETED"), "partly": ("REJECT", "FAILED"), "registered": ("REGISTER_EXISTING", "COMPLETED"),
        "twice": ("REJECT", "FAILED"), "changed": ("REJECT", "FAILED"),
    }
    errors = {r["dataset"]: r["error"] for r in dicts(report)}
    assert errors["partly"] == "1 of 2 filings are stored already" and "twice" in errors["twice"] and "infotable" in errors["changed"]
    after = content(spark, folder)
    assert len(after["infotable"]) == len(before["infotable"]) + 4 == 10
    assert [a for _, a in lineage_rows(spark, folder)].count("a") == 2
    assert {r["accession_number"]: r["etl_batch_id"] for r in dicts(loading.filing_batches(spark, folder))} == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 3}
    counts = {(r.etl_batch_id, r.table_name): (r.source_row_count, r.stored_row_count) for r in loading.batch_counts(spark, folder).collect()}
    assert counts[1, "infotable"] == (4, 4) and counts[3, "submission"] == (2, 2)
    states = {r["dataset"]: r["status"] for r in dicts(loading.batches(spark, folder))}
    assert states["partly"] == "FAILED" and states["2021q3"] == "COMPLETED"
    assert set(r[0] for r in loading.pending(spark, more, folder)["submission"].select("dataset").distinct().collect()) == {"again", "partly", "twice", "changed"}


def test_empty_deliveries(spark, folder):
    assert loading.load_datasets(spark, delivery(spark, {}), folder).count() == 0
    assert all(df.count() == 0 for df in loading.raw_tables(spark, folder).values())


def test_a_run_that_dies_anywhere_is_mended_by_the_next(spark, folder, monkeypatch):
    """Killed in front of single table writes, of lineage and counts, and of the last record: no half batch is ever seen."""
    one, two = delivery(spark, {"2021q1": ["a", "b"]}), delivery(spark, {"2021q2": ["c", "d"]}, lines=3)
    loading.load_datasets(spark, one, folder)
    before, write = content(spark, folder), loading.overwrite_partitions
    for victim in ("raw/submission", "raw/othermanager2", "raw/infotable", "lineage", "counts", None):

        def dies(df, path, column, victim=victim):
            if victim and path.endswith(victim):
                raise OSError("executor lost")
            write(df, path, column)

        def ends(step, victim=victim):
            if victim is None and step == "counts":
                raise OSError("driver lost")

        monkeypatch.setattr(loading, "overwrite_partitions", dies)
        with pytest.raises(OSError):
            loading.load_datasets(spark, two, folder, ends)
        assert content(spark, folder) == before
        assert lineage_rows(spark, folder) == [(1, "a"), (1, "b")]
    monkeypatch.setattr(loading, "overwrite_partitions", write)
    other = delivery(spark, {"2021q2b": ["c"]})  # the filing of the abandoned batch is not stored yet
    again = loading.load_datasets(spark, {t: one[t].unionByName(other[t]) for t in RAW_TABLES}, folder)
    assert decisions(again) == {"2021q1": ("SKIP", "COMPLETED"), "2021q2b": ("APPEND", "COMPLETED")}
    assert lineage_rows(spark, folder) == [(1, "a"), (1, "b"), (3, "c")] and len(content(spark, folder)["infotable"]) == 6


def test_a_repeated_attempt_keeps_its_batch_id(spark, folder):
    def dies(step):
        if step == "infotable":
            raise OSError

    tables = delivery(spark, {"2021q1": ["a", "b"]})
    with pytest.raises(OSError):
        loading.load_datasets(spark, tables, folder, dies)
    loading.load_datasets(spark, tables, folder)
    assert lineage_rows(spark, folder) == [(1, "a"), (1, "b")] and len(content(spark, folder)["infotable"]) == 4


def test_files_are_loaded_by_data_set(spark, folder):
    tables = delivery(spark, {"2021q1_form13f": ["a", "b"], "2021q2_form13f": ["c"]})
    for d in ("2021q1_form13f", "2021q2_form13f"):
        for t, df in tables.items():
            filings_tsv.write_filing_table(df.filter(F.col("dataset") == d), f"{folder}/in/{d}/{t.upper()}.tsv", t)
    found = loading.read_deliveries(spark, f"{folder}/in")
    assert decisions(loading.load_datasets(spark, found, f"{folder}/out")) == {d: ("APPEND", "COMPLETED") for d in ("2021q1_form13f", "2021q2_form13f")}
    assert {r["dataset"]: r["dataset_quarter"] for r in dicts(loading.batches(spark, f"{folder}/out"))} == {"2021q1_form13f": "2021Q1", "2021q2_form13f": "2021Q2"}


def prints(spark, rows, schema="dataset string, x string, y string"):
    frame = spark.createDataFrame(rows, schema)
    parts = lineage.table_fingerprints({"t": frame.repartition(3), "u": frame.limit(1)})
    return {r.dataset: r.sha256 for r in lineage.batch_fingerprints(parts).collect()}


def test_fingerprints_follow_the_multiset_of_rows(spark):
    base = [("d", "a", "b"), ("d", "c", None), ("d", "a", "b")]
    one = prints(spark, base)["d"]
    assert prints(spark, base[::-1]) == {"d": prints(spark, [base[2], base[1], base[0]])["d"]}
    assert prints(spark, base + [("e", "z", "z")])["d"] == one
    for other in ([*base, base[0]], base[:2], [("d", "a", "b"), ("d", None, "c"), ("d", "a", "b")], [("d", "ab", ""), ("d", "c", None), ("d", "a", "b")], [("d", "a", "b"), ("d", "c", ""), ("d", "a", "b")]):
        assert prints(spark, other)["d"] != one


def test_the_plan_combines_before_it_exchanges(spark):
    tables = delivery(spark, {"q": ["a"]})
    plan = lineage.table_fingerprints(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
