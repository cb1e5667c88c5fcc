"""Batch admission, count checks and table maintenance."""

from holdfast.operators import lineage, merge
from tests.conftest import dicts


def accessions(spark, batch, names, sha=None):
    return spark.createDataFrame(
        [(batch, n, sha or f"sha{batch}") for n in names], "etl_batch_id bigint, accession_number string, sha256 string"
    )


def test_admission(spark):
    source = accessions(spark, 1, "ab").union(accessions(spark, 2, "cd")).union(accessions(spark, 3, "ef")).union(
        accessions(spark, 4, "gh")
    )
    stored = spark.createDataFrame([(x,) for x in "abefg"], "accession_number string")
    completed = spark.createDataFrame([("sha1",)], "sha256 string")
    got = {r["etl_batch_id"]: r["decision"] for r in dicts(lineage.admit_batches(source, stored, completed))}
    assert got == {1: "SKIP", 2: "APPEND", 3: "REGISTER_EXISTING", 4: "REJECT"}
    wrong = spark.createDataFrame([(1,), (2,), (3,)], "etl_batch_id bigint")
    got = {r["etl_batch_id"]: r["decision"] for r in dicts(lineage.admit_batches(source, stored, completed, wrong))}
    assert got == {1: "REJECT", 2: "APPEND", 3: "REJECT", 4: "REJECT"}


def test_a_batch_that_lists_a_filing_twice_is_rejected(spark):
    source = accessions(spark, 1, "aab").union(accessions(spark, 2, "c"))
    got = {r["etl_batch_id"]: r["decision"] for r in dicts(lineage.admit_batches(source, source.limit(0), source.limit(0)))}
    assert got == {1: "REJECT", 2: "APPEND"}


def test_counts_and_closing(spark):
    batches = accessions(spark, 1, "ab").union(accessions(spark, 2, "c"))
    lines = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "accession_number string")
    expected = lineage.source_counts({"infotable": lines}, batches)
    assert {r["etl_batch_id"]: r["row_count"] for r in dicts(expected)} == {1: 3, 2: 1}
    actual = lineage.source_counts({"infotable": lines.filter("accession_number <> 'b'")}, batches)
    assert dicts(lineage.count_mismatches(expected, actual)) == [
        {"etl_batch_id": 1, "table_name": "infotable", "source_row_count": 3, "stored_row_count": 2}
    ]
    nothing = batches.limit(0)
    closed = lineage.close_batches(lineage.admit_batches(batches, nothing, nothing), expected, actual)
    assert {r["etl_batch_id"]: r["status"] for r in dicts(closed)} == {1: "FAILED", 2: "COMPLETED"}
    assert [r["accession_number"] for r in dicts(lineage.batch_lineage(batches, closed))] == ["c"]
    assert dicts(lineage.duplicate_accessions(lines)) == [{"accession_number": "a", "row_count": 2}]


def test_upsert_takes_incoming_nulls_and_keeps_the_rest(spark):
    schema = "k string, v string, w int"
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], schema)
    new = spark.createDataFrame([("b", None, 9), ("c", "new", 3)], schema)
    assert dicts(merge.upsert(old, new, ["k"]), "k") == [
        {"k": "a", "v": "old", "w": 1}, {"k": "b", "v": None, "w": 9}, {"k": "c", "v": "new", "w": 3}
    ]


def test_insert_prune_deactivate_fill_and_evolve(spark):
    old = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    new = spark.createDataFrame([("b", "y"), ("c", "z"), ("c", "z")], "k string, v string")
    assert [r["k"] for r in dicts(merge.insert_new_keys(old, new, ["k"]), "k")] == ["a", "b", "c"]
    assert [r["k"] for r in dicts(merge.prune_absent(old, new, ["k"]))] == ["b"]
    active = {r["k"]: (r["v"], r["is_active"]) for r in dicts(merge.soft_deactivate(old.selectExpr("*", "1 AS is_active"), new.distinct(), ["k"]))}
    assert active == {"a": ("x", 0), "b": ("y", 1), "c": ("z", 1)}
    only_keys = merge.soft_deactivate(old.selectExpr("k", "1 AS is_active"), new.select("k").distinct(), ["k"])
    assert {r["k"]: r["is_active"] for r in dicts(only_keys)} == {"a": 0, "b": 1, "c": 1}
    filled = {r["k"]: r["v"] for r in dicts(merge.fill_gaps(old, new.distinct(), ["k"], ["v"]))}
    assert filled == {"a": "x", "b": "y"}
    wide = merge.add_columns(old, spark.createDataFrame([("d", 1)], "k string, extra int"))
    assert {r["k"]: (r["v"], r["extra"]) for r in dicts(wide)}["d"] == (None, 1)


def test_new_keys_get_new_ids_and_old_ones_keep_theirs(spark):
    def ids(df):
        return {(r["a"], r["b"]): r["id"] for r in df.collect()}

    def keys(rows, parts):
        return spark.createDataFrame(rows, "a string, b int").repartition(parts)

    first = [("k%03d" % i, i % 3) for i in range(200)] + [(None, 1), ("k000", None), (None, None)]
    later = [("k%03d" % i, i % 3) for i in range(150, 400)] + [("", 0), (None, 1), (None, 2)]
    empty = spark.createDataFrame([], "a string, b int, id bigint")
    for parts in (1, 7):
        one = ids(merge.number_new_keys(empty, keys(first + first, parts), ["a", "b"]))
        ordered = sorted(first, key=lambda k: (k[0] is not None, k[0] or "", k[1] is not None, k[1] or 0))
        assert one == {k: i + 1 for i, k in enumerate(ordered)}
        stored = merge.number_new_keys(empty, keys(first, parts), ["a", "b"])
        two = ids(merge.number_new_keys(stored, keys(later, parts), ["a", "b"]))
        assert two.items() >= one.items() and len(set(two.values())) == len(two) == len(set(first) | set(later))
        new = sorted(set(later) - set(first), key=lambda k: (k[0] is not None, k[0] or "", k[1] or 0))
        assert [two[k] for k in new] == list(range(len(one) + 1, len(two) + 1))
    assert ids(merge.number_new_keys(stored, keys([], 2), ["a", "b"])) == one
    assert ids(merge.number_new_keys(empty, keys([], 1), ["a", "b"])) == {}
