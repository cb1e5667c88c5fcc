"""Amendment resolution against hand-made cases and a sequential fold."""

import datetime as dt
import itertools

import pytest

from holdfast.operators.filings import canonical_filings, holdings_filings, resolve_amendments
from tests.conftest import dicts

KINDS = ("BASE", "RESTATEMENT", "ADDITION", "UNKNOWN", "EXCLUDE")
SCHEMA = """manager_cik string, quarter_id int, accession_number string, filing_date date, amendment_number int,
    component_type string, is_amendment int, is_confidential_omitted int"""


def fold(kinds, confidential):
    """Walk the filings in order: the definition the closed form has to equal."""
    in_force, by, reset_seen, review, incomplete = [], {}, False, False, False
    for i, kind in enumerate(kinds):
        if kind in ("BASE", "RESTATEMENT"):
            review |= kind == "BASE" and reset_seen
            by.update({old: i for old in in_force})
            in_force, reset_seen, incomplete = [i], True, False
        elif kind == "ADDITION":
            in_force.append(i)
            incomplete |= not reset_seen
        elif kind == "UNKNOWN":
            review = True
    status = "INCOMPLETE_HISTORY" if incomplete else "REVIEW_REQUIRED" if review else "RESOLVED"
    return in_force, by, status, int(any(confidential[i] for i in in_force))


def run(spark, groups):
    """groups: name -> list of (kind, day, amendment number, accession, confidential)."""
    rows = [
        (g, 202301, acc, dt.date(2023, 5, day), number, kind, int(kind != "BASE"), conf)
        for g, filings in groups.items()
        for kind, day, number, acc, conf in filings
    ]
    components = resolve_amendments(spark.createDataFrame(rows, SCHEMA)).cache()
    by_group = {}
    for r in dicts(components):
        by_group.setdefault(r["manager_cik"], []).append(r)
    for found in by_group.values():
        found.sort(key=lambda r: r["component_sequence"])
    return by_group, {r["manager_cik"]: r for r in dicts(canonical_filings(components))}


def simple(kinds):
    return [(k, 1 + i, None, f"{i:010d}-23-{i:06d}", i % 2) for i, k in enumerate(kinds)]


def test_every_sequence_up_to_five_equals_the_fold(spark):
    sequences = [s for n in range(1, 6) for s in itertools.product(KINDS, repeat=n)]
    groups = {"/".join(s): simple(s) for s in sequences}
    components, canonical = run(spark, groups)
    assert len(components) == len(sequences)
    for s in sequences:
        name = "/".join(s)
        in_force, by, status, hidden = fold(s, [i % 2 for i in range(len(s))])
        rows = components[name]
        assert [r["component_sequence"] for r in rows] == list(range(1, len(s) + 1))
        assert [i for i, r in enumerate(rows) if r["is_effective"]] == in_force, name
        replaced = {i: r["superseded_by_accession_number"] for i, r in enumerate(rows)}
        assert {i: a for i, a in replaced.items() if a} == {
            i: rows[j]["accession_number"] for i, j in by.items()
        }, name
        group = canonical[name]
        assert group["resolution_status"] == status, name
        assert group["effective_component_count"] == len(in_force)
        assert group["is_analytics_ready"] == int(status == "RESOLVED" and bool(in_force))
        assert group["has_confidential_omission"] == hidden
        assert group["latest_accession_number"] == rows[-1]["accession_number"]
        assert group["has_amendment"] == int(any(k != "BASE" for k in s))


@pytest.mark.parametrize(
    "kinds,effective,status,ready",
    [
        (("BASE", "ADDITION", "RESTATEMENT", "ADDITION"), [2, 3], "RESOLVED", 1),
        (("ADDITION",), [0], "INCOMPLETE_HISTORY", 0),
        (("ADDITION", "BASE"), [1], "RESOLVED", 1),
        (("RESTATEMENT", "BASE"), [1], "REVIEW_REQUIRED", 0),
        (("BASE", "UNKNOWN"), [0], "REVIEW_REQUIRED", 0),
        (("EXCLUDE",), [], "RESOLVED", 0),
    ],
)
def test_named_cases(spark, kinds, effective, status, ready):
    components, canonical = run(spark, {"m": simple(kinds)})
    assert [i for i, r in enumerate(components["m"]) if r["is_effective"]] == effective
    assert canonical["m"]["resolution_status"] == status
    assert canonical["m"]["is_analytics_ready"] == ready


def test_ties_on_the_filing_date_go_by_amendment_number_then_accession(spark):
    filings = [
        ("ADDITION", 1, 2, "A", 0), ("ADDITION", 1, 1, "B", 0), ("BASE", 1, None, "Z", 0), ("ADDITION", 1, 1, "A1", 0),
    ]
    components, _ = run(spark, {"m": filings})
    assert [r["accession_number"] for r in components["m"]] == ["Z", "A1", "B", "A"]


def test_one_group_over_many_pieces(spark):
    """3,000 filings of one manager on one day are ordered in several partitions."""
    days = [("BASE" if i % 7 == 0 else "ADDITION", 1, None, f"0001234567-23-{i:06d}", 0) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        components, canonical = run(spark, {"m": days})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = components["m"]
    last = max(i for i in range(3000) if i % 7 == 0)
    assert [i for i, r in enumerate(rows) if r["is_effective"]] == list(range(last, 3000))
    assert [r["component_sequence"] for r in rows] == list(range(1, 3001))
    for i, r in enumerate(rows):
        following = (i // 7 + 1) * 7
        expected = f"0001234567-23-{following:06d}" if following < 3000 else None
        assert r["superseded_by_accession_number"] == expected
    assert canonical["m"]["resolution_status"] == "REVIEW_REQUIRED"


def test_pieces_are_balanced(spark, folder):
    from holdfast.operators.filings import _ordered_pieces

    filings = spark.range(4000).selectExpr(
        "'m' AS manager_cik", "202301 AS quarter_id", "lpad(id, 8, '0') AS accession_number",
        "DATE '2023-05-01' AS filing_date", "CAST(id AS INT) AS amendment_number", "'ADDITION' AS component_type",
        "1 AS is_amendment", "0 AS is_confidential_omitted",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in _ordered_pieces(filings, ["manager_cik", "quarter_id"], folder).groupBy("piece").count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 2500


def test_override_beats_every_other_rule(spark):
    filings = spark.createDataFrame(
        [("a", "13F-HR", 202301, 0, None), ("b", "13f-hr/a", 202301, 1, "new holdings"),
         ("c", "13F-NT", 202301, 0, None), ("d", "13F-HR", None, 0, None), ("e", "13F-HR/A", 202301, 1, "odd")],
        "accession_number string, submission_type string, quarter_id int, is_amendment int, amendment_type string",
    )
    overrides = spark.createDataFrame([("a", "EXCLUDE")], "accession_number string, override_component_type string")
    kinds = {r["accession_number"]: r["component_type"] for r in dicts(holdings_filings(filings, overrides))}
    assert kinds == {"a": "EXCLUDE", "b": "ADDITION", "e": "UNKNOWN"}
