"""Positions, weights, summaries, changes and activity on hand-made holdings."""

import pytest

from holdfast.operators import changes as c
from holdfast.operators import positions as p
from tests.conftest import dicts

LINE = """accession_number string, cusip string, value bigint, sshprnamt bigint, sshprnamttype string, putcall string,
    investmentdiscretion string, othermanager string"""
FILING = """accession_number string, manager_cik string, quarter_id int, is_analytics_ready int,
    has_confidential_omission int, value_reconciliation_status string, value_multiplier bigint"""


def facts(spark, filings, lines, classes=None):
    """filings: (accession, manager, quarter, hidden); lines: (accession, cusip, value, amount, unit, option)."""
    effective = spark.createDataFrame([(a, m, q, 1, h, "MATCH", 1) for a, m, q, h in filings], FILING)
    infotable = spark.createDataFrame([(*line, "SOLE", None) for line in lines], LINE)
    cusips = sorted({line[1] for line in lines})
    classification = spark.createDataFrame(
        [(x, (classes or {}).get(x, 1), "RULE_VOTE") for x in cusips],
        "cusip string, security_type_id int, classification_method string",
    )
    lines = infotable.join(effective, "accession_number").selectExpr("*", "1 AS is_effective")
    base = p.aggregate_positions(lines, classification)
    context = p.manager_quarter_context(base)
    return p.weigh_positions(base, context).cache(), context, classification


def sh(accession, cusip, value, amount):
    return (accession, cusip, value, amount, "SH", None)


def test_one_cusip_splits_into_four_instruments(spark):
    lines = [
        ("f", "A", 1, 1, "SH", None), ("f", "A", 1, 1, "SH", "Call"), ("f", "A", 1, 1, "sh", "put"),
        ("f", "A", 1, 1, "PRN", None), ("f", "A", 1, 1, "SH", None), ("f", "B", 1, 1, "SH", "Other"),
    ]
    positions, _, classification = facts(spark, [("f", "m", 202301, 0)], lines)
    found = dicts(p.instruments(positions, classification), "cusip", "security_type_id")
    assert [(r["cusip"], r["security_type_id"], r["option_type"], r["amount_type"], r["classification_method"]) for r in found] == [
        ("A", 1, "NONE", "SH", "RULE_VOTE"), ("A", 5, "CALL", "SH", "PUTCALL"), ("A", 6, "PUT", "SH", "PUTCALL"),
        ("A", 7, "NONE", "PRN", "AMOUNT_TYPE"), ("B", 1, "NONE", "SH", "PUTCALL"),
    ]
    stock = positions.filter("cusip = 'A' AND security_type_id = 1").first()
    assert (stock.source_row_count, stock.effective_accession_count, stock.value_usd) == (2, 1, 2)


def test_two_effective_filings_count_once_each(spark):
    filings = [("f", "m", 202301, 0), ("g", "m", 202301, 0)]
    positions, _, _ = facts(spark, filings, [sh("f", "A", 10, 1), sh("f", "A", 5, 1), sh("g", "A", 1, 1)])
    row = positions.first()
    assert (row.value_usd, row.source_row_count, row.effective_accession_count, row.portfolio_weight) == (16, 3, 2, 1.0)


def test_zero_portfolio_has_no_weight_and_no_concentration(spark):
    positions, _, _ = facts(spark, [("f", "m", 202301, 0)], [sh("f", "A", 0, 1), sh("f", "B", 0, 2)])
    assert {r["portfolio_weight"] for r in dicts(positions)} == {None}
    assert {r["manager_concentration_hhi"] for r in dicts(p.security_quarter_summary(positions))} == {None}
    assert p.manager_quarter_summary(positions).first().top_10_weight is None


def test_hhi_and_largest_holder_tie(spark):
    filings = [(x, f"m{x}", 202301, 0) for x in "abc"]
    positions, _, _ = facts(spark, filings, [sh("a", "X", 60, 1), sh("b", "X", 40, 1), sh("b", "Y", 7, 1), sh("c", "Y", 7, 1)])
    rows = {r["cusip"]: r for r in dicts(p.security_quarter_summary(positions))}
    assert rows["X"]["manager_concentration_hhi"] == pytest.approx(0.52)
    assert (rows["X"]["largest_manager_cik"], rows["X"]["largest_manager_value_usd"]) == ("ma", 60)
    assert (rows["Y"]["largest_manager_cik"], rows["Y"]["manager_count"]) == ("mb", 2)


def test_top_ten_weight_and_largest_position_tie(spark):
    lines = [sh("f", f"C{i:02d}", 10, 1) for i in range(12)]
    positions, _, _ = facts(spark, [("f", "m", 202301, 0)], lines)
    row = p.manager_quarter_summary(positions).first()
    assert row.top_10_weight == pytest.approx(10 / 12)
    assert (row.largest_cusip, row.cusip_count, row.instrument_count) == ("C00", 12, 12)


def change_rows(spark, filings, lines):
    positions, context, _ = facts(spark, filings, lines)
    return c.quarter_changes(positions), positions, context


def test_actions(spark):
    filings = [("p", "m", 202204, 0), ("q", "m", 202301, 0)]
    prior = [sh("p", x, 10, n) for x, n in (("A", 10), ("B", 10), ("C", 10), ("D", 10), ("F", 0))]
    current = [sh("q", x, 20, n) for x, n in (("A", 10), ("B", 12), ("C", 8), ("E", 5), ("F", 5))]
    rows = {r["cusip"]: r for r in dicts(change_rows(spark, filings, prior + current)[0])}
    assert {k: r["action"] for k, r in rows.items()} == {
        "A": "UNCHANGED", "B": "ADDED", "C": "REDUCED", "D": "EXITED", "E": "NEW", "F": "ADDED"
    }
    assert {k: r["amount_change_percent"] for k, r in rows.items()} == {
        "A": 0.0, "B": pytest.approx(0.2), "C": pytest.approx(-0.2), "D": -1.0, "E": None, "F": None
    }
    assert {(r["from_quarter_id"], r["to_quarter_id"]) for r in rows.values()} == {(202204, 202301)}
    assert rows["D"]["current_value_usd"] is None and rows["D"]["value_change_usd"] == -10
    assert rows["C"]["value_change_usd"] == 10  # fewer shares, higher value: still REDUCED


def test_no_changes_over_a_missing_quarter(spark):
    filings = [("p", "m", 202301, 0), ("q", "m", 202303, 0)]
    changes, _, context = change_rows(spark, filings, [sh("p", "A", 1, 1), sh("q", "A", 1, 2)])
    assert changes.count() == 0 and c.manager_pairs(context).count() == 0


@pytest.mark.parametrize("hidden", [(1, 0), (0, 1)])
def test_confidential_side_hides_every_action(spark, hidden):
    filings = [("p", "m", 202301, hidden[0]), ("q", "m", 202302, hidden[1])]
    rows = dicts(change_rows(spark, filings, [sh("p", "A", 1, 1), sh("q", "B", 1, 2)])[0])
    assert {(r["action"], r["is_comparable"], r["noncomparable_reason"]) for r in rows} == {
        ("UNKNOWN", 0, "CONFIDENTIAL_OMISSION")
    }
    assert len(rows) == 2


def test_activity_keeps_the_buy_sell_asymmetry(spark):
    filings = [("p", "m", 202301, 0), ("q", "m", 202302, 0)]
    lines = [sh("p", "A", 100, 1), sh("q", "A", 40, 2), sh("p", "B", 10, 5), sh("q", "B", 30, 4), sh("q", "C", 7, 1)]
    changes, _, _ = change_rows(spark, filings, lines)
    row = c.manager_activity(changes).first()
    assert row.gross_buy_value_usd == -60 + 7  # an addition that lost value counts negative
    assert row.gross_sell_value_usd == 20  # a reduction that gained value still counts as sold
    assert (row.gross_value_change_usd, row.net_value_change_usd) == (87, -33)
    by_action = {r["action"]: r for r in dicts(c.security_action_activity(changes))}
    assert by_action["NEW"]["institution_count"] == 1


def test_period_changes_for_distant_quarters(spark):
    filings = [("p", "m", 202201, 0), ("q", "m", 202303, 0), ("r", "n", 202303, 0)]
    positions, _, _ = facts(spark, filings, [sh("p", "A", 1, 1), sh("q", "A", 1, 3), sh("q", "B", 1, 1), sh("r", "A", 1, 1)])
    rows = dicts(c.period_changes(positions, 202201, 202303), "cusip")
    assert [(r["manager_cik"], r["cusip"], r["action"]) for r in rows] == [("m", "A", "ADDED"), ("m", "B", "NEW")]


def test_identities_on_the_sample(warehouse):
    """Weights add to one, HHI stays in (0, 1], and comparable changes explain the portfolio difference."""
    from pyspark.sql import functions as F

    w = warehouse
    sums = w.positions.groupBy("manager_cik", "quarter_id").agg(F.sum("portfolio_weight").alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").count() == 0
    assert w.security_summary.filter("NOT (manager_concentration_hhi > 0 AND manager_concentration_hhi <= 1.0000001)").count() == 0
    per_pair = w.changes.groupBy("manager_cik", "from_quarter_id", "to_quarter_id").agg(
        F.sum("value_change_usd").alias("change")
    )
    total = w.manager_summary.select("manager_cik", "quarter_id", "portfolio_value_usd")
    both = per_pair.join(
        total.toDF("manager_cik", "from_quarter_id", "before"), ["manager_cik", "from_quarter_id"]
    ).join(total.toDF("manager_cik", "to_quarter_id", "after"), ["manager_cik", "to_quarter_id"])
    assert both.count() == per_pair.count() > 0
    assert both.filter("change <> after - before").count() == 0


def test_held_position_without_an_amount_is_not_exited(spark):
    held = ("m", "A", 1, "NONE", "SH")
    positions = spark.createDataFrame(
        [(*held, 202201, 10, 5, "OK", 0), (*held, 202202, 11, None, "OK", 0)],
        """manager_cik string, cusip string, security_type_id int, option_type string, amount_type string, quarter_id int,
           value_usd bigint, reported_amount bigint, value_quality_status string, has_confidential_omission int""",
    )
    assert c.period_changes(positions, 202201, 202202).first().action == "UNCHANGED"
