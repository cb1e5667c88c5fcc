"""Physical plans: what must not appear at scale, and what has to."""

import re

import pytest

from holdfast.operators import filings as f
from holdfast.operators import positions as p
from holdfast.plans.catalog import CATALOG
from holdfast.plans.warehouse import INPUTS, TABLES, Warehouse

STREAMED = {"stream_append", "stream_reresolve"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def check(plan: str) -> None:
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = "\n".join(lines[i + 1 : i + 4])
            assert "SinglePartition" not in below, line


@pytest.fixture(scope="module")
def shuffled(spark, warehouse):
    """Every join forced to shuffle, as if no side were small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield warehouse
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(TABLES))
def test_table_plans(shuffled, name):
    fresh = Warehouse(shuffled.spark, {n: shuffled.table(n) for n in INPUTS}, None)
    for other in TABLES:
        if other != name:
            fresh.adopt(other, shuffled.table(other))
    plan = plan_of(TABLES[name].build(fresh))
    check(plan)
    assert "BroadcastExchange" not in plan  # nothing is broadcast by force


@pytest.mark.parametrize("name", sorted(set(CATALOG) - STREAMED))
def test_query_plans(warehouse, name):
    check(plan_of(CATALOG[name](warehouse)))


def test_ranked_rows_are_limited_before_the_exchange(warehouse):
    plan = plan_of(p.largest_positions(warehouse.positions, 10))
    window, exchange, partial = (plan.index(x) for x in ("Window ", "Exchange", "WindowGroupLimit"))
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > exchange > window
    assert partial < exchange


def test_scans_read_only_what_they_need(warehouse):
    w = warehouse
    plan = plan_of(p.aggregate_positions(w.lines, w.classification))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "sshprnamt" in x)
    assert "nameofissuer" not in scan and "voting_auth_sole" not in scan
    quarter = plan_of(w.positions.filter("quarter_id = 202301").select("cusip"))
    assert re.search(r"PartitionFilters: \[.*quarter_id.*202301", quarter)


def test_holdings_need_no_join_of_facts(warehouse):
    from holdfast.plans.institutions import held_and_left

    plan = plan_of(held_and_left(warehouse))
    assert "Join" not in plan and "Exchange" not in plan


def test_lines_are_dealt_out_by_filing_once(shuffled):
    """One exchange of lines by filing number in the whole graph; every other one of that key has aggregated before."""
    w = shuffled
    fresh = Warehouse(w.spark, {n: w.table(n) for n in INPUTS}, None)
    for other in TABLES:
        fresh.adopt(other, w.table(other))
    found = {}
    consumers = {name: TABLES[name].build(fresh) for name in TABLES}
    consumers |= {name: CATALOG[name](fresh) for name in ("holding_variant", "analytics_holdings", "value_usd")}
    for name, df in consumers.items():
        lines = plan_of(df).splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning(accession_number" in line:
                depth = re.match(r"[\s:+*()\d-]*", line).end()
                below = []
                for other in lines[i + 1 :]:
                    if re.match(r"[\s:+*()\d-]*", other).end() <= depth:
                        break
                    below.append(other)
                reads_lines = any("FileScan" in x and "infotable_sk" in x.split("ReadSchema", 1)[-1] or "FileScan" in x and "cusip:string" in x for x in below)
                if reads_lines and not any("HashAggregate" in x for x in below):
                    found[name] = found.get(name, 0) + 1
    assert found == {"lines": 1}


def test_late_headers_read_the_waiting_lines_only(warehouse):
    from holdfast.operators import filings as f

    w = warehouse
    late = f.with_late_headers(w.lines, w.headers)
    assert re.search(r"PartitionFilters: \[isnull\(quarter_id", plan_of(late))


def test_headers_exchange_every_table_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = lambda *names: ", ".join(f"{n} string" for n in names)
    sent = spark.createDataFrame(
        [("a", "7", "01-MAR-2021", "13F-HR", "31-DEC-2020")], text("accession_number", "cik", "filing_date", "submissiontype", "periodofreport")
    )
    cover = spark.createDataFrame(
        [("a", "31-DEC-2020", "r", "f", "m"), ("b", "31-MAR-2021", "r", "f", "n")],
        text("accession_number", "reportcalendarorquarter", "reporttype", "form13ffilenumber", "filingmanager_name"),
    )
    effective = spark.createDataFrame([("a", "0000000007", 202004, 1)], "accession_number string, manager_cik string, quarter_id int, value_multiplier int")
    headers = f.filing_headers(sent, cover, effective)
    assert plan_of(headers).count("Exchange hashpartitioning") == 3
    rows = {r.accession_number: (r.manager_cik, r.quarter_id, r.value_multiplier, r.is_effective) for r in headers.collect()}
    assert rows == {"a": ("0000000007", 202004, 1, 1), "b": (None, 202101, None, None)}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
