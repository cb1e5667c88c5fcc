"""Every named query against its DuckDB statement, on the sample and on heavily skewed copies."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries
from holdfast.plans.catalog import CATALOG
from tests.skewed import write_skewed
from tools.check import compare

GOLDEN = {  # FIXTURES.md, column sf0.001
    "resolution": {"RESOLVED": 159, "REVIEW_REQUIRED": 49, "INCOMPLETE_HISTORY": 8},
    "actions": {"NEW": 702, "ADDED": 108, "REDUCED": 85, "EXITED": 649, "UNCHANGED": 24, "UNKNOWN": 388},
    "classes": {1: 2, 2: 1, 3: 8, 4: 4, 8: 5, 9: 4, 99: 1},
    "quality": {"OK": 1421, "ROUNDING_DIFFERENCE": 58, "ISSUE": 195},
    "rows": {
        "variants": 3560, "positions": 1674, "instruments": 115, "relationships": 500, "manager_summary": 159,
        "security_summary": 617,
    },
}
SKEWED = (
    "amendment_components", "canonical_filings", "component_kind", "reconcile", "positions", "manager_summary",
    "security_summary", "quarter_changes", "manager_activity", "cusip_activity", "classify", "current_variant",
    "manager_dim", "institution_holdings", "security_holders", "relationship_history", "same_issuer",
    "institution_movers", "holding_variant", "fk_audit",
)


def connect(directory):
    con = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(CATALOG) <= set(queries()) & set(oracle_sql())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["quarter_id", "cik", "institution_name", "portfolio_value_usd", "holding_count"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_oracle(spark, sf, name):
    verdict, _, _ = compare(spark, connect(sf), name, sf)
    assert verdict == "ok"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, sf):
    return write_skewed(sf, str(tmp_path_factory.mktemp("skewed")))


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_input_equals_oracle(spark, skewed, name):
    verdict, rows, _ = compare(spark, connect(skewed), name, skewed)
    assert verdict == "ok" and rows > 0


def test_golden_counts(warehouse):
    w = warehouse

    def counts(df, column):
        return {r[0]: r[1] for r in df.groupBy(column).count().collect()}

    assert counts(w.canonical, "resolution_status") == GOLDEN["resolution"]
    assert counts(w.changes, "action") == GOLDEN["actions"]
    assert counts(w.classification, "security_type_id") == GOLDEN["classes"]
    assert counts(w.positions, "value_quality_status") == GOLDEN["quality"]
    assert {n: w.table(n).count() for n in GOLDEN["rows"]} == GOLDEN["rows"]
    assert w.components.filter("is_effective = 1").count() == 726
    assert w.context.filter("prior_pair_confidential IS NOT NULL").count() == 107
    assert w.positions.agg({"value_usd": "sum"}).first()[0] == 32065830854


def test_hot_filing_is_split_when_both_sides_are_shuffled(spark, skewed):
    """With nothing small enough to broadcast, AQE has to cut the partition of the filing that owns a third of the lines."""
    from holdfast.plans.warehouse import INPUTS, TABLES, Warehouse, sample_warehouse

    w = sample_warehouse(spark, skewed)
    expected = w.lines
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        fresh = Warehouse(spark, {n: w.table(n) for n in INPUTS}, None)
        for name in TABLES:
            fresh.adopt(name, w.table(name))
        fresh.adopt("infotable", w.infotable.repartition(16))
        built = TABLES["lines"].build(fresh)
        rows = built.collect()
        plan = built._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    assert "skew=true" in plan
    assert sorted(map(str, rows)) == sorted(map(str, expected.select(*built.columns).collect()))
