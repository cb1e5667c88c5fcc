"""The table graph: raw filing tables -> dimensions -> facts -> rollups.

Each table is a function of earlier tables.  Where a shared folder exists a table is
written once as Parquet and read back, which cuts its lineage and lets every serving
query start from the rollup it needs.  Without one the plans stay lazy and give the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import changes as C
from holdfast.operators import filings as f
from holdfast.operators import managers as m
from holdfast.operators import positions as p
from holdfast.operators import securities as s
from holdfast.operators.merge import conform
from holdfast.schemas import CLASS_RULES, RAW_SCHEMAS, RAW_TABLES, SECURITY_TYPE_COLUMNS, SECURITY_TYPES
from holdfast.session import new_folder, prepare, shared_dir
from holdfast.sources.sample import sample_tables, summary_pages
from holdfast.sources.store import write_table

INPUTS = (*RAW_TABLES, "listings", "sic")
LARGE_INPUTS = ("infotable", "summarypage", "signature", "submission", "coverpage")


@dataclass(frozen=True)
class Table:
    stage: str
    build: Callable[["Warehouse"], DataFrame]
    partition_by: str | None = None
    sort_by: str | None = None
    exchange: bool = True  # before a partitioned write


# Stages run in this order and a run can resume at any of them.
STAGES = ("managers", "securities", "canonical", "instruments")

TABLES: dict[str, Table] = {
    "manager_dim": Table(
        "managers",
        lambda w: m.manager_dimension(w.submission, w.coverpage, w.othermanager, w.othermanager2, w.listings),
    ),
    "listing_dim": Table("managers", lambda w: m.listing_dimension(w.listings, w.sic, w.sic_as_of)),
    "variants": Table("securities", lambda w: s.security_variants(w.lines)),
    "current_variant": Table("securities", lambda w: s.current_variant(w.variants)),
    "line_totals": Table("canonical", lambda w: f.line_totals(w.infotable)),
    "filings": Table(
        "canonical", lambda w: f.normalize_filings(w.submission, w.coverpage, w.summarypage, w.line_totals, w.batches)
    ),
    "calendar": Table("canonical", lambda w: f.dense_calendar(w.filings, "report_date")),
    "components": Table(
        "canonical",
        lambda w: f.resolve_amendments(f.holdings_filings(w.filings, w.filing_overrides), path=w.path("ordered_filings")),
    ),
    "canonical": Table("canonical", lambda w: f.canonical_filings(w.components)),
    "reconciliation": Table(
        "canonical", lambda w: f.reconcile_values(w.components, w.line_totals, w.summarypage)
    ),
    "effective": Table(
        "canonical", lambda w: f.effective_filings(w.components, w.canonical, w.reconciliation)
    ),
    "headers": Table("canonical", lambda w: f.filing_headers(w.submission, w.coverpage, w.effective)),
    "lines": Table("canonical", lambda w: f.enriched_lines(w.infotable, w.headers), "quarter_id", "manager_cik", False),
    "classification": Table(
        "instruments",
        lambda w: s.classify_securities(
            w.variants, w.type_overrides, CLASS_RULES if w.class_rules is None else w.class_rules
        ),
    ),
    "position_base": Table(
        "instruments", lambda w: p.aggregate_positions(w.lines, w.classification)
    ),
    "context": Table("instruments", lambda w: p.manager_quarter_context(w.position_base)),
    "positions": Table(
        "instruments", lambda w: p.weigh_positions(w.position_base, w.context), "quarter_id", "manager_cik", False
    ),
    "instruments": Table("instruments", lambda w: p.instruments(w.positions, w.classification)),
    "relationships": Table("instruments", lambda w: p.relationships(w.positions)),
    "manager_summary": Table("instruments", lambda w: p.manager_quarter_summary(w.positions), "quarter_id"),
    "security_summary": Table("instruments", lambda w: p.security_quarter_summary(w.positions), "quarter_id"),
    "changes": Table("instruments", lambda w: C.quarter_changes(w.positions), "to_quarter_id", "manager_cik"),
    "manager_activity": Table("instruments", lambda w: C.manager_activity(w.changes), "quarter_id"),
    "manager_action_activity": Table("instruments", lambda w: C.manager_action_activity(w.changes), "quarter_id"),
    "security_action_activity": Table("instruments", lambda w: C.security_action_activity(w.changes), "quarter_id"),
    "security_activity": Table("instruments", lambda w: C.security_activity(w.security_action_activity), "quarter_id"),
}


def stage_tables(stage: str) -> list[str]:
    return [name for name, table in TABLES.items() if table.stage == stage]


# Tables that several others start from.  Without a folder they are persisted, so a
# plan is still evaluated once; lost blocks are computed again from the inputs.
REUSED = {
    "variants", "line_totals", "filings", "components", "effective", "classification", "position_base", "positions",
    "changes", "security_action_activity", "lines",
}


class Warehouse:
    """Named DataFrames, built on first use: ``warehouse.positions``."""

    def __init__(
        self,
        spark: SparkSession,
        inputs: dict[str, DataFrame | Callable[["Warehouse"], DataFrame]],
        folder: str | None,
        *,
        batches: DataFrame | None = None,
        filing_overrides: DataFrame | None = None,
        type_overrides: DataFrame | None = None,
        class_rules: DataFrame | None = None,
        sic_as_of: str | None = None,
        store_inputs: bool = False,
    ):
        self.spark = spark
        self.folder = folder
        self.batches, self.filing_overrides, self.type_overrides = batches, filing_overrides, type_overrides
        self.class_rules, self.sic_as_of = class_rules, sic_as_of
        self._inputs = inputs
        self._store_inputs = store_inputs
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in INPUTS):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in TABLES:
                plan, store = TABLES[name].build(self), True
            else:
                plan, store = self._inputs[name], self._store_inputs
                plan = plan(self) if callable(plan) else plan
            if self.folder is not None and store:
                layout = TABLES.get(name, Table("inputs", None))
                plan = write_table(plan, f"{self.folder}/{name}", layout.partition_by, layout.sort_by, layout.exchange)
            elif name in REUSED:
                plan = plan.persist(StorageLevel.DISK_ONLY)
            self._frames[name] = plan
        return self._frames[name]

    def build(self, *groups: list[str]) -> None:
        """Build groups of tables, the groups at the same time.

        Groups must not depend on each other.  Independent jobs submitted together keep
        the executors busy while one of them waits for its last tasks.
        """
        with ThreadPoolExecutor(max_workers=len(groups)) as pool:
            for done in [pool.submit(lambda g: [self.table(n) for n in g], g) for g in groups]:
                done.result()

    def build_inputs(self) -> None:
        if self._store_inputs:
            small = [n for n in INPUTS if n not in LARGE_INPUTS]
            self.build(["infotable", "summarypage"], ["signature"], ["submission", "coverpage"], small)

    def build_dimensions_and_filings(self) -> None:
        """Managers beside filings; spellings are counted on the lines that resolved filings have enriched."""
        self.build(stage_tables("managers"), ["line_totals", "filings", "components"])
        self.build(["canonical"], ["reconciliation"], ["calendar"])
        self.build(["effective", "headers", "lines", "variants"])

    def build_facts(self) -> None:
        self.build(["current_variant"], ["classification", "position_base", "context", "positions"])
        self.build(["instruments", "relationships"], ["manager_summary"], ["security_summary"], ["changes"])
        self.build(
            ["manager_activity"], ["manager_action_activity"], ["security_action_activity", "security_activity"]
        )

    def build_all(self) -> None:
        self.build_inputs()
        self.build_dimensions_and_filings()
        self.build_facts()

    def path(self, name: str) -> str | None:
        return None if self.folder is None else f"{self.folder}/{name}"

    def adopt(self, name: str, frame: DataFrame) -> None:
        """Use an already stored table instead of building it."""
        self._frames[name] = frame

    @property
    def security_type(self) -> DataFrame:
        """Ten fixed rows, as a literal relation."""
        rows = ", ".join(f"({i}, '{code}', '{name}', {core})" for i, code, name, core in SECURITY_TYPES)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(SECURITY_TYPE_COLUMNS)})")

    def latest_quarter(self) -> int:
        """Newest quarter with portfolios; one number, used to prune partitions."""
        newest = self.manager_summary.agg(F.max("quarter_id")).first()[0]
        if newest is None:
            raise LookupError("no analytical quarters are available")
        return newest


_open: dict[tuple[str, str], Warehouse] = {}


def sample_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Warehouse over the star-schema test tables; one per application and directory.

    The test tables do not change while an application runs.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _open:
        prepare(spark)
        folder = new_folder(spark, "warehouse") if shared_dir(spark) else None
        inputs = sample_tables(spark, key[1])
        inputs = {**inputs, **complete_inputs(inputs)}
        # totals of stored lines, which would else be joined with their parts once more
        inputs["summarypage"] = lambda w: conform(summary_pages(spark, w.infotable), RAW_SCHEMAS["summarypage"])
        _open[key] = Warehouse(spark, inputs, folder, store_inputs=True)
    return _open[key]


def complete_inputs(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Give every raw table its full documented column list; absent columns are NULL."""
    return {name: conform(inputs[name], schema) for name, schema in RAW_SCHEMAS.items()}
