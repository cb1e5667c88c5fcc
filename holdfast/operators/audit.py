"""Data-quality audits: keys, references and value domains.

Every audit returns one small row per rule.  Rules over one table share a single scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.schemas import (
    ACTIONS, COMPONENT_KINDS, INSTRUMENT_KEY, MANAGER_QUARTER, QUALITY_STATUSES, RELATIONSHIP_KEY, RESOLUTIONS,
    SECURITY_QUARTER,
)


@dataclass(frozen=True)
class Reference:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def _refs(*rows: tuple[str, str, str, str]) -> list[Reference]:
    return [Reference(c, tuple(cc.split()), p, tuple(pc.split())) for c, cc, p, pc in rows]


_INSTRUMENT, _PAIR = " ".join(INSTRUMENT_KEY), " ".join(RELATIONSHIP_KEY)
REFERENCES = _refs(
    ("coverpage", "accession_number", "submission", "accession_number"),
    ("summarypage", "accession_number", "submission", "accession_number"),
    ("signature", "accession_number", "submission", "accession_number"),
    ("othermanager", "accession_number", "submission", "accession_number"),
    ("othermanager2", "accession_number", "submission", "accession_number"),
    ("infotable", "accession_number", "submission", "accession_number"),
    ("listing_dim", "cik", "manager_dim", "cik"),
    ("filings", "accession_number", "submission", "accession_number"),
    ("filings", "quarter_id", "calendar", "quarter_id"),
    ("calendar", "previous_quarter_id", "calendar", "quarter_id"),
    ("components", "accession_number", "submission", "accession_number"),
    ("components", "superseded_by_accession_number", "submission", "accession_number"),
    ("components", "manager_cik quarter_id", "canonical", "manager_cik quarter_id"),
    ("canonical", "quarter_id", "calendar", "quarter_id"),
    ("canonical", "latest_accession_number", "submission", "accession_number"),
    ("current_variant", "cusip", "classification", "cusip"),
    ("classification", "security_type_id", "security_type", "security_type_id"),
    ("instruments", "cusip", "classification", "cusip"),
    ("instruments", "security_type_id", "security_type", "security_type_id"),
    ("relationships", _INSTRUMENT, "instruments", _INSTRUMENT),
    ("relationships", "first_observed_quarter_id", "calendar", "quarter_id"),
    ("relationships", "latest_observed_quarter_id", "calendar", "quarter_id"),
    ("positions", _PAIR, "relationships", _PAIR),
    ("positions", "quarter_id", "calendar", "quarter_id"),
    ("changes", _PAIR, "relationships", _PAIR),
    ("changes", "from_quarter_id", "calendar", "quarter_id"),
    ("changes", "to_quarter_id", "calendar", "quarter_id"),
    ("manager_summary", "quarter_id", "calendar", "quarter_id"),
    ("security_summary", "cusip", "current_variant", "cusip"),
    ("security_summary", "quarter_id", "calendar", "quarter_id"),
    ("manager_activity", "quarter_id", "calendar", "quarter_id"),
    ("manager_action_activity", "quarter_id", "calendar", "quarter_id"),
    ("security_activity", "cusip", "current_variant", "cusip"),
    ("security_activity", "quarter_id", "calendar", "quarter_id"),
    ("security_action_activity", "cusip", "current_variant", "cusip"),
    ("security_action_activity", "quarter_id", "calendar", "quarter_id"),
    ("variants", "cusip", "current_variant", "cusip"),
    ("classification", "selected_rule_id", "class_rule", "rule_id"),
    ("class_rule", "security_type_id", "security_type", "security_type_id"),
    ("manager_summary", " ".join(f"largest_{c}" for c in INSTRUMENT_KEY), "instruments", _INSTRUMENT),
    ("filing_override", "accession_number", "submission", "accession_number"),
    ("type_override", "cusip", "current_variant", "cusip"),
    ("type_override", "security_type_id", "security_type", "security_type_id"),
    ("filings", "etl_batch_id", "batch", "etl_batch_id"),
    ("batch_accession", "etl_batch_id", "batch", "etl_batch_id"),
    ("batch_accession", "accession_number", "submission", "accession_number"),
    ("batch_count", "etl_batch_id", "batch", "etl_batch_id"),
)

UNIQUE_KEYS: dict[str, list[str]] = {
    "submission": ["accession_number"],
    "coverpage": ["accession_number"],
    "signature": ["accession_number"],
    "summarypage": ["accession_number"],
    "othermanager": ["accession_number", "othermanager_sk"],
    "infotable": ["accession_number", "infotable_sk"],
    "manager_dim": ["cik"],
    "listing_dim": ["cik", "ticker"],
    "variants": ["cusip", "reportcalendarorquarter", "nameofissuer", "titleofclass", "figi"],
    "current_variant": ["cusip"],
    "calendar": ["quarter_id"],
    "filings": ["accession_number"],
    "components": ["accession_number"],
    "canonical": MANAGER_QUARTER,
    "classification": ["cusip"],
    "instruments": INSTRUMENT_KEY,
    "relationships": RELATIONSHIP_KEY,
    "positions": [*RELATIONSHIP_KEY, "quarter_id"],
    "changes": [*RELATIONSHIP_KEY, "from_quarter_id", "to_quarter_id"],
    "manager_summary": MANAGER_QUARTER,
    "security_summary": SECURITY_QUARTER,
    "manager_activity": MANAGER_QUARTER,
    "manager_action_activity": [*MANAGER_QUARTER, "action"],
    "security_activity": SECURITY_QUARTER,
    "security_action_activity": [*SECURITY_QUARTER, "action"],
}


def one_of(column: str, allowed: tuple) -> tuple[str, Column]:
    return f"{column} in domain", F.col(column).isin(*allowed)


def required(column: str) -> tuple[str, Column]:
    return f"{column} not null", F.col(column).isNotNull()


FLAG = (0, 1)
DOMAINS: dict[str, list[tuple[str, Column]]] = {}


def domains() -> dict[str, list[tuple[str, Column]]]:
    """Rules per table.  Built on first use because columns need a running session."""
    if not DOMAINS:
        DOMAINS.update(
            {
                "infotable": [required(c) for c in ("cusip", "value", "sshprnamt", "nameofissuer", "titleofclass")]
                + [one_of("sshprnamttype", ("SH", "PRN"))],
                "submission": [required(c) for c in ("filing_date", "submissiontype", "cik", "periodofreport")],
                "calendar": [("quarter_number between 1 and 4", F.col("quarter_number").between(1, 4))],
                "filings": [
                    required("manager_cik"), required("filing_date"), one_of("is_amendment", FLAG),
                    one_of("is_confidential_omitted", FLAG), one_of("has_information_table", FLAG),
                ],
                "components": [one_of("component_type", COMPONENT_KINDS), one_of("is_effective", FLAG)],
                "canonical": [
                    one_of("resolution_status", RESOLUTIONS), one_of("is_analytics_ready", FLAG),
                    one_of("has_amendment", FLAG), one_of("has_confidential_omission", FLAG),
                ],
                "classification": [
                    one_of("classification_method", ("CUSIP_OVERRIDE", "RULE_VOTE", "UNKNOWN")),
                    ("confidence between 0 and 1", F.col("classification_confidence").between(0, 1)),
                ],
                "instruments": [
                    one_of("option_type", ("NONE", "CALL", "PUT")), one_of("amount_type", ("SH", "PRN", "OTHER")),
                    one_of("is_active", FLAG),
                ],
                "positions": [
                    required("value_usd"), required("reported_amount"), one_of("has_shared_discretion", FLAG),
                    one_of("has_confidential_omission", FLAG), one_of("value_quality_status", QUALITY_STATUSES),
                ],
                "changes": [one_of("action", ACTIONS), one_of("is_comparable", FLAG)],
            }
        )
    return DOMAINS


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def literal_rows(spark, rows: list[tuple], *names: str) -> DataFrame:
    """A few integer rows as a literal relation."""
    body = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def _key(columns: tuple[str, ...]) -> Column:
    """Values of a key as one text, each behind its length; NULL if any is NULL."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def reference_audit(table, references: list[Reference] = REFERENCES, parent=None) -> DataFrame:
    """Rows per foreign key whose non-NULL reference has no parent.  ``table`` maps a name to a DataFrame, ``parent`` the
    name of a referenced table where the children are only parts of their tables.

    One scan of each child makes a row per reference; rows of all children are counted per key together, in each task before
    the one exchange; one scan of each parent key gives the keys that exist; one anti join compares all of them.
    """
    parents = list(dict.fromkeys((r.parent, r.parent_columns) for r in references))
    found = [(parent or table)(p).select(F.lit(i).alias("parent"), _key(columns).alias("key")) for i, (p, columns) in enumerate(parents)]
    children: dict[str, list[Column]] = {}
    for i, r in enumerate(references):
        entry = F.struct(F.lit(i).alias("reference"), F.lit(parents.index((r.parent, r.parent_columns))).alias("parent"), _key(r.columns).alias("key"))
        children.setdefault(r.child, []).append(entry)
    given = _union([table(child).select(F.inline(F.array(*entries))).filter("key IS NOT NULL") for child, entries in children.items()])
    counted = given.groupBy("reference", "parent", "key").agg(F.count("*").alias("n"))
    orphans = counted.join(_union(found), ["parent", "key"], "left_anti").groupBy("reference").agg(F.sum("n").alias("n"))
    names = [
        F.struct(
            F.lit(i).alias("reference"), F.lit(r.child).alias("child_table"), F.lit(",".join(r.columns)).alias("child_columns"),
            F.lit(r.parent).alias("parent_table"),
        )
        for i, r in enumerate(references)
    ]
    every = orphans.sparkSession.range(1).select(F.inline(F.array(*names)))
    return every.join(orphans, "reference", "left").select(
        "child_table", "child_columns", "parent_table", F.coalesce("n", F.lit(0).cast("bigint")).alias("violations")
    )


def unique_audit(table, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Keys that occur more than once, and the rows involved.  NULL counts as a value."""
    checks = []
    for name, columns in (keys or UNIQUE_KEYS).items():
        repeated = table(name).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
        checks.append(
            repeated.agg(
                F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("row_count")
            ).select(
                F.lit(name).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"), "duplicate_keys",
                "row_count",
            )
        )
    return _union(checks)


def domain_audit(table, rules: dict[str, list[tuple[str, Column]]] | None = None) -> DataFrame:
    """Rows that break each NOT NULL or CHECK rule; a CHECK on NULL counts as kept."""
    checks = []
    for name, list_of_rules in (rules or domains()).items():
        counts = table(name).agg(*[F.count_if(~rule).alias(f"r{i}") for i, (_, rule) in enumerate(list_of_rules)])
        rows = F.array(
            *[
                F.struct(F.lit(text).alias("rule"), F.col(f"r{i}").alias("violations"))
                for i, (text, _) in enumerate(list_of_rules)
            ]
        )
        checks.append(
            counts.select(F.lit(name).alias("table_name"), F.inline(rows).alias("rule", "violations"))
        )
    return _union(checks)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of several tables in one query."""
    return _union(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ]
    )
