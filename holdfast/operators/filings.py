"""Filing normalization, amendment resolution and value reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.schemas import MANAGER_QUARTER
from holdfast.sources.store import store_once


def dense_calendar(dates: DataFrame, column: str) -> DataFrame:
    """Every quarter between the first and last observed date, with its predecessor."""
    bounds = dates.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo IS NOT NULL")
    steps = F.sequence(F.trunc("lo", "quarter"), F.trunc("hi", "quarter"), F.expr("INTERVAL 3 MONTH"))
    quarters = bounds.select(F.col("lo"), F.explode(steps).alias("first_day"))
    q = v.quarter_key("first_day")
    return quarters.select(
        q.alias("quarter_id"),
        v.quarter_label(q).alias("quarter_label"),
        v.quarter_end(q).alias("quarter_end_date"),
        v.quarter_year(q).alias("year"),
        (q % 100).cast("int").alias("quarter_number"),
        F.when(F.col("first_day") > F.trunc("lo", "quarter"), v.previous_quarter(q)).alias("previous_quarter_id"),
    )


def line_totals(infotable: DataFrame) -> DataFrame:
    """Lines and raw value per filing: one narrow scan that serves both the
    has-information-table flag and the reconciliation."""
    return infotable.groupBy("accession_number").agg(
        F.count("*").alias("holding_row_count"), F.sum("value").alias("holding_raw_total")
    )


def normalize_filings(
    submission: DataFrame,
    coverpage: DataFrame,
    summarypage: DataFrame,
    line_totals: DataFrame,
    batch_accessions: DataFrame | None = None,
) -> DataFrame:
    """One typed row per submission.  A missing required date, or a CIK that is no number, fails the job."""
    cover = coverpage.select(
        "accession_number", "reportcalendarorquarter", "reporttype", "isamendment", "amendmentno", "amendmenttype",
        "form13ffilenumber",
    )
    summary = summarypage.select("accession_number", "isconfidentialomitted")
    with_lines = line_totals.select("accession_number", F.lit(1).alias("has_lines"))
    joined = (
        submission.join(cover, "accession_number", "left")
        .join(summary, "accession_number", "left")
        .join(with_lines, "accession_number", "left")
    )
    batch = F.lit(None).cast("bigint")
    if batch_accessions is not None:
        joined = joined.join(batch_accessions.select("accession_number", "etl_batch_id"), "accession_number", "left")
        batch = F.col("etl_batch_id")
    report = v.filing_date("reportcalendarorquarter")

    def required(column: str, parse: Callable[[str], Column] = v.filing_date, problem: str = "missing") -> Column:
        message = F.concat(F.lit(f"{problem} {column} for "), F.col("accession_number"))
        return F.coalesce(parse(column), F.raise_error(message))

    amended = (F.upper("isamendment") == "Y") | F.col("submissiontype").endswith("/A")
    return joined.select(
        "accession_number",
        batch.alias("etl_batch_id"),
        required("cik", v.cik10, "invalid").alias("manager_cik"),
        required("filing_date").alias("filing_date"),
        required("periodofreport").alias("period_of_report"),
        report.alias("report_date"),
        v.quarter_key(report).alias("quarter_id"),
        F.col("submissiontype").alias("submission_type"),
        F.col("reporttype").alias("report_type"),
        F.when(amended, 1).otherwise(0).alias("is_amendment"),
        F.col("amendmentno").alias("amendment_number"),
        F.col("amendmenttype").alias("amendment_type"),
        F.when(F.upper("isconfidentialomitted") == "Y", 1).otherwise(0).alias("is_confidential_omitted"),
        F.col("form13ffilenumber").alias("form13f_file_number"),
        F.coalesce("has_lines", F.lit(0)).alias("has_information_table"),
    )


def component_kind(override: Column | str | None = None) -> Column:
    """Manual override, else original filing, else what the amendment type says."""
    kind = F.upper("amendment_type")
    derived = (
        F.when(F.col("is_amendment") == 0, "BASE")
        .when(kind == "RESTATEMENT", "RESTATEMENT")
        .when(kind == "NEW HOLDINGS", "ADDITION")
        .otherwise("UNKNOWN")
    )
    return derived if override is None else F.coalesce(v.blank_to_null(override), derived)


def holdings_filings(filings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Holdings reports with a report quarter, each with its component kind."""
    chosen = filings.filter(F.col("submission_type").ilike("13F-HR%") & F.col("quarter_id").isNotNull())
    if overrides is None:
        return chosen.withColumn("component_type", component_kind())
    manual = overrides.select("accession_number", "override_component_type")
    return (
        chosen.join(manual, "accession_number", "left")
        .withColumn("component_type", component_kind("override_component_type"))
        .drop("override_component_type")
    )


def filing_order() -> list[Column]:
    return [F.col("filing_date"), F.coalesce("amendment_number", F.lit(-1)), F.col("accession_number")]


def _ordered_pieces(filings: DataFrame, keys: list[str], path: str | None) -> DataFrame:
    """Filings with the piece of their group they fall into and their place in that piece.

    Pieces are the range partitions of (group, filing order): balanced whatever the groups
    look like, and numbered in filing order.  Range bounds come from a sample, so the rows
    are stored once; everything after it reads the same pieces.
    """
    replaces = F.col("component_type").isin("BASE", "RESTATEMENT")
    pieces = filings.repartitionByRange(*keys, *filing_order()).withColumn("piece", F.spark_partition_id())
    w = Window.partitionBy(*keys, "piece")
    backwards = w.orderBy(*[c.desc() for c in filing_order()]).rowsBetween(Window.unboundedPreceding, -1)
    replacing = F.when(replaces, F.col("accession_number"))
    return store_once(
        pieces.select(
            "accession_number", *keys, "piece", "component_type", "is_amendment", "is_confidential_omitted",
            "filing_date",
            F.row_number().over(w.orderBy(*filing_order())).alias("place"),
            # Walking backwards, the last replacing filing seen is the next one in time.
            F.last(replacing, ignorenulls=True).over(backwards).alias("replaced_by"),
        ),
        path,
    )


def resolve_amendments(filings: DataFrame, keys: list[str] = MANAGER_QUARTER, path: str | None = None) -> DataFrame:
    """Order the filings of a group and mark which of them are in effect.

    BASE and RESTATEMENT replace everything before them; ADDITION adds to what is
    in effect.  With ``last`` = position of the last replacing filing, a row is in
    effect if it is that filing or an ADDITION after it.

    A group may be very large, so no window runs over all of its rows: rows are ordered
    within pieces, and one summary row per piece carries counts and resets across them.
    ``path`` is where the ordered rows are stored.
    """
    replaces = F.col("component_type").isin("BASE", "RESTATEMENT")
    rows = _ordered_pieces(filings, keys, path)
    reset_place = F.when(replaces, F.col("place"))
    pieces = rows.groupBy(*keys, "piece").agg(
        F.count("*").alias("piece_rows"),
        F.max(reset_place).alias("last_reset_place"),
        F.min_by("accession_number", reset_place).alias("first_replacing"),
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    backwards = group.orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *keys,
        "piece",
        F.coalesce(F.sum("piece_rows").over(before), F.lit(0)).alias("rows_before"),
        F.last("first_replacing", ignorenulls=True).over(backwards).alias("replaced_later_by"),
        "last_reset_place",
    ).withColumn("last_reset", F.max(F.col("rows_before") + F.col("last_reset_place")).over(group))
    placed = rows.join(pieces, [*keys, "piece"]).withColumns(
        {
            "component_sequence": (F.col("rows_before") + F.col("place")).cast("int"),
            "last_reset": F.coalesce("last_reset", F.lit(0)),
        }
    )
    sequence, last = F.col("component_sequence"), F.col("last_reset")
    effective = (replaces & (sequence == last)) | ((F.col("component_type") == "ADDITION") & (sequence > last))
    return placed.select(
        "accession_number",
        *keys,
        "component_type",
        "component_sequence",
        F.when(effective, 1).otherwise(0).alias("is_effective"),
        F.when(
            F.col("component_type").isin("BASE", "RESTATEMENT", "ADDITION"),
            F.coalesce("replaced_by", "replaced_later_by"),
        ).alias("superseded_by_accession_number"),
        "is_amendment",
        "is_confidential_omitted",
        "filing_date",
    )


def canonical_filings(components: DataFrame, keys: list[str] = MANAGER_QUARTER) -> DataFrame:
    """Resolution status per group, from the resolved components."""
    kind, seq = F.col("component_type"), F.col("component_sequence")
    replaces = kind.isin("BASE", "RESTATEMENT")
    marks = components.groupBy(*keys).agg(
        F.min(F.when(replaces, seq)).alias("first_reset"),
        F.max(F.when(kind == "BASE", seq)).alias("last_base"),
        F.count_if(kind == "ADDITION").alias("additions"),
        F.count_if(kind == "UNKNOWN").alias("unknowns"),
        F.max("is_amendment").alias("has_amendment"),
        F.max(F.col("is_effective") * F.col("is_confidential_omitted")).alias("has_confidential_omission"),
        F.sum("is_effective").alias("effective_component_count"),
        F.max_by("accession_number", "component_sequence").alias("latest_accession_number"),
    )
    repeated_base = F.coalesce(F.col("last_base") > F.col("first_reset"), F.lit(False))
    status = (
        F.when((F.col("additions") > 0) & F.col("first_reset").isNull(), "INCOMPLETE_HISTORY")
        .when((F.col("unknowns") > 0) | repeated_base, "REVIEW_REQUIRED")
        .otherwise("RESOLVED")
    )
    ready = (F.col("resolution_status") == "RESOLVED") & (F.col("effective_component_count") > 0)
    return marks.withColumn("resolution_status", status).select(
        *keys,
        "resolution_status",
        F.when(ready, 1).otherwise(0).alias("is_analytics_ready"),
        "has_amendment",
        "has_confidential_omission",
        "effective_component_count",
        "latest_accession_number",
    )


def reconciliation_status(held: Column, reported: Column) -> Column:
    """Ordered labels; the first that applies wins."""
    return (
        F.when(reported.isNull(), "NO_SUMMARY")
        .when(held == reported, "MATCH")
        .when(F.abs(held - reported) <= 1, "ROUNDING_DIFFERENCE")
        .when(reported == 0, "SUMMARY_ZERO")
        .when(held.between(reported * 999, reported * 1001), "HOLDINGS_APPROX_1000X_SUMMARY")
        .when(reported.between(held * 999, held * 1001), "SUMMARY_APPROX_1000X_HOLDINGS")
        .otherwise("MISMATCH")
    )


def reconcile_values(components: DataFrame, totals: DataFrame, summarypage: DataFrame) -> DataFrame:
    """Detail totals of effective filings against the total the filer stated."""
    effective = components.filter("is_effective = 1").select("accession_number")
    stated = summarypage.select("accession_number", F.col("tablevaluetotal").alias("summary_raw_total"))
    # 19 digits so that a stated total x 1001 cannot overflow
    held = F.col("holding_raw_total").cast("decimal(20,0)")
    reported = F.col("summary_raw_total").cast("decimal(20,0)")
    return totals.join(effective, "accession_number").join(stated, "accession_number", "left").select(
        "accession_number",
        "holding_row_count",
        "holding_raw_total",
        "summary_raw_total",
        (F.col("holding_raw_total") - F.col("summary_raw_total")).alias("raw_difference"),
        reconciliation_status(held, reported).alias("reconciliation_status"),
    )


def effective_filings(components: DataFrame, canonical: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """One row per effective filing with everything its holding lines inherit."""
    groups = canonical.drop("has_amendment", "effective_component_count", "latest_accession_number")
    status = reconciliation.select(
        "accession_number", F.col("reconciliation_status").alias("value_reconciliation_status")
    )
    rows = components.filter("is_effective = 1").select("accession_number", *MANAGER_QUARTER, "filing_date")
    return (
        rows.join(groups, MANAGER_QUARTER)
        .join(status, "accession_number", "left")
        .withColumn("value_multiplier", v.value_multiplier("filing_date"))
        .drop("filing_date")
    )


def filing_headers(submission: DataFrame, coverpage: DataFrame, effective: DataFrame) -> DataFrame:
    """One row per filing with all that its lines inherit: submission, cover, quarter and resolution.

    Only submissions are resolved, so ``effective`` meets them before the covers: a full outer join keeps no partitioning,
    and all filings would be exchanged once more after it.
    """
    cover = coverpage.select(
        "accession_number", "reportcalendarorquarter", "reporttype", "form13ffilenumber", "filingmanager_name",
        F.lit(1).alias("has_cover"),
    )
    sent = submission.select(
        "accession_number", v.cik10("cik").alias("manager_cik"), "filing_date", "submissiontype", "periodofreport",
        F.lit(1).alias("has_submission"),
    )
    resolved = effective.drop(*MANAGER_QUARTER).withColumn("is_effective", F.lit(1))
    columns = list(dict.fromkeys([*sent.columns, *cover.columns, *resolved.columns]))
    return (
        sent.join(resolved, "accession_number", "left").join(cover, "accession_number", "full_outer").select(*columns)
        .withColumn("quarter_id", v.quarter_key(v.filing_date("reportcalendarorquarter")))
    )


def enriched_lines(infotable: DataFrame, headers: DataFrame) -> DataFrame:
    """Every as-filed line with its filing's header: the only join that deals lines out by filing.

    ``headers`` has one row per number and is a stored table, so both sides are exchanged for this join alone and a
    partition of a filing with very many lines can be split.  A line whose filing has no submission or cover yet is
    kept with NULL there; without a cover it has no quarter and waits in the partition of unknown quarters.
    """
    return infotable.join(headers, "accession_number", "left")


def with_late_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """The lines of the unknown quarter again, with headers that have arrived meanwhile; the other partitions are not read."""
    own = [c for c in lines.columns if c == "accession_number" or c not in headers.columns]
    return enriched_lines(lines.filter("quarter_id IS NULL").select(*own), headers).select(*lines.columns)


def canonical_holdings(lines: DataFrame, ready_only: bool = False) -> DataFrame:
    """Holding lines of effective filings in dollars; ``ready_only`` keeps resolved groups."""
    rows = lines.filter("is_effective = 1")
    if ready_only:
        rows = rows.filter("is_analytics_ready = 1")
    headers = ("filing_date", "submissiontype", "periodofreport", "reportcalendarorquarter", "reporttype", "form13ffilenumber",
               "filingmanager_name", "has_cover", "has_submission", "is_effective")
    return rows.drop(*headers).withColumnRenamed("value", "raw_reported_value").withColumns(
        {
            "value_usd": F.col("raw_reported_value") * F.col("value_multiplier"),
            "quarter_label": v.quarter_label("quarter_id"),
            "quarter_end_date": v.quarter_end("quarter_id"),
        }
    )
