"""Stored tables are larger in memory than in their files; the planner must not broadcast them by file size."""

from pyspark.sql import functions as F

from holdfast.operators import lineage, managers
from holdfast.sources.store import write_table
from tests.test_plans import plan_of

FILINGS = 600_000
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def stored_filings(spark, folder):
    """As many filings as take 120 MB as rows and a few in Parquet."""
    ids = spark.range(FILINGS).select(F.col("id").cast("string").alias("accession_number"), (F.col("id") % 50).cast("string").alias("cik"))
    submission = ids.withColumns({"filing_date": F.lit("01-MAR-2021"), "periodofreport": F.lit("31-DEC-2020")})
    texts = ["filingmanager_name", *managers.ADDRESS, *managers.REGISTRATION]
    cover = ids.select("accession_number", *[F.concat(F.lit(f"{c} of manager "), "cik").alias(c) for c in texts])
    return write_table(submission, f"{folder}/submission"), write_table(cover, f"{folder}/coverpage")


def test_cover_pages_are_not_broadcast(spark, folder):
    spark.conf.set(THRESHOLD, "10m")
    submission, cover = stored_filings(spark, folder)
    latest = managers.latest_filer(submission, cover)
    assert "BroadcastExchange" not in plan_of(latest)
    assert {(r.cik, r.accession_number, r.submission_count) for r in latest.collect()} == {
        (f"{c:010d}", max(str(i) for i in range(c, FILINGS, 50)), FILINGS // 50) for c in range(50)
    }
    spark.conf.unset(THRESHOLD)

def test_filings_of_batches_are_not_broadcast(spark, folder):
    spark.conf.set(THRESHOLD, "10m")
    submission, cover = stored_filings(spark, folder)
    batches = write_table(
        cover.withColumn("etl_batch_id", F.length("accession_number").cast("bigint")).select(*cover.columns, "etl_batch_id"), f"{folder}/filings"
    )
    counts = lineage.source_counts({"submission": submission}, batches)
    assert "BroadcastExchange" not in plan_of(counts)
    assert {r.etl_batch_id: r.row_count for r in counts.collect()} == {1: 10, 2: 90, 3: 900, 4: 9_000, 5: 90_000, 6: 500_000}
    spark.conf.unset(THRESHOLD)
