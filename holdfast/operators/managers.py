"""Manager dimension: filers, other managers and exchange listings joined per CIK."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators.keys import latest_per_key
from holdfast.schemas import SIC_SOURCE

REGISTRATION = ["form13ffilenumber", "crdnumber", "secfilenumber"]
ADDRESS = [f"filingmanager_{p}" for p in ("street1", "street2", "city", "stateorcountry", "zipcode")]


def relationship_roles(submission: DataFrame, othermanager: DataFrame, othermanager2: DataFrame) -> DataFrame:
    """(CIK, filing, role) for filing managers and the two kinds of other managers."""

    def role(df: DataFrame, name: str) -> DataFrame:
        return df.select(v.cik10("cik").alias("cik"), "accession_number", F.lit(name).alias("relationship_type"))

    return (
        role(submission, "FILING_MANAGER")
        .unionByName(role(with_cik(othermanager), "OTHER_MANAGER"))
        .unionByName(role(with_cik(othermanager2), "INCLUDED_OTHER_MANAGER"))
    )


def with_cik(df: DataFrame) -> DataFrame:
    return df.filter(v.blank_to_null("cik").isNotNull())


def latest_filer(submission: DataFrame, coverpage: DataFrame) -> DataFrame:
    """Cover page of the newest filing of every filer, with its number of filings.

    The count is a separate aggregate so that the newest-row step can drop rows
    before the exchange.
    """
    cover = coverpage.select("accession_number", "filingmanager_name", *ADDRESS, *REGISTRATION)
    filed = submission.select(
        v.cik10("cik").alias("cik"), "accession_number", "filing_date", "periodofreport"
    ).join(cover, "accession_number")
    newest = latest_per_key(filed, ["cik"], [F.col("accession_number").desc()])
    counts = filed.groupBy("cik").agg(F.count("*").alias("submission_count"))
    return newest.join(counts, "cik")


def latest_other_manager(othermanager: DataFrame, othermanager2: DataFrame) -> DataFrame:
    """Newest mention of every other manager over both lists, with its number of mentions."""

    def mentions(df: DataFrame, priority: int, key: str) -> DataFrame:
        return with_cik(df).select(
            v.cik10("cik").alias("cik"), "name", *REGISTRATION, "accession_number",
            F.lit(priority).alias("source_priority"), F.col(key).cast("bigint").alias("source_key"),
        )

    both = mentions(othermanager, 1, "othermanager_sk").unionByName(mentions(othermanager2, 2, "sequencenumber"))
    # Included managers may repeat under one number; the name settles what is left.
    order = [
        F.col("accession_number").desc(), F.col("source_priority"), F.col("source_key").desc(), F.col("name"),
        *[F.col(c) for c in REGISTRATION],
    ]
    newest = latest_per_key(both, ["cik"], order).drop("source_priority", "source_key")
    counts = both.groupBy("cik").agg(F.count("*").alias("mention_count"))
    return newest.join(counts, "cik")


def ticker_lists(listings: DataFrame) -> DataFrame:
    """Company name of the first listing, distinct tickers and all exchanges in source order.

    The exchange list is not deduplicated, so the two lists may differ in length; the
    listing table itself is the safe pairing.  Lists are as long as one company's
    listings, which the result has to hold anyway.
    """
    rows = listings.select(v.cik10("cik").alias("cik"), "name", "ticker", "exchange", "pos")
    per_ticker = rows.groupBy("cik", "ticker").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("name", "pos").alias("name"),
        F.collect_list(F.struct("pos", F.coalesce("exchange", F.lit("")).alias("exchange"))).alias("exchanges"),
    )

    def joined(entries, field: str):
        return F.array_join(F.transform(F.array_sort(entries), lambda e: e[field]), ", ")

    return per_ticker.groupBy("cik").agg(
        F.min_by("name", "first_pos").alias("sec_company_name"),
        joined(F.collect_list(F.struct("first_pos", "ticker")), "ticker").alias("ticker"),
        joined(F.flatten(F.collect_list("exchanges")), "exchange").alias("exchange"),
    )


def manager_dimension(
    submission: DataFrame, coverpage: DataFrame, othermanager: DataFrame, othermanager2: DataFrame,
    listings: DataFrame,
) -> DataFrame:
    """One row per CIK seen anywhere.

    The newest cover page wins; other-manager mentions only fill gaps; the name falls
    back to the listed company.  All inputs are reduced to one row per CIK before the
    full outer joins on it.
    """
    filer = latest_filer(submission, coverpage).select(
        "cik", F.col("filingmanager_name").alias("f_name"), *ADDRESS, *[F.col(c).alias(f"f_{c}") for c in REGISTRATION],
        F.col("accession_number").alias("f_accession"), "filing_date", "periodofreport", "submission_count",
    )
    other = latest_other_manager(othermanager, othermanager2).select(
        "cik", F.col("name").alias("o_name"), *[F.col(c).alias(f"o_{c}") for c in REGISTRATION],
        F.col("accession_number").alias("o_accession"), "mention_count",
    )
    submitters = submission.filter(v.blank_to_null("cik").isNotNull()).select(v.cik10("cik").alias("cik")).distinct()
    everyone = (
        submitters.join(filer, "cik", "full_outer")
        .join(other, "cik", "full_outer")
        .join(ticker_lists(listings), "cik", "full_outer")
    )
    zero = F.lit(0).cast("bigint")
    return everyone.select(
        "cik",
        "sec_company_name",
        F.coalesce("f_name", "o_name", "sec_company_name").alias("manager_name"),
        "ticker",
        "exchange",
        *ADDRESS,
        *[F.coalesce(f"f_{c}", f"o_{c}").alias(c) for c in REGISTRATION],
        F.greatest("f_accession", "o_accession").alias("latest_related_accession_number"),
        F.col("filing_date").alias("latest_filing_date"),
        F.col("periodofreport").alias("latest_period_of_report"),
        F.coalesce("submission_count", zero).alias("submission_count"),
        F.coalesce("mention_count", zero).alias("other_manager_mention_count"),
    )


def listing_dimension(listings: DataFrame, sic: DataFrame | None = None, as_of_date: str | None = None) -> DataFrame:
    """One row per (CIK, ticker, exchange) with the industry of the company on each."""
    first = latest_per_key(
        listings.withColumn("cik", v.cik10("cik")),
        ["cik", "ticker", "exchange"],
        [F.col("pos").asc()],
    )
    rows = first.select("cik", F.col("name").alias("sec_company_name"), "ticker", "exchange")
    return refresh_sic(rows, sic, as_of_date)


def refresh_sic(listing_rows: DataFrame, sic: DataFrame | None, as_of_date: str | None = None) -> DataFrame:
    """Replace the industry attributes of listing rows; companies missing in ``sic`` end up without."""
    industry = ["sic", "sic_description", "sic_major_group_division", "sic_as_of_date", "sic_source"]
    rows = listing_rows.drop(*industry)
    if sic is None:
        return rows.withColumns({c: F.lit(None).cast("string") for c in industry})
    known = sic.select(
        v.cik10("cik").alias("cik"),
        v.blank_to_null("sic").alias("sic"),
        v.blank_to_null("sicdescription").alias("sic_description"),
        v.sic_division("sic").alias("sic_major_group_division"),
        F.lit(as_of_date).cast("string").alias("sic_as_of_date"),
        F.lit(SIC_SOURCE).alias("sic_source"),
    )
    return rows.join(known, "cik", "left")
