"""Company listings and industry codes from JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.schemas import SIC_SOURCE

LISTING_FIELDS = ("cik", "name", "ticker", "exchange")


def read_listings(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(cik, name, ticker, exchange, pos) from ``{"fields": [...], "data": [[...], ...]}`` documents.

    Other field names or a row of another shape fail the job.  The published snapshot is
    one document of some ten thousand rows; several documents, or one per line, work too.
    """
    documents = spark.read.schema("fields array<string>, data array<array<string>>").option(
        "multiLine", not one_per_line
    ).option("mode", "FAILFAST").json(path)
    expected = F.array(*[F.lit(x) for x in LISTING_FIELDS])
    rows = documents.withColumn(
        "data",
        F.when(F.col("fields").eqNullSafe(expected) & F.col("data").isNotNull(), F.col("data")).otherwise(
            F.raise_error(F.lit("unexpected listing fields"))
        ),
    ).select(F.posexplode("data").alias("pos", "row"))

    def item(i: int) -> Column:
        return F.get("row", F.lit(i))

    valid = (
        (F.size("row") == 4)
        & v.cik10(item(0)).isNotNull()
        & v.blank_to_null(item(1)).isNotNull()
        & v.blank_to_null(item(2)).isNotNull()
        & (item(3).isNull() | (item(3) != ""))
    )
    complaint = F.concat(F.lit("invalid listing row "), F.to_json("row"))
    checked = rows.withColumn(
        "row", F.when(F.coalesce(valid, F.lit(False)), F.col("row")).otherwise(F.raise_error(complaint))
    )
    return checked.select(
        v.cik10(item(0)).alias("cik"), item(1).alias("name"), item(2).alias("ticker"), item(3).alias("exchange"),
        F.col("pos").cast("bigint").alias("pos"),
    )


def read_sic(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(cik, sic, sicdescription, as_of_date) from ``{"as_of_date": ..., "data": {cik: {...}}}`` documents."""
    schema = "as_of_date string, data map<string, struct<sic: string, sicDescription: string>>"
    documents = spark.read.schema(schema).option("multiLine", not one_per_line).json(path)
    return documents.select("as_of_date", F.explode("data").alias("cik", "entry")).select(
        "cik",
        v.blank_to_null("entry.sic").alias("sic"),
        v.blank_to_null("entry.sicDescription").alias("sicdescription"),
        "as_of_date",
    )


def extract_sic(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Industry of each wanted CIK from a folder of per-company documents (``CIK##########`` in the path).

    Companies without a document keep a row with NULLs.
    """
    documents = (
        spark.read.schema("sic string, sicDescription string")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    cik = F.regexp_extract(F.col("_metadata.file_path"), r"CIK(\d{10})", 1)
    found = documents.select(
        cik.alias("cik"), v.blank_to_null("sic").alias("sic"), v.blank_to_null("sicDescription").alias("sicdescription")
    )
    keys = wanted.select(v.cik10("cik").alias("cik")).distinct()
    return keys.join(found, "cik", "left")


def write_companies(documents: DataFrame, path: str) -> None:
    """One document per company, in the folder ``company=...``.

    The work lies in the files, not in their few bytes, by which AQE would merge the tasks into one or two; a given
    number of partitions it leaves alone.  Tasks move their own files into place, else the driver does it one by one.
    """
    spark = documents.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = documents.repartition(tasks, "company").write.partitionBy("company")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


def write_sic_snapshot(sic: DataFrame, path: str, as_of_date: str) -> None:
    """One single-company document per line, so that writing and reading stay parallel."""
    entry = F.struct("sic", F.col("sicdescription").alias("sicDescription"))
    document = F.struct(
        F.lit(SIC_SOURCE).alias("source"), F.lit(as_of_date).alias("as_of_date"),
        F.create_map(v.cik10("cik"), entry).alias("data"),
    )
    sic.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_listings(listings: DataFrame, path: str) -> None:
    """One document per company and line, rows in listing order."""
    row = F.array(F.col("cik").cast("string"), "name", "ticker", "exchange")
    per_company = listings.groupBy("cik").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]).alias("data")
    )
    fields = F.array(*[F.lit(x) for x in LISTING_FIELDS]).alias("fields")
    per_company.select(F.to_json(F.struct(fields, "data")).alias("value")).write.text(path)
