"""Load driver: data sets into the raw tables, with stored lineage and recovery.

A data set is seven tables that are delivered together.  The raw tables are partitioned by batch, and one record decides
what counts: a batch is part of the tables only once its COMPLETED record is in the log.

1. fingerprint and count every delivered table (one pass over each, combined before the exchange);
2. decide: SKIP, APPEND, REGISTER_EXISTING or REJECT, from a few numbers per data set;
3. log the batches as RUNNING, with ids that a later run finds by their fingerprint;
4. write table by table, each batch into its own partition, replacing what an earlier attempt left there; each task writes
   what it has read, as the delivered files hold one data set each;
5. count what is stored, from the written files;
6. write lineage, and then one log file that completes or fails all batches of the run.

A run that dies anywhere before step 6 leaves partitions that no reader looks at.  The next run gives the same content the same id
and writes the same partitions again; unfinished batches that are not delivered again stay invisible.
One driver at a time may load into a folder.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators import lineage
from holdfast.schemas import RAW_SCHEMAS, RAW_TABLES
from holdfast.session import prepare
from holdfast.sources import filings_tsv
from holdfast.sources.store import gathered, overwrite_partitions, store_once

LOG = "seq long, etl_batch_id long, dataset string, sha256 string, dataset_quarter string, import_mode string, status string, error string, at timestamp"
COUNTS = "etl_batch_id long, table_name string, source_row_count long, stored_row_count long"
LINEAGE = "etl_batch_id long, accession_number string"
REPORT = "dataset string, etl_batch_id long, decision string, status string, error string, table_name string, source_row_count long, stored_row_count long"


def _read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def batches(spark: SparkSession, out: str) -> DataFrame:
    """The last record of every batch."""
    log = _read(spark, f"{out}/log", LOG)
    newest = F.max_by(F.struct(*[c for c in log.columns if c != "etl_batch_id"]), "seq").alias("r")
    return log.groupBy("etl_batch_id").agg(newest).select("etl_batch_id", "r.*").drop("seq")


def _completed(spark: SparkSession, out: str) -> list[int]:
    """Ids of completed batches: one for each data set ever loaded."""
    return [r[0] for r in batches(spark, out).filter("status = 'COMPLETED'").select("etl_batch_id").collect()]


def _stored(spark: SparkSession, out: str, table: str, ids: list[int]) -> DataFrame:
    schema = T.StructType([*RAW_SCHEMAS[table].fields, T.StructField("etl_batch_id", T.LongType())])
    return _read(spark, f"{out}/raw/{table}", schema).filter(F.col("etl_batch_id").isin(ids))


def raw_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The seven tables of all completed batches; other partitions are not read."""
    ids = _completed(spark, out)
    return {t: _stored(spark, out, t, ids) for t in RAW_TABLES}


def batch_counts(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, f"{out}/counts", COUNTS).filter(F.col("etl_batch_id").isin(_completed(spark, out)))


def batch_accessions(spark: SparkSession, out: str) -> DataFrame:
    """(batch, filing) pairs of completed batches; a filing that was registered again has several."""
    return _read(spark, f"{out}/lineage", LINEAGE).filter(F.col("etl_batch_id").isin(_completed(spark, out)))


def filing_batches(spark: SparkSession, out: str) -> DataFrame:
    """(filing, first batch), for ``etl_batch_id`` of normalized filings."""
    return batch_accessions(spark, out).groupBy("accession_number").agg(F.min("etl_batch_id").alias("etl_batch_id"))


def read_deliveries(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All data sets below ``root`` (``<data set>/<TABLE>.tsv``) as one frame per table, with their ``dataset``."""
    out = {}
    for t in RAW_TABLES:
        rows = filings_tsv.with_options(spark.read.schema(RAW_SCHEMAS[t])).option("mode", "FAILFAST").csv(f"{root}/*/{t.upper()}.tsv")
        dataset = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{t.upper()}\.tsv", 1).alias("dataset")
        out[t] = rows.select("*", dataset).select("dataset", *filings_tsv.clean_columns(t))
    return out


def pending(spark: SparkSession, deliveries: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Deliveries without data sets whose name is completed already, which are then not even read again."""
    done = [r.dataset for r in batches(spark, out).filter("status = 'COMPLETED'").select("dataset").collect()]
    return {t: df.filter(~F.col("dataset").isin(done)) for t, df in deliveries.items()}


def _decide(names: list[str], hashes: dict, twice: set, sets: list, known: list, next_id: int) -> dict[str, dict]:
    """One data set after the other, as later ones meet what earlier ones store.

    ``sets`` has (data sets that list a filing, whether it is stored, number of such filings).  Appended sets are
    disjoint, so a filing is stored if it was before or if an appended set lists it.
    """
    completed = {r.sha256: r.etl_batch_id for r in known if r.status == "COMPLETED"}
    begun = {r.sha256: r.etl_batch_id for r in known}
    appended: set[str] = set()
    out = {}
    for name in names:
        sha = hashes[name]
        listed = sum(n for of, _, n in sets if name in of)
        stored = sum(n for of, was, n in sets if name in of and (was or not appended.isdisjoint(of)))
        row = {"etl_batch_id": completed.get(sha, begun.get(sha)), "sha256": sha, "error": None}
        if name in twice:
            row |= {"decision": "REJECT", "error": "the data set lists a filing twice"}
        elif sha in completed:
            row["decision"] = "SKIP"
        elif stored == 0:
            row["decision"] = "APPEND"
            appended.add(name)
        elif stored == listed:
            row["decision"] = "REGISTER_EXISTING"
        else:
            row |= {"decision": "REJECT", "error": f"{stored} of {listed} filings are stored already"}
        if row["etl_batch_id"] is None:
            row["etl_batch_id"] = next_id
            next_id += 1
        if row["decision"] in ("APPEND", "REGISTER_EXISTING"):
            completed[sha] = row["etl_batch_id"]
        out[name] = row
    return out


def _of_sets(rows: DataFrame, ids: dict[str, int]) -> DataFrame:
    """Rows of the given data sets, with the batch of each.

    The driver holds the ids, a number for each data set, so they are sent to the rows: a join by data set would exchange
    whole tables into as many partitions as there are data sets.
    """
    known = rows.sparkSession.createDataFrame([*ids.items()], "dataset string, etl_batch_id long")
    return rows.filter(F.col("dataset").isin(*ids)).join(F.broadcast(known), "dataset")


def _log(spark: SparkSession, out: str, seq: int, rows: list[tuple]) -> None:
    """One file: records of a run appear together or not at all."""
    frame = spark.createDataFrame([(seq, *r, None) for r in rows], LOG).withColumn("at", F.current_timestamp())
    frame.coalesce(1).write.mode("append").parquet(f"{out}/log")


def load_datasets(
    spark: SparkSession, deliveries: dict[str, DataFrame], out: str, after: Callable[[str], None] = lambda step: None
) -> DataFrame:
    """Load what is new and report on every data set and table.

    ``deliveries`` has the seven tables with a ``dataset`` column.  The report compares delivered and stored rows; a set whose
    counts differ is FAILED.  Only numbers per data set reach the driver.  ``after`` is called with each finished step.
    """
    prepare(spark)
    deliveries = {t: deliveries[t].select("dataset", *RAW_SCHEMAS[t].names) for t in RAW_TABLES}
    parts = store_once(lineage.table_fingerprints(deliveries))
    hashes = {r.dataset: r.sha256 for r in lineage.batch_fingerprints(parts).collect()}
    names = sorted(hashes)
    known = batches(spark, out).collect()
    done = [r.etl_batch_id for r in known if r.status == "COMPLETED"]
    listed = deliveries["submission"].groupBy("dataset", "accession_number").agg(F.count("*").alias("times"))
    listed = store_once(listed)
    twice = {r.dataset for r in listed.filter("times > 1").select("dataset").distinct().collect()}
    before = batch_accessions(spark, out).select("accession_number").distinct().withColumn("was", F.lit(True))
    grouped = listed.groupBy("accession_number").agg(F.sort_array(F.collect_set("dataset")).alias("of"))
    sets = grouped.join(before, "accession_number", "left").groupBy("of", F.col("was").isNotNull().alias("was")).count()
    plan = _decide(
        names, hashes, twice, [tuple(r) for r in sets.collect()], known, max((r.etl_batch_id for r in known), default=0) + 1
    )
    seq = _read(spark, f"{out}/log", LOG).agg(F.coalesce(F.max("seq"), F.lit(0).cast("bigint"))).first()[0] + 1
    quarters = {
        r.dataset: r.q for r in spark.createDataFrame([(n,) for n in names] or [("",)], "dataset string").select("dataset", lineage.dataset_quarter("dataset").alias("q")).collect()
    }

    def records(status: Callable[[str], tuple[str, str | None]], of: list[str]) -> list[tuple]:
        return [
            (plan[n]["etl_batch_id"], n, plan[n]["sha256"], quarters[n], plan[n]["decision"] if plan[n]["decision"] != "REJECT" else None, *status(n))
            for n in of
        ]

    new = [n for n in names if plan[n]["decision"] != "SKIP"]
    if new:
        _log(spark, out, seq, records(lambda n: ("RUNNING", None), new))
    after("log")
    ids = spark.createDataFrame([(n, p["etl_batch_id"], p["decision"]) for n, p in plan.items()], "dataset string, etl_batch_id long, decision string")
    appended = {n: p["etl_batch_id"] for n, p in plan.items() if p["decision"] == "APPEND"}
    fresh = [*appended.values()]
    if fresh:
        def write(t: str) -> str:
            overwrite_partitions(_of_sets(deliveries[t], appended).drop("dataset"), f"{out}/raw/{t}", "etl_batch_id")
            return t

        with ThreadPoolExecutor(max_workers=len(RAW_TABLES)) as pool:  # tables do not depend on each other
            for t in pool.map(write, RAW_TABLES):
                after(t)
    judged = store_once(_of_sets(listed, {n: p["etl_batch_id"] for n, p in plan.items() if p["decision"] != "REJECT"}).select("dataset", "accession_number"))
    stored = {t: _stored(spark, out, t, [*done, *fresh]) for t in RAW_TABLES}
    counted = _counted(stored, judged)
    expected = parts.select("dataset", "table_name", "row_count")
    every = ids.withColumn("table_name", F.explode(F.array(*map(F.lit, RAW_TABLES))))
    zero = F.lit(0).cast("bigint")
    report = store_once(
        every.join(expected, ["dataset", "table_name"], "left").join(counted, ["dataset", "table_name"], "left").select(
            "dataset", "etl_batch_id", "decision", "table_name", F.coalesce("row_count", zero).alias("source_row_count"),
            F.when(F.col("decision") != "REJECT", F.coalesce("stored_row_count", zero)).alias("stored_row_count"),
        )
    )
    wrong = report.filter("source_row_count <> stored_row_count").groupBy("dataset").agg(F.sort_array(F.collect_list("table_name")).alias("t"))
    for r in wrong.collect():
        plan[r.dataset] |= {"error": f"stored and delivered rows differ in {', '.join(r.t)}", "decision": "REJECT"}
    good = [n for n in new if plan[n]["decision"] != "REJECT"]
    if good:
        kept = _of_sets(judged, {n: plan[n]["etl_batch_id"] for n in good})
        overwrite_partitions(gathered(kept.select("etl_batch_id", "accession_number"), "etl_batch_id"), f"{out}/lineage", "etl_batch_id")
        after("lineage")
        counts = report.filter(F.col("dataset").isin(good)).select("etl_batch_id", "table_name", "source_row_count", "stored_row_count")
        overwrite_partitions(gathered(counts, "etl_batch_id"), f"{out}/counts", "etl_batch_id")
        after("counts")

    def ended(name: str) -> tuple[str, str | None]:
        return ("FAILED" if plan[name]["decision"] == "REJECT" else "COMPLETED"), plan[name]["error"]

    if new:
        _log(spark, out, seq + 1, records(ended, new))
    after("end")
    final = spark.createDataFrame([(n, p["decision"], *ended(n)) for n, p in plan.items()], "dataset string, decision string, status string, error string")
    return report.drop("decision").join(final, "dataset").select(*[c.split()[0] for c in REPORT.split(", ")])


def _counted(stored: dict[str, DataFrame], judged: DataFrame) -> DataFrame:
    """Stored rows of each data set's filings; tables are counted per filing first, reading that column only."""
    joined = lineage.counts_per_filing(stored).join(judged, "accession_number")
    return lineage.counts_by(joined, "dataset", stored, "stored_row_count")
