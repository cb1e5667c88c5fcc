"""Incremental ingest: append unseen filings, re-resolve only the groups they touch.

The file source remembers which files it has seen; ``foreachBatch`` may still run a
batch twice, so each batch owns one partition and a replay rewrites exactly that.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast.operators.filings import holdings_filings, resolve_amendments
from holdfast.schemas import MANAGER_QUARTER, RAW_SCHEMAS
from holdfast.sources.filings_tsv import clean_columns, with_options
from holdfast.sources.store import append_batch, gathered, overwrite_partitions, write_table


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_batch(schema: T.StructType) -> T.StructType:
    """The stored form of a table: its columns, the delivery they came in, and the batch."""
    return T.StructType(
        [*schema.fields, T.StructField("dataset", T.StringType()), T.StructField("etl_batch_id", T.LongType())]
    )


LINEAGE = T.StructType([T.StructField("accession_number", T.StringType())])


def data_path(out: str) -> str:
    return f"{out}/data"


def lineage_path(out: str) -> str:
    return f"{out}/filings"


def repeated_filings(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(filing, dataset) pairs to leave out.

    A filing belongs to the data set that delivered it first; within a batch the lowest
    path wins.  A data set may spread one filing over several files and batches.
    """
    first = pairs.groupBy("accession_number").agg(F.min("dataset").alias("first_claim"))
    stored_owner = known.select("accession_number", F.col("dataset").alias("stored_owner"))
    owner = F.coalesce("stored_owner", "first_claim")
    claims = pairs.join(first, "accession_number").join(stored_owner, "accession_number", "left")
    return claims.filter(F.col("dataset") != owner).select("accession_number", "dataset")


def _append(rows: DataFrame, batch_id: int, out: str, schema: T.StructType) -> DataFrame:
    """Store the unseen rows of a batch and then its lineage; returns the stored batch.

    Looking up known filings reads the lineage table, one row per filing, never the lines.
    The batch is read twice: for its pairs, which are stored, and for its rows.  Pairs to leave out
    are stored as well, so that rows are exchanged only if these are too many for a broadcast.
    The folder of both belongs to one query and is reused by each batch.
    """
    spark, pair, staging = rows.sparkSession, ["accession_number", "dataset"], f"{out}-staging"
    known = stored(spark, lineage_path(out), with_batch(LINEAGE)).filter(F.col("etl_batch_id") != batch_id)
    known = known.groupBy("accession_number").agg(F.min("dataset").alias("dataset"))
    pairs = write_table(rows.select(*pair).distinct(), f"{staging}/pairs")
    repeated = write_table(repeated_filings(pairs, known), f"{staging}/repeated")
    kept = rows.join(repeated, pair, "left_anti")
    append_batch(kept.select(*schema.names, "dataset"), data_path(out), batch_id)
    written = stored(spark, data_path(out), with_batch(schema)).filter(F.col("etl_batch_id") == batch_id)
    append_batch(pairs.join(repeated, pair, "left_anti"), lineage_path(out), batch_id)
    return written


def _dataset():
    """Folder of the file a row came from; cut without a pattern, as this runs for every line."""
    path = F.col("_metadata.file_path")
    return path.substr(F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1).alias("dataset")


def stream_append(
    spark: SparkSession, in_dir: str, out: str, checkpoint: str, table: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Load every unseen file below ``in_dir`` (one folder per data set) into ``out``, then stop."""
    schema = RAW_SCHEMAS[table]
    reader = with_options(spark.readStream.schema(schema)).option("recursiveFileLookup", True).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.csv(in_dir).select("*", _dataset())

    def load(batch: DataFrame, batch_id: int) -> None:
        _append(batch.select("dataset", *clean_columns(table)), batch_id, out, schema)

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_reresolve(
    spark: SparkSession, in_dir: str, filings_out: str, components_out: str, checkpoint: str, schema: T.StructType,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Keep resolved components current while normalized filings arrive in any order.

    A batch names the (manager, quarter) groups it touches; only those are resolved
    again from all their filings.  The quarters they lie in are rewritten as untouched
    groups plus new groups.  Untouched ones go to a staging folder first, because a table must
    not be read and overwritten in one job.  Staging belongs to one query and is reused by each batch.
    """
    staging = f"{components_out}-staging"
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(in_dir).select("*", _dataset())

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        arrived = _append(batch, batch_id, filings_out, schema)
        touched = write_table(
            arrived.filter("quarter_id IS NOT NULL").select(*MANAGER_QUARTER).distinct(), f"{staging}/touched"
        )
        history = stored(session, data_path(filings_out), with_batch(schema))
        reopened = holdings_filings(history.join(touched, MANAGER_QUARTER, "left_semi"))
        fresh = resolve_amendments(reopened, path=f"{staging}/ordered")
        current = stored(session, components_out, fresh.schema)
        quarters = touched.select("quarter_id").distinct()
        kept = current.join(quarters, "quarter_id", "left_semi").join(touched, MANAGER_QUARTER, "left_anti")
        untouched = write_table(kept, f"{staging}/untouched")
        overwrite_partitions(gathered(fresh.unionByName(untouched), "quarter_id"), components_out, "quarter_id")

    return (
        rows.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
