"""Tab-separated filing tables: UTF-8 with or without BOM, quoted fields, strict header and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import values as v
from holdfast.schemas import KEEP_BLANK, RAW_SCHEMAS, RAW_TABLES, TEXT

CORRUPT = "_corrupt_record"


def read_filing_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of one or many data sets (``path`` may be a glob).

    A header that differs from the schema or a bad number fails the job.  Files stay
    splittable, so a line break inside a field shows up as a malformed line.
    """
    rows = _reader(spark, RAW_SCHEMAS[table]).option("mode", "FAILFAST").csv(path)
    return blanks_to_null(rows, table)


def read_filing_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """All seven tables of an extracted data set; a missing file raises."""
    return {t: read_filing_table(spark, f"{directory}/{t.upper()}.tsv", t) for t in RAW_TABLES}


def malformed_lines(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Lines that do not fit the schema, for the audit report."""
    schema = T.StructType([*RAW_SCHEMAS[table].fields, T.StructField(CORRUPT, TEXT)])
    reader = _reader(spark, schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    lines = reader.option("enforceSchema", True).csv(path)
    # Fields that no one asks for are not converted, so the filter has to look at all of them.
    fields = F.to_json(F.struct(*RAW_SCHEMAS[table].names))
    return lines.filter(F.col(CORRUPT).isNotNull() & (F.length(fields) > 0)).select("accession_number", CORRUPT)


def _reader(spark: SparkSession, schema: T.StructType):
    return with_options(spark.read.schema(schema))


def with_options(reader):
    """Options of filing tables for batch and stream readers: the header has to equal the schema, in order."""
    return (
        reader
        .option("sep", "\t")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("encoding", "UTF-8")
    )


def clean_columns(table: str) -> list[Column]:
    """Blank text means missing, except where the schema keeps a blank as filed."""
    keep = KEEP_BLANK.get(table, set())
    columns = []
    for field in RAW_SCHEMAS[table].fields:
        if field.name in keep:
            columns.append(F.coalesce(field.name, F.lit("")).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            columns.append(v.blank_to_null(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return columns


def blanks_to_null(df: DataFrame, table: str) -> DataFrame:
    return df.select(*clean_columns(table))


def write_filing_table(df: DataFrame, path: str, table: str) -> None:
    """The published form of a table (upper-case header), as a directory of part files."""
    header = [F.col(f.name).alias(f.name.upper()) for f in RAW_SCHEMAS[table].fields]
    (
        df.select(*header).write.mode("errorifexists")
        .option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("nullValue", "")
        .csv(path)
    )
