"""Table maintenance without a MERGE statement: every operator returns the new table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources.store import store_once


def insert_new_keys(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus incoming rows whose key is new; repeated incoming keys count once."""
    fresh = incoming.dropDuplicates(keys).join(existing, keys, "left_anti")
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values replace existing ones key by key, unmatched rows of both sides stay.

    Unlike ``coalesce`` of both sides, an incoming NULL does overwrite.
    """
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    row = F.coalesce("_new", "_old")
    return old.join(new, keys, "full_outer").select(*keys, *[row[c].alias(c) for c in values])


def prune_absent(existing: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose key is not in the new stage."""
    return existing.join(stage, keys, "left_semi")


def soft_deactivate(existing: DataFrame, stage: DataFrame, keys: list[str], flag: str = "is_active") -> DataFrame:
    """Keep every key ever seen; ``flag`` is 1 for those in the new stage, whose values win."""
    values = [c for c in existing.columns if c not in keys and c != flag]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = stage.select(*keys, F.struct(*(values or [F.lit(1)])).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    row = F.coalesce("_new", "_old") if values else None
    return joined.select(
        *keys, *[row[c].alias(c) for c in values], F.when(F.col("_new").isNotNull(), 1).otherwise(0).alias(flag)
    )


def fill_gaps(existing: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Take ``columns`` from the other table where they are NULL."""
    extra = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = existing.join(extra, keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def surrogate_key(*keys: str | Column) -> Column:
    """Id from the natural key: stable over reloads and needs no global numbering."""
    return F.xxhash64(*keys)


def number_new_keys(existing: DataFrame, incoming: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """(keys, id) of all known keys: stored ids stay, new keys follow the largest one, gapless and in key order.

    Nothing is hashed, so no two keys can share an id, and the ids do not depend on how tasks divide the rows.  New keys are
    sorted in ranges, which are stored with each row's place in its range, and a range starts behind the rows of those before
    it: one small row holds the counts of all ranges.  NULL is a key value like any other; repeated incoming keys count once.
    """
    known = existing.select(*[F.col(k).alias(f"_{k}") for k in keys])
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    fresh = incoming.select(*keys).distinct().join(known, met, "left_anti")
    ranges = fresh.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = store_once(ranges.withColumn("_at", F.monotonically_increasing_id()))  # the range above bit 33, the place below
    placed = rows.select(*keys, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place"))

    highest = existing.agg(F.max(id_column)).first()[0] or 0
    entry = F.struct("_range", F.col("n"))
    counts = placed.groupBy("_range").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(entry)).alias("counts"))
    counted = counts.select(F.col("counts"), F.posexplode("counts").alias("pos", "of"))
    before = F.aggregate(F.slice("counts", F.lit(1), F.col("pos")), F.lit(highest).cast("bigint"), lambda a, c: a + c["n"])
    starts = counted.select(F.col("of._range").alias("_range"), before.alias("_start"))
    numbered = placed.join(starts, "_range").select(*keys, (F.col("_start") + F.col("_place") + 1).alias(id_column))
    return existing.select(*keys, F.col(id_column).cast("bigint").alias(id_column)).unionByName(numbered)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: extra ones go, missing ones become NULL."""
    have = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(x.name) if x.name.lower() in have else F.lit(None)).cast(x.dataType).alias(x.name)
            for x in schema.fields
        ]
    )


def add_columns(df: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two table versions of which one has columns the other lacks."""
    return df.unionByName(other, allowMissingColumns=True)
