"""Operator 8: benchmark decontamination by winnowed word n-grams.

Both sides keep the smallest hash of every ``WINDOW - K + 1`` consecutive K-grams, so two texts that share ``WINDOW`` words in
a row share a kept hash inside them: no window is missed.  Kept hashes of documents are tested against a Bloom filter
of fixed size; the few that pass carry the hashed words around them and are joined with those of the items, where a hit is
extended to the left and right as far as the words agree.  An item of fewer words than a window is one K-gram of its own
length, looked up at every position.

Words are compared by 64-bit hashes, so a false window needs thirteen equal hashes of different words in a row.
Only hits are shuffled, never texts.  Null and empty texts have no words and are clean.  Repeated documents are
judged each by itself; repeated items, also those of equal id, count once for each distinct id (a null id is counted,
but is no part of ``items_sha256``).  Empty tables give empty or clean results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import common

WINDOW, K = 13, 7
#: Bits of the Bloom filter of item hashes; a fuller filter lets more rows through to the join, which is exact.
BLOOM_BITS = 23

_LONG = T.LongType()
_LONGS = T.ArrayType(_LONG, False)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def fingerprints(words: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions; for a ``size`` below the window all grams of just that size."""
    if size < WINDOW:
        grams = common.gram_hashes(words, size)
        return grams ^ np.uint64(size), np.arange(len(grams))
    grams = common.gram_hashes(words, K)
    if len(words) < WINDOW:
        return grams[:0], np.empty(0, np.int64)
    at = common.winnowed(grams, WINDOW - K + 1)
    return grams[at], at


def _context(words: np.ndarray, at: int, size: int) -> tuple[int, int]:
    """Words that any window around the gram at ``at`` can have."""
    if size < WINDOW:
        return at, at + size
    return max(0, at + K - WINDOW), min(len(words), at + WINDOW)


_GRAM = T.StructType([T.StructField(n, t) for n, t in (
    ("fp", _LONG), ("size", T.IntegerType()), ("start", T.IntegerType()), ("at", T.IntegerType()), ("words", _LONGS))])
_GRAM_PA = pa.list_(pa.struct([
    ("fp", pa.int64()), ("size", pa.int32()), ("start", pa.int32()), ("at", pa.int32()), ("words", pa.list_(pa.int64()))]))


def _grams(words: np.ndarray, size: int, wanted=None) -> list[tuple]:
    hashes, at = fingerprints(words, size)
    if wanted is not None and len(hashes):
        keep = wanted(hashes)
        hashes, at = hashes[keep], at[keep]
    out, signed = [], _signed(words)
    for h, p in zip(_signed(hashes).tolist(), at.tolist(), strict=True):
        low, high = _context(words, p, size)
        out.append((h, size, low, p, signed[low:high].tolist()))
    return out


def _extended(batches):
    """Joined hits to the spans of the document that an item's windows cover."""
    for batch in batches:
        rid, item, span = [], [], []
        rows = batch.to_pydict()
        for k in range(batch.num_rows):
            a, b, size = rows["words"][k], rows["iwords"][k], rows["size"][k]
            i, j = rows["at"][k] - rows["start"][k], rows["iat"][k] - rows["istart"][k]
            length = size if size < WINDOW else K
            if a[i : i + length] != b[j : j + length]:
                continue
            left = right = 0
            if size >= WINDOW:
                while i > left and j > left and a[i - left - 1] == b[j - left - 1]:
                    left += 1
                while i + K + right < len(a) and j + K + right < len(b) and a[i + K + right] == b[j + K + right]:
                    right += 1
                if left + K + right < WINDOW:
                    continue
            rid.append(rows["rid"][k])
            item.append(rows["item_id"][k])
            start = rows["at"][k] - left
            span.append((start, start + left + length + right))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(item, pa.string()), pa.array([s[0] for s in span], pa.int32()),
             pa.array([s[1] for s in span], pa.int32())], names=["rid", "item_id", "first", "end"])


def item_grams(benchmark: DataFrame) -> DataFrame:
    """Kept hashes of all items, one row for each, with the words around."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for value in batch.column("text").to_pylist():
            words = common.ALNUM.hashes(value)
            out.append(_grams(words, min(WINDOW, len(words))) if len(words) else [])
        return [pa.array(out, _GRAM_PA)]

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("grams", T.ArrayType(_GRAM))])
    grams = rows.mapInArrow(common.by_batch(columns, ["grams"], ("text",)), schema)
    return grams.select("item_id", F.explode("grams").alias("g")).select(
        "item_id", F.col("g.fp").alias("fp"), F.col("g.size").alias("size"), F.col("g.start").alias("istart"),
        F.col("g.at").alias("iat"), F.col("g.words").alias("iwords"),
    )


def _bloom(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bit table of item hashes (at most 2**BLOOM_BITS / 64 numbers reach the driver), and the short item sizes."""
    bit = F.shiftrightunsigned("fp", 64 - BLOOM_BITS)
    cells = items.groupBy((bit / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("b")
    )
    bits = np.zeros((1 << BLOOM_BITS) // 64, np.uint64)
    for w, b in cells.collect():
        bits[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    sizes = [r[0] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect()]  # at most 12
    return bits, sorted(sizes)


def judged(docs: DataFrame, benchmark: DataFrame, keep_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored rows ``(rid, doc, n_words)`` of all documents, and the hits ``(rid, item_id, first, end)``.

    ``doc`` is the whole input row with ``keep_row``, else only ``doc_id``.
    """
    spark = common.prepared(docs.sparkSession)
    items = common.stored(item_grams(benchmark), "items")
    bits, short = _bloom(items)
    shared = spark.sparkContext.broadcast(bits)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        table = shared.value

        def wanted(hashes: np.ndarray) -> np.ndarray:
            bit = hashes >> np.uint64(64 - BLOOM_BITS)
            return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

        counts, grams = [], []
        for value in batch.column("data").to_pylist():
            words = common.ALNUM.hashes(value)
            counts.append(len(words))
            grams.append([g for size in [*short, WINDOW] for g in _grams(words, size, wanted)])
        return [pa.array(counts, pa.int64()), pa.array(grams, _GRAM_PA)]

    doc = F.struct(*(docs.columns if keep_row else ["doc_id"])).alias("doc")
    rows = docs.select(doc, F.col("text").cast("binary").alias("data"))
    schema = T.StructType([rows.schema["doc"], T.StructField("n_words", _LONG), T.StructField("grams", T.ArrayType(_GRAM))])
    found = rows.mapInArrow(common.by_batch(columns, ["n_words", "grams"], ("data",)), schema)
    found = common.stored(found.select(F.monotonically_increasing_id().alias("rid"), "*"), "judged")
    hits = (
        found.select("rid", F.explode("grams").alias("g"))
        .select("rid", F.col("g.fp").alias("fp"), F.col("g.size").alias("size"), "g.start", "g.at", "g.words")
        .join(items, ["fp", "size"])
    )
    schema = "rid long, item_id string, first int, end int"
    return found.drop("grams"), hits.mapInArrow(_extended, schema)


def verdicts(docs: DataFrame, benchmark: DataFrame, keep_row: bool = False) -> DataFrame:
    """``doc, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    found, hits = judged(docs, benchmark, keep_row)
    # Spans and items of one document: at most one span for each of its words and one row for each item.
    spans = hits.groupBy("rid").agg(
        F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["first"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    spans = spans.select("rid", covered.alias("n_hit"), (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"),
                         F.array_join("items", ",").alias("names"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.join(spans, "rid", "left").select(
        "doc", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return verdicts(docs, benchmark).select("doc.*", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return verdicts(docs, benchmark, keep_row=True).where("not contaminated").select("doc.*")
