"""Helpers shared by the operators: stored tables, Arrow columns, hashed words, gapless numbering."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.session import new_folder

#: Separators of ``[^\x20\x09-\x0D]+``: ASCII white space only, whatever Unicode calls a space.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows and bytes per Arrow batch, so that a batch of very long texts still fits in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that every operator with Python workers relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished plans now: it does so when the driver's unreachable objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows that each name a file to be read, dealt out one by one: a count of partitions that is given is never merged."""
    return files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extend(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def by_batch(columns: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str], drop: tuple[str, ...] = ()):
    """A ``mapInArrow`` function that appends the columns computed for each batch and drops others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            more = columns(batch)
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in drop]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + more, names=[n for n, _ in kept] + names)

    return run


class Memo(dict):
    """A bounded memo: when it is full the older half is forgotten, so a worker's memory stays flat."""

    def __init__(self, function: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest, self.older = function, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    first = np.empty(len(values), bool)
    first[0] = True
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = acc * _M1 + words[j : j + n]
    return mixed(acc)


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions kept by winnowing: the rightmost smallest hash of every ``w`` consecutive ones.

    With fewer than ``w`` hashes they form one window.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    best, at = hashes[: n - w + 1].copy(), np.arange(n - w + 1)
    for j in range(1, w):
        other = hashes[j : j + n - w + 1]
        less = other <= best
        best[less] = other[less]
        at[less] += j - (at[less] - np.flatnonzero(less))
    return distinct(at)


#: Longest stretch of text that is hashed at once, and longest word that the fast hash is trusted with.
_STRETCH, _LONG_WORD = 1 << 18, 256
_BASE = 0xD1342543DE82EF95
_powers = np.cumprod(np.r_[np.uint64(1), np.full(_STRETCH, _BASE, np.uint64)])
_inverse = np.cumprod(np.r_[np.uint64(1), np.full(_STRETCH, pow(_BASE, -1, 1 << 64), np.uint64)])


class WordClass:
    """Words of a UTF-8 text as 64-bit hashes, A-Z taken as a-z; words are runs of the bytes that ``is_word`` names.

    The hash of a word is a difference of running sums of byte values times powers, so a text costs a few array operations.
    """

    def __init__(self, is_word: Callable[[int], bool]):
        self.word = bytes(is_word(b) for b in range(256))
        values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.values = values

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of all words."""
        inside = np.frombuffer(data.translate(self.word), np.uint8)
        change = np.empty(len(inside) + 1, bool)
        change[0], change[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
        edges = np.flatnonzero(change)
        return edges[::2], edges[1::2]

    def hashes(self, data: bytes | None) -> np.ndarray:
        if not data:
            return np.empty(0, np.uint64)
        starts, ends = self.spans(data)
        out = np.empty(len(starts), np.uint64)
        text, first = np.frombuffer(data, np.uint8), 0
        while first < len(starts):
            at = starts[first]
            last = max(int(np.searchsorted(ends, at + _STRETCH, "right")), first + 1)
            if ends[last - 1] - at > _STRETCH:  # one word, hashed below
                out[first] = 0
            else:
                part = text[at : ends[last - 1]]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(self.values[part] * _powers[: len(part)], out=sums[1:])
                s, e = starts[first:last] - at, ends[first:last] - at
                out[first:last] = (sums[e] - sums[s]) * _inverse[s]
            first = last
        sizes = ends - starts
        out = mixed(out + sizes.astype(np.uint64) * _M1)
        for i in np.flatnonzero(sizes > _LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].lower())
        return out


#: Words ``[^\x20\x09-\x0D]+``, and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text; both split at ASCII bytes only.
SPACED = WordClass(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = WordClass(lambda b: b >= 0x80 or chr(b).isalnum())


def numbered(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` with ``part`` (its task) and ``idx`` (gapless inside the part), in the order that ``df`` has.

    Both are written with the rows, so they never change afterwards, also if executors are lost.
    """
    ids = df.withColumn("_id", F.monotonically_increasing_id())  # the task above bit 33, its rows below
    return stored(ids.select(*df.columns, F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("idx")), label)


def salt() -> Column:
    """A number that tells rows with equal keys apart, the same again when a task is repeated."""
    return F.xxhash64(F.monotonically_increasing_id())
