"""Operator 9: token ids in training order, as binary shards of fixed stride.

Documents become ids with a separator after each, packed into sequences of ``length`` ids (the last one of a task is
filled up with separators).  Sequence ``g`` of ``n`` gets the slot that a keyed Feistel network assigns to it: a permutation of
a power of four, walked until it falls below ``n``.  So the order of the sequences is fixed by the key, needs no sort keys or tables,
and can be inverted; which documents a sequence holds depends on how the tasks divide the table.  Slots are range-partitioned by shard, and each shard is a file of slots in order, two bytes per id:
slot ``s`` starts at byte ``(s % per_shard) * 2 * length`` of file ``s // per_shard``, so reading can resume anywhere.

Null and empty texts are a separator only.  Texts of any length are cut over as many sequences as they need.  Repeated rows are
written as often as they occur.  An empty table gives no file and no row.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import common, files
from holdfast.session import new_folder

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The free id of the vocabulary.
SEPARATOR = 50256
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 4096, 20240229, 6
#: Rounds in which shards are written, so that only a part of all sequences is shuffled, and lies on the disks twice, at a time.
WAVES = 3


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (common.mixed(right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) & mask)
    return (left << shift) | right


def _keys(key: int) -> list[int]:
    return [int(common.mixed(np.array([key + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r))[0]) for r in range(ROUNDS)]


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequences: a permutation of ``0 .. n - 1``."""
    half, keys = _half_bits(n), _keys(key)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = _rounds(out[walking], half, keys)
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def sequence_at(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The sequence of a slot: the inverse of ``slots``."""
    half, keys = _half_bits(n), _keys(key)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = slot.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in reversed(keys):
            left, right = right ^ (common.mixed(left * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) & mask), left
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


_DOCS = "array<struct<doc_id: bigint, from: bigint, at: int, n: int>>"
_DOCS_PA = pa.list_(pa.struct([("doc_id", pa.int64()), ("from", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))


def packed(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY) -> DataFrame:
    """Stored sequences (part, idx, ids, docs), ``ids`` deflated; ``docs`` tells which ids of which documents a sequence has."""

    def run(batches):
        codec, held, docs_of, fill = encoding(path), [], [], 0
        out_ids, out_docs = [], []

        def flush(ids: np.ndarray) -> None:
            nonlocal held, docs_of, fill
            out_ids.append(zlib.compress(ids.astype("<u2").tobytes(), 1))
            out_docs.append(docs_of)
            held, docs_of, fill = [], [], 0

        def rows():
            nonlocal out_ids, out_docs
            batch = pa.RecordBatch.from_arrays([pa.array(out_ids, pa.binary()), pa.array(out_docs, _DOCS_PA)], names=["ids", "docs"])
            out_ids, out_docs = [], []
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*(codec.encode_ordinary(text) if text else ()), SEPARATOR], np.uint16)
                done = 0
                while done < len(ids):
                    take = min(length - fill, len(ids) - done)
                    docs_of.append({"doc_id": doc_id, "from": done, "at": fill, "n": take})
                    held.append(ids[done : done + take])
                    fill, done = fill + take, done + take
                    if fill == length:
                        flush(np.concatenate(held))
                    if len(out_ids) >= 4096:
                        yield rows()
            if out_ids:
                yield rows()
        if fill:
            flush(np.concatenate([*held, np.full(length - fill, SEPARATOR, np.uint16)]))
            yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.numbered(rows.mapInArrow(run, f"ids binary, docs {_DOCS}"), "sequences")


def materialise(
    docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str = VOCABULARY
) -> DataFrame:
    """Write the shards; returns the stored index (slot, shard, offset, crc32, docs, uri) with a row for each sequence."""
    spark = common.prepared(docs.sparkSession)
    folder = folder or new_folder(spark, "shards")
    rows = packed(docs, length, path)
    counts = sorted(tuple(r) for r in rows.groupBy("part").count().collect())  # one row for each task of the packing
    total, starts = 0, np.zeros(max((part for part, _ in counts), default=0) + 1, np.int64)  # eight bytes for each of these tasks
    for part, n in counts:
        starts[part] = total
        total += n

    def placed(part: pd.Series, idx: pd.Series) -> pd.Series:
        return pd.Series(slots(starts[part.to_numpy()] + idx.to_numpy(), total, key))

    sequences = rows
    # Only the numbers travel to the workers, and no sequence is shuffled before its shard is written.
    rows = rows.select(F.pandas_udf(placed, "long")("part", "idx").alias("slot"), "ids", "docs")
    rows = rows.withColumn("shard", (F.col("slot") / per_shard).cast("long"))

    def write(batches):
        shard, out, uri = None, None, None
        for batch in batches:
            offsets, crcs, uris = [], [], []
            for s, slot, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "ids")), strict=True):
                if s != shard:
                    if out is not None:
                        out.close()
                    shard, uri = s, files.fresh(folder, f"shard-{s:08d}", ".bin")
                    out = files.writer(uri)
                ids = zlib.decompress(ids)
                out.write(ids)
                offsets.append((slot - s * per_shard) * 2 * length)
                crcs.append(zlib.crc32(ids))
                uris.append(uri)
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"), pa.array(offsets, pa.int64()), pa.array(crcs, pa.int64()), batch.column("docs"),
                 pa.array(uris, pa.string())], names=["slot", "shard", "offset", "crc32", "docs", "uri"])
        if out is not None:
            out.close()

    shards, index = -(-total // per_shard), None
    for wave in range(min(WAVES, max(shards, 1))):
        some = rows.where((F.col("shard") >= wave * shards // WAVES) & (F.col("shard") < (wave + 1) * shards // WAVES))
        if shards < WAVES:
            some = rows.where(F.col("shard") == wave)
        dealt = some.repartitionByRange("shard").sortWithinPartitions("slot").select("slot", "shard", "ids", "docs")
        written = common.stored(dealt.mapInArrow(write, f"slot long, shard long, offset long, crc32 long, docs {_DOCS}, uri string"), "index")
        index = written if index is None else index.unionAll(written)
    common.dropped(sequences)
    return index


def read(spark: SparkSession, index: DataFrame, first: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, ids) from slot ``first`` on; each file is read by one task, in order, a piece at a time."""
    stride = 2 * length

    def run(batches):
        for batch in batches:
            for uri, shard, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = max(first - shard * per_shard, 0)
                with files.reader(uri) as f:
                    f.seek(begin * stride)
                    while begin < n:
                        take = min(512, n - begin)
                        data = f.read(take * stride)
                        if len(data) != take * stride:
                            raise ValueError(f"{uri} ends early")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(range(shard * per_shard + begin, shard * per_shard + begin + take), pa.int64()),
                             pa.array([data[i * stride : (i + 1) * stride] for i in range(take)], pa.binary())], names=["slot", "ids"])
                        begin += take

    shards = index.groupBy("uri", "shard").agg(F.count("*").alias("n")).where((F.col("shard") + 1) * per_shard > first)
    return common.spread(spark, shards).mapInArrow(run, "slot long, ids binary")


def ordered(docs: DataFrame) -> DataFrame:
    """Index of all sequences with the checksum of what the shards really hold, as read back."""
    index = materialise(docs)
    back = read(docs.sparkSession, index).select("slot", F.crc32("ids").alias("crc32_read"))
    return index.drop("uri").join(back, "slot", "left")
