"""Operator 10: n-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct shingles of ``N`` words (all its words if there are fewer).  Two documents link when
``100 * |A and B| >= PERCENT * |A or B|``.

1. Every task counts its documents' shingles into a sketch of fixed size; the sum orders shingles from rare to frequent.
   The order is the same everywhere, which is all that correctness needs; the counts only keep lists short.
2. Each document stores the rarest ``n - ceil(t n) + 1`` shingles of its set: two linked sets share one of them.  Equal
   word sequences are collapsed to one representative, so copies never meet each other.
3. Representatives meet on these shingles.  In each list all first meet only the list's smallest member and its centre, the
   member whose prefix is shared most: an edit brings shingles that nobody else has, so it is the text with the fewest edits.
   Length, positional and suffix filters drop pairs, each other pair is verified once, and links give components.
4. Lists whose members are not yet all in one component are met in full, but only across components and with one side
   outside of the list's main component.  No link between components is lost, and pairs inside a component are not made.
   Rows that are linked to a centre are met through it: by the triangle inequality they are all too far from what is far from it.

Documents without words have an empty set and link with nothing.  Null ids are allowed: a component's id is the smallest
id that is not null.  Repeated rows and ids are rows of their own and share a component.  Empty tables give empty results.
Shingles are 64-bit hashes; equal hashes of different shingles in one pair of documents,
less than one pair in ten million at a thousand words, may shift its count by one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import common

N, PERCENT = 5, 75
#: Counters of the sketch: 4 MB whatever the corpus.  Counts beyond its noise are told apart; see ``_order``.
SKETCH_BITS = 20
#: Bits of Bloom filters as powers of two: 16 bits for each hash, 2 MB at least and 32 MB at most (beyond 16 million hashes a fuller
#: filter lets more rows through to the joins behind it, which are exact).
BLOOM_BITS, BLOOM_MOST = 24, 28

#: Cells of the coarsest parity, as a power of two; every parity can be folded to these.
PARITY_BITS = 10

#: Hashes that one task of the search for shared hashes holds, about, and ranges of hashes that it is dealt out over.
HELD, RANGES = 4_000_000, 4096
_LONGS = T.ArrayType(T.LongType(), False)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of hashed words, sorted."""
    if not len(words):
        return np.empty(0, np.uint64)
    return common.distinct(common.gram_hashes(words, min(N, len(words))))


def identity(words: np.ndarray) -> bytes:
    """128 bits that tell word sequences apart."""
    return xxhash.xxh3_128_digest(words.tobytes())


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of shingles by the top bits of their hash, over all documents."""
    cells, strips = 1 << SKETCH_BITS, 64
    each = cells // strips

    def count(batches):
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total[_cell(shingles(common.SPACED.hashes(value)))] += np.uint32(1)  # a cell counts once for a document
        strip = [zlib.compress(total[i * each : (i + 1) * each].tobytes(), 1) for i in range(strips)]
        yield pa.RecordBatch.from_arrays([pa.array(range(strips), pa.int32()), pa.array(strip, pa.binary())], names=["strip", "counts"])

    def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(each, np.uint64)
        for batch in groups:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(c), np.uint32)
        data = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["strip", "counts"])

    parts = docs.select(F.col("text").cast("binary").alias("data")).mapInArrow(count, "strip int, counts binary")
    out = np.zeros(cells, np.uint32)
    for strip, counts in parts.groupBy("strip").applyInArrow(merge, "strip int, counts binary").collect():  # 64 strips
        out[strip * each : (strip + 1) * each] = np.frombuffer(counts, np.uint32)
    return out


def _order(counts: np.ndarray) -> np.ndarray:
    """A rank class for each cell: 0 where a count is within the noise of its many rare shingles, else log2 of the excess."""
    mean = counts.mean()
    excess = counts - mean - 4 * math.sqrt(mean + 1)
    return np.where(excess > 0, np.log2(np.maximum(excess, 0) + 1) * 4 + 1, 0).astype(np.uint8)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def ordered_prefix(sets: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set that any linked set must share one of."""
    by = np.lexsort((sets, order[_cell(sets)]))
    return sets[by[: prefix_length(len(sets))]]


def parity(sets: np.ndarray) -> bytes:
    """One bit for each of 1024 cells, or two to four times as many as shingles: whether an odd number of them fall there.

    Wherever two sets' bits differ, there is a shingle that only one of them has; so the bits bound how far the sets differ.
    """
    cells = 1 << max(PARITY_BITS, (2 * len(sets) - 1).bit_length())
    return np.packbits((np.bincount((sets & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(bool)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Cells in which two parities differ; the finer one is folded to the cells of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _overlap_needed(n: Column, m: Column) -> Column:
    """Smallest number of common shingles of linked sets of these sizes."""
    return F.floor((PERCENT * (n + m) + (99 + PERCENT)) / F.lit(100 + PERCENT))


def documents_table(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """Stored rows (rid, doc_id, uid, n, bits, prefix); ``prefix`` only at the first of equal texts in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        seen, levels = set(), shared.value
        for batch in batches:
            uid, n, bits, prefix = [], [], [], []
            for value in batch.column("data").to_pylist():
                words = common.SPACED.hashes(value)
                s = shingles(words)
                key = identity(words)
                uid.append(key)
                n.append(len(s))
                if not len(s) or key in seen:
                    bits.append(None)
                    prefix.append(None)
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                bits.append(parity(s))
                prefix.append(ordered_prefix(s, levels).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(uid, pa.binary()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "uid", "n", "bits", "prefix"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("uid", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("bits", T.BinaryType()), T.StructField("prefix", _LONGS)])
    out = rows.mapInArrow(run, schema)
    return common.stored(out.select(F.monotonically_increasing_id().alias("rid"), "*"), "sets")


def shared_postings(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Stored (rid, n, share, gram, at) of the representatives' prefix shingles that two rows or more have.

    ``share`` is about the part of the whole prefix that is shared, and ranks centres only.

    Most prefix shingles stand in one document only.  To leave them out, tasks send their distinct hashes, packed, to one task for
    each range of hashes, which knows those that came twice; a Bloom filter of these keeps the rest out of the join.  A task makes a
    packed row for each range, so beyond ``RANGES`` ranges the hashes are counted as rows of their own.
    """
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    ranges = 1 << max(5, math.ceil(math.log2(total / HELD + 1)))
    bits = ranges.bit_length() - 1

    def send(batches):
        held: list[np.ndarray] = []

        def flush():
            # Hashes of one task that came twice are sent twice, hashes that came more often not more.
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values = np.repeat(values, np.minimum(times, 2))
            cuts = np.searchsorted(values >> np.uint64(64 - bits), np.arange(ranges + 1))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(range(ranges), pa.int32()), pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["range", "grams"]
            )

        for batch in batches:
            held.extend(np.array(x, np.int64).view(np.uint64) for x in batch.column(0).to_pylist())
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    def twice(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, np.uint64) for g in groups for x in g.column("grams").to_pylist()]
        values, times = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values[times > 1].view(np.int64), pa.int64())], names=["gram"])

    prefixes = rows.where("prefix is not null").select("prefix")
    if ranges <= RANGES:
        grams = prefixes.mapInArrow(send, "range int, grams binary").groupBy("range").applyInArrow(twice, "gram long")
    else:
        grams = prefixes.select(F.explode("prefix").alias("gram")).groupBy("gram").count().where("count > 1").select("gram")
    grams = common.stored(grams, "shared")
    seen = spark.sparkContext.broadcast(_bloom(grams.select(F.col("gram").alias("h")), grams.count()))

    def keep(batches):
        for batch in batches:
            out, at, share = [], [], []
            for x in batch.column("prefix").to_pylist():
                h = np.array(x, np.int64)
                at.append(np.flatnonzero(_in_bloom(seen.value, h.view(np.uint64))).astype(np.int32))
                out.append(h[at[-1]])
                share.append(len(at[-1]) / len(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("n"), pa.array(share, pa.float32()), pa.array(out, pa.list_(pa.int64())),
                 pa.array(at, pa.list_(pa.int32()))], names=["rid", "n", "share", "gram", "at"],
            )

    some = rows.where("prefix is not null").select("rid", "n", "prefix")
    some = some.mapInArrow(keep, "rid long, n long, share float, gram array<long>, at array<int>")
    some = some.select("rid", "n", "share", F.inline(F.arrays_zip("gram", "at")))
    # Copies in other tasks are out from here on.
    out = common.stored(some.join(grams, "gram").join(reps.select("rid"), "rid", "left_semi"), "postings")
    common.dropped(grams)
    return out


def _bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """Bit table of the top bits of the hashes ``h``, at most ``n`` ones; words of the table that have bits reach the driver, in Arrow."""
    bits = min(max(BLOOM_BITS, (16 * n).bit_length()), BLOOM_MOST)
    bit = F.shiftrightunsigned("h", 64 - bits)
    cells = hashes.groupBy((bit / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("b")
    )
    out, found = np.zeros((1 << bits) // 64, np.uint64), cells.toArrow()
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def _in_bloom(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _top(uid: bytes) -> np.ndarray:
    return np.array([int.from_bytes(uid[:8], "big")], np.uint64)


def _uid_hash(uid: str = "uid") -> Column:
    """First eight bytes of a uid as a number."""
    return F.conv(F.hex(F.substring(F.col(uid), 1, 8)), 16, -10).cast("long")


def _possible(batches):
    for batch in batches:
        a, b, n, m = (batch.column(c).to_pylist() for c in ("p_a", "p_b", "n_a", "n_b"))
        keep = [differing(p, q) <= k + l - 2 * -(-PERCENT * (k + l) // (100 + PERCENT)) for p, q, k, l in zip(a, b, n, m, strict=True)]
        names = [c for c in batch.schema.names if c not in ("p_a", "p_b")]
        yield batch.select(names).filter(pa.array(keep, pa.bool_()))


def _filtered(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows that pass length and suffix filter, with the uids and sizes of both.

    The suffix filter drops pairs whose parities differ in more cells than linked sets can differ in shingles, before any set
    is looked at.
    """
    for side in "ab":
        pairs = pairs.join(rows.select(F.col("rid").alias(side), F.col("uid").alias(f"u_{side}"), F.col("n").alias(f"n_{side}"),
                                       F.col("bits").alias(f"p_{side}")), side)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return pairs.select("a", "b", "u_a", "u_b", "n_a", "n_b", "p_a", "p_b").mapInArrow(
        _possible, "a long, b long, u_a binary, u_b binary, n_a long, n_b long"
    )


def _sets(docs: DataFrame, uids: DataFrame, n: int) -> DataFrame:
    """(uid, set): packed sets of the texts whose uid a Bloom filter of the ``uids`` (``n`` at most) lets through, once in each task."""
    seen = docs.sparkSession.sparkContext.broadcast(_bloom(uids.select(_uid_hash().alias("h")), n))

    def run(batches):
        bits, done = seen.value, set()
        for batch in batches:
            uid, sets = [], []
            for value in batch.column(0).to_pylist():
                words = common.SPACED.hashes(value)
                key = identity(words)
                if len(words) and key not in done and _in_bloom(bits, _top(key))[0]:
                    if len(done) < 200_000:
                        done.add(key)
                    uid.append(key)
                    sets.append(shingles(words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(sets, pa.binary())], names=["uid", "set"])

    rows = docs.select(F.col("text").cast("binary").alias("data")).mapInArrow(run, "uid binary, set binary")
    return rows.groupBy("uid").agg(F.first("set").alias("set"))


def _similar(batches):
    for batch in batches:
        rows = {n: batch.column(n).to_pylist() for n in ("s_a", "s_b", "n_a", "n_b")}
        keep, apart = [], []
        for s_a, s_b, n, m in zip(*(rows[k] for k in ("s_a", "s_b", "n_a", "n_b")), strict=True):
            both = len(np.intersect1d(np.frombuffer(s_a, np.uint64), np.frombuffer(s_b, np.uint64), assume_unique=True))
            keep.append(100 * both >= PERCENT * (n + m - both))
            apart.append(n + m - 2 * both)
        columns = [batch.column("a"), batch.column("b"), pa.array(apart, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "apart"]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored (a, b, apart) of the filtered pairs whose whole sets are similar enough; each pair is verified once.

    ``apart`` is the number of shingles that only one of both has.

    Sets are computed again, from the texts that stand in a pair.  ``b`` may stand in very many pairs: its side of the join is one
    row, the other side is split like any skewed key.
    """
    pairs = common.stored(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs.select("a", "b", F.lit(0).cast("long").alias("apart"))
    hubs = common.stored(_sets(docs, pairs.select(F.col("u_b").alias("uid")).distinct(), n), "hubs")
    members = _sets(docs, pairs.select(F.col("u_a").alias("uid")).distinct(), n)
    left = pairs.join(members.select(F.col("uid").alias("u_a"), F.col("set").alias("s_a")), "u_a").drop("u_a")
    both = left.join(hubs.select(F.col("uid").alias("u_b"), F.col("set").alias("s_b")), "u_b").drop("u_b")
    links = common.stored(both.mapInArrow(_similar, "a long, b long, apart long"), "links")
    common.dropped(pairs, hubs)
    return links


def components(links: DataFrame) -> DataFrame:
    """(rid, comp): the smallest rid reachable from each linked one, by alternating large and small stars.

    Each round is two aggregates and joins; a star's centre with very many leaves is split like any skewed join key.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        # Each node u points its neighbours (the larger ones, or itself and the smaller ones) at its smallest neighbour.
        if larger:
            near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = near.join(low, "a")
        if larger:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    edges, before = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    last = None
    while True:
        edges = common.stored(star(star(edges, True), False), "star")
        if last is not None:
            common.dropped(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, last = now, edges
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    found = low.select(F.col("a").alias("rid"), F.col("m").alias("comp"))
    return found.union(low.select("m", "m").distinct())


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents as stored rows (rid, doc_id, uid, n, ...) and (uid, comp) of the representatives that have links."""
    common.prepared(docs.sparkSession)
    rows = documents_table(docs, _order(sketch(docs)))
    reps = common.stored(rows.where("prefix is not null").groupBy("uid").agg(F.min("rid").alias("rid")), "reps")
    postings = shared_postings(rows, reps)
    lists = postings.groupBy("gram").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.max(F.struct("share", "rid"))["rid"].alias("centre"))
    lists = lists.where("low <> high").select("gram", F.array("low", "centre").alias("hubs"))
    star = postings.join(lists, "gram").select("rid", F.explode(F.array_distinct("hubs")).alias("hub")).where("rid <> hub")
    # Of the hubs that a row meets the one that it shares most with; whatever that misses is found across components.
    star = star.groupBy("rid", "hub").count().groupBy("rid").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    star = common.stored(star.select(F.col("rid").alias("a"), F.col("hub").alias("b")), "stars")
    links = _verified(docs, _filtered(star, rows))
    found = common.stored(components(links), "found")
    # What the star has judged is not judged again.
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _across(postings, found, links, rows).join(done, ["a", "b"], "left_anti")
    more = _verified(docs, _filtered(more, rows))
    common.dropped(star)
    whole = common.stored(components(links.union(more)), "whole")
    common.dropped(found)
    return rows, reps.select("rid", "uid").join(whole, "rid").select("uid", "comp")


def _anchored(postings: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """Stored postings of the lists whose members are in several components, with ``comp``, ``minor``, ``anchor``, ``apart``; drops ``postings``.

    ``minor`` marks rows outside of their list's main component; ``anchor`` is the hub that a row is linked to, else the row,
    and ``apart`` is how many shingles only one of both has.
    """
    # A row met one hub at most, so it has one anchor at most.
    near = links.select(F.col("a").alias("rid"), F.col("b").alias("anchor"), "apart")
    marked = postings.join(found.join(near, "rid", "left"), "rid", "left")
    marked = marked.withColumns({
        "comp": F.coalesce("comp", "rid"), "anchor": F.coalesce("anchor", "rid"), "apart": F.coalesce("apart", F.lit(0))})
    marked = common.stored(marked, "marked")
    common.dropped(postings)
    lists = marked.groupBy("gram", "comp").agg(F.count("*").alias("k")).groupBy("gram")
    mixed = lists.agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("comps > 1").drop("comps")
    sides = common.stored(marked.join(mixed, "gram").withColumn("minor", F.col("comp") != F.col("main")).drop("main"), "sides")
    common.dropped(marked)
    return sides


def _anchor_pairs(sides: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored (gram, g, h, between, and bounds of h's rows) of anchors some of whose rows may link and have ``gram`` first in common.

    A pair has to be found only in the list of the first shingle, in the order of all prefixes, that its sets share.  All that
    they share stands there or behind, so the shorter rest of both has to reach the overlap that a link needs: texts that share a
    frequent passage, which stands last, never meet in its lists unless the passage alone could link them.

    ``between`` is a lower bound of the anchors' distance.  By the triangle inequality rows of two anchors can link only if the anchors,
    whose parities bound their distance from below, are no further apart than a link and the way from each row to its anchor.
    """
    groups = sides.groupBy("gram", "comp", "anchor", "minor").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("rest"),
        F.min("rid").alias("low"), F.max("rid").alias("high"),
    )
    groups = common.stored(groups, "groups")
    a, b = groups.where("minor").alias("x"), groups.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    on = (
        (x("gram") == y("gram")) & (x("comp") != y("comp")) & (~y("minor") | (x("low") < y("high")))
        & (100 * x("most") >= PERCENT * y("least")) & (100 * y("most") >= PERCENT * x("least"))
        & (F.least(x("rest"), y("rest")) >= _overlap_needed(x("least"), y("least")))
    )
    met = a.join(b, on).select(
        x("gram").alias("gram"), x("anchor").alias("g"), y("anchor").alias("h"),
        y("least").alias("h_least"), y("most").alias("h_most"), y("rest").alias("h_rest"),
    )
    met = common.stored(met, "met")
    # How far an anchor's rows reach, times 100 + PERCENT: linked sets are at most 100 - PERCENT apart for each shingle of both.
    reach = sides.groupBy("anchor").agg(F.max((100 - PERCENT) * F.col("n") + (100 + PERCENT) * F.col("apart")).alias("step"))
    reach = reach.join(rows.select(F.col("rid").alias("anchor"), "bits"), "anchor")
    near = met.select("g", "h").distinct()
    for side in "gh":
        near = near.join(reach.select(F.col("anchor").alias(side), F.col("step").alias(f"s_{side}"), F.col("bits").alias(f"p_{side}")), side)
    near = near.select("g", "h", "s_g", "s_h", "p_g", "p_h").mapInArrow(_within_reach, "g long, h long, between long")
    out = common.stored(met.join(near, ["g", "h"]), "anchors")
    common.dropped(met, groups)
    return out


def _within_reach(batches):
    for batch in batches:
        g, h, s, t = (batch.column(c).to_pylist() for c in ("p_g", "p_h", "s_g", "s_h"))
        between = [differing(p, q) for p, q in zip(g, h, strict=True)]
        keep = [(100 + PERCENT) * d <= k + l for d, k, l in zip(between, s, t, strict=True)]
        columns = [batch.column("g"), batch.column("h"), pa.array(between, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "h", "between"]).filter(pa.array(keep, pa.bool_()))


def _with_parity(side: DataFrame, rows: DataFrame) -> DataFrame:
    """``side`` with ``folded``: the parity of each row at the coarsest number of cells, as longs."""

    def fold(batch: pa.RecordBatch) -> list[pa.Array]:
        size = (1 << PARITY_BITS) // 8
        parities = (np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, size)) for b in batch.column("bits").to_pylist())
        return [pa.array([p.view(np.int64) for p in parities], pa.list_(pa.int64()))]

    needed = rows.join(side.select("rid").distinct(), "rid", "left_semi").select("rid", "bits")
    folded = needed.mapInArrow(common.by_batch(fold, ["folded"], ("bits",)), T.StructType([rows.schema["rid"], T.StructField("folded", _LONGS)]))
    return side.join(folded, "rid")


def _across(postings: DataFrame, found: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored distinct pairs of a list's members in different components that pass the length, positional and suffix filters.

    All filters are conditions of the join, so what they drop is never written.  Anchors meet first, so a group of near copies meets a text that shares a passage with all of them once.
    """
    sides = _anchored(postings, found, links)
    near = _anchor_pairs(sides, rows)
    n, rest = F.col("n"), F.col("n") - F.col("at")
    one = sides.where("minor").join(near.withColumnRenamed("g", "anchor"), ["gram", "anchor"]).where(
        (100 * n >= PERCENT * F.col("h_least")) & (100 * F.col("h_most") >= PERCENT * n)
        & (F.least(rest, F.col("h_rest")) >= _overlap_needed(n, F.col("h_least")))
    ).drop("h_least", "h_most", "h_rest")
    other = sides.join(near.select("gram", F.col("h").alias("anchor")).distinct(), ["gram", "anchor"])
    a, b = (_with_parity(side, rows).alias(name) for side, name in ((one, "x"), (other, "y")))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    possible = F.least(x("n") - x("at"), y("n") - y("at"))  # in the list of the first shingle that both have
    differ = sum(F.bit_count(x("folded")[i].bitwiseXOR(y("folded")[i])) for i in range((1 << PARITY_BITS) // 64))
    on = (
        (x("gram") == y("gram")) & (x("h") == y("anchor")) & (x("comp") != y("comp")) & (~y("minor") | (x("rid") < y("rid")))
        & (100 * F.least(x("n"), y("n")) >= PERCENT * F.greatest(x("n"), y("n"))) & (possible >= _overlap_needed(x("n"), y("n")))
        & ((100 + PERCENT) * (x("between") - x("apart") - y("apart")) <= (100 - PERCENT) * (x("n") + y("n")))
        & ((100 + PERCENT) * differ <= (100 - PERCENT) * (x("n") + y("n")))
    )
    pairs = a.join(b, on).select(F.least(x("rid"), y("rid")).alias("a"), F.greatest(x("rid"), y("rid")).alias("b")).distinct()
    pairs = common.stored(pairs, "across")
    common.dropped(sides, near)
    return pairs


def clusters(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, uid, n_shingles, component_id, kept, several) of every document.

    ``component_id`` is the component's smallest doc_id, ``kept`` the row that stands for it, ``several`` whether it has more rows.
    """
    rows, comps = linked(docs)
    # Copies share their uid, so a component is a set of uids; texts without words stay alone.
    joined = rows.select("rid", "doc_id", "uid", "n").join(comps, "uid", "left")
    none = F.lit(None)
    group = (
        F.when(F.col("n") == 0, F.struct(F.lit(0).alias("kind"), F.col("rid").alias("at"), none.cast("binary").alias("uid")))
        .when(F.col("comp").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("comp").alias("at"), none.cast("binary").alias("uid")))
        .otherwise(F.struct(F.lit(2).alias("kind"), none.cast("long").alias("at"), F.col("uid")))
    )
    keyed = joined.select("rid", "doc_id", "uid", "n", F.sha2(F.to_json(group), 256).alias("grp"))
    smallest = keyed.groupBy("grp").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid"))["rid"].alias("kept"),
        (F.count("*") > 1).alias("several"),
    )
    return keyed.join(smallest, "grp").select("rid", "doc_id", "uid", F.col("n").alias("n_shingles"), "component_id", "kept", "several")


def components_of(docs: DataFrame) -> DataFrame:
    """The contract's result: doc_id, n_shingles, component_id."""
    return clusters(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of smallest id of each component (null ids last, one row where it is repeated), with all its columns.

    Texts of components of one row pass without a shuffle, by a Bloom filter of the others.
    """
    result = common.stored(clusters(docs).where("several").select("rid", "doc_id", "uid", "kept"), "several")
    seen = docs.sparkSession.sparkContext.broadcast(_bloom(result.select(_uid_hash().alias("h")), result.count()))
    doc = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("binary").alias("data"))

    def marks(batch: pa.RecordBatch) -> list[pa.Array]:
        uids = [identity(common.SPACED.hashes(v)) for v in batch.column("data").to_pylist()]
        top = np.array([int.from_bytes(u[:8], "big") for u in uids], np.uint64)
        return [pa.array(uids, pa.binary()), pa.array(_in_bloom(seen.value, top), pa.bool_())]

    schema = T.StructType([doc.schema["doc"], T.StructField("uid", T.BinaryType()), T.StructField("maybe", T.BooleanType())])
    marked = doc.mapInArrow(common.by_batch(marks, ["uid", "maybe"], ("data",)), schema)
    by_uid = result.groupBy("uid").agg(
        F.max(F.col("rid") == F.col("kept")).alias("keeps"), F.max_by("doc_id", F.col("rid") == F.col("kept")).alias("keep_id")
    )
    some = marked.where("maybe").join(by_uid, "uid", "left")
    alone = some.where("keeps is null").select("doc")
    # Rows of one text and id are the same document: one of them stays.
    chosen = some.where("keeps").where(F.col("doc.doc_id").eqNullSafe(F.col("keep_id")))
    chosen = chosen.groupBy("uid").agg(F.first("doc").alias("doc")).select("doc")
    return marked.where("not maybe").select("doc").unionAll(alone).unionAll(chosen).select("doc.*")
