"""Operator 11: alignment of two tokenizers by pointer jumping over overlapping tokens.

A byte-level BPE (A) reads a space and the text, a piece model with byte fallback (B) reads the text and adds the space.
Tokens of both stand on one byte axis; a link is a pair of an A and a B token whose byte ranges overlap, and a group is a
connected component of links.  Every token points to the farthest-right token that overlaps it, itself included, and of
two that end together the B token is the right one.  Pointers are replaced by their pointers' pointers until none changes,
in as many rounds as the logarithm of the longest chain; each then names the terminal token of its component, which labels
the group.  All tokens of a batch are treated at once.

Both tokenizers cut where a single space stands between two characters that are no white space: A's pattern starts a
piece there, and no piece of B has a space behind another character (looked up in the vocabulary; without that a text is
one unit).  So links never cross such places, and a text is aligned as a sequence of units that are remembered; a unit is
encoded once while it is in the bounded memo.

Counts of id pairs are taken over all documents: each task sums the pairs of the units it has seen, Spark adds them up.
``FREQUENT`` pairs at most, those above a power of two, are sent to every worker (16 bytes each); links of all rarer
pairs are joined with the table of counts, where no key can be hot because frequent pairs are not among them.

Nulls, empty texts and texts that a tokenizer doesn't give back byte by byte have no tokens: counts of 0, and '' as
digest.  Repeated rows and ids are kept apart by row numbers that are written with the rows.  Very long texts are single
steps of a batch; batches are cut at ``STEP_CHARS``.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import common

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs sent to every worker at most.
FREQUENT = 1 << 20
#: Units a worker remembers, and characters that it handles at once (a longer text is handled alone).
UNITS, STEP_CHARS = 400_000, 2_000_000
#: Units given to tokenizer A as one text.
TOGETHER = 50

_NONE = np.empty(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and whether B can be cut before a space."""

    def __init__(self, path_a: str = PATH_A, path_b: str = PATH_B):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Ids of A and of B of all units, one unit after the other, how many of each, and which units both give back.

        A unit starts with the space that B adds by itself.  Units without white space at their end are cut from each other
        by their spaces, so several are given to A at once; the ids belong to the unit in which their bytes end.
        """
        data = [u.encode() for u in units]
        ends_well = [not u[-1].isspace() for u in units]
        runs = [0, *[i for i in range(1, len(units)) if i % TOGETHER == 0 or not ends_well[i - 1] or not self.cuts], len(units)]
        a = [x.ids for x in self.a.encode_batch_fast(["".join(units[i:j]) for i, j in zip(runs, runs[1:])], add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        many_b = np.fromiter(map(len, b), np.int64, len(b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends, ends_a, ends_b = np.cumsum([len(d) for d in data]), np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != b"".join(data):
            raise ValueError("the first tokenizer does not give its text back")
        many_a = np.diff(np.searchsorted(ends_a, ends, "right"), prepend=0)
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) == b"".join(data) and np.isin(ends, ends_b).all():
            return a, b, many_a, many_b, [True] * len(units)
        from_b = np.split(b, np.cumsum(many_b)[:-1])
        good = [b"".join(map(self.bytes_b.__getitem__, x.tolist())) == d for x, d in zip(from_b, data)]
        a, b = a[np.repeat(good, many_a)], b[np.repeat(good, many_b)]
        return a, b, np.where(good, many_a, 0), np.where(good, many_b, 0), good


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def terminals(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> np.ndarray:
    """Number of each token's terminal, tokens of A first, by pointer jumping.

    Ranges are sorted, not empty, and both cover the same bytes.
    """
    n = len(a_ends)
    to_b = np.searchsorted(b_starts, a_ends, "left") - 1
    to_a = np.searchsorted(a_starts, b_ends, "left") - 1
    own = np.arange(n + len(b_ends))
    pointer = own.copy()
    if n:
        pointer[:n] = np.where(b_ends[to_b] >= a_ends, n + to_b, own[:n])
        pointer[n:] = np.where(a_ends[to_a] > b_ends, to_a, own[n:])
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            return pointer
        pointer = further


def links(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of A, token of B) that overlap, in order of A."""
    first = np.searchsorted(b_ends, a_starts, "right")
    many = np.searchsorted(b_starts, a_ends, "left") - first
    left = np.repeat(np.arange(len(a_ends)), many)
    behind = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
    return left, np.repeat(first, many) + behind


class Aligned:
    """Alignments of units, in arrays with one entry per unit; ``codes`` are their links as ``a * |B| + b``.

    Groups are only looked for with ``grouped``.
    """

    def __init__(self, both: Tokenizers, units: list[str], grouped: bool = True):
        self.both, n = both, len(units)
        self.a, self.b, self.n_a, self.n_b, good = both.encode(units)
        self.good = np.array(good, bool)
        a_ends, b_ends = np.cumsum(both.sizes_a[self.a]), np.cumsum(both.sizes_b[self.b])
        places = a_ends, a_ends - both.sizes_a[self.a], b_ends, b_ends - both.sizes_b[self.b]
        left, right = links(*places)
        self.codes = self.a[left] * len(both.bytes_b) + self.b[right]
        self.n_links = np.bincount(np.repeat(np.arange(n), self.n_a)[left], minlength=n)
        if not grouped:
            return
        pointer = terminals(*places)
        last = pointer == np.arange(len(pointer))
        self.group = (np.cumsum(last) - 1)[pointer]  # terminals are numbered from left to right, all are tokens of B
        self.n_groups = np.bincount(np.repeat(np.arange(n), self.n_b)[last[len(self.a) :]], minlength=n)
        self.written = self._written(n)

    def _written(self, units: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        n = len(self.a)
        side = np.r_[np.zeros(n, np.int64), np.ones(len(self.b), np.int64)]
        key = self.group * 2 + side
        order = np.argsort(key, kind="stable")
        key = key[order]
        unit = np.r_[np.repeat(np.arange(units), self.n_a), np.repeat(np.arange(units), self.n_b)][order]
        change = np.r_[key[1:] != key[:-1], True][: len(key)]
        ends = np.r_[unit[1:] != unit[:-1], True][: len(key)]
        sign = np.where(ends, "\n", np.where(change, np.where(key % 2 == 0, "|", ";"), ",")).tolist()
        lines = iter("".join([f"{i}{s}" for i, s in zip(np.r_[self.a, self.b][order].tolist(), sign)]).split("\n"))
        return [next(lines) if m else "" for m in self.n_a.tolist()]


def units_of(text: str) -> list[str]:
    """Parts of a space and the text, cut before single spaces between characters that are no white space."""
    out, whole = [], " "
    for i, part in enumerate(text.split(" ")):
        if not i:
            whole = " " + part
        elif part and not part[0].isspace() and whole[-1] != " " and not whole[-1].isspace():
            out.append(whole)
            whole = " " + part
        else:
            whole += " " + part
    return [*out, whole]


class _Numbers(dict):
    """Numbers of units, given out when they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


#: What is known of a part of a text between spaces.
GOOD, UNEQUAL, NO_UNIT = 0, 1, 2


class Memory:
    """Units seen so far, numbered, and arrays of what is known of each; the most used half survives when it is full.

    Keys are parts between spaces, whose unit is a space and the part, or units of several parts, which start with a space.
    A part that is empty or has white space at an end is ``NO_UNIT``: its text has to be cut by ``units_of``.
    """

    ONE = ("kind", "used", "seen", "n_a", "n_b", "n_groups", "n_links", "best", "sum", "n_rare")
    MANY = (("n_links", "codes"), ("n_rare", "rare"))

    def __init__(self, both: Tokenizers, frequent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.both, self.frequent = both, frequent
        self.number, self.written = _Numbers(), []
        self.known = 0
        self.of = {k: _NONE for k in (*self.ONE, *(v for _, v in self.MANY))}

    def learn(self) -> None:
        """Align the units that have got a number but no entries."""
        new = list(islice(reversed(self.number), len(self.number) - self.known))[::-1]
        if not new:
            return
        kinds = np.array([NO_UNIT if not k or k[0] != " " and (k[0].isspace() or k[-1].isspace()) else GOOD for k in new])
        found = Aligned(self.both, [k if k[0] == " " else " " + k for k, kind in zip(new, kinds) if kind == GOOD], self.frequent is not None)
        is_unit = kinds == GOOD
        kinds[np.flatnonzero(is_unit)[~found.good]] = UNEQUAL

        def placed(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(new), np.int64)
            out[is_unit] = values
            return out

        more = {"kind": kinds, "n_a": placed(found.n_a), "n_b": placed(found.n_b), "n_links": placed(found.n_links), "codes": found.codes}
        if self.frequent is not None:
            codes, counts, best = self.frequent
            unit = np.repeat(np.arange(len(new)), more["n_links"])
            at = np.searchsorted(codes, found.codes) if len(codes) else np.zeros(len(unit), np.int64)
            at[at == len(codes)] = 0
            hit = codes[at] == found.codes if len(codes) else np.zeros(len(unit), bool)
            for name, values in (("sum", counts), ("best", best)):
                out = np.zeros(len(new), np.int64)
                np.add.at(out, unit[hit], values[at[hit]])
                more[name] = out
            more |= {"n_groups": placed(found.n_groups), "n_rare": np.bincount(unit[~hit], minlength=len(new)), "rare": found.codes[~hit]}
            written = iter(found.written)
            self.written += [next(written) if u else "" for u in is_unit.tolist()]
        for k, old in self.of.items():
            self.of[k] = np.r_[old, more[k] if k in more else np.zeros(0 if k in ("codes", "rare") else len(new), np.int64)]
        self.known = len(self.number)

    def spread(self, of: np.ndarray, sizes: str, values: str) -> tuple[np.ndarray, np.ndarray]:
        """Values of units ``of`` one after the other, and how many each has."""
        many = self.of[sizes][of]
        first = (np.cumsum(self.of[sizes]) - self.of[sizes])[of]
        behind = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.of[values][np.repeat(first, many) + behind], many

    def shrink(self) -> None:
        keep = np.sort(np.argsort(-self.of["used"], kind="stable")[: UNITS // 2])
        keys = list(self.number)
        many = {v: self.spread(keep, sizes, v)[0] for sizes, v in self.MANY if len(self.of[sizes])}
        self.of |= {k: self.of[k][keep] for k in self.ONE} | many
        self.of["used"] //= 2
        if self.written:
            self.written = [self.written[i] for i in keep.tolist()]
        self.number = _Numbers((keys[i], n) for n, i in enumerate(keep.tolist()))
        self.known = len(self.number)

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of the texts, one text after the other, and how many each has; none if a text has no tokens."""
        get = self.number.__getitem__
        if self.both.cuts:
            out = [np.array(list(map(get, t.split(" "))), np.int64) if t else _NONE for t in texts]
            self.learn()
            kind = self.of["kind"]
            for i, x in enumerate(out):
                if len(x) and kind[x].max() == NO_UNIT:
                    out[i] = np.array([get(u if " " in u[1:] or u[-1].isspace() or u[1].isspace() else u[1:]) for u in units_of(texts[i])], np.int64)
        else:
            out = [np.array([get(" " + t)], np.int64) if t else _NONE for t in texts]
        self.learn()
        kind = self.of["kind"]
        out = [x if not len(x) or kind[x].max() == GOOD else _NONE for x in out]
        flat = np.concatenate([_NONE, *out])
        now = np.bincount(flat, minlength=self.known)
        self.of["used"] += now
        self.of["seen"] += now
        return flat, np.array([len(x) for x in out], np.int64)


def _steps(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of at most ``STEP_CHARS``, or of one longer text."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > STEP_CHARS:
            yield first, texts[first:i]
            first = i
            size = 0
        size += n
    if first < len(texts):
        yield first, texts[first:]


#: The memory of this worker's last tasks, under what it was made for: the next task starts with it.
_last: dict[tuple, Memory] = {}


def _memory(key: tuple, both: Tokenizers, frequent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Memory:
    memory = _last.get(key)
    if memory is None or memory.known != len(memory.number):  # a task may have ended within a step
        _last.clear()
        memory = _last[key] = Memory(both, frequent)
    memory.of["seen"][:] = 0
    return memory


PAIRS = "code long, n long"


def pair_counts(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B) -> DataFrame:
    """(code, n, best): links of each id pair over all texts; best if no other pair of that B id has more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory((path_a, path_b), tokenizers(path_a, path_b))

        def summed() -> pa.RecordBatch:
            codes, at = np.unique(memory.of["codes"], return_inverse=True)
            n = np.bincount(at, np.repeat(memory.of["seen"], memory.of["n_links"]), len(codes)).astype(np.int64)
            memory.of["seen"][:] = 0
            return pa.RecordBatch.from_arrays([pa.array(codes[n > 0]), pa.array(n[n > 0])], names=["code", "n"])

        for batch in batches:
            for _, texts in _steps(batch.column(0).to_pylist()):
                if memory.known > UNITS:
                    yield summed()
                    memory.shrink()
                memory.numbered(texts)
        if memory.known:
            yield summed()

    pairs = docs.select("text").mapInArrow(run, PAIRS).groupBy("code").agg(F.sum("n").alias("n"))
    pairs = common.stored(pairs, "pairs")
    of_b = F.expr(f"code % {len(tokenizers(path_a, path_b).bytes_b)}")
    most = pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # at most a row for each B id
    return pairs.withColumn("b", of_b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in order, counts and best of the pairs above the smallest power of two that leaves at most ``FREQUENT``."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()  # at most 64 rows
    total, least = 0, 64
    for r in sorted(sizes, key=lambda r: -r["power"]):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["power"]
    rows = pairs.where(F.floor(F.log2("n")) >= least).toArrow() if least < 64 else pairs.limit(0).toArrow()
    codes, n, best = (rows.column(c).to_numpy().astype(np.int64) for c in ("code", "n", "best"))
    order = np.argsort(codes)
    return codes[order], n[order], best[order]


OUTPUTS = (
    ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("n_best", T.LongType()),
    ("count_sum", T.LongType()), ("groups_sha256", T.StringType()), ("rare", T.ArrayType(T.LongType(), False)),
)


def aligned(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B, groups: bool = False) -> DataFrame:
    """``docs`` without the text and with counts of the alignment; with ``groups`` also ``groups``, the written groups."""
    common.prepared(docs.sparkSession)
    names = [n for n, _ in OUTPUTS] + ["groups"] * groups
    docs = docs.select(*[c for c in docs.columns if c == "text" or c not in (*names, "groups", "_row")])
    pairs = common.stored(pair_counts(docs, path_a, path_b), "counted-pairs")
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(pairs))
    table = uuid.uuid4().hex
    types = [*(pa.int64(),) * 6, pa.string(), pa.list_(pa.int64()), *(pa.string(),) * groups]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory((path_a, path_b, table), tokenizers(path_a, path_b), sent.value)
        for batch in batches:
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            for first, texts in _steps(batch.column("text").to_pylist()):
                if memory.known > UNITS:
                    memory.shrink()
                flat, many = memory.numbered(texts)

                def summed(values: np.ndarray) -> np.ndarray:
                    sums = np.r_[0, np.cumsum(values)]
                    ends = np.cumsum(many)
                    return sums[ends] - sums[ends - many]

                columns: list = [summed(memory.of[k][flat]) for k in ("n_a", "n_b", "n_groups", "n_links", "best", "sum")]
                lines = iter(map(memory.written.__getitem__, flat.tolist()))
                written = [";".join(islice(lines, m)) for m in many.tolist()]
                columns.append([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written])
                rare, sizes = memory.spread(flat, "n_rare", "rare")
                columns.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(summed(sizes))].astype(np.int32), pa.array(rare)))
                columns += [written] * groups
                kept = [batch.column(i).slice(first, len(texts)) for i in rest]
                new = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(kept + new, names=[batch.schema.names[i] for i in rest] + names)

    kept = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = common.extend(kept, *OUTPUTS, *[("groups", T.StringType())] * groups)
    rows = common.stored(docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    rare = rows.select("_row", F.explode("rare").alias("code")).groupBy("_row", "code").agg(F.count("*").alias("times"))
    rare = rare.join(pairs, "code").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best")
    )
    rows = rows.drop("rare").join(rare, "_row", "left")
    return rows.withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }).drop("_row", "_sum", "_best")


def alignment(docs: DataFrame) -> DataFrame:
    """The counts of whole ``docs``, one row per document."""
    return aligned(docs.select("doc_id", "text"))
