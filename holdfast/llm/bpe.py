"""Operator 2: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: the token ``t`` whose start ``s`` has
last token ``u`` such that ``u, t`` stay apart when their bytes are merged.  Storing that token for each prefix gives the
encoding of every prefix by walking back, an append without touching what is stored, and an edit that stops as soon as
the stored tokens agree again.

Text is split by a pattern; pieces that are a token as a whole keep that token.  Null and empty texts have no ids.  Texts
of any length are encoded whole; repeated rows are encoded alike; ids and digests ignore every other column.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdfast.llm import common

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Pairs of tokens whose verdict is remembered in a worker.
PAIRS = 1_000_000
#: Prefixes of short pieces whose last token is remembered in a worker.
PREFIXES = 600_000


class Vocabulary:
    """Ranks of byte strings, with what the dynamic programme looks up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every end of a token, with the token that it is itself, or -1.
        self.ends = {b[i:]: ranks.get(b[i:], -1) for b in ranks for i in range(len(b))}
        self._apart: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._last: dict[bytes, int] = {}
        self.pieces = common.Memo(self._piece, 200_000)

    def _merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merge the pair of lowest rank, leftmost first, while more than ``until`` parts are left; for one token's bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: int) -> tuple[list, list] | None:
        """What stands at the left and at the right edge of a token while it is merged: (bytes, rank at which it is made).

        None for a token that its own bytes do not merge to.
        """
        if token in self._edges:
            return self._edges[token]
        data = self.bytes_of[token]
        found = ([(data, -1)], [(data, -1)])
        if len(data) > 1:
            halves = self._merged(data, 2)
            if len(halves) > 2 or sum(map(len, halves)) != len(data) or len(self._merged(data)) > 1:
                found = None
            else:
                left, right = (self.edges(self.ranks[h]) for h in halves)
                found = (left[0] + [(data, token)], right[1] + [(data, token)])
        self._edges[token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay what they are when their bytes are encoded.

        The parts that touch at the border grow as their tokens are merged; the border goes if the two parts that touch
        make a token of lower rank than the next merge on either side (on the left also of equal rank, as the leftmost
        pair goes first).
        """
        found = self._apart.get((left, right))
        if found is None:
            found = self._border_holds(left, right)
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            self._apart[left, right] = found
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return False
        a, b, i, j, never = a[1], b[0], 0, 0, len(self.ranks) + 1
        while True:
            next_a = a[i + 1][1] if i + 1 < len(a) else never
            next_b = b[j + 1][1] if j + 1 < len(b) else never
            across = self.ranks.get(a[i][0] + b[j][0], never)
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a == next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add to ``last``, which has the last tokens of some first prefixes of ``data``, those of all others.

        The last token of a prefix is the only token that can end its encoding: what stands before it is a prefix, too,
        and the last token there must stay apart from it.
        """
        ends, apart, longest = self.ends, self._apart, self.longest
        for end in range(len(last), len(data) + 1):
            start, fits, low = end - 1, [], max(end - longest, 0)
            while start >= low and (token := ends.get(data[start:end])) is not None:
                if token >= 0:
                    fits.append((start, token))
                start -= 1
            for start, token in reversed(fits):
                if start:
                    pair = last[start], token
                    holds = apart.get(pair)
                    if holds is None:
                        holds = self.apart(*pair)
                else:
                    holds = self.edges(token) is not None
                if holds:
                    last.append(token)
                    break
            else:
                raise AssertionError("a prefix without a last token")

    def back(self, data: bytes, last: list[int], end: int) -> tuple[int, ...]:
        """The encoding of the first ``end`` bytes, from the last tokens."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tuple(out[::-1])

    def _ending(self, prefix: bytes) -> int:
        """Last token of a prefix; found from the few shorter prefixes that it asks for, shared by pieces that begin alike."""
        known, ends, apart = self._last, self.ends, self._apart
        end, fits = len(prefix), []
        start, low = end - 1, max(end - self.longest, 0)
        while start >= low and (token := ends.get(prefix[start:])) is not None:
            if token >= 0:
                fits.append((start, token))
            start -= 1
        for start, token in reversed(fits):
            if start:
                before = prefix[:start]
                left = known.get(before)
                if left is None:
                    left = self._ending(before)
                holds = apart.get((left, token))
                if holds is None:
                    holds = self.apart(left, token)
            else:
                holds = self.edges(token) is not None
            if holds:
                if len(known) >= PREFIXES:
                    known.clear()
                known[prefix] = token
                return token
        raise AssertionError("a prefix without a last token")

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if data in self.ranks:
            return (self.ranks[data],)
        if len(data) > 64:
            last = [-1]
            self.extend(data, last)
            return self.back(data, last, len(data))
        out, known, bytes_of = [], self._last, self.bytes_of
        while data:
            token = known.get(data)
            if token is None:
                token = self._ending(data)
            out.append(token)
            data = data[: -len(bytes_of[token])]
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        return [i for piece in self.pattern.findall(text) for i in pieces[piece]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """One piece: ``last[i]`` is the last token of its first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``data[start:stop]``; returns how many prefixes were computed anew."""
        old, tail = self.last, self.data[stop:]
        fixed, self.data = start + len(new), self.data[:start] + new + tail
        self.last, shift, agree = old[: start + 1], stop - start - len(new), 0
        for end in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data[:end], self.last)
            token = self.last[end]
            # A last token depends on the bytes and last tokens of the longest token's length before it.
            agree = agree + 1 if end > fixed and token == old[end + shift] else 0
            if agree >= self.vocabulary.longest and end - fixed >= 2 * self.vocabulary.longest:
                self.last += old[end + shift + 1 :]
                return end - start
        return len(self.data) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        end = len(self.data) if end is None else end
        whole = self.vocabulary.ranks.get(self.data[:end]) if end <= self.vocabulary.longest else None
        return [whole] if whole is not None else list(self.vocabulary.back(self.data, self.last, end))


class EditedText:
    """A text whose ids are kept up to date: an edit splits and encodes again only near itself."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text = vocabulary, text
        self.pieces = vocabulary.pattern.findall(text)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` in place of ``text[start:stop]``; returns how many pieces were split anew."""
        at, first = 0, 0
        # The pattern looks at most two characters beyond a piece.
        while first < len(self.pieces) and at + len(self.pieces[first]) + 2 <= start:
            at += len(self.pieces[first])
            first += 1
        shift = len(new) - (stop - start)
        starts, where = {}, at
        for i in range(first, len(self.pieces)):
            starts[where + shift] = i
            where += len(self.pieces[i])
        self.text = self.text[:start] + new + self.text[stop:]
        fresh, rest = [], len(self.pieces)
        while at < len(self.text):
            if at >= start + len(new) and at in starts:
                rest = starts[at]
                break
            fresh.append(self.vocabulary.pattern.match(self.text, at)[0])
            at += len(fresh[-1])
        self.pieces[first:rest] = fresh
        return len(fresh)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in self.vocabulary.pieces[p]]


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a rank file, once per process."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class _Written:
    """Ids of whole texts as decimal text.

    A single space between two characters that are no white space always starts a piece, so a text is cut there first and
    each part looked up with the space before it.  A part that touches other white space has no value, and its text is
    split by the pattern alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.parts = common.Memo(self._part, 300_000)
        self.token = {str(i): b for i, b in vocabulary.bytes_of.items()}

    def _part(self, part: str) -> str | bool:
        if not part or part[0].isspace() or part[-1].isspace():
            return False  # joining it raises TypeError
        if part.isalpha() and max(part) < "\u0250":  # letters by every version of Unicode: one piece
            return ",".join(map(str, self.vocabulary._piece(" " + part)))
        return ",".join(map(str, self.vocabulary.encode(" " + part)))

    def encode(self, text: str) -> str:
        if not text:
            return ""
        first, *parts = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return ",".join([",".join(map(str, self.vocabulary.encode(first))), *map(self.parts.__getitem__, parts)])
            except TypeError:
                pass
        return ",".join(map(str, self.vocabulary.encode(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def _written(path: str) -> _Written:
    return _Written(load(path))


#: What ``encode`` can return for each row.
OUTPUTS = {
    "token_ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.BinaryType(), pa.binary()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode(
    df: DataFrame, outputs: tuple[str, ...] = ("token_ids",), text: str = "text", path: str = VOCABULARY, keep: bool = True
) -> DataFrame:
    """``df`` with ``outputs`` of its text column; with ``keep=False`` the text column goes.

    Row by row, no shuffle.  ``decoded`` is read back from the ids, not copied from the text.  A column of ``df`` that has
    the name of an output is replaced.
    """
    common.prepared(df.sparkSession)
    df = df.select(*[c for c in df.columns if c not in outputs])

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        written = _written(path)
        out: dict[str, list] = {name: [] for name in outputs}
        for value in batch.column(text).to_pylist():
            ids = written.encode(value or "")
            decoded = written.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
            for name, values in out.items():
                values.append(
                    ids.count(",") + 1 if name == "n_tokens" and ids
                    else 0 if name == "n_tokens"
                    else hashlib.sha256(ids.encode()).hexdigest() if name == "ids_sha256"
                    else hashlib.sha256(decoded).hexdigest() if name == "decoded_sha256"
                    else decoded if name == "decoded"
                    else [int(i) for i in ids.split(",")] if ids else []
                )
        return [pa.array(out[name], OUTPUTS[name][1]) for name in outputs]

    drop = () if keep else (text,)
    kept = T.StructType([f for f in df.schema.fields if f.name not in drop])
    schema = common.extend(kept, *((n, OUTPUTS[n][0]) for n in outputs))
    return df.mapInArrow(common.by_batch(columns, list(outputs), drop), schema)


def decode(df: DataFrame, ids: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the bytes of an id column as ``decoded``; null ids give null, unknown ids fail."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        vocabulary = load(path)
        return [pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(ids).to_pylist()], pa.binary())]

    df = df.select(*[c for c in df.columns if c != "decoded"])
    return df.mapInArrow(common.by_batch(columns, ["decoded"]), common.extend(df.schema, ("decoded", T.BinaryType())))
