"""Operator 12: personal data by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, payment cards and telephone numbers (``base_spans``); they miss entities that
stand side by side (a number and a card joined by a space), and later mentions in another spelling.  The field adds those.

Nodes are words with a digit or an ``@``; all other words are fixed as no entity and cut the chain.  Labels are no entity and
the four kinds.  A node has weights for its shape, neighbouring words share a transition matrix, and distant words that
repeat or resemble each other (equal text, equal digits from seven on,
the last seven of up to eleven digits, the name before an ``@``) share a potential that
favours equal labels.  Edges go from the first such word to each later one, so messages reach any mention in two
steps and a word that is repeated n times costs n edges.  Words inside base spans are observed.  Loopy sum-product passes
``ROUNDS`` rounds of messages along all edges of a batch at once, so neither documents nor loops limit each other.

Weights are fitted by pseudo-likelihood on at most ``SAMPLE`` distinct texts (those of smallest hash) and at most ``NODES``
consecutive nodes of each; base spans are the labels.  Left out are words of joined matches that a check dropped, and words
outside of base spans that resemble one inside, because these are what the field shall judge.
The weight of the skip potential is the log odds that similar words agree there, from ``AGREE`` prior agreements on.

Added spans are words that the field labels, cut as the kind demands.  They do not overlap base spans and must
match the kind's pattern and check themselves, or resemble a base or matching span of the kind in the same text.

Nulls: a null text is empty and has no spans; a null id is kept.  Repeated rows get equal spans.  Very long texts are read
whole; every pattern takes time in proportion to the text.  An empty table, or one without digits, has no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import common

KINDS = ("email", "ip", "card", "phone")
OTHER, EMAIL, IP, CARD, PHONE = range(5)
#: Bounds of what is learned from, and agreements of similar words that are assumed beforehand (against one disagreement).
SAMPLE, NODES, AGREE = 3000, 400, 20
ROUNDS = 10
#: Score of an observed label, and strength of the weights' prior.
OBSERVED, RIDGE = 30.0, 0.05

_LOCAL = "A-Za-z0-9._%+-"
_LOCAL_END = re.compile(f"[{_LOCAL}]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile("[0-9@]")
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.DOTALL)
_NO_DIGIT = re.compile("[^0-9]+")


def digits(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


#: Whether a match of the kind's pattern counts.
CHECKS = {
    IP: lambda m: all(map(_small, m.split("."))),
    CARD: lambda m: 12 <= len(d := digits(m)) <= 19 and luhn(d),
    PHONE: lambda m: 9 <= len(digits(m)) <= 15,
}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each ``@`` outwards: the name is all that may stand before it, behind the last match."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = at = found.end()
        else:
            free = at = at + 1  # a name cannot hold an @


def found(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) in order, and matches that a check has dropped."""
    spans, dropped = [], []
    if "@" in text:
        spans += [(s, EMAIL, e) for s, e in emails(text)]
    for kind, pattern in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
        for m in pattern.finditer(text):
            if CHECKS[kind](m.group()):
                spans.append((m.start(), kind, m.end()))
            else:
                dropped.append(m.span())
    return sorted(spans), dropped


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return found(text)[0] if _MARK.search(text) else []


def _between(value: int, edges: tuple[int, ...]) -> list[bool]:
    return [low <= value < high for low, high in zip(edges, (*edges[1:], 1 << 60))]


_DIGITS, _LETTERS, _DOTS, _HYPHENS = (0, 1, 2, 3, 4, 5, 7, 8, 12, 16, 17, 20), (0, 1, 3), (0, 1, 2, 3, 4), (0, 1, 2)
_SHAPES = tuple(map(re.compile, (r"\+[0-9]{1,3}", r"\([0-9]{2,4}\)", r"[0-9]{3}[.-]?[0-9]{4}", r"[0-9]{4}", r"[0-9]+")))


def shape(core: str) -> int:
    """Binary features of a word as bits."""
    d = digits(core)
    letters = sum(map(str.isalpha, core))
    quad = _IP.fullmatch(core) is not None
    at = core.find("@")
    bits = [
        True, at >= 0, at > 0 and _DOMAIN.fullmatch(core, at + 1) is not None, core[:1] == "+", "(" in core or ")" in core,
        quad, quad and CHECKS[IP](core), 12 <= len(d) <= 19 and luhn(d), any(c in "/=:_\"'#$%&*|" for c in core), len(core) > len(d) + letters + 6,
        *_between(len(d), _DIGITS), *_between(letters, _LETTERS), *_between(core.count("."), _DOTS), *_between(core.count("-"), _HYPHENS),
        *[p.fullmatch(core) is not None for p in _SHAPES],
    ]
    return sum(1 << i for i, b in enumerate(bits) if b)


BITS = 10 + len(_DIGITS) + len(_LETTERS) + len(_DOTS) + len(_HYPHENS) + len(_SHAPES)


def keys(core: str) -> set[str]:
    """What makes words similar: they share a key."""
    d = digits(core)
    out = {core.lower()} if len(core) > 3 and (len(d) > 2 or "@" in core) else set()
    if len(d) >= 7:
        out |= {d, d[-7:]} if len(d) < 12 else {d}
    if "@" in core and core[0] != "@":
        out.add(core[: core.index("@")].lower())
    return out


@dataclass
class Words:
    """The nodes of one text."""

    spans: list[tuple[int, int]]
    shapes: list[int]
    keys: list[set[str]]
    follows: list[bool]  # the node before stands next to it
    observed: list[int]  # label of the base span that it is in, 0 without
    hidden: list[bool]  # in a dropped match of several words
    skips: list[tuple[int, int]]


def words(text: str, base: list[tuple[int, int, int]], dropped: list[tuple[int, int]]) -> Words:
    out = Words([], [], [], [], [], [], [])
    first: dict[str, int] = {}
    joined = sorted(s for s in dropped if _WORD.search(text, *s).end() < s[1])
    before, b, j = -1, 0, 0
    shapes: dict[str, int] = {}
    for n, w in enumerate(_WORD.finditer(text)):
        if not _MARK.search(w.group()):
            continue
        core = _CORE.search(w.group())
        if core is None:  # an @ among signs
            continue
        s, e, core = w.start() + core.start(), w.start() + core.end(), core.group()
        while b < len(base) and base[b][2] <= s:
            b += 1
        while j < len(joined) and joined[j][1] <= s:
            j += 1
        i = len(out.spans)
        out.spans.append((s, e))
        if core not in shapes:
            shapes[core] = shape(core)
        out.shapes.append(shapes[core])
        out.keys.append(keys(core))
        out.follows.append(before == n - 1 and i > 0)
        out.observed.append(base[b][1] if b < len(base) and base[b][0] < e else 0)
        out.hidden.append(j < len(joined) and joined[j][0] < e)
        for hub in {first[k] for k in out.keys[i] if k in first}:
            out.skips.append((hub, i))
        for k in out.keys[i]:
            first.setdefault(k, i)
        before = n
    return out


@dataclass
class Model:
    node: np.ndarray  # BITS x labels
    chain: np.ndarray  # label of a word x label of the next
    skip: float


def _matrix(shapes: list[int] | np.ndarray) -> np.ndarray:
    return (np.asarray(shapes, np.int64)[:, None] >> np.arange(BITS) & 1).astype(float)


def fit(shapes: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, agree: int, differ: int) -> Model:
    """Pseudo-likelihood: each label given its word's shape and its neighbours' labels (-1: none), by accelerated gradient.

    ``right`` and ``left`` are the labels beside a word.  Equal rows are counted once, with their number as weight.
    """
    skip = float(np.log((agree + AGREE) / (differ + 1)))
    model = Model(np.zeros((BITS, 5)), np.zeros((5, 5)), skip)
    if not len(labels):
        return model
    rows, n = np.unique(np.stack([shapes, labels, left, right], 1), axis=0, return_counts=True)
    x, y, sides = _matrix(rows[:, 0]), np.eye(5)[rows[:, 1]], np.vstack([np.eye(5), np.zeros(5)])
    before, after = sides[rows[:, 2]], sides[rows[:, 3]]
    n = np.sqrt(n)  # common words do not outweigh all others
    n = (n / n.sum())[:, None]
    step = 1 / (0.5 * (x.sum(1) + 2).max() + RIDGE)
    w, t = model.node, model.chain
    w_at, t_at = w, t
    for k in range(1500):
        score = x @ w_at + before @ t_at + after @ t_at.T
        p = np.exp(score - score.max(1, keepdims=True))
        gap = n * (y - p / p.sum(1, keepdims=True))
        w_new = w_at + step * (x.T @ gap - RIDGE / 100 * w_at)
        t_new = t_at + step * (before.T @ gap + (after.T @ gap).T - RIDGE / 100 * t_at)
        pull = k / (k + 3)
        w_at, t_at = w_new + pull * (w_new - w), t_new + pull * (t_new - t)
        w, t = w_new, t_new
    return Model(w, t, skip)


def labelled(texts: list[Words], model: Model) -> list[np.ndarray]:
    """Labels of the nodes of each text by loopy belief propagation over all texts at once."""
    sizes = [len(t.spans) for t in texts]
    first = np.cumsum([0, *sizes])
    if not first[-1]:
        return [np.empty(0, int) for _ in texts]
    node = _matrix([s for t in texts for s in t.shapes]) @ model.node
    seen = np.array([o for t in texts for o in t.observed])
    node[seen > 0, seen[seen > 0]] += OBSERVED
    right = np.flatnonzero(np.array([f for t in texts for f in t.follows]))
    pairs = [(o + i, o + j) for o, t in zip(first.tolist(), texts) for i, j in t.skips]
    skips = np.array(pairs, np.int64).reshape(-1, 2)
    # Each edge in both directions: from, to, potential by label of from and of to.
    start = np.r_[right - 1, right, skips[:, 0], skips[:, 1]]
    end = np.r_[right, right - 1, skips[:, 1], skips[:, 0]]
    back = np.r_[np.arange(len(right)) + len(right), np.arange(len(right)), np.arange(len(skips)) + 2 * len(right) + len(skips), np.arange(len(skips)) + 2 * len(right)]
    same = np.eye(5) * model.skip
    kind = np.r_[np.zeros(len(right), int), np.ones(len(right), int), np.full(2 * len(skips), 2)]
    potential = np.stack([model.chain, model.chain.T, same])
    message = np.zeros((len(start), 5))
    belief = node.copy()
    for _ in range(ROUNDS if len(start) else 0):
        new = np.empty_like(message)
        for part in np.array_split(np.arange(len(start)), len(start) // 100_000 + 1):
            out = (belief[start[part]] - message[back[part]])[:, :, None] + potential[kind[part]]
            top = out.max(1, keepdims=True)
            new[part] = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        belief = node.copy()
        np.add.at(belief, end, message)
    label = belief.argmax(1)
    return [label[a:b] for a, b in zip(first, first[1:])]


def _whole(text: str, kind: int) -> bool:
    """Whether the text is one match of the kind."""
    spans = base_spans(text)
    return any(k == kind and s == 0 and e == len(text) for s, k, e in spans)


def added_spans(text: str, base: list[tuple[int, int, int]], nodes: Words, label: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base spans."""
    groups: list[list[int]] = []
    for i, kind in enumerate(label.tolist()):
        if kind == OTHER or nodes.observed[i]:
            continue
        n = len(digits(text[slice(*nodes.spans[i])]))
        joins = groups and nodes.follows[i] and groups[-1][-1] == i - 1 and label[i - 1] == kind and kind in (CARD, PHONE)
        if joins and kind == PHONE:
            joins = text[nodes.spans[i][0]] != "+" and held + n <= 15
        if joins and kind == CARD:
            joins = held + n <= 19 and max(n, held) < 12
        if joins:
            groups[-1].append(i)
            held += n
        else:
            groups.append([i])
            held = n
    linked: dict[int, set[str]] = {k: set() for k in range(1, 5)}
    for i, kind in enumerate(nodes.observed):
        if kind:
            linked[kind] |= nodes.keys[i]
    spans = [(nodes.spans[g[0]][0], int(label[g[0]]), nodes.spans[g[-1]][1], g) for g in groups]
    sure = [_whole(text[s:e], kind) for s, kind, e, _ in spans]
    for (_, kind, _, g), ok in zip(spans, sure):
        if ok:
            linked[kind].update(*(nodes.keys[i] for i in g))
    out = [(s, kind, e) for (s, kind, e, g), ok in zip(spans, sure) if ok or any(nodes.keys[i] & linked[kind] for i in g)]
    taken = sorted((s, e) for s, _, e in base)
    starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken]) if taken else np.empty(0)
    return [x for x in out if not (at := np.searchsorted(starts, x[2])) or ends[at - 1] <= x[0]]


def spans_of(texts: list[str | None], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text."""
    marked = [i for i, t in enumerate(texts) if t and _MARK.search(t)]
    matches = [found(texts[i]) for i in marked]
    nodes = [words(texts[i], *m) for i, m in zip(marked, matches)]
    out: list = [([], [])] * len(texts)
    for i, (base, _), n, label in zip(marked, matches, nodes, labelled(nodes, model)):
        out[i] = base, sorted(base + added_spans(texts[i], base, n, label))
    return out


_FACTORS = "h long, shapes array<long>, labels array<int>, lefts array<int>, rights array<int>, agree long, differ long"


def learned(docs: DataFrame) -> Model:
    """The model of a table's texts."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    chosen = F.broadcast(marked.select("h").distinct().orderBy("h").limit(SAMPLE))  # SAMPLE rows at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = words(text, *found(text))
                named = set().union(*(k for k, o in zip(n.keys, n.observed) if o))
                known = [-1 if x or not o and k & named else o for o, x, k in zip(n.observed, n.hidden, n.keys)]
                beside = [known[i - 1] if i and n.follows[i] else -1 for i in range(len(known))]
                after = [known[i + 1] if i + 1 < len(known) and n.follows[i + 1] else -1 for i in range(len(known))]
                first = h % max(len(known) - NODES + 1, 1)
                use = [i for i in range(first, min(first + NODES, len(known))) if known[i] >= 0]
                pairs = [known[i] == known[j] for i, j in n.skips[:NODES] if known[i] > 0 and known[j] > 0]
                rows.append((h, [n.shapes[i] for i in use], [known[i] for i in use], [beside[i] for i in use], [after[i] for i in use], sum(pairs), len(pairs) - sum(pairs)))
            kinds = [pa.int64(), pa.list_(pa.int64()), *(pa.list_(pa.int32()),) * 3, pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _FACTORS.split(", ")])

    rows = marked.join(chosen, "h").mapInArrow(run, _FACTORS).dropDuplicates(["h"]).toArrow().sort_by("h")
    flat = [np.array(rows.column(c).combine_chunks().flatten() if len(rows) else [], np.int64) for c in ("shapes", "labels", "lefts", "rights")]
    return fit(*flat, sum(rows.column("agree").to_pylist()), sum(rows.column("differ").to_pylist()))


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{s}:{e}" for s, k, e in spans)


OUTPUTS = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def tagged(docs: DataFrame, model: Model, redacted: bool = False) -> DataFrame:
    """``docs`` without the text, with the base counts and digest and all spans.

    With ``redacted`` also ``redacted``, the text with each span replaced by its kind in brackets.
    """
    common.prepared(docs.sparkSession)
    fields = OUTPUTS + [("redacted", T.StringType())] * redacted
    names = [n for n, _ in fields]
    docs = docs.select(*[c for c in docs.columns if c not in names])

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text").to_pylist()
        result = spans_of(texts, model)
        counts = [pa.array([sum(x[1] == k for x in base) for base, _ in result], pa.int64()) for k in range(1, 5)]
        digest = pa.array([hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in result], pa.string())
        out = [*counts, digest, pa.array([_text(every) for _, every in result], pa.string())]
        return out + [pa.array([hidden(t, every) for t, (_, every) in zip(texts, result)], pa.string())] * redacted

    kept = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    return docs.mapInArrow(common.by_batch(columns, names, ("text",)), common.extend(kept, *fields))


def hidden(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s, kind, e in spans:
        if e > at:  # kinds can overlap
            out += [text[at : max(s, at)], f"[{KINDS[kind - 1].upper()}]"] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of whole ``docs``, with a model learned from them."""
    return tagged(docs.select("doc_id", "text"), learned(docs))
