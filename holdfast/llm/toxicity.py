"""Operator 4: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A document is as toxic as its most toxic expression.  Expressions are its words, and runs of three and more single
characters read as one word (``i d i o t``).  They are compared by a gap-weighted subsequence kernel: each ordered triple of
characters counts ``DECAY`` to the power of the span it covers, so letters put in between, left out or changed move an
expression only a little.  With the landmarks' kernel values as coordinates (Nystroem) a linear machine is trained; its
expansion over the landmarks adds up to one weight for each triple, so scoring costs one look-up for each triple of a text.

Training uses a bounded sample of labelled documents (``MOST`` of either label, those of smallest hash; repeated rows count once, and
of a doc_id with several texts one is taken before any second one) and, of their expressions, bounded candidate lists.  A label belongs to a document, so the machine learns from several instances:
of every toxic document the expression that speaks most for toxicity, of the others those that are most easily taken for it.

Null and empty texts, and texts without an expression, score 0.  Texts of any length are scored whole.  Labels that are
null are ignored; of contradicting labels of one document the toxic one counts.  Without labels of both kinds all
scores are 0.  Repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import common

#: Labelled documents of either label that are learned from, at most.
MOST = 5000
#: Expressions that reach the trainer, at most, of each kind.
POSITIVES, NEGATIVES, LANDMARKS, ROUNDS = 1500, 3000, 256, 3
#: Kernel: span of a triple at most, weight of each character it spans.
SPAN, DECAY = 6, 0.6
THRESHOLD = 0.3
#: Letters beyond ASCII share the codes from 40 on.
ALPHABET = 64
#: Longer expressions are scored in overlapping pieces of this length.
LONGEST = 32

_SPELLED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def expressions(text: str) -> set[str]:
    """Words of a text, lower-cased, and spelled-out words put together."""
    text = text.lower()
    found = set(text.split())
    if _SPELLED.search(text):
        found |= {m.replace(" ", "") for m in _SPELLED.findall(text)}
    return found


def plain(word: str) -> str:
    """An expression without punctuation, digits read as the letters they look like when letters stand around."""
    word = word.strip(".,;:!?\"'()[]{}<>|#*&%-_/\\")
    if not word.isalpha() and any(map(str.isalpha, word)):
        word = "".join(c for c in word.translate(_LEET) if c.isalnum())
    return word


def _code(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o % 10 if 48 <= o <= 57 else 40 + o % 23


#: First and second distance of every triple within the span.
_STEPS = [(i, j) for j in range(2, SPAN + 1) for i in range(1, j)]


def triples(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Expressions by length: (their places in ``words``, triple codes, weights); weights are normed by length."""
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    out = []
    for n, places in by.items():
        codes = np.zeros((len(places), n + 2), np.int32)  # marks before and after, code 0
        for row, at in enumerate(places):
            codes[row, 1 : n + 1] = [_code(c) for c in words[at]]
        codes[:, -1] = 63
        steps = [(i, j) for i, j in _STEPS if j < n + 2]
        if not steps:
            continue
        cols = [(codes[:, : n + 2 - j] * ALPHABET + codes[:, i : i + n + 2 - j]) * ALPHABET + codes[:, j:] for i, j in steps]
        weight = np.concatenate([np.full(n + 2 - j, DECAY ** (j + 1)) for _, j in steps])
        out.append((np.array(places), np.concatenate(cols, axis=1), weight / np.sqrt((weight**2).sum())))
    return out


def features(words: list[str]) -> list[dict[int, float]]:
    out: list[dict[int, float]] = [{} for _ in words]
    for places, codes, weight in triples(words):
        for at, row in zip(places, codes, strict=True):
            d = out[at]
            for c, w in zip(row.tolist(), weight.tolist(), strict=True):
                d[c] = d.get(c, 0.0) + w
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of expressions and landmarks."""
    marks = features(landmarks)
    used = sorted({c for d in marks for c in d})
    row_of = np.full(ALPHABET**3, len(used), np.int32)
    row_of[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for j, d in enumerate(marks):
        for c, w in d.items():
            table[row_of[c], j] = w
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for places, codes, weight in triples(words):
        for lo in range(0, len(places), 256):
            part = table[row_of[codes[lo : lo + 256]]]
            out[places[lo : lo + 256]] = np.einsum("wtl,t->wl", part, weight.astype(np.float32))
    return out


def train(positive: list[str], negative: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Weights of all triples and the offset: squared-hinge machine on Nystroem coordinates, by Newton steps."""
    gram = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(landmarks)))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel(positive + negative, landmarks).astype(np.float64) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.r_[np.full(len(positive), 20.0 / len(positive)), np.full(len(negative), 40.0 / len(negative))] * 50
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), xa.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    alpha = root @ w[:-1]
    weights = np.zeros(ALPHABET**3)
    for a, d in zip(alpha, features(landmarks), strict=True):
        for c, v in d.items():
            weights[c] += a * v
    return weights.astype(np.float32), float(w[-1])


def decision(words: list[str], weights: np.ndarray, offset: float) -> np.ndarray:
    """Values of the machine; an expression of more than ``LONGEST`` characters has that of its most toxic piece."""
    pieces, owner = [], []
    for at, w in enumerate(words):
        w = plain(w)
        cut = [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
        pieces += cut
        owner += [at] * len(cut)
    values = np.full(len(pieces), offset, np.float32)
    for places, codes, weight in triples(pieces):
        for lo in range(0, len(places), 4096):
            values[places[lo : lo + 4096]] += weights[codes[lo : lo + 4096]] @ weight.astype(np.float32)
    values[[i for i, p in enumerate(pieces) if len(p) < 2]] = -10
    out = np.full(len(words), -10, np.float32)
    np.maximum.at(out, np.array(owner, np.int64), values)
    return out


def scorer(weights: np.ndarray, offset: float, slope: float, middle: float):
    """Scores of texts; values of frequent expressions are remembered in the worker, up to a limit."""
    known: dict[str, float] = {}

    def score(texts: list[str | None]) -> list[float]:
        found = [expressions(t) if t else () for t in texts]
        fresh = [w for w in set().union(*found) if w not in known]
        if len(known) + len(fresh) > 500_000:
            known.clear()
            fresh = list(set().union(*found))
        known.update(zip(fresh, decision(fresh, weights, offset).tolist(), strict=True))
        most = np.array([max(map(known.__getitem__, f), default=-1e9) for f in found])
        return (1 / (1 + np.exp(np.clip(slope * (middle - most), -700, 700)))).tolist()

    return score


def held_out() -> Column:
    """Rows that labels are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, train_only: Column) -> DataFrame:
    """(toxic, words) of the documents learned from, each doc_id and text once: at most ``2 * MOST`` rows."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(train_only)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (0, 1):
        some = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST)
        ids = some if ids is None else ids.unionAll(some)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([sorted({p for w in expressions(t or "") if len(p := plain(w)) >= 2}) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))]

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", F.xxhash64("text").alias("hash")).agg(F.any_value("text").alias("text"))
    words = T.StructField("words", T.ArrayType(T.StringType()))
    lists = rows.mapInArrow(common.by_batch(columns, ["words"], ("text",)), T.StructType([*rows.drop("text").schema.fields, words]))
    lists = common.stored(lists, "labelled")
    # First texts of all ids, then second ones; the window is limited to MOST rows of an id before the exchange.
    ranked = lists.select("doc_id", "hash", "toxic", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")).alias("rank")).where(F.col("rank") <= MOST)
    chosen = None
    for label in (0, 1):
        some = ranked.where(F.col("toxic") == label).orderBy("rank", F.xxhash64("doc_id"), "doc_id").limit(MOST).select("doc_id", "hash")
        chosen = some if chosen is None else chosen.unionAll(some)
    return lists.join(F.broadcast(chosen), ["doc_id", "hash"]).select("toxic", "words")


def _grams(word: Column) -> Column:
    """Four-character runs of a marked word; evidence for a stem even if each word with it is rare."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - 3, F.lit(1))), lambda i: F.substring(marked, i, F.lit(4)))


def fit(docs: DataFrame, labels: DataFrame, train_only: Column | None = None) -> tuple[np.ndarray, float, float, float]:
    """(triple weights, offset, slope, middle) of the machine and its probability."""
    rows = _sample(docs, labels, held_out() == F.lit(False) if train_only is None else train_only)
    rows = common.stored(rows.select(F.monotonically_increasing_id().alias("id"), "toxic", "words"), "sample")
    size = {t: n for t, n in rows.groupBy("toxic").count().collect()}
    nothing = np.zeros(ALPHABET**3, np.float32), -10.0, 1.0, 0.0
    if not size.get(0) or not size.get(1):
        return nothing
    words = rows.select("id", "toxic", F.explode("words").alias("word"))
    grams = words.select("id", "toxic", F.explode(_grams(F.col("word"))).alias("gram")).distinct()
    tally = grams.groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # Share of toxic documents against that of clean ones; half a document and a half more on either side.
    tally = tally.where("t > 0").select(
        "gram", (F.log((F.col("t") + 0.5) / (size[1] + 1)) - F.log((F.col("c") + 0.5) / (size[0] + 1))).alias("for_"), "t"
    ).where("for_ > 1.5")
    toxic = words.where("toxic = 1").select("id", "word", F.explode(_grams(F.col("word"))).alias("gram"))
    strong = toxic.join(tally, "gram").groupBy("id", "word").agg(F.max(F.struct("t", "for_")).alias("best"))
    # The expression of each toxic document that most others share and clean ones lack.
    chosen = strong.groupBy("id").agg(F.max_by("word", F.struct("best.t", "best.for_", "word")).alias("word"))
    first = [r[0] for r in chosen.groupBy("word").count().orderBy(F.desc("count"), "word").limit(POSITIVES).collect()]
    clean = words.where("toxic = 0").groupBy("word").count()
    common_words = clean.orderBy(F.desc("count"), "word").limit(NEGATIVES // 2).unionAll(clean.orderBy(F.xxhash64("word")).limit(NEGATIVES // 2))
    clean_words = common.stored(clean.select("word"), "clean")
    negative = sorted({r[0] for r in common_words.collect()})
    positive = first
    if not positive:
        return nothing
    rng = np.random.default_rng(7)
    toxic_words = common.stored(words.where("toxic = 1").select("id", "word"), "toxic")
    for step in range(ROUNDS):
        gapped = [w[:i] + "xq.-*"[i % 2] + w[i:] for w in positive if len(w) > 3 for i in [1 + int(rng.integers(len(w) - 1))]]
        marks = sorted(set(rng.permutation(positive)[: LANDMARKS // 2]) | set(rng.permutation(negative)[: LANDMARKS // 2]))
        weights, offset = train(positive + [plain(w) for w in gapped], negative, [str(m) for m in marks])
        if step + 1 < ROUNDS:
            hard = _valued(clean_words, weights, offset).orderBy(F.desc("value"), "word").limit(NEGATIVES // 2)
            negative = sorted({*negative, *(r[0] for r in hard.select("word").collect())})
            best = _valued(toxic_words, weights, offset).groupBy("id").agg(F.max_by("word", F.struct("value", "word")).alias("word"))
            positive = [r[0] for r in best.groupBy("word").count().orderBy(F.desc("count"), "word").limit(POSITIVES).collect()]
            positive = sorted(set(positive) - set(negative)) or positive
    most = _valued(words, weights, offset).groupBy("id", "toxic").agg(F.max("value").alias("value")).select("toxic", "value").toPandas()
    return weights, offset, *_calibrated(most["value"].to_numpy(float), most["toxic"].to_numpy(float))


def _valued(words: DataFrame, weights: np.ndarray, offset: float) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast((weights, offset))

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(decision(batch.column("word").to_pylist(), *shared.value), pa.float32())]

    return words.mapInArrow(common.by_batch(columns, ["value"]), common.extend(words.schema, ("value", T.FloatType())))


def _calibrated(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the probability: the cut with fewest errors (its gap's middle) has the score ``THRESHOLD``."""
    by = np.argsort(value, kind="stable")
    value, toxic = value[by], toxic[by]
    wrong = np.r_[0, np.cumsum(toxic)] + np.r_[(1 - toxic).sum(), (1 - toxic).sum() - np.cumsum(1 - toxic)]
    ends = np.r_[value[0] - 1, value, value[-1] + 1]
    gap = ends[1:] - ends[:-1]
    cut = max(np.flatnonzero(wrong == wrong.min()), key=lambda i: gap[i])
    middle, slope = (ends[cut] + ends[cut + 1]) / 2, 4.0
    return slope, float(middle + np.log((1 - THRESHOLD) / THRESHOLD) / slope)


def scored(df: DataFrame, model: tuple, name: str = "score") -> DataFrame:
    """``df`` with the score of its ``text`` column; row by row, no shuffle."""
    common.prepared(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    cached: list = []

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        if not cached:
            cached.append(scorer(*shared.value))
        return [pa.array(cached[0](batch.column("text").to_pylist()), pa.float64())]

    df = df.select(*[c for c in df.columns if c != name])
    return df.mapInArrow(common.by_batch(columns, [name]), common.extend(df.schema, (name, T.DoubleType())))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    common.prepared(docs.sparkSession)
    model = fit(docs, labels)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    common.prepared(docs.sparkSession)
    model = fit(docs, labels)
    rows = scored(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return rows.where(F.col("score") < THRESHOLD).select("doc.*")
