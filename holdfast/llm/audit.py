"""Operator 13: interaction audit of document filters by the Hart-Mas-Colell potential, DataFrame functions only.

The removal game gives every coalition S of filters the number v(S) of documents that at least one filter of S fails.
Documents are counted once by (part, set of failed filters); v of all ``2^n`` coalitions, the potential

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,   P(empty) = 0,

and every step of every order follow from those few counts.  Filter i has Shapley value P(all) - P(all without i), and
in an order it removes v(before and i) - v(before).  Potentials are kept as whole numbers, |S|! P(S).

Texts are measured once, in one pass that keeps an id, a language, a digest and a bit mask per document.  Copies are told
by SHA-256.  A text copied by a third of the rows is one row per task before it is shuffled: the smallest id of each
digest is a partial aggregate, and (id, digest) pairs, not digests, are joined back.

Nulls: a null text is the empty text, a null language the part ``''``; a null id is no smaller and no larger than
another, so its row never fails E, and it has no label.  Repeated rows count once each and do not make each other fail
E, because their ids are equal.  Of several label rows of one id a 1 counts.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm import common

FILTERS = "ABCDE"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): bits 1, 2, 4, 8 say that A, B, C, D fail; E needs the whole table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = common.words_of(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), words.alias("w"))
    n = F.size("w")
    conditions = (
        n < 100,
        100 * F.size(F.array_distinct("w")) < 80 * n,
        100 * F.regexp_count("t", F.lit("[A-Z]")) > 10 * F.length("t"),
        F.col("t").rlike("[#$%&*|]"),
    )
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]).alias("mask"),
    )


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with ``bit`` added to the mask where a smaller doc_id has the same digest."""
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = rows.join(first, ["doc_id", "digest"], "left")
    return joined.withColumn("mask", F.col("mask") + F.when(copy, bit).otherwise(0)).drop("first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 0 or 1."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    return rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders and steps, from (part, mask, n, good, toxic) with one row for each part and mask; at most six filters.

    A part is one row from here on: at most ``2^len(filters)`` counts, whatever the table's size.
    """
    size = len(filters)
    everything = (1 << size) - 1
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    coalitions = F.sequence(F.lit(0), F.lit(everything))

    def game(name: str) -> Column:
        """v(S) of every coalition, by number."""
        return F.transform(coalitions, lambda s: F.aggregate(
            "c", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(s) != 0, x[name]).otherwise(0)))

    def potentials(v: Column) -> Column:
        """|S|! P(S) of every coalition; those without one member have smaller numbers."""
        weights = F.array(*[F.lit(factorial(max(k - 1, 0))).cast("long") for k in range(size + 1)])

        def one(q: Column, s: Column) -> Column:
            less = [F.when(s.bitwiseAND(1 << i) != 0, F.get(q, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0) for i in range(size)]
            return F.concat(q, F.array(F.get(weights, F.bit_count(s)) * F.get(v, s) + reduce(lambda a, b: a + b, less)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(everything)), F.array(F.lit(0).cast("long")), one)

    parts = parts.select("part", "c", *[game(x).alias(x) for x in ("n", "good", "toxic")])
    parts = parts.withColumn("q", potentials(F.col("n")))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    parts = parts.withColumn("total", total)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    place = {f: 1 << i for i, f in enumerate(filters)}
    bit = F.expr(f"shiftleft(1, instr('{filters}', substring(filter_order, step, 1)) - 1)")
    before = reduce(lambda a, b: a + b, [F.when(F.expr(f"instr(filter_order, '{f}') < step"), place[f]).otherwise(0) for f in filters])
    steps = steps.withColumns({"bit": bit, "before": before}).withColumn("after", F.col("bit") + F.col("before"))

    def here(game: str) -> Column:
        return F.get(game, F.col("after")) - F.get(game, F.col("before"))

    alone = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"] == F.col("bit"), x["n"]).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("n", F.col("after"))).alias("kept"),
        here("n").alias("removed"),
        (F.get("n", F.col("bit")) - here("n")).alias("redundant"),
        alone.alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        (F.get("q", F.lit(everything)) - size * F.get("q", F.lit(everything) - F.col("bit"))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step of the five filters over whole ``docs``."""
    rows = with_copies(common.stored(failures(docs), "failures"), 16)
    counts = with_labels(rows, labels).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    return interactions(counts)


#: The same counts by walking all orders.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, t, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
u AS (SELECT o, i AS step, o[i] AS k, o[1:i - 1] AS before FROM o, x),
r AS (SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step, k,
    sum(n) FILTER (NOT fails[k] AND NOT was) AS kept, sum(n) FILTER (fails[k] AND NOT was) AS removed, sum(n) FILTER (fails[k] AND was) AS redundant,
    sum(n) FILTER (fails[k] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails,
    sum(good) FILTER (fails[k] AND NOT was) AS good_lost, sum(toxic) FILTER (fails[k] AND NOT was) AS toxic_lost
    FROM (SELECT *, len(list_filter(before, lambda j: fails[j])) > 0 AS was FROM m, u) GROUP BY 1, 2, 3, 4),
z AS (SELECT part, k, sum(coalesce(removed, 0)) AS shapley FROM r GROUP BY 1, 2)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN z USING (part, k)
"""
