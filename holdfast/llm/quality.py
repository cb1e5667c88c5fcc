"""Operator 1: quality rules with risk-controlled cutoffs, DataFrame and SQL functions only.

Base rules are fixed (see ``base_failed``).  Further rules reject what exceeds a cutoff, and the cutoffs are learned: for
each stratum and rule a fixed chain of cutoffs, from lenient to strict, is tested on labelled documents.  A cutoff passes
while the exact binomial probability of seeing so few rejected good documents, if the true rate were ``ALPHA / rules``, is at
most ``DELTA / (strata * rules)``.  A chain ends at its first cutoff that does not pass (fixed-sequence testing), so
the only correction is over the chains.  With probability ``1 - DELTA`` the learned rules together reject at most a share
``ALPHA`` of the good documents of every stratum.  A chain without a passing cutoff rejects nothing.

The labelled documents are a holdout of the cutoffs: chains are constants, fixed before labels are seen.

Nulls: a null text has no words and fails the base rules; a null language belongs to the stratum ``other``; null ids have no
label; null labels are ignored, and of contradicting labels of one document the good one counts.  Repeated rows are
judged alike.  Empty tables give empty results.  All counts are taken from whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import common

#: Share of good documents that learned rules may reject in a stratum, and probability that the guarantee fails.
ALPHA, DELTA = 0.02, 0.05
#: Languages with strata of their own; all others, also null, share one.  At most ``len + 1`` strata, whatever the data.
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
#: Rules: measure in thousandths, and chains of cutoffs from lenient to strict; a document fails above the cutoff.
CHAINS = {
    "symbols_per_word": (4000, 2000, 1000, 700, 500, 350, 250, 180, 120, 80, 50, 30),
    "repeated_words": (190, 160, 130, 110, 90, 70, 50, 40, 30, 20),
    "repeated_lines": (900, 700, 500, 400, 300, 250, 200, 150, 100),
    "upper_letters": (950, 900, 800, 700, 600, 500, 400, 300, 200, 150),
    "exclamations_per_word": (1000, 800, 600, 400, 300, 200, 150, 100, 70, 50),
    "frequent_word": (900, 700, 500, 400, 350, 300, 250, 200),
}

_LONG = "long"


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, size: int = 5) -> Column:
    """Words that stand in a window of ``size`` words found twice or more, first occurrence included.

    Windows are compared by 64-bit hashes.  Only texts with a repeated window are sorted.
    """

    def hashed(w: Column) -> Column:
        last = F.size(w) - size
        return F.when(last < 1, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # Neighbours in hash order of equal hash: their places, in text order.
        places = bound(placed, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"])))
        total = F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda acc, i: F.struct((acc["n"] + i + size - F.greatest(i, acc["to"])).alias("n"), (i + size).alias("to")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

    return bound(words, lambda w: bound(hashed(w), covered))


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (with a ``text``) and the counts of the base rules and of the learned rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("_w", common.words_of(F.col("text")))
    joined = F.concat_ws("", "_w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(chars: str, of: Column) -> Column:
        return F.length(of) - F.length(F.regexp_replace(of, chars, ""))

    most = bound(F.sort_array("_w"), lambda s: F.aggregate(
        s, F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("top")),
        lambda a, x: bound(F.when(a["w"] == x, a["run"] + 1).otherwise(1), lambda r: F.struct(x.alias("w"), r.alias("run"), F.greatest(a["top"], r).alias("top"))),
        lambda a: a["top"]))
    return rows.select(
        *[c for c in rows.columns if c != "_w"],
        F.size("_w").cast(_LONG).alias("n_words"),
        F.length(joined).cast(_LONG).alias("word_chars"),
        without(r"[#*$%&|<>]", text).cast(_LONG).alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast(_LONG).alias("n_dup_lines"),
        repeat_words(F.col("_w")).cast(_LONG).alias("n_repeat_words"),
        F.size(lines).cast(_LONG).alias("n_lines"),
        without(r"[A-Z]", text).cast(_LONG).alias("n_upper"),
        without(r"!", text).cast(_LONG).alias("n_exclaim"),
        most.cast(_LONG).alias("n_frequent"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Numerator and denominator of each rule's measure.
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_letters": ("n_upper", "word_chars"),
    "exclamations_per_word": ("n_exclaim", "n_words"),
    "frequent_word": ("n_frequent", "n_words"),
}


def stratum() -> Column:
    return F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(OTHER)


def exceeds(rule: str, cutoff: Column) -> Column:
    """Whether a row's measure is above a cutoff; whole numbers on both sides."""
    over, under = MEASURES[rule]
    return 1000 * F.col(over) > cutoff * F.col(under)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series from 8 on."""
    y = x + 8
    shift = reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p).

    From k downwards each term is smaller than the one before by at least the factor k (1 - p) / ((n - k + 1) p); terms far
    below the largest are beyond double precision and end the sum, whose length grows as the root of n.
    """
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p)))
    steps = F.least(k, 40 * F.sqrt(n * p) + 100).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    # Above the mean the sum starts in the middle of the distribution and is no small probability: nothing to certify.
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def certified(good: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff) of every chain with a passing cutoff, from measured good documents with their stratum.

    ``good`` is aggregated at once into one row for each stratum; all that follows has strata x rules x cutoffs rows.
    """
    counts = [
        F.count_if(exceeds(rule, F.lit(c))).alias(f"{rule}:{i}") for rule, chain in CHAINS.items() for i, c in enumerate(chain)
    ]
    by = good.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    flat = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"`{rule}:{i}`").alias("k"))
        for rule, chain in CHAINS.items() for i, c in enumerate(chain)
    ])
    tests = by.select("stratum", "n", F.inline(flat))
    level = DELTA / ((len(STRATA) + 1) * len(CHAINS))
    tests = tests.withColumn("passes", binomial_tail(F.col("k"), F.col("n"), ALPHA / len(CHAINS)) <= level)
    stop = F.min(F.when(~F.col("passes"), F.col("step"))).over(Window.partitionBy("stratum", "rule"))
    kept = tests.withColumn("stop", F.coalesce(stop, F.lit(1 << 30))).where("step < stop")
    return kept.groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, keep_row: bool = False) -> DataFrame:
    """(doc, measures, base_failed, kept) of all documents; ``doc`` is the whole row with ``keep_row``, else the id.

    Texts are measured once, into a stored table; learning and judging read its narrow columns.
    """
    doc = F.struct(*(docs.columns if keep_row else ["doc_id"])).alias("doc")
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("text_key")
    rows = docs.select(doc, F.col("doc_id").alias("id"), stratum().alias("stratum"), key, "text")
    rows = common.stored(measured(rows).drop("text").withColumn("base_failed", base_failed()), "measured")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max("quality").alias("quality")).where("quality = 1").select("id")
    # What the base rules reject is out of the learned rules' reach.  Repeated rows and copies of a text are one trial, not several.
    good = rows.drop("doc").where(~F.col("base_failed")).join(marks, "id", "left_semi").dropDuplicates(["stratum", "text_key"])
    cutoffs = certified(good).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    rows = rows.join(F.broadcast(cutoffs), "stratum", "left")  # at most len(STRATA) + 1 rows
    rejected = reduce(lambda a, b: a | b, [F.coalesce(exceeds(r, F.col("cut")[r]), F.lit(False)) for r in CHAINS])
    return rows.withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    return judged(docs, labels).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return judged(docs, labels, keep_row=True).where("kept").select("doc.*")


def oracle() -> str:
    """The contract's result as DuckDB SQL."""
    tests = " UNION ALL ".join(
        f"SELECT stratum, '{rule}' AS rule, {i} AS step, {c} AS cutoff, n, count(*) FILTER (1000 * {MEASURES[rule][0]} > {c} * {MEASURES[rule][1]}) AS k FROM good JOIN (SELECT stratum, count(*) AS n FROM good GROUP BY 1) USING (stratum) GROUP BY stratum, n"
        for rule, chain in CHAINS.items() for i, c in enumerate(chain)
    )
    p, level = ALPHA / len(CHAINS), DELTA / ((len(STRATA) + 1) * len(CHAINS))
    reject = " OR ".join(
        f"coalesce(1000 * {a} > (SELECT cutoff FROM chosen c WHERE c.stratum = v.stratum AND c.rule = '{r}') * {b}, false)" for r, (a, b) in MEASURES.items()
    )
    langs = ", ".join(f"'{s}'" for s in STRATA)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    CASE WHEN lang IN ({langs}) THEN lang ELSE '{OTHER}' END AS stratum,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM windows) WHERE k > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
tops AS (SELECT rid, max(k) AS n FROM (SELECT rid, x, count(*) AS k FROM (SELECT rid, unnest(w) AS x FROM d) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT d.rid, doc_id, stratum, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
    coalesce(hit.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim,
    coalesce(tops.n, 0) AS n_frequent
    FROM d LEFT JOIN lines USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN tops USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
good AS (SELECT DISTINCT ON (stratum, t) * FROM v JOIN d USING (rid, doc_id, stratum) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS ({tests}),
tail AS (SELECT *, CASE WHEN k > n * {p!r} THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({p!r}) + (n - i) * ln(1 - {p!r})) for i in range(0, k + 1)]) END AS prob FROM tests),
ends AS (SELECT stratum, rule, coalesce(min(step) FILTER (prob > {level!r}), 1000000) AS stop FROM tail GROUP BY 1, 2),
chosen AS (SELECT stratum, rule, max_by(cutoff, step) AS cutoff FROM tail JOIN ends USING (stratum, rule) WHERE step < stop GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({reject}) AS kept FROM v
"""
