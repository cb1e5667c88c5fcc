"""Security identity: as-filed variants, the current spelling, and the class of a CUSIP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import values as v
from holdfast.operators.keys import latest_per_key
from holdfast.schemas import CLASS_RULES, UNCLASSIFIED

VARIANT_KEY = ["cusip", "reportcalendarorquarter", "nameofissuer", "titleofclass", "figi"]


def security_variants(lines: DataFrame) -> DataFrame:
    """Occurrences of every (CUSIP, report quarter, issuer, class, FIGI) spelling, from lines that know their cover.

    Filings of one quarter stand together and repeat each other's spellings, so counting shrinks before the exchange.
    """
    return lines.filter("has_cover = 1").groupBy(*VARIANT_KEY).agg(F.count("*").alias("occurrence_count"))


def current_variant(variants: DataFrame) -> DataFrame:
    """The spelling shown for a CUSIP: newest report quarter, then most used, then alphabetical.

    The report date is ranked on its text parts; a month that ends no quarter ranks lowest.
    """
    day = F.col("reportcalendarorquarter")
    month = F.substring(day, 4, 3)
    month_rank = (
        F.when(month == "DEC", 12).when(month == "SEP", 9).when(month == "JUN", 6).when(month == "MAR", 3).otherwise(0)
    )
    order = [
        F.substring(day, 8, 4).desc(),
        month_rank.desc(),
        F.substring(day, 1, 2).desc(),
        F.col("occurrence_count").desc(),
        F.col("nameofissuer"),
        F.col("titleofclass"),
        F.coalesce("figi", F.lit("")),
        day,
    ]
    return latest_per_key(variants, ["cusip"], order).select(
        "cusip",
        F.col("nameofissuer").alias("current_nameofissuer"),
        F.col("titleofclass").alias("current_titleofclass"),
        F.col("figi").alias("current_figi"),
        "reportcalendarorquarter",
        "occurrence_count",
    )


def holding_identity(lines: DataFrame, managers: DataFrame) -> DataFrame:
    """Every as-filed line with its manager and the id of its variant.

    The id is a hash of the line's own columns, so no join finds it; managers are one row each.
    """
    names = managers.select(F.col("cik").alias("manager_cik"), "manager_name")
    return (
        lines.filter("has_submission = 1").join(names, "manager_cik", "left")
        .withColumn("filing_manager_name", F.coalesce("manager_name", "filingmanager_name"))
        .withColumn("cusip_variant_id", F.when(F.col("has_cover") == 1, variant_id()))
        .withColumnRenamed("manager_cik", "filing_manager_cik")
        .drop("manager_name", "filingmanager_name")
    )


def with_variant_counts(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """How often each line's exact spelling occurs (NULL-safe on FIGI)."""
    known = variants.select(
        *[F.col(c).alias(f"v_{c}") for c in VARIANT_KEY], F.col("occurrence_count").alias("variant_occurrence_count")
    )
    match = [F.col(c) == F.col(f"v_{c}") for c in VARIANT_KEY if c != "figi"]
    match.append(F.col("figi").eqNullSafe(F.col("v_figi")))
    return rows.join(known, match, "left").drop(*[f"v_{c}" for c in VARIANT_KEY])


def variant_id() -> Column:
    """Surrogate id of a spelling: a hash of its natural key, so it never depends on load order."""
    return F.xxhash64(*[F.coalesce(c, F.lit("")) for c in VARIANT_KEY])


def matching_rule(rules: list[tuple] = CLASS_RULES) -> Column:
    """First rule in (priority, id) order that fits a spelling, as (rule_id, security_type_id) or NULL.

    For the reviewed list of a handful of rows held in code: one CASE expression instead of a join.  A rule table goes
    through ``ruled_by_table``.
    """
    text = {name: v.normalized_text(name) for name in ("titleofclass", "nameofissuer")}

    def fits(field: str, match_type: str, pattern: str) -> Column:
        plain, field = v.normalized_text(F.lit(pattern)), field.lower()
        if match_type == "EXACT":
            return text[field] == plain
        if match_type == "CONTAINS":
            return F.contains(text[field], plain)
        if match_type == "REGEX":
            return text[field].rlike(f"(?i){pattern}")
        raise ValueError(f"unknown match type {match_type}")

    branches = []
    for rule_id, _, field, match_type, pattern, type_id in sorted(rules, key=lambda r: (r[1], r[0])):
        hit = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(type_id).alias("security_type_id"))
        branches.append(F.when(fits(field, match_type, pattern), hit))
    return F.coalesce(*branches)


#: Length of the pieces that CONTAINS patterns are found by, and copies of REGEX rules that texts are dealt out to.
GRAM, SPREAD = 3, 32


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    last = F.length(text) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def active_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, priority, field, match_type, pattern, type_id) of active rules; an unknown kind or field fails the job."""
    kind, field = F.upper("match_type"), F.lower("field_name")
    wrong = F.raise_error(F.concat(F.lit("unknown match type or field in rule "), F.col("rule_id").cast("string")))
    known = kind.isin("EXACT", "CONTAINS", "REGEX") & field.isin("titleofclass", "nameofissuer")
    return rules.filter("is_active = 1").select(
        F.col("rule_id").cast("int").alias("rule_id"), F.col("priority").cast("int").alias("priority"), field.alias("field"),
        F.when(F.coalesce(known, F.lit(False)), kind).otherwise(wrong).alias("match_type"),
        F.when(kind == "REGEX", F.concat(F.lit("(?i)"), "match_pattern")).otherwise(v.normalized_text("match_pattern")).alias("pattern"),
        F.col("security_type_id").cast("int").alias("type_id"),
    )


def matches_of_texts(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule in (priority, id) order for each distinct (field, text), as ``rule``; texts without one are left out.

    EXACT patterns are found by an equi join.  A CONTAINS pattern is looked up by its piece of ``GRAM`` characters (all of
    a shorter pattern) that the fewest texts have, and then compared.  Only REGEX patterns are tried on every text of their
    field; the texts are dealt out to ``SPREAD`` copies of those rules, so that no task gets all texts of a field.
    """
    exact = texts.join(
        rules.filter("match_type = 'EXACT'").withColumnRenamed("pattern", "text"), ["field", "text"]
    ).select("field", "text", "priority", "rule_id", "type_id")

    sizes = F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])
    pieces = texts.select("field", "text", F.explode(sizes).alias("gram"))
    wanted = rules.filter("match_type = 'CONTAINS'").drop("match_type")
    own = F.when(F.length("pattern") >= GRAM, _grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))
    of_rules = wanted.select("rule_id", "field", F.explode(own).alias("gram"))
    common = pieces.join(of_rules.select("field", "gram").distinct(), ["field", "gram"], "left_semi")
    frequency = common.groupBy("field", "gram").agg(F.count("*").alias("texts"))
    rarest = of_rules.join(frequency, ["field", "gram"], "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0).cast("bigint")).alias("texts"), "gram")).alias("anchor")
    )
    anchored = wanted.join(rarest.filter("anchor.texts > 0"), "rule_id").withColumn("gram", F.col("anchor.gram"))
    contained = pieces.join(anchored, ["field", "gram"]).filter(F.contains("text", "pattern")).select(*exact.columns)

    copies = rules.filter("match_type = 'REGEX'").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = texts.withColumn("copy", F.pmod(F.xxhash64("text"), F.lit(SPREAD)).cast("int"))
    tried = dealt.join(copies, ["field", "copy"]).filter(F.rlike("text", F.col("pattern"))).select(*exact.columns)

    first = F.min(F.struct("priority", "rule_id", "type_id")).alias("rule")
    return exact.unionByName(contained).unionByName(tried).groupBy("field", "text").agg(first)


def ruled_by_table(spellings: DataFrame, rules: DataFrame) -> DataFrame:
    """``spellings`` with ``rule`` as ``matching_rule`` gives it, from a rule table of any length that never leaves Spark."""
    fields = ("titleofclass", "nameofissuer")
    spelled = spellings.withColumns({f"_{f}": v.normalized_text(f) for f in fields})
    texts = spelled.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("text")) for f in fields]))).distinct()
    best = matches_of_texts(texts, active_rules(rules))
    for f in fields:
        mine = best.filter(F.col("field") == f).select(F.col("text").alias(f"_{f}"), F.col("rule").alias(f"_rule_{f}"))
        spelled = spelled.join(mine, f"_{f}", "left")
    won = F.least(*[F.col(f"_rule_{f}") for f in fields])
    rule = F.when(won.isNotNull(), F.struct(won["rule_id"].alias("rule_id"), won["type_id"].alias("security_type_id")))
    return spelled.select(*spellings.columns, rule.alias("rule"))


def classify_securities(
    variants: DataFrame, overrides: DataFrame | None = None, rules: list[tuple] | DataFrame = CLASS_RULES
) -> DataFrame:
    """Class of each CUSIP: manual override, else the type most lines vote for, else unknown.

    Votes are weighted by occurrences.  Ties go to the lower type id, inside the type
    to the lower rule id.  Each step aggregates, so no task ever sees a whole CUSIP.
    """
    spellings = variants.groupBy("cusip", "nameofissuer", "titleofclass").agg(
        F.sum("occurrence_count").alias("votes")
    )
    ruled = ruled_by_table(spellings, rules) if isinstance(rules, DataFrame) else spellings.withColumn("rule", matching_rule(rules))
    voted = ruled.groupBy("cusip", "rule").agg(
        F.sum("votes").alias("votes")
    )
    by_type = voted.groupBy("cusip", F.col("rule.security_type_id").alias("type_id")).agg(
        F.sum("votes").alias("type_votes"),
        F.min(F.struct((-F.col("votes")).alias("order"), F.col("rule.rule_id").alias("rule_id"))).alias("best_rule"),
    )
    is_vote = F.col("type_id").isNotNull()
    best = F.min(
        F.when(
            is_vote,
            F.struct((-F.col("type_votes")).alias("order"), F.col("type_id"), F.col("best_rule.rule_id")),
        )
    )
    tally = by_type.groupBy("cusip").agg(
        F.sum("type_votes").alias("total"),
        F.sum(F.when(is_vote, F.col("type_votes")).otherwise(F.lit(0).cast("bigint"))).alias("matched"),
        best.alias("best"),
    )
    manual = F.lit(None).cast("int")
    if overrides is not None:
        chosen = overrides.select("cusip", F.col("security_type_id").cast("int").alias("manual_type"))
        tally = tally.join(chosen, "cusip", "left")
        manual = F.col("manual_type")
    forced, has_vote = manual.isNotNull(), F.col("best").isNotNull()
    winning = F.when(forced, F.col("total")).when(has_vote, -F.col("best.order")).otherwise(F.lit(0))
    return tally.select(
        "cusip",
        F.coalesce(manual, F.col("best.type_id"), F.lit(UNCLASSIFIED)).cast("int").alias("security_type_id"),
        F.when(forced, "CUSIP_OVERRIDE").when(has_vote, "RULE_VOTE").otherwise("UNKNOWN").alias(
            "classification_method"
        ),
        F.when(~forced, F.col("best.rule_id")).cast("int").alias("selected_rule_id"),
        F.col("total").alias("total_occurrence_count"),
        F.when(forced, F.col("total")).otherwise(F.col("matched")).alias("matched_occurrence_count"),
        winning.cast("bigint").alias("winning_occurrence_count"),
        F.coalesce(v.ratio(winning, "total"), F.lit(0.0)).alias("classification_confidence"),
    )
