"""Variants, current spelling and classification."""

import random

import pytest

from pyspark.sql import functions as F

from holdfast.operators import securities as s
from holdfast.schemas import CLASS_RULES
from tests.conftest import dicts

VARIANT = """cusip string, reportcalendarorquarter string, nameofissuer string, titleofclass string, figi string,
    occurrence_count bigint"""


def variants(spark, *rows):
    return spark.createDataFrame(list(rows), VARIANT)


def classify(spark, *spellings, overrides=None):
    rows = [("C", "31-MAR-2023", issuer, cls, None, n) for issuer, cls, n in spellings]
    return s.classify_securities(variants(spark, *rows), overrides).first()


def test_current_variant_prefers_newest_then_most_used(spark):
    v = variants(
        spark,
        ("A", "31-MAR-2023", "OLD", "COM", None, 99),
        ("A", "30-JUN-2023", "FIVE", "COM", None, 5),
        ("A", "30-JUN-2023", "SEVEN", "COM", None, 7),
        ("A", "31-JUL-2023", "ODD MONTH", "COM", None, 999),
        ("B", "31-DEC-2022", "B2", "COM", "F", 1),
        ("B", "31-DEC-2022", "B1", "COM", "F", 1),
        ("D", "31-DEC-2022", "D", "COM", "F", 1),
        ("D", "31-DEC-2022", "D", "COM", None, 1),
    )
    found = {r["cusip"]: r for r in dicts(s.current_variant(v))}
    assert found["A"]["current_nameofissuer"] == "SEVEN" and found["A"]["occurrence_count"] == 7
    assert found["B"]["current_nameofissuer"] == "B1"
    assert found["D"]["current_figi"] is None


def test_vote_tie_goes_to_the_lower_type(spark):
    row = classify(spark, ("X", "COM", 10), ("X", "PFD", 10), ("X", "???", 20))
    assert (row.security_type_id, row.selected_rule_id, row.classification_method) == (1, 7, "RULE_VOTE")
    assert (row.total_occurrence_count, row.matched_occurrence_count, row.winning_occurrence_count) == (40, 20, 10)
    assert row.classification_confidence == 0.25


def test_earlier_rule_wins_within_one_spelling(spark):
    row = classify(spark, ("X", "ADR PFD", 1))
    assert (row.security_type_id, row.selected_rule_id) == (3, 1)


def test_rule_inside_the_winning_type_is_chosen_by_votes(spark):
    row = classify(spark, ("ISHARES TR", "SHS", 5), ("X", "S&P etf", 3))
    assert (row.security_type_id, row.selected_rule_id, row.winning_occurrence_count) == (2, 5, 8)


def test_unknown_and_override(spark):
    row = classify(spark, ("X", "???", 4))
    assert (row.security_type_id, row.classification_method, row.classification_confidence) == (99, "UNKNOWN", 0.0)
    manual = spark.createDataFrame([("C", 4)], "cusip string, security_type_id int")
    row = classify(spark, ("X", "COM", 4), overrides=manual)
    assert (row.security_type_id, row.classification_method, row.selected_rule_id) == (4, "CUSIP_OVERRIDE", None)
    assert (row.matched_occurrence_count, row.winning_occurrence_count, row.classification_confidence) == (4, 4, 1.0)


@pytest.mark.parametrize(
    "title,type_id",
    [("common  stock", 1), ("COMMON STOCKS", 1), ("cl a new", 1), ("CL AB", None), ("sponsored adr", 3),
     ("PFDX", None), ("EXCHANGE-TRADED NOTE", 2), ("EXCHANGETRADED", 2), ("fund", 9), ("MUTUAL FUND", None)],
)
def test_rule_patterns(spark, title, type_id):
    row = classify(spark, ("X", title, 1))
    assert row.security_type_id == (type_id or 99)


RULE = "rule_id int, priority int, field_name string, match_type string, match_pattern string, security_type_id int, is_active int"


def test_rule_tables_match_as_the_expression_does(spark):
    """Hundreds of random rules of all kinds against one CASE expression, with short, empty, blank and inactive patterns."""
    rng = random.Random(4)
    letters = "ABC "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rules = [
        (i, rng.randrange(5), rng.choice(("titleofclass", "NAMEOFISSUER")), kind, text(rng.choice((0, 1, 2, 3, 4, 6))) if kind != "REGEX" else rf"\b{text(2).strip() or 'A'}+", rng.randrange(1, 9), int(rng.random() < 0.8))
        for i in range(400) for kind in [("CONTAINS", "EXACT", "EXACT", "REGEX")[rng.randrange(4) if i % 10 else 3]] if kind != "CONTAINS" or i % 7 == 0
    ]
    rows = [(text(rng.randrange(9)) or None, text(rng.randrange(5)).lower()) for _ in range(300)] + [("x", "y"), (None, None)]
    spellings = spark.createDataFrame(rows, "titleofclass string, nameofissuer string").repartition(3)
    for some in (rules, rules[:40], [r for r in rules if r[3] != "CONTAINS" or r[4].strip()][:30], []):
        expected = [(r[0], r[1], r[2].lower(), r[3], r[4], r[5]) for r in some if r[6]]
        want = spellings.withColumn("rule", s.matching_rule(expected) if expected else F.lit(None).cast("struct<rule_id:int,security_type_id:int>"))
        got = s.ruled_by_table(spellings, spark.createDataFrame(some, RULE))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_unknown_rule_kinds_fail(spark):
    spellings = spark.createDataFrame([("A", "B")], "titleofclass string, nameofissuer string")
    bad = spark.createDataFrame([(1, 1, "titleofclass", "LIKE", "A", 2, 1)], RULE)
    with pytest.raises(Exception, match="unknown match type or field in rule 1"):
        s.ruled_by_table(spellings, bad).collect()
    off = spark.createDataFrame([(1, 1, "titleofclass", "LIKE", "A", 2, 0)], RULE)
    assert s.ruled_by_table(spellings, off).first().rule is None


def test_built_in_rules_as_a_table_classify_alike(spark, warehouse):
    table = spark.createDataFrame([(*r, 1) for r in CLASS_RULES] + [(99, 0, "titleofclass", "CONTAINS", "COM", 4, 0)], RULE)
    found = s.classify_securities(warehouse.variants, None, table)
    assert sorted(map(str, found.collect())) == sorted(map(str, s.classify_securities(warehouse.variants).collect()))


def test_exact_and_contains_rules(spark):
    rules = [(1, 1, "titleofclass", "EXACT", " unit  a", 9), (2, 2, "nameofissuer", "CONTAINS", "gold", 2)]
    df = spark.createDataFrame([("Unit A", "x"), ("UNIT AB", "Big gold co"), ("z", "z")], "titleofclass string, nameofissuer string")
    got = [r[0] for r in df.select(s.matching_rule(rules).getField("rule_id")).collect()]
    assert got == [1, 2, None]


def test_missing_figi_matches_only_missing_figi(spark, warehouse):
    w = warehouse
    rows = s.with_variant_counts(s.holding_identity(w.lines, w.manager_dim), w.variants)
    assert rows.count() == w.infotable.count()
    assert rows.filter("variant_occurrence_count IS NULL").count() == 0
    assert rows.filter("figi IS NULL").count() > 0
    ids = rows.select("cusip_variant_id", *s.VARIANT_KEY).distinct()
    assert ids.filter("cusip_variant_id IS NULL").count() == 0 and ids.count() == ids.select("cusip_variant_id").distinct().count()
