"""Filter interactions against a walk over all orders."""

import itertools
import random
from fractions import Fraction

from holdfast.llm import audit


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    out, parts = [], {}
    for d, text, lang in docs:
        text = text or ""
        words = [w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        fails = "".join(
            name for name, bad in {
                "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                "D": any(c in "#$%&*|" for c in text), "E": d is not None and first[text] < d,
            }.items() if bad
        )
        parts.setdefault(lang or "", []).append((d, fails))
    for part, rows in parts.items():
        orders = {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                seen = [r for r in rows if f in r[1]]
                left = [r for r in left if f not in r[1]]
                orders["".join(order), step] = (len(left), len(gone), len(seen) - len(gone), sum(x == f for _, x in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
        shapley = {f: sum(v[1] for (o, s), v in orders.items() if o[s - 1] == f) for f in "ABCDE"}
        out += [(part, o, s, *v, shapley[o[s - 1]]) for (o, s), v in orders.items()]
    return sorted(out)


def test_audit_equals_walk_over_orders(spark):
    rng = random.Random(9)
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((5, 120, 130)))]
        if rng.random() < 0.3:
            words = words[:3] * (len(words) // 3)
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        text = (" ", "\n", "\x0b")[i % 3].join(words) + ("#" if rng.random() < 0.3 else "")
        docs.append((i, text, rng.choice(("en", "de", None, ""))))
    docs += [(100 + i, docs[i][1], docs[i + 1][2]) for i in range(8)] + [(i, docs[i][1], "en") for i in range(3)]
    docs += [(None, docs[0][1], "en"), (None, None, None), (200, None, "en"), (201, "", "fr"), (202, "long " * 30_000, "en")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 0, 0), (None, 1, 1), (200, None, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' AS mask", "1 AS part", "2 AS good", "3 AS w").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part")
    found = audit.filter_audit(table, marks)
    assert dict(found.dtypes)["step"] == "int"
    assert sorted(map(tuple, found.collect())) == brute(docs, labels)
    assert audit.filter_audit(table.limit(0), marks).count() == 0
    assert {r.good_lost + r.toxic_lost for r in audit.filter_audit(table, marks.limit(0)).collect()} == {0}


def test_potential_gives_shapley_values_of_other_sizes(spark):
    """Three filters; values also as sums over orders with fractions."""
    counts = {0: 5, 1: 3, 2: 2, 3: 7, 4: 1, 5: 4, 6: 6, 7: 2}
    rows = spark.createDataFrame([("p", m, n, 0, 0) for m, n in counts.items()], "part string, mask int, n long, good long, toxic long")
    found = audit.interactions(rows, "XYZ").collect()
    assert len(found) == 18
    for i, f in enumerate("XYZ"):
        value = Fraction(sum(n * Fraction(1, m.bit_count()) for m, n in counts.items() if m >> i & 1))  # each document is shared by the filters it fails
        assert {Fraction(r.shapley, 6) for r in found if r.filter_order[r.step - 1] == f} == {value}
