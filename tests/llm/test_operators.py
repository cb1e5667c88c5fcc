"""Operators against brute force, round trips and held-out labels, on small tables with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import string
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from holdfast.llm import bpe, chat, common, decontaminate, jaccard, licenses, order, quality, sharding, toxicity, warc

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, uid string, rid long, n_words string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = [None, "", "  \n\t", "one two", "One TWO", "a" * 3000, "é " * 50, "x y z \x1c\x85 end"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        if rng.random() < 0.5:
            base[5:5] = passage
        for k in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(k * 2):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [out[-1]] * 12 + ["long " + " ".join(rng.choice(vocabulary) for _ in range(8000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 3 else None, t, ("en", None, "xx")[i % 3], "clash", 7, "clash") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def by_text(rows, docs):
    """Results of rows that can repeat, as sorted tuples."""
    return sorted(tuple(map(str, r)) for r in rows)


def test_bpe_equals_tiktoken_and_round_trips(docs):
    v = bpe.load()
    codec = tiktoken.Encoding("t", pat_str=v.pattern.pattern, mergeable_ranks=v.ranks, special_tokens={})
    found = bpe.encode(docs, ("token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")).collect()
    assert len(found) == docs.count()
    for r in found:
        ids = codec.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    again = bpe.decode(bpe.encode(docs)).where(F.col("text").isNotNull())
    assert again.where(F.col("decoded") != F.col("text").cast("binary")).count() == 0


def test_bpe_appends_and_edits():
    v, rng = bpe.load(), random.Random(2)
    codec = tiktoken.Encoding("t", pat_str=v.pattern.pattern, mergeable_ranks=v.ranks, special_tokens={})
    marks = list("aaab  \n\t'srtve1é中́.#ñ") + ["the", "ing", " of", "'ll"]
    for _ in range(150):
        data = "".join(rng.choice("abcdehinst") for _ in range(160)).encode()
        p = bpe.Prefixes(v, data[:70])
        p.append(data[70:])
        assert p.last == bpe.Prefixes(v, data).last
        a = rng.randrange(150)
        b, new = a + rng.randrange(6), bytes(rng.choice(b"abthe") for _ in range(rng.randrange(6)))
        p.replace(a, b, new)
        assert p.last == bpe.Prefixes(v, data[:a] + new + data[b:]).last
        text = "".join(rng.choice(marks) for _ in range(60))
        e = bpe.EditedText(v, text)
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randrange(5))
        e.replace(a, b, "the 'l")
        assert e.ids() == codec.encode_ordinary(text[:a] + "the 'l" + text[b:])
    long = bpe.Prefixes(v, b"thing" * 200)
    assert long.replace(500, 501, b"x") < 400


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(spark, labels):
    texts = [None, "", "a b c d e a b c d e f g", "x\nx\ny\n \n \nx", "# $ 100% <b>", "a a a a a a a", "r " * 300, "é😀 é😀\x0b\x1cz"]
    docs = spark.createDataFrame([(i, t, None, "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    for r in quality.quality(docs, labels).collect():
        assert tuple(r)[1:6] == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 1), (0, 500), (2, 300), (1, 40), (9, 2000), (30, 5000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        exact = 1.0 if r.k > r.n * 0.01 else sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_certified_cutoffs_reject_junk_and_keep_good(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(4000):
        bad = i % 5 == 0
        words = [f"v{rng.randrange(10**6)}" + ("!!" if bad else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en"))
        marks.append((i, 0 if bad else 1))
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] == bool(q) for i, q in marks)


def test_quality_counts_a_repeated_label_once(spark):
    text = "a good text of some words that nobody would ever want to reject at all"
    one = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    others = [(i, " ".join(f"w{i}x{j}!" for j in range(30)), "en") for i in range(2, 22)]
    docs = one.crossJoin(spark.range(5000)).drop("id").unionAll(one.withColumn("doc_id", F.lit(99).cast("long")))
    docs = docs.unionAll(spark.createDataFrame(others, docs.schema))
    found = quality.quality(docs, spark.createDataFrame([(1, 1), (99, 1)], "doc_id long, quality int"))
    assert found.where("not kept").count() == 0 and found.count() == 5021


def test_files_are_read_by_many_tasks(spark):
    listed = spark.range(2000).select(F.col("id").cast("string").alias("uri"))
    tasks = common.spread(spark, listed).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 4 and max(t["count"] for t in tasks) < 1000


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            up[find(b)] = find(a)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows))], len(least)


def test_jaccard_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, groups = brute_components(rows)
    assert by_text(jaccard.components_of(docs).collect(), docs) == by_text(expected, docs)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_jaccard_empty_and_unlinked(spark, docs):
    assert jaccard.components_of(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    assert by_text(jaccard.components_of(two).collect(), two) == [("1", "2", "1"), ("2", "0", "2"), ("3", "0", "3")]


def brute_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(13, len(v))
        grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        at = [i for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in grams] if m else []
        if at:
            ids.add(str(item))
            hit |= {p for i in at for p in range(i, i + m)}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), 0 < len(w) <= 20 * len(hit)


def test_decontamination_equals_brute_force(spark, docs, texts):
    long = texts[40].split()
    items = [(1, " ".join(long[3:30])), (2, " ".join(long[10:23]).upper()), (3, " ".join(long[5:8])), (4, None), (5, ""), (6, " ".join(long[:12])),
             (7, "one, two!"), (10, " ".join(texts[-1].split()[4000:4014])), (2, "nothing else"), (11, "zq " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark).collect()
    expected = [(r.doc_id, *brute_hits(r.text, items)) for r in docs.collect()]
    assert by_text(found, docs) == by_text(expected, docs)
    assert sum(r.contaminated for r in found) > 3
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in found)
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_sharding_law_slots_and_sizes(spark, docs):
    hot = docs.unionByName(docs.where("doc_id = 10").crossJoin(spark.range(120).select(F.lit(1).alias("_k"))).drop("_k"))
    rows = sharding.shard_documents(hot, 7).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == hot.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in hot.collect())
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_ring_overflow_moves_few_keys():
    keys = np.random.default_rng(1).integers(0, sharding.CELLS, 20_000)

    def placed(shards, slack):
        cells, owners = sharding.ring(shards, 64)
        arcs = sharding.arc_of_cell(cells)[keys]
        counts = collections.Counter(arcs.tolist())
        runs = sharding.walk(counts, owners, sharding.capacities(len(keys), shards, slack))
        load = collections.Counter()
        for _, a, b, shard, slot in runs:
            assert slot == load[shard]
            load[shard] += b - a
        assert sum(load.values()) == len(keys) and max(load.values()) <= max(sharding.capacities(len(keys), shards, slack))
        by = {arc: [(a, b, s) for x, a, b, s, _ in sorted(runs) if x == arc] for arc in counts}
        seen, out = collections.Counter(), []
        for arc in arcs.tolist():
            out.append(next(s for a, b, s in by[arc] if a <= seen[arc] < b))
            seen[arc] += 1
        return np.array(out)

    assert (placed(40, 0.25) != placed(41, 0.25)).mean() < 0.15


def test_warc_round_trip(spark):
    same = "<p>" + "same " * 40
    rows = [(5, "http://a/ b\n", same, "x"), (2, None, same, "x"), (9, "u", same, "x"), (2, None, same, "x"), (None, "n", same, "x"), (7, "u", None, "x"),
            (8, "u", "", "x"), (1, "u", "short", "x"), (3, "u", "short", "x"), (4, "u", "é" * 300_000, "x")]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} " + "text of a page " * 30, "x") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    archives = warc.write(pages)
    found = warc.read(spark, archives).collect()
    expected = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        group = [p for p, _, h, _ in rows if h == html and p is not None]
        first = min(group, default=None) if len(data) >= 100 else page
        revisit = first is not None and first != page
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert by_text([tuple(r)[:5] for r in found], pages) == by_text(expected, pages)
    assert all(bytes(r.payload) == b"" for r in found if r.record_type == "revisit")
    assert sum(r["bytes"] for r in archives.collect()) < sum(r["plain_bytes"] for r in archives.collect()) / 3
    uri = archives.first().uri
    with warc.files.reader(uri) as f:
        assert int.from_bytes(f.read(4), "little") == warc.SKIPPABLE
    assert warc.archived(pages.limit(0)).count() == 0


def test_chat_repair_costs_legality_and_long_conversations(spark, monkeypatch):
    rng = random.Random(4)
    for _ in range(100):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        best = min(
            sum(chat.COSTS[r][a][b] for r, a, b in zip(roles, (0, *s), s)) + chat.FINISH[s[-1]] for s in itertools.product((1, 2, 3), repeat=len(roles))
        )
        assert best == chat.borders([chat.matrix(roles)])[1] == chat.borders([chat.matrix(roles[:2]), chat.matrix(roles[2:])])[1]
    monkeypatch.setattr(chat, "SEGMENT", 16)
    names = ["system", "user", "assistant", "tool", None, " User "]
    rows = [(c if c else None, t if t % 7 else None, rng.choice(names), None if t == 3 else f"t{t}", "x") for c in range(4) for t in range((1, 9, 300, 2)[c])]
    rows += [(1, 2, "user", "again", "x")] * 3
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)
    found = sorted(chat.repair(turns).collect(), key=lambda r: (r.part, r.idx))
    assert len(found) == len(rows)
    for conv in {r.conv_id for r in found}:
        mine = [r for r in found if r.conv_id == conv]
        text = "".join(r.rendered for r in mine)
        state = 0
        for role in re.findall(r"<\|im_start\|>(\w+)\n", text):
            assert chat.STATES.index(role) in chat.NEXT[state]
            state = chat.STATES.index(role)
        assert state == chat.END and text.count("<|im_start|>") == text.count("<|im_end|>")
        codes = [{"system": 1, "user": 2, "assistant": 3}.get((r.role_in or "").strip().lower(), 0) for r in mine]
        assert {r.conversation_cost for r in mine} == {chat.borders([chat.matrix(codes)])[1]}
    assert chat.repair(turns.limit(0)).count() == 0


def test_chat_groups_stay_small(spark, monkeypatch):
    """A long conversation is reduced over several levels, to the same costs, and no group has more than FAN members."""
    monkeypatch.setattr(chat, "SEGMENT", 4)
    monkeypatch.setattr(chat, "FAN", 3)
    sizes, stored = [], common.stored

    def watched(df, label):
        out = stored(df, label)
        if label == "groups":
            sizes.append(out.agg(F.max(F.size("inside"))).first()[0])
        return out

    monkeypatch.setattr(common, "stored", watched)
    rng = random.Random(12)
    names = ["system", "user", "assistant", "tool"]
    rows = [(c, t, rng.choice(names), "x") for c, n in ((None, 5), (1, 400), (2, 1)) for t in range(n)]
    found = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert len(found) == len(rows) and len(sizes) > 2 and max(sizes) <= 3
    for conv in (None, 1, 2):
        mine = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.part, r.idx))
        codes = [(names.index(r.role_in) + 1) % 4 for r in mine]
        states = [chat.STATES.index(r.role) for r in mine]
        cost = chat.borders([chat.matrix(codes)])[1]
        assert {r.conversation_cost for r in mine} == {cost}
        assert sum(chat.COSTS[c][a][b] for c, a, b in zip(codes, (0, *states), states)) + chat.FINISH[states[-1]] == cost
        assert sum(r.rendered.count(chat.CLOSE) for r in mine) == sum(r.rendered.count("<|im_start|>") for r in mine)


def test_license_spans(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-header"]
    changed = apache.replace("may not use", "must never use").replace("a copy of", "one copy of")
    texts = [None, "", "no license here", f"Code é. {mit}. Rest", "x " * 5000 + changed + " y" * 10, f"{mit} and {mit}"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    found = {r.doc_id: r for r in licenses.matches(docs).collect()}
    assert [found[i].n_matches for i in (0, 1, 2, 5)] == [0, 0, 0, 2]
    one = found[3].matches[0]
    assert one.license == "MIT" and one.coverage == 1.0 and texts[3][one.start : one.end] == mit
    header = next(m for m in found[4].matches if m.license == "Apache-2.0-header")
    assert 0.85 < header.coverage < 1 and texts[4][header.start : header.end].startswith("Licensed under")
    assert licenses.matches(docs.limit(0)).count() == 0


def test_license_index_loses_no_alignment():
    """Every alignment of enough words, at any shift, has a find of as many words over it."""
    rng = random.Random(6)
    one = licenses.Index(licenses.TEMPLATES)
    for text in ("Released under MIT License", "Released under an MIT License", "Licensed under the CC BY 4.0", "Licensed under the Apache Licence, Version 2.0"):
        assert licenses.scan(f"some words. {text}, more".encode(), one), text
    for name, text in licenses.TEMPLATES.items():
        index = licenses.Index({name: text})
        words, band = text.split(), index.bands[0]
        if len(index.words[0]) > 60:
            continue
        need = licenses.needed(len(index.words[0]), licenses.LEAST)
        for _ in range(10):
            edited = [w for w in words for w in [*["odd"] * rng.choice((0, 0, 0, 1)), *([w] if rng.random() < 0.92 else rng.choice(([], ["other"])))]]
            doc = " ".join(["and"] * rng.randrange(8) + edited + ["so", "on"] * rng.randrange(4) + edited[: rng.randrange(len(edited) + 1)])
            found = licenses.scan(doc.encode(), index)
            hashes = common.ALNUM.hashes(doc.encode()).tolist()
            for shift in range(-len(hashes), len(hashes)):
                m, first, last = licenses.aligned(index.words[0], hashes, shift, band)
                assert m < need or any(f["coverage"] * len(index.words[0]) > m - 0.5 and f["first_word"] <= last and f["last_word"] >= first for f in found), doc


def test_license_relatives_are_told_apart():
    index = licenses.Index(licenses.TEMPLATES)
    for text, name in {
        "licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
        "licensed under the GNU General Public License, version 2": "GPL-2.0",
        "licensed under the GNU General Public License, version 3": "GPL-3.0",
        "Released under the ISC License": "ISC",
        "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY 4.0": "CC-BY-4.0",
        "licensed under the Eclipse Public License v2.0": "EPL-2.0-short",
        licenses.TEMPLATES["LGPL-2.1-header"]: "LGPL-2.1-header",
    }.items():
        assert [m["license"] for m in licenses.scan(f"Some code. {text}; the end".encode(), index)] == [name]
    rng = random.Random(8)
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        assert [m["license"] for m in licenses.scan(" ".join(["head", *words, "tail"]).encode(), index)] == [name]
        if name.endswith("-text"):
            edited = " ".join(w if rng.random() < 0.95 else "other" for w in words)
            assert licenses.scan(edited.encode(), index)[0]["license"] == name


def test_training_order_is_a_permutation_and_reads_back(spark, docs):
    for n in (1, 2, 3, 7, 64, 1000):
        slots = order.slots(np.arange(n), n)
        assert sorted(slots) == list(range(n)) and (order.sequence_at(slots, n) == np.arange(n)).all()
    index = order.materialise(docs, length=64, per_shard=10)
    rows = {r.slot: r for r in index.collect()}
    back = {r.slot: bytes(r.ids) for r in order.read(spark, index, 0, 64, 10).collect()}
    assert sorted(rows) == list(range(len(rows))) == sorted(back) and len(rows) > 20
    assert all(zlib.crc32(back[s]) == r.crc32 and r.offset == s % 10 * 128 for s, r in rows.items())
    late = {r.slot for r in order.read(spark, index, 13, 64, 10).collect()}
    assert late == set(range(13, len(rows)))
    pieces = collections.defaultdict(list)
    for s, r in rows.items():
        ids = np.frombuffer(back[s], "<u2")
        for d in r.docs:
            pieces[d.doc_id].append((d["from"], ids[d.at : d.at + d.n].tolist()))
    codec, text = order.encoding(order.VOCABULARY), {r.doc_id: r.text for r in docs.collect()}
    for doc_id in (30, len(text) - 2):
        got = [i for _, part in sorted(pieces[doc_id]) for i in part]
        assert got == [*codec.encode_ordinary(text[doc_id]), order.SEPARATOR]
    assert order.ordered(docs.limit(0)).count() == 0


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST", 8)
    rows = [(i, f"text of {'abcdef'[i] * 5}") for i in range(6)] + [(1, "text of bbbbb")] * 50 + [(2, f"other{i} text") for i in range(40)] + [(4, None)] * 5
    marks = spark.createDataFrame([(i, int(i > 3)) for i in range(6)], "doc_id long, toxic int")
    sample = toxicity._sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), marks, F.lit(True)).collect()
    by = collections.Counter((r.toxic, tuple(r.words)) for r in sample)
    assert max(by.values()) == 1 and collections.Counter(r.toxic for r in sample) == {0: 8, 1: 3}
    assert all(any("abcdef"[i] * 5 in r.words for r in sample) for i in (0, 1, 3, 4, 5))


def test_toxicity_tolerates_gaps_and_nulls(spark, docs, labels):
    rng = random.Random(3)
    plain_words = ["the", "river", "stone", "garden", "yellow", "window", "market", "sailing", "number", "letters"]
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(plain_words) for _ in range(30)]
        if i % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(["grobnik", "zarkuf", "plimdot"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    extra = [(1000, "the grob-nik river"), (1001, "the g*r*o*b*n*i*k river"), (1002, "the zarrkuf river"), (1003, "river market stone"), (1004, ""), (1005, None)]
    table = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in toxicity.toxicity(table, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert all(found[i].predicted == t for i, t in marks)
    assert [found[i].predicted for i in range(1000, 1006)] == [1, 1, 1, 0, 0, 0]
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.predicted for r in none)


def test_word_hashes_follow_the_words():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("aB \n\t\x1cé9.😀") for _ in range(rng.randrange(60))).encode()
        for kind, pattern in ((common.SPACED, rb"[^\x20\x09-\x0d]+"), (common.ALNUM, rb"[0-9a-z\x80-\xff]+")):
            words = re.findall(pattern, text.lower())
            hashes = kind.hashes(text).tolist()
            assert len(hashes) == len(words) and len(set(hashes)) == len(set(words))
            assert {w: h for w, h in zip(words, hashes)} == {w: kind.hashes(w)[0] for w in words}
    far = b"ab " * 200_000 + b"q" * 600_000 + b" ab"
    assert len(set(common.SPACED.hashes(far).tolist())) == 2


def _families(spark, families):
    """Families of four near copies of 40 own words, all around one passage of 200 words: 0.7 similar from family to family."""
    passage, rows = [f"p{i}" for i in range(200)], []
    for f in range(families):
        own = [f"f{f}w{i}" for i in range(40)]
        for c in range(4):
            words = [*own[:20], *passage, *own[20:]]
            words[3] = f"f{f}c{c}"
            rows.append((4 * f + c, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_jaccard_families_around_a_passage_do_not_meet_each_other(spark, monkeypatch):
    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, label: made.append((label, out := stored(df, label))) or out)
    counts, dropped = [], common.dropped
    monkeypatch.setattr(common, "dropped", lambda *dfs: [counts.append((label, df.count())) for label, df in made if any(df is d for d in dfs)] or dropped(*dfs))
    seen = {}
    for families in (15, 30, 60):
        made.clear(), counts.clear()
        found = jaccard.components_of(_families(spark, families)).collect()
        assert {(r.doc_id, r.component_id) for r in found} == {(i, i // 4 * 4) for i in range(4 * families)}
        for label, n in counts:
            seen.setdefault(label, []).append(n)
    for label in ("met", "anchors"):
        assert seen[label][2] <= 5 * max(seen[label][0], 15), seen


def test_jaccard_counts_hashes_as_rows_beyond_the_ranges(docs, monkeypatch):
    expected = sorted(map(tuple, jaccard.components_of(docs).collect()), key=str)
    monkeypatch.setattr(jaccard, "RANGES", 1)
    assert sorted(map(tuple, jaccard.components_of(docs).collect()), key=str) == expected
