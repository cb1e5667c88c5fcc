"""Alignment of two tokenizers against whole-text encoding and a union-find over all overlaps."""

import collections
import hashlib
import random

import numpy as np
import pytest

from holdfast.llm import align


def brute(texts):
    """Per text: ids of A and B, groups, links by comparing every pair of ranges."""
    both = align.Tokenizers()
    out = []
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(both.bytes_a[i] for i in a) != whole or b"".join(both.bytes_b[i] for i in b) != whole:
            out.append(([], [], "", [], 0))
            continue
        ranges = []
        for ids, sizes in ((a, both.sizes_a), (b, both.sizes_b)):
            ends = np.cumsum(sizes[ids]).tolist()
            ranges.append(list(zip([0, *ends], ends)))
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, start = [], 0
        for cut in cuts:
            sides = [",".join(str(i) for i, (s, e) in zip(ids, r) if start <= s and e <= cut) for ids, r in zip((a, b), ranges)]
            groups.append("|".join(sides))
            start = cut
        links = [(i, j) for i, (s, e) in zip(a, ranges[0]) for j, (u, v) in zip(b, ranges[1]) if s < v and u < e]
        out.append((a, b, ";".join(groups), links, len(groups)))
    return out


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    words = ["the", "unbelievable", "naïve", "日本語テキスト", "don't", "x=1;", "ﬁn", "\x00", "a\nb", "<|endoftext|>", "<s>", "😀é", "  ", "\t", "tokenizer's", "1234567"]
    texts = [None, "", " ", "  lead", "trail  ", "end\n", " nbsp mid  x", "a▁b c", "ok text", "ok text", "x" * 3000, "\n\n\n", "one  two   three", "é́ é", "<unk> <0x41>"]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]


@pytest.mark.parametrize("frequent,units", [(1 << 20, 400_000), (4, 20), (0, 400_000)])
def test_alignment_equals_brute_force(spark, odd_texts, monkeypatch, frequent, units):
    monkeypatch.setattr(align, "FREQUENT", frequent)
    monkeypatch.setattr(align, "UNITS", units)
    monkeypatch.setattr(align, "STEP_CHARS", 500)
    align._last.clear()
    rows = [(i if i % 9 else None, t, "clash", 5) for i, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows + rows[8:10], "doc_id long, text string, n_a string, _row long").repartition(3)
    found = align.aligned(docs, groups=True).collect()
    assert len(found) == len(rows) + 2
    texts = [t for _, t, _, _ in rows + rows[8:10]]
    want = brute(texts)
    pairs = collections.Counter(p for _, _, _, links, _ in want for p in links)
    most = collections.defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    expected = [
        (len(a), len(b), n, len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for a, b, g, links, n in want
    ]
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in found]
    assert sorted(got) == sorted(expected)
    assert align.alignment(docs.limit(0)).count() == 0


def test_pointer_jumping_labels_components():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 40)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n}) for _ in range(2)]
        a, b = (np.array(e) for e in ends)
        starts = [np.r_[0, e[:-1]] for e in (a, b)]
        label = align.terminals(a, starts[0], b, starts[1])
        left, right = align.links(a, starts[0], b, starts[1])
        every = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert list(zip(left.tolist(), right.tolist())) == every
        parent = list(range(len(a) + len(b)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in every:
            parent[root(i)] = root(len(a) + j)
        assert len({(root(i), label[i]) for i in range(len(parent))}) == len({root(i) for i in range(len(parent))}) == len(set(label.tolist()))
    long = np.arange(2, 20_001, 2), np.r_[np.arange(1, 20_000, 2), 20_000]  # one chain of 20,000 tokens
    assert len(set(align.terminals(long[0], long[0] - 2, long[1], np.r_[0, long[1][:-1]]).tolist())) == 1
