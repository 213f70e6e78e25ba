import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tilewright.llm import jaccard as J
from tilewright.llm.common import components


def brute(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, post = sorted(sets), defaultdict(list)
    for i in ids:
        for j, common in Counter(j for t in sets[i] for j in post[t]).items():
            if 100 * common >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for t in sets[i]:
            post[t].append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(60)]
    docs = []
    for i in range(n):
        words = [f"r{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 150, 400]))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = common
        docs.append(words)
    for i in range(n):
        words = list(rng.choice(docs))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(words))
            words[at] = f"e{rng.randrange(10**6)}"
        docs.append(words)
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    docs = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one two three"), (1006, "x y " * 20000), (1007, "x y " * 20000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("most", [3_000_000, 600])
def test_all_links_and_membership(spark, monkeypatch, most):
    monkeypatch.setattr(J, "GROUP_ELEMENTS", most)
    docs = corpus(5, 60) + [(900, None), (901, "two words"), (902, "Two  words")]
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    distinct = [i for s, i in first.items() if s]
    want = {(a, b) for a in distinct for b in distinct if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    links, held = J.pairs(spark.createDataFrame(docs, "doc_id long, text string"))
    by_row = {r.doc_id: r.vid for r in held.collect()}
    own = {i: by_row[i] for i in distinct}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == {(own[a], own[b]) for a, b in want}
    assert {r.doc_id for r in held.collect()} == set(by_row) and all(by_row[i] == own[first[s]] for i, s in sets.items() if s)


def test_repeated_rows_empty_table_and_null_ids(spark):
    docs = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "alone in the world"), (7, None)]
    got = sorted(((r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (7, 7)], key=str)
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_ELEMENTS", 500)
    docs = corpus(3, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_linked_sets_always_share_a_signature():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        new = rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 12) + 1))).astype(np.uint64)
        b = np.unique(np.append(rng.permutation(a)[drop:], new))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            assert np.isin(J.signatures(a), J.signatures(b)).any()


def test_trie_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    base = rng.permutation(60)
    sets = {k: np.sort(np.unique(np.append(rng.permutation(base)[: rng.integers(30, 60)], rng.integers(60, 90, 2)))) for k in range(80)}
    sets[80], sets[81] = sets[3][:-1], np.sort(np.append(sets[3], 95))
    distinct = {v.tobytes(): k for k, v in sets.items()}
    sets = {k: sets[k] for k in distinct.values()}
    trie, marks = J.Trie(sets), np.zeros(100, dtype=bool)
    for k, probe in sets.items():
        want = {j for j, s in sets.items() if 100 * len(np.intersect1d(probe, s)) >= 90 * len(np.union1d(probe, s))}
        assert set(trie.search(probe, marks).tolist()) == want
        assert not marks.any()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(1, 300)] + [(500, 500), (401, 400)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 301)}, 400: 400, 401: 400}
    assert components(edges.where("a < 0")).count() == 0


def test_other_widths_and_shares(spark):
    docs = corpus(7)
    words = [f"w{k}" for k in range(100)]
    docs += [(2000, " ".join(words)), (2001, " ".join("other" if k in (30, 70) else w for k, w in enumerate(words)))]
    sets = {}
    for i, text in docs:
        w = text.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])
    want = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and want[a] != want[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = {i: low if c == high else c for i, c in want.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, 5, 80).collect()} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert want[2001] == 2000 and brute(docs)[2001][1] == 2001


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_linked_sets_share_a_signature_at_other_shares(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(600):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        most = J.differing(n, percent)
        drop = int(rng.integers(0, most // 2 + 1))
        b = np.unique(np.append(rng.permutation(a)[drop:], rng.integers(0, 2**63, int(rng.integers(0, most // 2 + 1))).astype(np.uint64)))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            met += 1
            assert np.isin(J.signatures(a, percent), J.signatures(b, percent)).any()
            for share in (0.2, 0.7, 1.0):
                both = np.union1d(a, b)
                frequent = np.zeros(1 << 16, dtype=bool)
                frequent[(rng.permutation(both)[: int(share * len(both))] & np.uint64((1 << 16) - 1)).astype(np.int64)] = True
                assert np.isin(J.signatures(a, percent, frequent), J.signatures(b, percent, frequent)).any()
    assert met > 200


def test_an_id_with_two_texts_loses_no_link(spark):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (4, "nothing like it")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(order, "doc_id long, text string")).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_row_without_an_id_joins_others(spark):
    a = [f"a{k}" for k in range(100)]
    near = lambda n: " ".join([*(f"x{k}" for k in range(n)), *a[n:]])
    rows = [(7, near(0)), (None, near(3)), (9, near(6))]
    got = sorted(((r.doc_id, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(7, 7), (9, 7), (None, 7)]


def near_copies(n, chain):
    base, rows = [f"b{k}" for k in range(200)], []
    for i in range(n):
        words = list(base)
        for k in range(i % 3):
            words[(i * 17 + k * 50) % 200] = f"e{i}_{k}"
        rows.append((i, " ".join(words)))
    for j in range(chain):  # each similar to the one before, the last ones not to the first
        words = [f"n{k}" if k < 5 * j else w for k, w in enumerate(base)]
        rows.append((n + j, " ".join(words)))
    return rows


@pytest.mark.parametrize("most", [2_000, 12_000])
def test_sets_apart_from_the_pivot_are_searched_for(spark, monkeypatch, most):
    monkeypatch.setattr(J, "GROUP_ELEMENTS", most)
    rows = near_copies(150, 12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
