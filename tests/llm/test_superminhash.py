import numpy as np
import pytest

from tilewright.llm import jaccard as J
from tilewright.llm import superminhash as S


def plain_signature(elements, slots):
    """The signature element by element, with a whole permutation each."""
    step, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def scramble(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    out = [mask] * slots
    for e in elements:
        places = list(range(slots))
        for rank in range(slots):
            draw = scramble((e + (rank + 1) * step) & mask)
            at = rank + ((draw >> 40) * (slots - rank) >> 24)
            places[rank], places[at] = places[at], places[rank]
            out[places[rank]] = min(out[places[rank]], rank << 40 | draw & (1 << 40) - 1)
    return out


def some_sets(rng, sizes):
    return [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]


def test_signatures_are_those_of_whole_permutations(monkeypatch):
    rng = np.random.default_rng(1)
    sets = some_sets(rng, [1, 2, 0, 7, 40, 90, 3])
    want = [plain_signature(s.tolist(), 24) for s in sets]
    for block in (1 << 14, 11):
        monkeypatch.setattr(S, "BLOCK_ELEMENTS", block)
        assert S.signatures(sets, 24).tolist() == want
    assert S.signatures([], 24).shape == (0, 24)


def test_estimates_vary_less_than_independent_slots():
    rng = np.random.default_rng(2)
    apart = []
    for _ in range(400):
        both = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        left, right = S.signatures([np.sort(both[:45]), np.sort(both[15:])], 64)
        apart.append(S.similarity(left, right) - 0.5)
    assert abs(np.mean(apart)) < 0.01
    assert np.var(apart) < 0.85 * 0.25 / 64


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(3)
    lefts, rights = [], []
    for _ in range(500):
        n = int(rng.integers(9, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = n // 9
        lefts.append(a), rights.append(np.unique(np.append(rng.permutation(a)[drop:], rng.integers(0, 2**64, drop, dtype=np.uint64))))
    left, right = (S.bands(S.signatures(x, S.BANDS * S.ROWS), S.ROWS) for x in (lefts, rights))
    assert (left == right).any(axis=1).all()


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def plain_join(docs, width=4, percent=80):
    """{id: (size, component, kept)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    words, shared = [f"w{k}" for k in range(3000)], [f"c{k}" for k in range(60)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.5:
            text = (docs[int(rng.integers(len(docs)))][1] or "").split()
            for _ in range(int(rng.integers(0, 6))):
                if text:
                    text[int(rng.integers(len(text)))] = str(rng.choice(words))
            text = " ".join(text).upper() if kind < 0.1 else " ".join(text)
        elif kind < 0.55:
            text = ["", None, " \t ", "one", "One  two", "one two three"][int(rng.integers(6))]
        else:
            text = list(rng.choice(words, int(rng.integers(3, 120))))
            if kind > 0.85:
                text[2:2] = shared
            text = " ".join(text)
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CODES", 3000)
    monkeypatch.setattr(S, "BUCKET_BYTES", 20_000)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in S.join(df).collect()} == plain_join(docs)


def test_split_groups_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_ELEMENTS", 400)
    docs = corpus(3, 100)
    long = [f"l{k}" for k in range(60_000)]
    docs += [(200, " ".join(long)), (201, " ".join([*long[:30_000], "new", *long[30_000:]])), (202, " ".join(long[:40_000]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in S.join(df).collect()} == plain_join(docs)


def test_odd_rows(spark):
    rows = [(None, "a b c d e", "x"), (7, "a b c d e", "y"), (7, "a b c d e", "y"), (3, None, None), (5, "", "z"), (9, "A B C D E", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `component.id` string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in S.join(df).collect())
    assert got == [(False, 3, 0, 3, True), (False, 5, 0, 5, True), (False, 7, 2, 7, True), (False, 7, 2, 7, True), (False, 9, 2, 7, False), (True, 0, 2, 7, False)]
    assert S.join(df.limit(0)).collect() == []
    held = {r.doc_id: r for r in S.sketch(df.where("doc_id is not null")).collect()}
    assert held[3].signature is None and len(held[9].signature) == 8 * S.BANDS * S.ROWS and held[9].signature == held[7].signature
