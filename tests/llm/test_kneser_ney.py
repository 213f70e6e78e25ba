import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tilewright.llm import kneser_ney as K

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())


class Brute:
    """The textbook's model: counts of preceding words below the highest order, plain ones at the beginning of a text."""

    def __init__(self, texts, order):
        self.order = order
        raw = Counter()
        for t in texts:
            s = ("begin", *tokens(t), "end")
            raw.update(s[i : i + k] for k in range(1, order + 1) for i in range(len(s) - k + 1))
        self.uni = Counter({g[0]: c for g, c in raw.items() if len(g) == 1 and g != ("begin",)})
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.count = {}
        for k in range(1, order + 1):
            grams = [g for g in raw if len(g) == k]
            before = Counter(g[1:] for g in raw if len(g) == k + 1)
            self.count[k] = Counter({g: raw[g] if k == order or (g[0] == "begin" and k > 1) else before[g] for g in grams})
        self.d = {k: K.discounts([sum(x == m for x in c.values()) for m in (1, 2, 3, 4)]) for k, c in self.count.items()}
        self.total, self.spread = defaultdict(Counter), defaultdict(lambda: [0] * 4)
        for k in range(2, order + 1):
            for g, c in self.count[k].items():
                self.total[k][g[:-1]] += c
                self.spread[g[:-1]][min(c, 3)] += 1
        self.pairs = len(self.count[2])
        self.rest = sum(self.d[1][min(c, 3)] for c in self.count[1].values()) / self.pairs

    def p(self, context, w):
        if not context:
            c = self.count[1][(w,)]
            return max(c - self.d[1][min(c, 3)], 0) / self.pairs + self.rest / (self.v + 1)
        k, low = len(context) + 1, self.p(context[1:], w)
        if not self.total[k][context]:
            return low
        c = self.count[k][(*context, w)]
        return (max(c - self.d[k][min(c, 3)], 0) + sum(self.d[k][m] * self.spread[context][m] for m in (1, 2, 3)) * low) / self.total[k][context]

    def scores(self, text):
        s = ("begin", *tokens(text), "end")
        base = sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in s[1:])
        return len(s) - 1, sum(self.uni[w] > 0 for w in s[1:]), base, sum(math.log10(self.p(s[max(0, i - self.order + 1) : i], s[i])) for i in range(1, len(s)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_are_those_of_the_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(K, "SHARD_BYTES", 40_000)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(words[i : i + rng.randint(1, 60)]) for i in range(0, 4000, 40)]
    texts += [None, "", "  \t", "Straße É ÉCOLE école A-Z a-z", "once\x1conly \x85 x", texts[0], texts[0], "long " * 30000, "one"]
    other = [*texts[:9], "never seen words here", None]
    model = K.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order)
    want = Brute(texts, order)
    assert model.shards > 1 and (model.tokens, model.vocabulary, *model.sizes) == (want.n, want.v, *(len(want.count[k]) for k in range(2, order + 1)))
    got = {r.doc_id: r for r in K.score(spark.createDataFrame([(i, t, "x") for i, t in enumerate(other)], "doc_id long, text string, score string"), model).collect()}
    for i, t in enumerate(other):
        n, known, base, score = want.scores(t)
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(score, rel=1e-9)
    assert sum(want.p(("begin",), w) for w in want.uni) + want.p(("begin",), "unseen") == pytest.approx(1)


def test_empty_table_and_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = K.train(none)
    assert model.tokens == 0 and K.score(none, model).count() == 0
    rows = K.score(spark.createDataFrame([(1, "a b"), (2, None), (None, "a"), (None, "a")], "doc_id long, text string"), model).collect()
    assert len(rows) == 4
    assert all(math.isfinite(r.score) for r in rows)


def test_stored_hashes_are_found():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**62, 5000).astype(np.uint64))
    table, rest = K.stored(keys, 4)  # all in the first of four shards
    assert (K.find(table, rest, keys, 4) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 2**62, 5000).astype(np.uint64), keys)
    assert (K.find(table, rest, others, 4) == -1).all()
    assert (K.find(*K.stored(keys[:0], 4), keys, 4) == -1).all()


def test_packed_arrays():
    import pyarrow as pa

    a, b = np.arange(1000, dtype=np.uint32) * 7, np.arange(1000, dtype=np.int64) - 5
    blobs = pa.chunked_array([pa.array([K.packed([a, b]), K.packed([a[:0], b[:0]]), K.packed([a[:3], b[:3]])])])
    x, y = K.unpacked(blobs, [np.uint32, np.int64])
    assert (x == np.append(a, a[:3])).all() and (y == np.append(b, b[:3])).all()


def test_words_are_hashed_all_at_once(monkeypatch):
    import pyarrow as pa

    words = ["", "a", "a\0", "a\0\0", "é", "ab" * 4, "ab" * 4 + "\0", *("x" * n for n in range(2, 90)), *("x" * n + "y" for n in range(90))]
    hashes = K.word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(set(words)) == len(words)
    assert (K.word_hashes(pa.array(["before", *words])[1:]) == hashes).all() and len(K.word_hashes(pa.array([], pa.string()))) == 0

    def one_by_one(_):
        raise AssertionError("a call for a word")

    monkeypatch.setattr("xxhash.xxh64_intdigest", one_by_one)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([" B a  b\t", None, "c"])], ["doc_id", "text"])
    blocks = [([*known[which]], lengths.tolist()) for _, known, which, lengths in K.sequences([batch])]
    a, b, c = K.word_hashes(pa.array(["a", "b", "c"]))
    assert blocks == [([K.BEGIN, b, a, b, K.END, K.BEGIN, K.END, K.BEGIN, c, K.END], [5, 2, 3])]


def test_bytes_of_zeros_are_not_packed():
    import pyarrow as pa

    few, none = np.arange(70_000, dtype=np.int64), np.zeros(70_000, dtype=np.int64)
    blob = K.packed([few, none])
    assert blob[8:10] == bytes([3, 0])
    x, y, z = K.unpacked(pa.chunked_array([pa.array([K.packed([few, none, few[::-1].astype(np.uint32)])])]), [np.int64, np.int64, np.uint32])
    assert (x == few).all() and not y.any() and len(y) == len(few) and (z == few[::-1]).all()


def test_sums_of_runs():
    values = np.array([3, 4_000_000_000, 1, 0, 7], dtype=np.uint32)
    assert K.sums(values, np.array([0, 1, 3])).tolist() == [3, 4_000_000_001, 7]
    assert len(K.sums(values[:0], np.empty(0, dtype=np.int64))) == 0
