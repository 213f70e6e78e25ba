import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import packing as P

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_are_those_of_whole_texts(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids, counts = P.token_ids(pa.array(texts, pa.string()), P.chunk_ids(PATH))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_ids_of_words_marks_and_other_scripts(tokenizer):
    import pyarrow as pa

    texts = ["Straße, ÉCOLE! it's don't (x) a.b.c 12 3.4", "ΣΑΣ ΟΔΟΣ İstanbul ﬁ é é 日本語", "a\x1cb c d\x85e", "$$$ ### word&&& |", "<|endoftext|> [x] `~` \\", "a <|startoftext|> b", "x<|endoftext|>y<|ENDOFTEXT|><|endoftext|>.", "<| endoftext |>", "x" * 5000, None, ""]
    ids, counts = P.token_ids(pa.array(texts), P.chunk_ids(PATH))
    want = [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4095), min_size=1, max_size=60))
def test_windows_hold_all_and_fit(sizes):
    groups = P.windows_for(sizes)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= P.CAPACITY for g in groups)


def test_differencing_evens_out():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 200).tolist()
    sums = [sum(sizes[i] for i in g) for g in P.differencing(sizes, 10)]
    assert max(sums) - min(sums) <= 20


def check(rows, docs, tokenizer):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
    return len(sequences)


def test_pack(spark, tokenizer):
    rng = np.random.default_rng(2)
    docs = {i: " ".join(f"w{int(x)}" for x in rng.integers(0, 999, int(rng.lognormal(5, 1)))) for i in range(400)}
    docs |= {1000: None, 1001: "", 1002: "long words here " * 20000}
    rows = P.pack(spark.createDataFrame([(i, t, 7) for i, t in docs.items()], "doc_id long, text string, start int"), PATH).collect()
    n = check(rows, docs, tokenizer)
    tokens = sum(r.length for r in rows)
    assert n <= math.ceil(tokens / P.CAPACITY) * 1.04 + 1


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = P.pack(df, PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 2)]
    assert P.pack(df.where("doc_id > 5"), PATH).count() == 0


def test_copies_of_a_row_are_dealt_over_groups(spark, tokenizer):
    n = 6000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three " * 30).alias("text"))
    rows = P.pack(df, PATH).collect()
    assert len(rows) == n and len({r.sequence_id >> 32 for r in rows}) == math.ceil(n / P.GROUP_DOCS)
    check(rows[:0], {}, tokenizer)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == [k * parts[0][1] for k in range(len(parts))] and sum(x for _, x in parts) <= P.CAPACITY
