"""What the registered queries return, against plain versions of their contracts, on the small tables."""

import hashlib
import re
import zlib

import pytest

from tilewright.llm import queries as Q

from ..compare import same
from ..conftest import SF
from .test_jaccard import brute as linked_groups
from .test_kneser_ney import Brute
from .test_neighbours import brute as nearest_of_all
from .test_packing import check as check_pieces
from .test_pii import base as base_spans
from .test_repeats import brute as repeated
from .test_superminhash import plain_join as near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op6_mixing", "op12_merkle", "op13_vector_codes"])
def test_queries_are_their_sql(spark, duck, name):
    same(Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name]))


def test_op11_is_all_pairs(spark, documents):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op11_superminhash(spark, SF).collect()} == near_groups(list(documents.items()))


def test_op4_reads_back_what_it_stores(spark, documents):
    rows = {r.doc_id: r for r in Q.op4_tiff(spark, SF).collect()}
    assert set(rows) == set(documents)
    for i, text in documents.items():
        data = (text or "").encode()
        r = rows[i]
        assert r.n_bytes == len(data)
        data = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        media = Q.stored_as(data)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len({(r.layout, r.pages) for r in rows.values()}) == 16


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_is_the_plain_model(spark, documents):
    texts = [t for i, t in documents.items() if fold(i, 5) != 1]
    want = Brute(texts, 3)
    rows = {r.doc_id: r for r in Q.op1_lm_scoring(spark, SF).collect()}
    assert set(rows) == set(documents)
    for i, text in documents.items():
        n, known, base, score = want.scores(text)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, n, known, want.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_op2_is_all_pairs(spark, documents):
    want = linked_groups(list(documents.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op2_jaccard_join(spark, SF).collect()} == want


def test_op3_scores_and_decides(spark, documents):
    rows = {r.doc_id: r for r in Q.op3_toxicity(spark, SF).collect()}
    assert set(rows) == set(documents)
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())


def test_op3_learns_from_its_folds_only(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {r.doc_id for r in Q.toxic_labels(spark, SF).collect()}
    assert kept == {r.doc_id for r in labels if fold(r.doc_id, 5) != 0}


def test_op5_packs_all_ids(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    rows = Q.op5_packing(spark, SF).collect()
    sequences = check_pieces(rows, documents, tokenizer)
    assert sequences * 4096 <= sum(r.length for r in rows) * 1.1 + 4096


def test_op7_finds_the_nearest(spark):
    held = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = nearest_of_all([r.vec_id for r in held], [r.embedding for r in held])
    got = {}
    for r in Q.op7_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    vectors = {r.vec_id: r.embedding for r in held}
    hit = 0
    for q, near in got.items():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, len(near) + 1)) == list(range(1, len(want[q]) + 1))
        assert all(s == pytest.approx(sum(a * b for a, b in zip(vectors[q], vectors[i])), rel=1e-12) for _, i, s in near)
        hit += len({i for _, i, _ in near} & {i for i, _ in want[q]})
    assert hit >= 0.9 * sum(len(x) for x in want.values())


def test_op8_finds_notices(spark, documents):
    for r in Q.op8_licences(spark, SF).collect():
        assert documents[r.doc_id][r.start : r.end] == r.text


def test_op9_has_the_base_spans(spark, documents):
    rows = {r.doc_id: r for r in Q.op9_pii(spark, SF).collect()}
    for i, text in documents.items():
        want, r = base_spans(text or ""), rows[i]
        spans = [x for x in want.split(",") if x]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in spans) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) and r.n_spans == len([x for x in r.spans.split(",") if x])


def test_op10_removes_what_all_windows_say(spark, documents):
    ids = sorted(documents)
    texts = [(documents[i] or "").encode() for i in ids]
    rows = {r.doc_id: r for r in Q.op10_repeats(spark, SF).collect()}
    for i, text, spans in zip(ids, texts, repeated(texts)):
        kept, at = b"", 0
        for start, end in spans:
            kept, at = kept + text[at:start], end
        kept += text[at:]
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        assert not spans or r.n_passages or all(texts.count(text) == 1 for _ in spans)
