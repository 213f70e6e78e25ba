import random
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import repeats as R


def brute(docs):
    count = Counter(b[i : i + 400] for b in docs for i in range(len(b) - 399))
    out = []
    for b in docs:
        cover = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                cover[i] += 1
                cover[i + 400] -= 1
        gone = np.append(0, (np.cumsum(cover)[:-1] > 0).astype(int))
        step = np.diff(np.append(gone, 0))
        out.append(list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())))
    return out


def made(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (330, 395, 400, 401, 450, 900, 2000)]
    docs = [text(rng.choice([0, 10, 399, 400, 700, 3000])) for _ in range(60)]
    for k in range(60):
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p)) for _ in range(2))
            at = rng.randrange(len(docs[k]) + 1)
            docs[k] = docs[k][:at] + (p if rng.random() < 0.6 else p[a:b]) + docs[k][at:]
    copy = docs[5]
    docs += [copy, copy, copy[:-1] + "z", "x" + copy, docs[7] + docs[8], "from " * 300, "from " * 90, "ab" * 500, "\0" * 900, "\0" * 400 + "q", "p" * 399, "p" * 400, passages[5] * 3, passages[6][:1000] + "!" + passages[6][1000:]]
    return docs


@pytest.mark.parametrize(("seed", "hot"), [(1, R.HOT), (2, R.HOT), (3, 2), (4, 1)])
def test_spans_are_those_of_all_windows(spark, seed, hot):
    docs = made(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, key int").repartition(3)
    got = {r.doc_id: list(zip(r.starts or [], r.ends or [])) for r in R.remove_repeats(df, hot).collect()}
    assert [got[i] for i in range(len(docs))] == brute([t.encode() for t in docs])


def test_repeated_rows_and_nulls(spark):
    t = "".join(chr(97 + (k * k) % 26) for k in range(500)) + "!" * 10
    rows = [(1, t), (1, t), (2, None), (3, ""), (None, "y" + t[:450]), (4, t[1:300])]
    got = [(r.doc_id, list(zip(r.starts or [], r.ends or []))) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = brute([(x or "").encode() for _, x in rows])
    assert sorted(map(str, got)) == sorted(str((i, s)) for (i, _), s in zip(rows, want))
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    core = rng.integers(0, 256, 420).astype(np.uint8)
    a, b = (np.concatenate((rng.integers(0, 256, n).astype(np.uint8), core, rng.integers(0, 256, m).astype(np.uint8))) for n, m in ((700, 200), (13, 900)))
    (_, _, ha, pa, _), (_, _, hb, pb, _) = R.anchors(a), R.anchors(b)
    in_core = lambda h, p, at: {(int(x), int(y) - at) for x, y in zip(h, p) if at <= y < at + 405}
    assert in_core(ha, pa, 700) & in_core(hb, pb, 13)


def test_sliding_and_window_hashes():
    x = np.random.default_rng(2).integers(0, 99, 1000)
    assert R.sliding(x, 7, np.minimum, 10**6).tolist() == [int(x[i : i + 7].min()) for i in range(994)]
    data = np.random.default_rng(3).integers(0, 3, 1200).astype(np.uint8)
    data[600:1050] = data[0:450]
    h = R.window_hashes(R.gram_hashes(data))
    same = {(i, j) for i in range(0, 60) for j in range(600, 660) if h[i] == h[j]}
    assert same == {(i, i + 600) for i in range(51)}


def test_united():
    k, s, e = R.united(np.array([2, 1, 1, 1, 2]), np.array([0, 5, 0, 4, 3]), np.array([2, 9, 4, 6, 5]))
    assert list(zip(k.tolist(), s.tolist(), e.tolist())) == [(1, 0, 9), (2, 0, 2), (2, 3, 5)]


def maximal(docs):
    """All maximal repeats of 400 characters or more: every string two suffixes have in common, extended to the left."""
    found = set()
    places = [(k, i) for k, t in enumerate(docs) for i in range(len(t))]
    starts = {}
    for k, i in places:
        starts.setdefault(docs[k][i : i + 400], []).append((k, i))
    for w, same in starts.items():
        if len(w) == 400 and len(same) > 1:
            for x, (a, i) in enumerate(same):
                for b, j in same[x + 1 :]:
                    if i and j and docs[a][i - 1] == docs[b][j - 1]:
                        continue
                    n = 400
                    while i + n < len(docs[a]) and j + n < len(docs[b]) and docs[a][i + n] == docs[b][j + n]:
                        n += 1
                    found.add(docs[a][i : i + n])
    return {one: {(k, i, len(one)) for k, t in enumerate(docs) for i in range(len(t) - len(one) + 1) if t.startswith(one, i)} for one in found}


def strings_of(rows, docs):
    found, by_text = {}, {}
    for r in rows:
        found.setdefault(r.group, set()).add((r.key, r.start, r.length))
    for places in found.values():
        (one,) = {docs[k][s : s + n] for k, s, n in places}
        assert one not in by_text
        by_text[one] = places
    return by_text


def test_groups_are_the_maximal_repeats(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, long, core, huge = text(430), text(520), text(410), text(2500)
    docs = [text(50) + short + text(50), short + text(20), text(300) + short, "q" + long + "r" + long, text(9) + long[:450] + "zz", "A" + core + "B", "A" + core + "C", "D" + core + "B", text(900)]
    docs += [text(30) + huge + "x", huge + "y" + text(80)]
    got = strings_of(R.repeat_groups(spark.createDataFrame(list(enumerate(docs)), "key long, text string")).collect(), docs)
    assert got == maximal(docs) and huge in got


@pytest.mark.parametrize("hot", [R.HOT, 1])
def test_groups_of_nested_repeats_are_whole(spark, hot):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    huge = text(2500)
    docs = [text(30) + huge + "x", huge + "y" + text(80), text(5) + huge[:1700] + "z", huge[900:] + text(40) + huge[200:800]]
    got, want = strings_of(R.repeat_groups(spark.createDataFrame(list(enumerate(docs)), "key long, text string"), hot).collect(), docs), maximal(docs)
    for one, places in got.items():
        assert places == {(k, i, len(one)) for k, t in enumerate(docs) for i in range(len(t) - len(one) + 1) if t.startswith(one, i)}
    # What a longer string shares with more documents is a group of its own; on either side of it is another one.
    assert {huge[:1700], huge[900:], huge[900:1700], huge[200:800]} & set(want) <= set(want)
    for one in want:
        for i in range(len(one) - 399):
            assert any(one[i : i + 400] in other for other in got)


def test_cores_that_two_anchors_have_are_one_place(spark):
    """Near copies that differ every 380 bytes share cores and no window; anchors are everywhere in them."""
    rng = random.Random(12)
    docs = []
    for seed in range(6):
        base = "".join(random.Random(seed).choice("abcdefgh") for _ in range(3000))
        for copy in range(3):
            letters = list(base)
            for at in range(rng.randrange(40), len(base), 380):
                letters[at] = "XYZ"[copy]
            docs.append("".join(letters))
    docs.append(docs[0][100:520])
    rows = R.remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), 1).collect()
    got = {r.doc_id: list(zip(r.starts or [], r.ends or [])) for r in rows}
    assert [got[i] for i in range(len(docs))] == brute([t.encode() for t in docs])


def test_shared_passages_below_the_length_are_told(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = text(230), text(127)
    docs = [text(300) + passage + text(200), text(20) + passage, text(700), text(50) + other + text(50), other + text(90), (text(40) + "ab") * 30, text(300) + passage + text(9) + passage + text(400) + passage]
    rows = R.remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.shared_starts or []) for r in rows} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 2}
    assert all(docs[r.doc_id][s:e] in passage for r in rows if r.doc_id < 6 for s, e in zip(r.shared_starts or [], r.shared_ends or []))


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_around_hot_anchors(spark, parts):
    t = "".join(chr(97 + (k * k) % 26) for k in range(500)) + "!" * 10
    rows = [(1, t), (1, t), (2, None), (3, ""), (None, "y" + t[:450]), (4, t[1:300]), (None, "z" * 450), (None, "z" * 450), (5, t[:420] + "?"), (6, "".join(chr(97 + (k * k * k + k) % 23) for k in range(450)))]
    rng = random.Random(4)
    alone = "".join(rng.choice("abcdefgh") for _ in range(600))
    rows += [(7, alone), (7, alone)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [(r.doc_id, len(r.text or ""), list(zip(r.starts or [], r.ends or []))) for r in R.remove_repeats(df, 1).collect()]
    want = brute([(x or "").encode() for _, x in rows])
    assert sorted(map(str, got)) == sorted(str((i, len(x or ""), s)) for (i, x), s in zip(rows, want))
