import random
import re

from tilewright.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted(sizes):
    """Targets by the plain loop: those above three times their size stop there, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def made(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 80, 300]))), rng.choice(["b"] * 9 + ["a", "é", "Z", None, ""])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "empty"), (n + 2, "x " * 40000, "long"), (n + 3, "one two", "tiny")]


def test_targets_and_words_taken(spark):
    for seed in (1, 2):
        rows = made(seed)
        sizes = {}
        for _, text, source in rows:
            sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
        df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
        out, plan = M.mix_sources(df)
        got = out.collect()
        want = wanted(sizes)
        assert len(got) == len(rows)
        sources = {r[0]: r[2] for r in rows}
        taken = {}
        for r in got:
            s = sources[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            assert r.size == len(WORD.findall(rows[r.doc_id][1] or "")) and 0 <= r.taken <= 3 * r.size
            taken[s] = taken.get(s, 0) + r.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(1, 0.002 * t), (s, taken[s], t)
        assert {(r.doc_id, r.taken) for r in M.mix_sources(df)[0].collect()} == {(r.doc_id, r.taken) for r in got}


def test_the_schedule_is_even_at_all_times(spark):
    rows = [(i, "word " * 50, "abc"[i % 3]) for i in range(300)]
    plan = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))[1].orderBy("time").collect()
    total = {s: sum(r.source == s for r in plan) for s in "abc"}
    seen = dict.fromkeys("abc", 0)
    for k, r in enumerate(plan, 1):
        seen[r.source] += 1
        for s in "abc":
            assert abs(seen[s] / total[s] - k / len(plan)) < 0.02 + 12 / len(plan)


def test_documents_are_repeated_and_cut(spark):
    rows = made(3, 200)
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in M.mix_sources(df)[0].collect()}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        assert (rows[r.doc_id][1] or "").startswith(r.text or "")
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    assert all(words.get(i, 0) == n for i, n in taken.items())
    assert {i for i, t, _ in rows if not WORD.findall(t or "")} <= set(words)


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert len(M.mix_sources(df)[0].collect()) == 3
    assert M.mix_sources(df.where("doc_id > 7"))[0].count() == 0
    assert M.mixed_documents(df.where("doc_id > 7")).count() == 0


def test_rows_stand_in_the_order_of_the_schedule(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(40)), "abc"[i % 3 if i < 240 else 0], 1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_taken int, mix int")
    made, plan = M.mix_sources(df)
    first = {r.doc_id: r.first_slot for r in made.collect()}
    times = {}
    for r in plan.collect():
        times.setdefault((r.source, r.rank), r.time)
    assert all(first[r.doc_id] == times.get((r.source, r.first_block)) for r in made.collect())
    got = [(r.doc_id, r.source) for r in M.mixed_documents(df).collect()]
    assert M.mixed_documents(df).columns == df.columns
    seen, order = set(), []
    for i, _ in got:
        if i not in seen:
            order.append(first[i])
            seen.add(i)
    assert order == sorted(order)
    shares = [s for _, s in got]
    for n in range(50, len(got), 50):
        for s in "abc":
            assert abs(shares[:n].count(s) / n - shares.count(s) / len(shares)) < 0.06
