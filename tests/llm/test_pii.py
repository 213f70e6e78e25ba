import hashlib
import random
import re
import time

from tilewright.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    "", None, "1.2.3.4.5", "a@b.c%x@y.z q@@w.e.r", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (017) 555-7713 +", "é€𝄞 a@b.co 256.1.1.1 001.002.003.004",
    "12 " * 60000, "a" * 100000 + "@x." + "b." * 50000 + "c", "." * 100000, "9" * 100000, "+1" + " 2" * 50000, "x+1 2345-6789.", "1  2", "4111 1111 1111 1111 1.1.1.1", "a@b a@b.c@d.e",
    "5555555555554444 4012888888881881", "a@b.co" * 3, "1.2.3.4.5.6.7.8", "+12345678+12345678", "@", "a@b", "x@y..z", "4111 1111 1111 11111", "0000000000000000",
]


def test_base_spans_are_those_of_the_patterns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base(ODD[r.doc_id] or "")
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want.split(",")) for k in PATTERNS]


def planted():
    known = [f"Some words. Contact number: +1 (555) 555-{1000 + i} then more words" for i in range(20)]
    unseen = [f"odd text {i} Contact number: 555-0{100 + i}-77 end." for i in range(20)]
    elsewhere = [f"nothing here but 555-0{100 + i}-77 alone" for i in range(5)]
    plain = [f"order id: 99887{i}66" for i in range(15)]
    return known, unseen, elsewhere, plain


def test_contexts_find_what_the_patterns_do_not(spark):
    groups = planted()
    texts = [t for g in groups for t in g]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        assert (got[i].spans == "") == (i >= 45)
        if 20 <= i < 45:
            _, start, end = got[i].spans.split(":")
            assert re.fullmatch(r"555-0\d{3}-77", t[int(start) : int(end)]) and got[i].n_phone == 0


def test_redaction(spark):
    texts = ["mail a@b.co now", "pay 4111 1111 1111 1111 and 1.2.3.4", None, "", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got[0] == "mail [email] now" and got[2] is None and got[3] == "" and got[4] == "nothing"
    assert "4111" not in got[1] and got[1].endswith("and [ip]")
    assert pii.redacted(df.where("doc_id > 9")).count() == 0 and pii.report(df.where("doc_id > 9")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "1.1.1.1")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.spans) for r in pii.report(df).collect()) == [("1", "email:0:6"), ("1", "email:0:6"), ("None", "ip:0:7")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def added(spark, seeds, unseen):
    texts = seeds + unseen
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in rows}
    return [[(k, t[int(a) : int(b)]) for k, a, b in spans[len(seeds) + i]] for i, t in enumerate(unseen)]


def test_instances_without_three_digits_in_a_row(spark):
    phones = [f"Contact number: +1 (555) 555-{1000 + i} then" for i in range(20)]
    hosts = [f"from host 10.1.2.{i + 1} on" for i in range(20)]
    unseen = ["Contact number: 06-12-34-56-78 end", "from host 10_20_30_40 end"]
    assert added(spark, phones + hosts, unseen) == [[("phone", "06-12-34-56-78")], [("ip", "10_20_30_40")]]


def test_instances_with_blanks_and_brackets(spark):
    phones = [f"Contact number: +1 (555) 555-{1000 + i} then" for i in range(20)]
    cards = [f"card no: {c} then" for c in ("4111 1111 1111 1111", "5555555555554444", "4012888888881881", "378282246310005", "6011111111111117", "3530 1113 3330 0000")]
    unseen = ["Contact number: 555 123 4567 end", "Contact number: (555) 123-4567 end", "Contact number: 555-0103-77 20 people", "card no: 4111 1111 1111 1112 end"]
    want = [[("phone", "555 123 4567")], [("phone", "(555) 123-4567")], [("phone", "555-0103-77")], [("card", "4111 1111 1111 1112")]]
    assert added(spark, phones + cards * 2, unseen) == want


def test_contexts_of_long_words(spark):
    long = "x" * 60
    phones = [f"a {long} number: +1 (555) 555-{1000 + i} then" for i in range(20)]
    far = [f"{'y ' * 40}{long} number: +1 (555) 555-{2000 + i} then" for i in range(3)]
    unseen = [f"{'z ' * 40}{long} number: 555-0103-77 end", f"{'z ' * 40}q{long} number: 555-0104-77 end"]
    assert added(spark, phones + far, unseen) == [[("phone", "555-0103-77")], []]


def test_base_spans_of_made_up_texts(spark):
    """Addresses with zeros, and strings of the characters that the patterns are made of."""
    rng = random.Random(9)
    texts = ["host 10.0.0.1 and 192.168.0.7 and 8.8.8.8 up", "127.0.0.1", "0.0.0.0", "00.000.0.255", "0.0.0.256", "255.255.255.0255", "1.0.0.300"]
    texts += [".".join(rng.choice(["0", "00", "1", "9", "10", "99", "100", "199", "249", "255", "256", "0255"]) for _ in range(rng.randint(3, 9))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789.@+-() ab") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert r.n_spans >= len([x for x in want.split(",") if x])


def test_columns_of_any_name(spark):
    names = ["key", "row", "found", "start", "end", "kind", "value", "pattern", "email", "ip", "card", "phone", "runs", "spaced", "done", "_pii_key"]
    df = spark.createDataFrame([(1, "see a@b.co now", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    (got,) = pii.redacted(df).collect()
    assert tuple(got) == (1, "see [email] now", *range(len(names)))
    assert pii.report(df).first().n_email == 1


def lines_of(n, seed=0):
    return "".join(f"host 10.{k // 250 % 250}.{seed}.{k % 250} id 7{k:07d} mail u{k}@x{k % 9}.org say\n" for k in range(n))


def test_pieces_do_not_change_spans(spark):
    """Texts over many pieces, with and without line ends; matches at every place of a cut."""
    rng = random.Random(4)
    words = ["a", "é", "host", "10.0.0.1", "+1 (23) 456-7890", "4539 1488 0343 6467", "x@y.org", "12", "1-2", ",", "\n", "\t", "(", "no."]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "  "]) for _ in range(3000)) for _ in range(6)]
    texts += [lines_of(300), lines_of(300).replace("\n", " "), "7 " * 9000, "x@y.org" * 2000, "+1 2 3 4 5 6 7 8 " * 900, "1" * 9000 + "@a.b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(rows).collect():
        want = base(texts[r.doc_id])
        spans = [x for x in want.split(",") if x]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in spans) for k in ("email", "ip", "card", "phone")]


def test_a_megabyte_of_addresses_takes_as_long_as_its_lines(spark):
    """The same bytes in one text and in a thousand rows."""
    lines = lines_of(20_000).splitlines(keepends=True)
    one = spark.createDataFrame([(0, "".join(lines))], "doc_id long, text string")
    many = spark.createDataFrame([(k, "".join(lines[16 * k : 16 * k + 16])) for k in range(1250)], "doc_id long, text string").coalesce(1)
    assert len(one.first().text) > 900_000
    took = []
    for df in (many, one):
        began = time.time()
        (n,) = pii.report(df).selectExpr("sum(n_ip)").first()
        took.append(time.time() - began)
        assert n == 20_000
    assert took[1] < 2 * took[0] + 5
    (r,) = pii.redacted(one).collect()
    assert r.text.count("[ip]") == 20_000 and r.text.count("[email]") == 20_000 and r.text.endswith(" say\n")
