"""Personal data by base patterns and bootstrapped contextual extraction. DataFrame functions only.

1. Base: e-mail and IP addresses, card and phone numbers by fixed patterns and tests.
2. Seeds: what the base finds. Their left contexts (the two words before) become lexical patterns.
3. Graph: patterns and the identifier-like strings (instances) that stand after them, in all texts. For each
   kind, ``ROUNDS`` times: a pattern scores the mean score of its instances, lowered for few instances; an
   instance that is no seed scores as if each of its patterns found it independently.
4. Instances above ``ACCEPT`` that have the build of their kind are found wherever they stand.

Texts are not shuffled: they are cut in pieces of some thousand characters that no match crosses, matches are placed within
their piece by a running position, and the graph holds one row for each distinct pattern and instance. So the work grows with the
length of a text, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, in forms that match the same spans without backtracking:
# a start inside a run of address characters is tried only behind a match that ended there, and runs are possessive.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
#: Runs of identifier characters with a digit or an at sign.
INSTANCE = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z._+-]*+[0-9@])[A-Za-z0-9@._+-]++"
#: Groups of digits with single blanks, marks or brackets between them.
SPACED = r"(?<![A-Za-z0-9@._+(-])\+?\(?[0-9]++(?:(?:\) ?| \(|[ ._-])[0-9]++(?![A-Za-z@]))++"
#: What every text with an instance has.
HAS_INSTANCE = "(?:[0-9][^0-9]*+){5}|@"

ROUNDS, ACCEPT = 3, 0.8
#: Patterns need so many seeds.
LEAST_SEEDS = 3
#: Where two words before an instance do not fit in so many characters, they are sought in all of its piece and the one before.
CONTEXT = 48
#: Characters of a piece, up to the next character that no match can hold: one of no pattern's, or a blank behind a letter.
PIECE = r"(?s)(?:.{2000}.*?(?:[^A-Za-z0-9._%+@ ()-]|(?<=[A-Za-z]) )|.+)"

SPAN = "array<struct<start: long, end: long>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""

    def add(total: Column, place: Column) -> Column:
        x = F.substr(number, F.length(number) - place + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(place % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def placed(text: Column, pattern: str, holds) -> Column:
    """Spans (code points) of the matches of ``pattern`` for which ``holds``; a match that fails is dropped."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(so_far: Column, part: Column) -> Column:
        begin = so_far["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        kept = F.when(part["hit"].isNotNull() & holds(part["hit"]), F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"])
        return F.struct(end.cast("long").alias("at"), kept.alias("spans"))

    return F.aggregate(parts, start, step, lambda x: x["spans"])


def card(match: Column) -> Column:
    number = digits(match)
    return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(SPAN)
    has_digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), placed(text, EMAIL, lambda m: F.lit(True))).otherwise(none),
        "ip": F.when(has_digit, placed(text, IP, lambda m: m.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"))).otherwise(none),
        "card": F.when(has_digit, placed(text, DIGITS, card)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), placed(text, PHONE, lambda m: F.length(digits(m)).between(8, 15))).otherwise(none),
    }


def located(text: Column) -> Column:
    """The pieces of a text in order: at (where it begins), lead (the piece before), body."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("lead"), F.array().cast("array<struct<at: long, lead: string, body: string>>").alias("out"))

    def step(so_far: Column, body: Column) -> Column:
        piece = F.struct(so_far["at"].alias("at"), so_far["lead"].alias("lead"), body.alias("body"))
        return F.struct((so_far["at"] + F.length(body)).alias("at"), body.alias("lead"), F.concat(so_far["out"], F.array(piece)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), start, step, lambda x: x["out"])


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def with_base(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``), a ``key`` of its id and text, its ``pieces`` with the base spans in them, and those of the whole text in columns named by kind."""
    docs = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.select("row", "key", located(F.col("text")).alias("cut"))
    cut = cut.withColumn("pieces", F.transform("cut", lambda p: F.struct(p["at"].alias("at"), p["lead"].alias("lead"), p["body"].alias("body"), *(spans.alias(k) for k, spans in base_spans(p["body"]).items()))))
    return cut.select("row", "key", "pieces", *(of_pieces(k).alias(k) for k in KINDS))


def of_pieces(kind: str) -> Column:
    """The spans of a kind in the whole text."""
    return F.flatten(F.transform("pieces", lambda p: shifted(p[kind], p["at"])))


def tagged_spans(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def occurrences(based: DataFrame) -> DataFrame:
    """key, kind (null: no seed), start, end, value, pattern: the seeds and other instances of all texts, from their pieces."""
    based = based.select("key", F.explode("pieces").alias("p")).where(F.col("p.body").rlike("[0-9@]")).select("key", "p.at", "p.lead", F.col("p.body").alias("text"), *(f"p.{k}" for k in KINDS))
    tagged = [tagged_spans(k, F.col(k)) for k in KINDS]
    text, none = F.col("text"), F.array().cast(SPAN)
    runs = F.when(text.rlike(HAS_INSTANCE), placed(text, INSTANCE, lambda m: F.contains(m, F.lit("@")) | (F.length(digits(m)) >= 5))).otherwise(none)
    spaced = F.when(text.rlike(HAS_INSTANCE), placed(text, SPACED, lambda m: m.rlike("[ ()]") & F.length(digits(m)).between(5, 19))).otherwise(none)
    based = based.withColumns({"runs": runs, "spaced": spaced})
    # A run that is an instance by itself does not take in the digits after a blank.
    longer = F.filter("spaced", lambda s: ~F.exists("runs", lambda t: t["start"] == s["start"]))
    found = F.concat("runs", longer)
    seeds = F.concat(*tagged)
    free = F.filter(found, lambda s: ~F.exists(seeds, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    both = F.concat(seeds, F.transform(free, lambda s: F.struct(F.lit(None).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    rows = based.select("key", "at", "lead", "text", F.explode(both).alias("s")).select("key", "at", "lead", "text", "s.*")
    value = F.substr("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    # An instance loses the marks that end a sentence.
    cut = F.when(F.col("kind").isNull(), F.regexp_replace(value, r"[._-]++$", "")).otherwise(value)
    whole, begin = F.concat("lead", "text"), (F.length("lead") + F.col("start")).cast("int")
    before = F.greatest(begin - CONTEXT, F.lit(0))
    near = F.substr(whole, before + 1, begin - before)
    left = F.when((before == 0) | near.rlike(r"\s\S+\s+\S+\s*$"), near).otherwise(F.substr(whole, F.lit(1), begin))
    words = F.reverse(F.regexp_extract(F.reverse(left), r"^\s*+\S++\s++\S++", 0))
    pattern = F.regexp_replace(F.lower(words), "[0-9]+", "0")
    rows = rows.select("key", "kind", (F.col("at") + F.col("start")).alias("start"), cut.alias("value"), F.regexp_replace(pattern, r"\s+", " ").alias("pattern"))
    return rows.where(F.length("value") >= 5).select("key", "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value", "pattern").distinct()


def built(kind: Column, value: Column) -> Column:
    """Whether an instance has the build of its kind."""
    n = F.length(digits(value))
    return (
        F.when(kind == "email", F.contains(value, F.lit("@")))
        .when(kind == "ip", value.rlike(r"^[0-9]+(?:[ ._-][0-9]+){3}$"))
        .when(kind == "card", value.rlike("^[0-9 ._-]+$") & n.between(13, 19))
        .otherwise(value.rlike("^[0-9+ ()._-]+$") & n.between(7, 15))
    )


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, least: int = LEAST_SEEDS) -> DataFrame:
    """kind, value: instances that are no seeds and that trusted patterns find, from :func:`occurrences`."""
    graph = written(seen.where("pattern <> ''").groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "pii-graph")
    kinds = F.explode(F.array(*(F.lit(k) for k in KINDS)))
    patterns = graph.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least)
    # Only patterns with seeds, and what they find, can score.
    graph = written(graph.join(patterns.select("pattern").distinct(), "pattern", "left_semi"), "pii-edges")
    edges = graph.select("pattern", "value", "seed", kinds.alias("kind")).join(patterns, ["pattern", "kind"])
    scores = edges.select("kind", "value", (F.col("seed") == F.col("kind")).cast("double").alias("score")).groupBy("kind", "value").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    for _ in range(rounds):
        scores = written(scores, "pii-scores")
        trust = edges.join(scores, ["kind", "value"]).groupBy("pattern", "kind").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"))
        missed = F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))
        scores = edges.join(trust, ["pattern", "kind"]).groupBy("kind", "value").agg(F.max(F.col("seed") == F.col("kind")).alias("own"), F.max("seed").alias("seed"), missed.alias("missed"))
        scores = scores.select("kind", "value", F.when(F.col("own"), 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(1 - F.col("missed")).alias("score"))
    best = F.max_by(F.struct("kind", "score"), F.struct("score", "kind"))
    seeds = seen.where("kind is not null").select("value").distinct()
    return scores.groupBy("value").agg(best.alias("b")).select("b.kind", "value", "b.score").where((F.col("score") >= accept) & built(F.col("kind"), F.col("value"))).join(seeds, "value", "left_anti").select("kind", "value")


def with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(:func:`with_base` of ``docs``, of its pieces only at, n (their characters) and spans; per key: found, the kinds, starts and ends that are added).

    Spans are code points, the end exclusive. A null text counts as empty. Rows alike in id and text get the
    same spans; an empty table gives no rows. Other columns, whatever their names, are carried along.
    """
    based = with_base(docs)
    seen = written(occurrences(based.select("key", "pieces")), "pii-occurrences")
    new = seen.where("kind is null").drop("kind").join(bootstrap(seen), "value")
    new = new.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    places = F.transform("pieces", lambda p: F.struct(p["at"].alias("at"), F.length(p["body"]).alias("n"), F.concat(*(tagged_spans(k, shifted(p[k], p["at"])) for k in KINDS)).alias("spans")))
    return based.withColumn("pieces", places), new


def joined_spans(based: DataFrame, new: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
    return based.join(new, "key", "left").withColumn("found", F.coalesce("found", none))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def with_added(kind: str) -> Column:
    added = F.transform(F.filter("found", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(F.concat(F.col(kind), added))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_spans (base and added) for every row."""
    based, new = with_spans(docs.select(F.col("doc_id").cast("long"), "text"))
    rows = joined_spans(based.select("row.doc_id", "key", *KINDS), new)
    base = F.array_join(F.concat(*(listed(k, F.col(k)) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(listed(k, with_added(k)) for k in KINDS)), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    every_size = (sum(F.size(k) for k in KINDS) + F.size("found")).cast("long")
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), every_size.alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets.

    Spans that overlap are replaced as one. Texts without any, null texts among them, stay as they are, as do
    all other columns.
    """
    based, new = with_spans(docs)
    rows = joined_spans(based, new)
    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0))
    def piece(p: Column) -> Column:
        """A piece with its spans replaced; all that begin in it end in it."""
        added = F.filter("found", lambda s: (s["start"] >= p["at"]) & (s["start"] < p["at"] + p["n"]))
        start = F.struct(p["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        inside = lambda place: (place - p["at"]).cast("int")

        def step(so_far: Column, s: Column) -> Column:
            gap = F.substr(p["body"], inside(so_far["at"]) + 1, (s["start"] - so_far["at"]).cast("int"))
            out = F.when(s["start"] < so_far["at"], so_far["out"]).otherwise(F.concat(so_far["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]")))))
            return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), out.alias("out"))

        def finish(done: Column) -> Column:
            return F.concat(F.array_join(done["out"], ""), F.substr(p["body"], inside(done["at"]) + 1, p["n"]))

        return F.aggregate(F.array_sort(F.concat(p["spans"], added), by_start), start, step, finish)

    bodies = F.transform("pieces", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), p["spans"].alias("spans"), F.substr(F.col("row.text"), p["at"].cast("int") + 1, p["n"]).alias("body")))
    changed = F.exists("pieces", lambda p: F.size(p["spans"]) > 0) | (F.size("found") > 0)
    text = F.when(changed, F.array_join(F.transform(bodies, piece), "")).otherwise(F.col("row.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
