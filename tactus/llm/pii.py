"""Personal data: base patterns, then bootstrapped contextual extraction.

Base spans of four kinds (email, ip, card, phone) are found by expression: a
text is split at the matches of a kind's pattern, and the lengths of pieces
and matches give the offsets in code points. The patterns are written so that
they need no backtracking over long runs (possessive, anchored at run starts or
at the end of the match before), with the same matches as the plain ones.

The base spans are the seeds of a bootstrap. Their lexical contexts, the word
and the two words to their left, are patterns; other identifier-like words
with four digits or more are candidate instances. Spark scores the graph of
patterns and instances in ``ROUNDS`` rounds: a pattern's score for a kind is the
mean confidence of its instances (1 for seeds of the kind, 0 for those of
others), smoothed towards 0; a candidate's confidence is the mean score of the
patterns around its occurrences. Occurrences of candidates whose confidence
reaches ``ACCEPT`` through patterns with ``SUPPORT`` seed occurrences or more
become spans of the kind. Base spans always stay.

Built-in expressions only. Texts are read once; contexts and spans of each
document are stored, and all later steps aggregate (pattern, instance) pairs,
so frequent words are summed before they are shuffled. Defined cases: a null
text is empty and has no spans; rows with equal doc_id and text are one
document to the bootstrap and get equal spans; a null doc_id is an id like
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import cut, written

ROUNDS, ACCEPT, SUPPORT, SMOOTH = 2, 0.8, 20, 2.0
KINDS = ["email", "ip", "card", "phone"]
# The contract's patterns, in forms that match the same without backtracking over runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like words, from which candidates are taken.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@._%+-]{6,}+"
CONTEXT = 80


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by ten."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """All matches in order: array of start, end (code points) and m."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("found"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(pairs, begin, step, lambda acc: acc["found"])


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, v (digest of the text), text, an array of spans for each kind, and cand."""
    df = docs.select("doc_id", F.xxhash64("text").alias("v"), F.coalesce("text", F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    needs = {"email": F.instr("text", "@") > 0, "phone": F.instr("text", "+") > 0}
    digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        df = df.withColumn(f"all_{kind}", F.when(needs.get(kind, digit), _found(F.col("text"), PATTERNS[kind])).otherwise(empty))
    df = df.withColumn("all_cand", F.when(digit, _found(F.col("text"), CANDIDATE)).otherwise(empty))
    return df.select("doc_id", "v", "text", *[F.filter(f"all_{k}", _keeps(k)).alias(k) for k in KINDS], F.col("all_cand").alias("cand"))


def _keeps(kind: str):
    return lambda s: _holds(kind, s["m"])


def _overlaps(spans: Column):
    def inner(s: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return inner


def _joined(*named: tuple[str, Column]) -> Column:
    parts = [F.transform(spans, _text_of(kind)) for kind, spans in named]
    return F.array_join(F.flatten(F.array(*parts)), ",")


def _text_of(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base (a struct of arrays of spans by kind) and more (discovered spans: kind, start, end)."""
    spans = _spans(docs)
    base = F.concat(*KINDS)
    fresh = F.filter("cand", lambda s: (F.length(_digits(s["m"])) >= 4) & ~_overlaps(base)(s))

    def occurrence(kind: Column):
        def inner(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
            left = F.substring(F.col("text"), begin + 1, s["start"] - begin)
            return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), left.alias("left"))

        return inner

    each = [F.transform(k, occurrence(F.lit(k))) for k in KINDS] + [F.transform(fresh, occurrence(F.lit(None).cast("string")))]
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    stored = written(spans.select("doc_id", "v", *bare, F.concat(*each).alias("seen")), "spans")

    seen = stored.where(F.size("seen") > 0).select("doc_id", "v", F.explode("seen").alias("o")).select("doc_id", "v", "o.*").distinct()
    words = F.slice(F.reverse(F.split(F.regexp_replace(F.lower(F.col("left")), "[0-9]+", "0"), r"[\x20\x09-\x0D]+")), 1, 3)
    # the text before an identifier ends with white space or with what is written to it directly
    near = F.concat_ws(" ", F.reverse(F.slice(words, 1, 2)))
    wide = F.concat_ws(" ", F.reverse(words))
    contexts = seen.select("*", F.explode(F.array(F.concat(F.lit("1 "), near), F.concat(F.lit("2 "), wide))).alias("pattern"))
    edges = cut(contexts.groupBy("pattern", "m", "kind").agg(F.count(F.lit(1)).alias("n")))

    # confidence of each instance for each kind: 1 for its seeds, 0 for other kinds' seeds, to be learnt for candidates
    seeds = edges.where("kind is not null").groupBy("pattern", F.col("kind").alias("k")).agg(F.sum("n").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    open_edges = edges.where("kind is null").select("pattern", "m", "n")
    patterns = seeds.join(totals, "pattern")
    score = F.round(F.col("seeds") / (F.col("all") + SMOOTH), 6)
    scored = cut(patterns.select("pattern", "k", "seeds", "all", score.alias("score")))
    best = None
    for _ in range(ROUNDS):
        instances = open_edges.join(scored, "pattern").groupBy("m", "k").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("c"))
        best = cut(instances.select("m", "k", F.round("c", 6).alias("c")))
        gained = open_edges.join(best, "m").groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("c")).alias("gain"))
        renewed = scored.drop("score").join(gained, ["pattern", "k"], "left")
        scored = cut(renewed.select("pattern", "k", "seeds", "all", F.round((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("all") + SMOOTH), 6).alias("score")))
    accepted = best.where(F.col("c") >= ACCEPT).groupBy("m").agg(F.min(F.struct((-F.col("c")).alias("c"), "k")).alias("b")).select("m", F.col("b.k").alias("found"))
    more = seen.where("kind is null").join(accepted, "m").select("doc_id", "v", F.struct("start", "end", F.col("found").alias("kind")).alias("s"))
    more = more.groupBy("doc_id", "v").agg(F.array_sort(F.collect_set("s")).alias("more")).withColumnsRenamed({"doc_id": "_d", "v": "_v"})
    joined = stored.drop("seen").join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("v") == F.col("_v")), "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return joined.select("doc_id", F.struct(*KINDS).alias("base"), F.coalesce("more", none).alias("more"))


def contract(docs: DataFrame) -> DataFrame:
    found = extract(docs)

    def both(kind: str) -> Column:
        own = F.transform(F.filter("more", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.array_sort(F.concat(F.col("base")[kind], own))

    return found.select(
        "doc_id",
        *[F.size(F.col("base")[k]).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(*[(k, F.col("base")[k]) for k in KINDS]), 256).alias("base_sha256"),
        _joined(*[(k, both(k)) for k in KINDS]).alias("spans"),
    )
