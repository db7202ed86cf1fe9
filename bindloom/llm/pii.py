"""Personal identifiers: four base patterns, and contexts learnt from them, in DataFrame expressions only.

Seeds are the valid matches of the base patterns. Every identifier-like run of characters of a text
is a candidate instance; the two words before it are its lexical pattern. Patterns and instances form
a graph per kind. In each round a pattern's confidence is the mean score of the distinct instances that
occur behind it, and the score of an instance that is no seed is 1 minus the product of (1 - confidence)
over its patterns. Patterns with enough distinct seeds and high confidence discover the instances
behind them that no base pattern matches. The discovered ones that can be identifiers of the kind are
seeds of the next generation of patterns, until a generation trusts no new pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
# The patterns start only where a run of their leading characters starts, or where the match before
# ended (\G), and their repetitions are possessive where what follows cannot be part of them: the
# matches are those of the plain patterns, in linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of visible characters with a digit or an at sign, with further groups of digits behind it.
CANDIDATE = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+(?: (?=[0-9().-])[0-9().-]*[0-9][0-9().-]*)*+"
MIN_SEEDS = 3
CONFIDENCE = 0.8
ROUNDS = 3
c = F.col


def _running(lengths: Column) -> Column:
    """Sums of an array up to and including each element, by doubling steps: n log n in a row of any length."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def add(sums: Column, step: Column) -> Column:
        longer = F.transform(sums, lambda x, i: x + F.when(i >= step, F.get(sums, i - step)).otherwise(F.lit(0).cast("long")))
        return F.when(step >= F.size(sums), sums).otherwise(longer)

    return F.aggregate(steps, lengths, add)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of all matches, in code points, end exclusive.

    ``before`` holds up to 200 characters between the match before and this one."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # there is one gap more than there are matches
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap"), F.substring(g, -200, 200).alias("before")))
    both = F.filter(both, lambda s: s["value"].isNotNull())

    def placed(m: Column) -> Column:
        ends = _running(F.transform(m, lambda s: (s["gap"] + F.length(s["value"])).cast("long")))
        return F.zip_with(ends, m, lambda e, s: F.struct((e - F.length(s["value"])).alias("start"), e.alias("end"), s["value"].alias("value"), s["before"].alias("before")))

    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    # most texts have no match: they skip the sums
    return F.when(text.rlike(pattern), _bound(both, placed)).otherwise(nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check sum of up to 19 digits; zeros in front do not matter."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind in ("card", "phone"):
        digits = _digits(value)
        low, high = (13, 19) if kind == "card" else (9, 15)
        right = F.length(digits).between(low, high)
        return right & _luhn(digits) if kind == "card" else right
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind: leftmost, not overlapping; a match that fails is dropped without another try."""
    return F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))


def _plausible(kind: Column, value: Column) -> Column:
    """Whether a new instance can be an identifier of the kind at all."""
    digits = F.length(_digits(value))
    return (
        F.when(kind == "email", value.rlike("[A-Za-z0-9]") & value.contains("@"))
        .when(kind == "ip", (digits >= 4) & value.rlike(r"^[0-9A-Fa-f.:]+$"))
        .when(kind == "card", digits.between(12, 19) & value.rlike(r"^[0-9 .-]+$"))
        .otherwise(digits.between(6, 15) & value.rlike(r"^[0-9 ()./+-]+$"))
    )


def _candidates(text: Column) -> Column:
    """Candidates with the text before them, trimmed of quotes and punctuation at both ends."""
    opening, closing = F.lit("\"'([{<"), F.lit("\"')]}>.,;:!?")

    def cut(s: Column) -> Column:
        tail = F.ltrim(s["value"], opening)
        start = s["end"] - F.length(tail)
        inner = F.rtrim(tail, closing)
        context = F.lower(F.regexp_replace(F.regexp_extract(s["before"], r"(?:[^\s]+\s+)?[^\s]+\s*$", 0), r"[\s]+", " "))
        return F.struct(start.alias("start"), (start + F.length(inner)).alias("end"), inner.alias("value"), F.trim(context).alias("pattern"))

    return F.filter(F.transform(_located(text, CANDIDATE), cut), lambda s: (F.length(s["value"]) > 0) & (F.length(s["pattern"]) > 0))


def _numbered(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def _joined(spans: Column) -> Column:
    """kind:start:end of (kind, start, end) spans, by kind as listed, then start."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"], s["end"])), ",")


def _trusted(edges: DataFrame, sizes: DataFrame, known: DataFrame, min_seeds: int, confidence: float, rounds: int) -> DataFrame:
    """(pattern, kind, confidence) worth trusting by the instances ``known`` (value, kind, score) already."""
    # patterns with fewer known instances behind them are not scored in this generation
    backed = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    backed = written(backed.filter(c("seeds") >= min_seeds).join(sizes, "pattern"), "pii-patterns")
    open_edges = written(edges.join(backed.select("pattern").distinct(), "pattern", "left_semi"), "pii-graph")
    scores = known
    trusted = None
    for turn in range(rounds):
        near = open_edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        trusted = backed.join(near, ["pattern", "kind"]).withColumn("confidence", c("sum") / c("instances"))
        if turn + 1 < rounds:
            new = _scored(open_edges, trusted).join(known.select("value").distinct(), "value", "left_anti")
            scores = written(known.unionByName(new.filter("score > 0.01")), "pii-scores")
    return trusted.filter(c("confidence") >= confidence).select("pattern", "kind", "confidence")


def _scored(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, kind, score) of the instances behind patterns (pattern, kind, confidence) that are no seeds there."""
    miss = F.exp(F.sum(F.log(F.greatest(1 - c("confidence"), F.lit(1e-12)))))
    return edges.filter("seed is null").join(patterns, "pattern").groupBy("value", "kind").agg((1 - miss).alias("score"))


def learn_patterns(occurrences: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind) worth trusting, from occurrences (pattern, value, kind); kind is null if no base pattern matched."""
    edges = written(occurrences.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "pii-edges")
    seeds = edges.filter("seed is not null").select("value", c("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), c("kind"))
    known, before = seeds, 0
    while True:
        trusted = written(_trusted(edges, sizes, known, min_seeds, confidence, rounds), "pii-trusted")
        now = trusted.count()
        if now <= before:
            return trusted.groupBy("pattern").agg(F.max_by("kind", "confidence").alias("kind"))
        before = now
        found = _scored(edges, trusted).filter(_plausible(name, c("value")))
        found = found.join(seeds.select("value").distinct(), "value", "left_anti")
        known = written(seeds.unionByName(found), "pii-known")


def find(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row.

    The counts and ``base_sha256`` are of the base spans, ``spans`` lists these and the discovered ones
    as kind:start:end (code points, end exclusive) by kind and start; ``n_found`` counts the
    discovered ones. A discovered span follows a trusted pattern, can be an identifier of its kind
    and overlaps no base span. Patterns need ``min_seeds`` distinct seeds, or
    instances discovered before, and the given mean score.

    Null and empty texts have no spans. Repeated rows and ids are rows of their own and get the same
    result for the same text. Values that occur often count once per pattern. Extra columns are not
    read; an empty table gives an empty result. The located spans, without texts, are written to the
    shared folder with a row number, which later steps join on.
    """
    source = df.select(c(doc_id).alias("_id"), F.coalesce(c(text), F.lit("")).alias("_text"))
    base = [_numbered(base_spans(c("_text"), kind), i + 1) for i, kind in enumerate(KINDS)]
    found = F.when(c("_text").rlike("[0-9@]"), _candidates(c("_text"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,pattern:string>>"))
    rows = source.select(F.monotonically_increasing_id().alias("row"), "_id", F.concat(*base).alias("base"), found.alias("candidates"))
    rows = written(rows, "pii-rows")

    # a candidate that holds a base span is an occurrence of that seed; one that only touches it is none
    cand = rows.filter(F.size("candidates") > 0).select("row", "base", F.explode("candidates").alias("x"))
    touch = lambda s: (s["start"] < c("x.end")) & (c("x.start") < s["end"])
    same = F.filter("base", lambda s: (s["start"] == c("x.start")) & touch(s))
    seed = F.get(F.transform(same, lambda s: F.struct(s["k"], s["value"])), F.lit(0))
    cand = cand.select("row", "x.*", seed.alias("seed"), F.exists("base", touch).alias("taken"))
    cand = cand.filter(c("seed").isNotNull() | ~c("taken"))
    cand = cand.select("row", "start", "end", "pattern", F.coalesce("seed.value", "value").alias("value"), c("seed.k").alias("kind"))
    cand = written(cand, "pii-candidates")
    trusted = learn_patterns(cand.select("pattern", "value", "kind"), min_seeds, confidence)
    names = F.element_at(F.array(*map(F.lit, KINDS)), c("k"))
    new = cand.filter("kind is null").drop("kind").join(trusted.withColumnRenamed("kind", "k"), "pattern").filter(_plausible(names, c("value")))
    new = new.groupBy("row").agg(F.collect_list(F.struct("k", "start", "end")).alias("new"))

    plain = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    extra = F.coalesce("new", F.array().cast("array<struct<k:int,start:bigint,end:bigint>>"))
    out = rows.join(new, "row", "left")
    counts = [_count("base", i + 1).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select(
        c("_id").alias(doc_id), *counts, F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(F.concat(plain, extra)).alias("spans"), F.size(extra).cast("long").alias("n_found")
    )
