"""Line dedup by an exact set-similarity join, in DataFrame expressions only.

A line is the set of its five-word shingles (as 64-bit hashes); fewer words are one token together. A shingle's token starts with its
rarity level, from counts over the whole corpus, so that the numeric order of tokens is rare-first
on every line. For a Jaccard threshold t, sets of n <= m tokens can only match if n >= t * m
(length), if they share one of their first n - ceil(t * n) + 1 tokens (prefix), and if the tokens
before and behind the shared one can still make up the overlap (position). Pairs that pass are
verified on the whole sets. A line goes if an earlier line matches it.

Lines that are equal but for case are one class, found by their hash. Sets too small to match any but an
equal one have no prefix: their class is the hash of the set, whatever the separators or repeats. A class is compared with the earliest class
at each of its shared tokens first; only classes without a match there meet all earlier ones, at tokens that can be the first one
of a pair: with enough tokens from there on in both, as nothing before it is shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.llm.common import dropped, written

WORDS = 5  # per shingle; fewer words of a line are one token
BLANK = " \t\x0b\x0c\r"
CELL_BITS = 16  # shingles are counted in 2^16 hashed cells
INNER_BITS = 10
c = F.col


def _cells(df: DataFrame, cell: str, value: Column, bits: int, kind: str, default) -> Column:
    """A table of 2^bits values as one scalar array of arrays; cells without a row hold ``default``.

    Its size is fixed by ``bits``, whatever the input."""
    every = df.sparkSession.range(1 << bits).withColumnRenamed("id", cell)
    filled = every.join(df.select(cell, value.cast(kind).alias("x")), cell, "left")
    filled = filled.select(F.shiftright(cell, INNER_BITS).alias("o"), F.struct((c(cell) % (1 << INNER_BITS)).alias("i"), F.coalesce("x", F.lit(default).cast(kind)).alias("x")).alias("s"))

    def in_order(rows: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(rows)), lambda s: s["x"])

    outer = filled.groupBy("o").agg(in_order(c("s")).alias("x"))
    return outer.agg(in_order(F.struct("o", "x")).alias("t")).scalar()


def _at(table: Column, cell: Column) -> Column:
    outer = F.get(table, F.shiftright(cell, INNER_BITS).cast("int"))
    return F.get(outer, (cell % (1 << INNER_BITS)).cast("int"))


def _bits(df: DataFrame, column: str, bits: int = 24) -> Callable[[str], Column]:
    """A first, inexact filter for the values of a column of longs: a bitmap of 2^bits bits."""
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    words = df.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b"))
    table = _cells(words.groupBy("w").agg(F.bit_or("b").alias("b")), "w", c("b"), bits - 6, "long", 0)

    def has(name: str) -> Column:
        at = F.shiftrightunsigned(F.xxhash64(name), 64 - bits)
        return F.getbit(_at(table, F.shiftright(at, 6)), (at % 64).cast("int")) == 1

    return has


def _lines(df: DataFrame) -> DataFrame:
    """(_id, th, line_no, h, line) of all lines, lower-cased; ``h`` is the class of a line."""
    # the hash of the text first: behind the explode it would be computed once per line
    texts = df.select("_id", F.xxhash64("_text").alias("th"), F.split("_text", "\n").alias("lines"))
    lines = texts.select("_id", "th", F.posexplode("lines").alias("line_no", "line")).withColumn("line", F.lower("line"))
    return lines.select("_id", "th", "line_no", F.xxhash64("line").alias("h"), "line")


def _words(line: Column) -> Column:
    """Words of a line; only a line with other separators than single blanks needs the regular expression."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for mark in ["  ", *BLANK[1:]]:
        odd = odd | F.contains(line, F.lit(mark))
    return F.when(odd, F.split(F.btrim(line, F.lit(BLANK)), f"[{BLANK}]+")).otherwise(F.split(line, " "))


def _shingles(words: Column) -> Column:
    """64-bit hashes of five words in a row, in their order; one hash of fewer words, none of a blank line."""
    n = F.greatest(F.size(words) - WORDS + 1, F.lit(0))
    runs = F.arrays_zip(*[F.slice(words, F.lit(k + 1), n) for k in range(WORDS)])
    # the words of a blank line are one empty string
    short = F.when(F.get(words, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
    return F.when(n > 0, F.transform(runs, lambda run: F.xxhash64(run))).otherwise(short)


def _cell_of(shingle: Column) -> Column:
    return F.shiftrightunsigned(shingle, 64 - CELL_BITS)


def _rarity(lines: DataFrame) -> Column:
    """Level (0 to 127) of every cell of shingle hashes."""
    words = lines.select(_words(c("line")).alias("words"))
    # an explode with the hash behind it compiles into one loop, unlike a lambda over the words
    last = F.size("words") - WORDS
    at = words.select("words", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
    shingle = F.xxhash64(*[F.get("words", c("i") + k) for k in range(WORDS)])
    cells = at.groupBy(_cell_of(shingle).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(127), F.floor(F.log2(c("n") + 1) * 4))
    return _cells(cells, "cell", level, CELL_BITS, "tinyint", 0)


def _entries(lines: DataFrame, levels: Column, num: int, den: int) -> DataFrame:
    """(_id, th, line_no, h, n, prefix) of the lines: number of tokens (0 if blank), first tokens.

    Sets that can only match an equal set have no prefix; their class ``h`` is the hash of the set."""

    def token(s: Column) -> Column:
        return F.shiftleft(_at(c("_levels"), _cell_of(s)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(s, 8))

    at = ["_id", "th", "line_no", "h"]
    # every step is its own projection and no filter follows, so that nothing is computed twice;
    # a scalar may not be written inside a lambda, as a column of its own it merges into the next step
    hashes = lines.select(*at, _words(c("line")).alias("words")).select(*at, _shingles(c("words")).alias("s"))
    tokens = hashes.withColumn("_levels", levels)
    tokens = tokens.select(*at, "s", F.sort_array(F.array_distinct(F.transform("s", lambda s: F.coalesce(token(s), F.lit(0))))).alias("tokens"))
    n = F.size("tokens")
    first = F.when((den - num) * n >= num, n - F.ceil(n * num / F.lit(den)).cast("int") + 1).otherwise(0)
    whole = F.xxhash64(F.sort_array(F.array_distinct("s")))
    h = F.when(first == 0, whole).otherwise(c("h"))
    return tokens.select("_id", "th", "line_no", h.alias("h"), n.alias("n"), F.slice("tokens", F.lit(1), first).alias("prefix"))


def _may_match(n: Column, pos: Column, m: Column, at: Column, num: int, den: int) -> Column:
    """Length and position filters for sizes n and m with a shared token at pos and at."""
    most = F.least(n - pos, m - at) + F.least(pos, at)
    return (n * den >= m * num) & (m * den >= n * num) & (most * (num + den) >= (n + m) * num)


def _may_begin(n: Column, pos: Column, m: Column, at: Column, num: int, den: int) -> Column:
    """Length and position filters for sizes n and m whose first shared token is at pos and at."""
    return (n * den >= m * num) & (m * den >= n * num) & (F.least(n - pos, m - at) * (num + den) >= (n + m) * num)


def _matches(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (h, other) whose sets reach the threshold."""
    mine = sets.select("h", c("s").alias("s1"))
    other = sets.select(c("h").alias("other"), c("s").alias("s2"))
    both = pairs.join(mine, "h").join(other, "other")
    overlap = F.size(F.array_intersect("s1", "s2"))
    return both.filter(overlap * den >= (F.size("s1") + F.size("s2") - overlap) * num).select("h", "other")


def removed_lines(df: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(_id, th, removed) for texts (_id, _text): ascending numbers of the lines that go."""
    lines = _lines(df)
    order = F.struct("_id", "th", "line_no")
    spark = df.sparkSession
    tokens = written(_entries(lines, _rarity(lines), num, den), "line-tokens")
    dropped(spark)
    table = tokens.filter("n > 0")
    places = table.select("h", "_id", "th", "line_no")
    entries = table.select("h", "n", F.posexplode("prefix").alias("pos", "token"))
    # first the tokens of several lines, then those of several classes
    repeated = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token"), "line-repeated")
    dropped(spark)
    few = entries.filter(_bits(repeated, "token")("token")).join(repeated, "token", "left_semi").distinct()
    few = written(few, "line-few")
    dropped(spark, repeated)
    shared = few.groupBy("token").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("token")
    classes = written(places.groupBy("h").agg(F.min(order).alias("first")), "line-classes")
    postings = written(few.join(shared, "token", "left_semi").join(classes, "h"), "line-postings")
    dropped(spark, few)
    keys = postings.select("h").distinct()
    # one line per class and task travels
    texts = lines.filter(_bits(keys, "h")("h")).groupBy("h").agg(F.first("line").alias("line"))
    words = texts.join(keys, "h", "left_semi").select("h", _words(c("line")).alias("words"))
    sets = written(words.select("h", F.array_distinct(_shingles(c("words"))).alias("s")), "line-sets")
    dropped(spark)

    # the earliest class at each shared token
    earliest = postings.groupBy("token").agg(F.min(F.struct("first", "h", "n", "pos")).alias("e"))
    met = postings.join(earliest, "token").filter((c("h") != c("e.h")) & _may_match(c("n"), c("pos"), c("e.n"), c("e.pos"), num, den))
    pairs = written(met.select("h", c("e.h").alias("other")).distinct(), "line-pairs")
    gone = written(_matches(pairs, sets, num, den).select("h").distinct(), "line-gone")

    # the classes without a match there, against all earlier ones at their tokens
    late = postings.join(gone, "h", "left_anti").select("token", "h", "n", "pos", "first")
    early = postings.select("token", c("h").alias("other"), c("n").alias("m"), c("pos").alias("at"), c("first").alias("before"))
    on = (c("before") < c("first")) & _may_begin(c("n"), c("pos"), c("m"), c("at"), num, den)
    rest = late.withColumnRenamed("token", "t").join(early, (c("t") == c("token")) & on).select("h", "other").distinct()
    rest = rest.join(pairs, ["h", "other"], "left_anti")
    gone = written(gone.unionByName(_matches(rest, sets, num, den).select("h").distinct()), "line-all-gone")
    dropped(spark, pairs, postings, sets)

    marked = places.join(classes.join(gone.withColumn("gone", F.lit(True)), "h", "left"), "h")
    goes = c("gone").isNotNull() | ~c("first").eqNullSafe(order)
    removed = marked.filter(goes).groupBy("_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    removed = written(removed, "line-removed")
    dropped(spark, tokens, classes, gone)
    return removed


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, num: int = 4, den: int = 5) -> DataFrame:
    """Columns ``keep`` (None: all) with the text without repeated lines, and n_lines, n_removed, n_worded.

    Lines end at a line feed; words are what blanks, tabs, carriage returns and form feeds separate,
    all lower-cased. A line goes if an earlier line, in the order of id and line number, is equal but for
    case or has five-word shingles with a Jaccard similarity of at least num/den (default 0.8), whether
    that earlier line stays itself or not; of fewer than five words both must have the same. The other
    lines, blank ones included, stay as they are and in their order. ``n_worded`` counts
    the lines left that hold anything but white space.

    Null ids come first; rows of one id go by a hash of their text; rows that repeat id and text keep
    the same lines. A null text stays null with 0 lines, an empty one has one line. An input column
    with the name of a new one gives way to it; an empty table gives an empty result.
    """
    new = ["n_lines", "n_removed", "n_worded"]
    names = [x for x in (df.columns if keep is None else keep) if x.lower() not in new]
    quoted = lambda x: c("`" + x.replace("`", "``") + "`")
    flat = df.select(quoted(doc_id).alias("_id"), quoted(text).alias("_text"), *[quoted(x).alias(f"_k{i}") for i, x in enumerate(names)])
    found = removed_lines(flat.select("_id", "_text"), num, den).select(c("_id").alias("_rid"), c("th").alias("_rth"), c("removed").alias("_gone"))
    flat = flat.withColumn("_th", F.xxhash64("_text"))
    # found is small beside the texts: hashed, so that no texts are sorted
    both = flat.join(found.hint("shuffle_hash"), c("_id").eqNullSafe(c("_rid")) & (c("_th") == c("_rth")), "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    both = both.withColumn("_gone", gone).withColumn("_lines", F.when(F.size(gone) > 0, F.split("_text", "\n")))
    both = both.withColumn("_n1", F.size("_gone")).withColumn("_stops", F.concat(F.array(F.lit(-1)), "_gone", F.array(F.size("_lines"))))
    # the runs of lines between removed ones
    run = lambda j: F.slice("_lines", F.get("_stops", j) + 2, F.get("_stops", j + 1) - F.get("_stops", j) - 1)
    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), c("_n1")), run)), "\n")
    both = both.withColumn("_kept", F.when(c("_n1") == 0, c("_text")).otherwise(left))
    count = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    both = both.withColumn("_n0", F.when(c("_text").isNull(), 0).otherwise(count))
    worded = F.size(F.filter(F.split("_kept", "\n"), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]")))
    both = both.withColumn("_n2", F.when(c("_text").isNull(), 0).otherwise(worded))
    columns = [c("_kept" if x == text else f"_k{i}").alias(x) for i, x in enumerate(names)]
    return both.select(*columns, *[c(f"_n{i}").alias(x) for i, x in enumerate(new)])
