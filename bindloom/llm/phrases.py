"""Phrase collocations: exact counts of word runs by multikey quicksort, scored by their weakest cut.

Words are counted per language first; a phrase with a rare word is rare itself, so only positions of
frequent words go on. Every such position is a pointer to the run of at most ``longest`` words that starts
there. Equal runs of one chunk of texts become one row with a count; the rows are routed over the cluster
by their leading words, two of them or, while all leading words are very common, one more, so that no
common pair is one task, a share of them at a time. Where they arrive, a three-way quicksort works on the pointers word by word:
the size of an equal part is the count of a phrase, and a part with fewer occurrences than wanted is
abandoned at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.llm.common import dropped, planes, unplanes, written

CHUNK_WORDS = 1 << 21  # words of one task that share a dictionary of their own
PART_ROWS = 1 << 20  # runs that one part of the routed rows holds about
COMMON_SHARE = 8  # a word is very common from this part of ``PART_ROWS`` on
PASSES = 2  # parts are dealt and counted in so many turns; the runs of one turn are on the disks at a time
RANK_SALTS = 64
FRONT = 1 << 16  # marks, in place of a depth, a front of very common words; beyond any depth
_ROUTE = np.uint64(0x9E3779B97F4A7C15)
#: Separators of pieces become line feeds, tabs become blanks.
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
c = F.col


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(planes(values), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    return unplanes(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def pack_runs(runs: np.ndarray, weights: np.ndarray, depth: np.ndarray) -> bytes:
    """A block of weighted runs: its distinct ids, rising, and the runs as numbers of these ids, the most frequent first."""
    ids, at, times = np.unique(runs, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    number = np.empty(len(ids), np.uint32)
    number[order] = np.arange(len(ids))
    rows = number[at.reshape(runs.shape)]
    rows = np.concatenate([rows, weights[None].astype(np.uint32), depth[None].astype(np.uint32)])
    rows = rows[:, np.lexsort(rows[1::-1])]
    rows[0] = np.diff(rows[0], prepend=np.uint32(0))
    parts = [np.diff(ids, prepend=0).view(np.uint64), order.astype(np.uint32)]
    body = b"".join(planes(x) for x in (*parts, rows.reshape(-1)))
    head = np.array([len(ids), runs.shape[1], len(body)], np.int64).tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unpack_runs(data: bytes, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs, weights and depths of a block."""
    n_ids, n, size = np.frombuffer(data[:24], np.int64).tolist()
    body = pa.decompress(data[24:], size, codec="zstd", asbytes=True)
    ids = np.cumsum(unplanes(body[: 8 * n_ids], np.uint64).view(np.int64))
    order = unplanes(body[8 * n_ids : 12 * n_ids], np.uint32)
    rows = unplanes(body[12 * n_ids :], np.uint32).reshape(longest + 2, n)
    rows[0] = np.cumsum(rows[0], dtype=np.uint32)
    return ids[order][rows[:longest]], rows[longest].astype(np.int64), rows[longest + 1].astype(np.int64)


def _chunks(df: DataFrame) -> DataFrame:
    """One row per language and chunk of texts: distinct words, their counts, and the word numbers in order.

    Number 0 ends a piece; word k of ``words`` has the number k + 1."""

    def row(lang, stream):
        numbers, places = stream
        flat = np.concatenate([np.asarray(x, np.uint32) for x in places])
        # the dictionary gives 0 to the break and 1 to the empty string between two blanks
        flat = flat[flat != 1]
        flat = np.where(flat > 1, flat - 1, 0).astype(np.uint32)
        times = np.bincount(flat, minlength=len(numbers) - 1)[1:]
        words = [w.decode() for w in list(numbers)[2:]]
        return lang, words, times.tolist(), int(times.sum()), len(flat), _packed(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            numbers[b"\n"], numbers[b""]
            return numbers, []

        streams: dict[str, tuple] = {}
        held = 0

        def flush():
            rows = [row(lang, s) for lang, s in streams.items()]
            streams.clear()
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            names = ["lang", "words", "times", "n", "size", "stream"]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                if lang not in streams:
                    streams[lang] = fresh()
                numbers, places = streams[lang]
                # the leading blank keeps the break of the last text apart
                parts = text.encode().lower().translate(_MARKS).replace(b"\n", b" \n ").split(b" ")
                parts.append(b"\n")
                places.append(np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts)))
                held += len(parts)
                if held >= CHUNK_WORDS:
                    yield flush()
                    held = 0
        if streams:
            yield flush()

    schema = "lang string, words array<string>, times array<long>, n long, size long, stream binary"
    out = df.select("lang", "text").mapInArrow(run, schema)
    return out.withColumn("chunk", F.monotonically_increasing_id())


def _frequent_words(chunks: DataFrame, least: int) -> DataFrame:
    """(chunk, at, id, f, lang, word) of the words with ``least`` occurrences or more, by chunk; lang and word in one row of each.

    One shuffle of the chunks' dictionaries gives the counts and the ids: a word is at most one row a chunk."""
    entries = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "times")).alias("at", "w"))
    entries = entries.select("chunk", "lang", (c("at") + 1).alias("at"), c("w.words").alias("word"), c("w.times").alias("times"))
    same = W.partitionBy("lang", "word")
    rows = entries.withColumn("f", F.sum("times").over(same)).filter(c("f") >= least).withColumn("_row", F.monotonically_increasing_id() + 1)
    rows = rows.withColumn("id", F.min("_row").over(same))  # 0 is no id
    first = c("id") == c("_row")
    return written(rows.select("chunk", "at", "id", "f", "lang", F.when(first, c("word")).alias("word")), "phrase-entries")


def _runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """Runs (rows of ``longest`` ids, 0 behind the end) that start at the positions of two ids or more in a row."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    starts = np.flatnonzero((padded[:n] != 0) & (padded[1 : n + 1] != 0))
    out = np.empty((longest, len(starts)), ids.dtype)
    out[0] = ids[starts]
    alive = np.ones(len(starts), bool)
    for k in range(1, longest):
        nxt = padded[starts + k]
        alive &= nxt != 0
        out[k] = np.where(alive, nxt, 0)
    return out


def _merged(runs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``runs`` in lexicographic order, and the summed weights."""
    if not len(weights):
        return runs, weights
    order = np.lexsort(runs[::-1])
    runs, weights = runs[:, order], weights[order]
    new = np.ones(len(weights), bool)
    new[1:] = (runs[:, 1:] != runs[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return runs[:, first], np.add.reduceat(weights, first)


def route_depth(common: np.ndarray) -> np.ndarray:
    """Leading words that route a run: 2, and one more as long as all words so far are very common."""
    depth = np.full(common.shape[1], 2)
    all_common = common[0] & common[1]
    for k in range(2, len(common)):
        depth[all_common] = k + 1
        all_common = all_common & common[k]
    return depth


def frequent_phrases(runs: np.ndarray, weights: np.ndarray, shortest: int, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """Prefixes of ``shortest`` words or more that at least ``least`` of the weighted runs start with.

    Multikey three-way quicksort of run pointers; a part that weighs less than ``least`` is abandoned."""
    longest = len(runs)
    stack = [(np.arange(runs.shape[1]), 0)]
    while stack:
        at, depth = stack.pop()
        if weights[at].sum() < least:
            continue
        keys = runs[depth][at]
        a, b, d = keys[0], keys[len(keys) // 2], keys[-1]
        pivot = max(min(a, b), min(max(a, b), d))
        low, equal = keys < pivot, keys == pivot
        rest = at[~(low | equal)]
        if len(rest):
            stack.append((rest, depth))
        if low.any():
            stack.append((at[low], depth))
        if pivot == 0:  # runs that ended before this word
            continue
        at = at[equal]
        total = int(weights[at].sum())
        if total >= least:
            if depth + 1 >= shortest:
                yield runs[: depth + 1, at[0]], total
            if depth + 1 < longest:
                stack.append((at, depth + 1))


def _routed(chunks: DataFrame, back: DataFrame, parts: int, longest: int, turn: int) -> DataFrame:
    """(part, block): the merged runs of every chunk, dealt by their leading words; the parts of one turn."""

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = dealt(left, right) if right.num_rows else []  # else no word of the chunk is frequent
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "block"])

    def dealt(left: pa.Table, right: pa.Table) -> list[tuple]:
        size = left.column("size")[0].as_py()
        stream = _unpacked(left.column("stream")[0].as_py(), size, np.uint32)
        top = int(stream.max()) + 1
        ids, common = np.zeros(top, np.int64), np.zeros(top, bool)
        at = right.column("at").to_numpy()
        ids[at] = right.column("id").to_numpy()
        common[at] = right.column("common").to_numpy()
        # the runs carry chunk numbers of words first: small values sort fast
        local = np.where(ids[stream] != 0, stream, 0).astype(np.uint32)
        runs = _runs(local, longest)
        runs, weights = _merged(runs, np.ones(runs.shape[1], np.int64))
        if not len(weights):
            return []
        depth = route_depth(common[runs])
        # the very common words in front of a deeper route are phrases of their own, counted where they are routed to
        whole = [(runs, weights, depth)]
        for k in range(2, longest):
            front, sums = _merged(runs[:k, depth > k], weights[depth > k])
            rest = np.zeros((longest - k, front.shape[1]), runs.dtype)
            whole.append((np.concatenate([front, rest]), sums, np.full(len(sums), FRONT + k)))
        runs, weights, depth = (np.concatenate([x[i] for x in whole], axis=-1) for i in range(3))
        key = np.zeros(len(weights), np.uint64)
        for k in range(longest):
            key = np.where(depth % FRONT > k, (key ^ ids[runs[k]].view(np.uint64)) * _ROUTE, key)
            key ^= key >> np.uint64(29)
        part = (key % np.uint64(parts)).astype(np.int64)
        mine = np.flatnonzero(part % PASSES == turn)
        order = mine[np.argsort(part[mine], kind="stable")]
        if not len(order):
            return []
        bounds = np.flatnonzero(np.diff(part[order])) + 1
        return [(int(part[some[0]]), pack_runs(ids[runs[:, some]], weights[some], depth[some])) for some in np.split(order, bounds)]

    left = chunks.select("chunk", "size", "stream").groupBy("chunk")
    return left.cogroup(back.groupBy("of")).applyInArrow(deal, "part long, block binary")


def _counted(routed: DataFrame, longest: int, least: int) -> DataFrame:
    """(ids, f) of the frequent phrases, part by part."""
    schema = "ids array<long>, f long"

    def count(rows: pa.Table) -> pa.Table:
        ids, f = [], []
        blocks = [unpack_runs(x.as_py(), longest) for x in rows.column("block")]
        all_runs, all_weights, depths = (np.concatenate([x[i] for x in blocks], axis=-1) for i in range(3))
        del blocks
        for depth in np.unique(depths).tolist():
            some = np.flatnonzero(depths == depth)
            runs, weights = all_runs[:, some], all_weights[some]
            if depth > FRONT:  # phrases of one length
                fronts, sums = _merged(runs[: depth - FRONT], weights)
                ids.extend(fronts[:, sums >= least].T.tolist())
                f.extend(sums[sums >= least].tolist())
                continue
            for phrase, total in frequent_phrases(runs, weights, depth, least):
                ids.append(phrase.tolist())
                f.append(total)
        return pa.table([pa.array(ids, pa.list_(pa.int64())), pa.array(f, pa.int64())], names=["ids", "f"])

    return routed.groupBy("part").applyInArrow(count, schema)


def _best_cuts(phrases: DataFrame, words: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of all candidates, each at its lowest-scoring cut."""
    long = phrases.filter(F.size("ids") > 1)
    counts = phrases.select("ids", "f")
    first = long.select("ids", c("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    first = first.withColumns({"head": F.slice("ids", 1, c("k")), "tail": F.slice("ids", c("k") + 1, F.size("ids"))})
    cuts = first.join(counts.select(c("ids").alias("head"), c("f").alias("l")), "head").join(counts.select(c("ids").alias("tail"), c("f").alias("r")), "tail")
    lang_of = words.select(c("id").alias("_first"), "lang")
    cuts = cuts.withColumn("_first", F.get("ids", F.lit(0))).join(lang_of, "_first").join(sizes, "lang")
    # 1000 * a * n and l * r need up to 38 digits
    wide = lambda x: x.cast("decimal(19,0)")
    above = ((wide(c("a")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(22,0)") * c("n").cast("decimal(16,0)")).cast("decimal(38,0)")
    below = (wide(c("l")) * wide(c("r"))).cast("decimal(38,0)")
    cuts = cuts.withColumns({"_above": above, "_below": below}).withColumn("score", F.expr("_above div _below"))
    best = cuts.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    return best.select("lang", "ids", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, pieces into words at
    blanks and tabs. Candidates are phrases of 2 to ``longest`` words inside one piece with at least ``least``
    occurrences ``a``, overlaps counted. A cut gives the counts l and r of both parts and the score
    floor(1000 * a * n / (l * r)), with n words in the language; the lowest score counts, ties to the
    shortest first part. A candidate goes if a longer candidate that holds it occurs as often. Order:
    score and a descending, then the phrase by its bytes.

    Null texts have no words, a null language is ``und``. Repeated rows count each time. Texts and pieces
    of any length are whole. Extra columns are not read; an empty table gives an empty result.
    """
    source = df.select(F.coalesce(c(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), c(f"`{text}`").alias("text"))
    chunks = written(_chunks(source), "phrase-chunks")
    sizes = chunks.groupBy("lang").agg(F.sum("n").alias("n"))  # one row a language
    entries = _frequent_words(chunks, least)
    words = entries.filter("word IS NOT NULL").select("lang", "word", "id", "f")
    dropped(df.sparkSession)
    held = words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()["f"]
    parts = max(8, -(-held // PART_ROWS))
    back = entries.select(c("chunk").alias("of"), "at", "id", (c("f") * COMMON_SHARE >= PART_ROWS).alias("common"))
    found = []
    for turn in range(PASSES):
        found.append(written(_counted(_routed(chunks, back, parts, longest, turn), longest, least), "phrase-runs"))
        dropped(df.sparkSession)
    phrases = words.select(F.array("id").alias("ids"), "f")
    for runs in found:
        phrases = phrases.unionByName(runs)
    phrases = written(phrases, "phrases")
    words = written(words, "phrase-words")
    sizes = written(sizes, "phrase-sizes")
    dropped(df.sparkSession, chunks, entries, *found)

    scored = _best_cuts(phrases, words, sizes, least)
    longer = phrases.filter(F.size("ids") > 2)
    inner = F.explode(F.array(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1)))
    # a phrase in a longer one with as many occurrences is in one with a single word more, too
    covered = longer.select(inner.alias("ids"), c("f").alias("_f")).groupBy("ids").agg(F.max("_f").alias("_f"))
    free = scored.join(covered, "ids", "left").filter("_f IS NULL OR _f < a").drop("_f")
    spelt = free.select("ids", F.posexplode("ids").alias("_at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return _first(free.join(spelt, "ids").drop("ids"), top)


def _first(found: DataFrame, top: int) -> DataFrame:
    """The first rows of every language, ranked in salted groups first."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).filter(c("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(c("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
