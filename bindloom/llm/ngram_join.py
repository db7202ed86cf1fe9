"""Near-duplicate texts by an exact Jaccard join on word n-grams.

The n-grams of a text are a set of 64-bit hashes. Sets of sizes n and m that reach the threshold t differ
in d <= (n + m) * (1 - t) / (1 + t) n-grams. Sizes fall into classes, each up to 1 / t times its least one, so that
two linked sets are of one class or of neighbouring ones; for both, d has the bound of the largest sizes.

  parts    the hashes are cut into d + 1 + s ranges; d differences leave s + 1 ranges equal, so linked sets
           share the hash of a part, unless all those ranges are empty in both
  prefix   a set with more than s empty ranges also takes part by the first n - ceil(t * n) + 1 of its hashes:
           of two linked sets that are both so, one of these is shared
  length   n >= t * m
  parity   bitmaps of the parity of n-grams per slot differ in no more bits than the sets differ in n-grams

A part is several n-grams in a row of hashes, so texts that share single common n-grams do not meet, however many
there are. Pairs that pass are verified once on the whole sets. Equal sets are one class from the start. For
components, every class is first compared with the nearest of a few partners that a random draw per shared part
gives, again and again until a draw finds few links; what is connected by then needs no further
comparison, and all pairs of different components that may still link are compared at the end. So the result is that
of all pairs, while a large group of near copies does not cost the square of its size. These filters pick them:

  ranges   a linked set shares as many parts as the bound d leaves equal, not just one
  private  n-grams that no other component holds are in no overlap; a set keeps the others, and goes if they are too few
  rarest   sorted by how many of these sets hold them, two linked sets share one of the first of them, where enough follow
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from bindloom.llm.common import LOWER, append_columns, byte_view, dropped, row_groups, run_hashes, token_classes, written
from bindloom.llm.graph import components

BLOCK = 1 << 14  # cells of a bitmap that travel in one row
PART_BITS = 40  # of a part's hash that travel
NEAREST = 2  # partners of a draw that a class is verified with
_WORD = token_classes(b" \t\n\x0b\x0c\r")
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Distinct 64-bit hashes of the word n-grams of every text, ascending.

    A text of fewer words is one n-gram of all its words, a text without words has none.
    """
    data, offsets = byte_view(col)
    for i, j in row_groups(offsets):
        a, b = offsets[i], offsets[j]
        lower = LOWER[data[a:b]]
        words, first = run_hashes(lower, _WORD[lower], offsets[i : j + 1] - a)
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n if len(grams) else 0):
            grams += _mix(words[k : len(words) - n + 1 + k] + np.uint64(_ODD * (k + 1) & (1 << 64) - 1))
        grams = _mix(grams)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e - s >= n:
                yield np.unique(grams[s : e - n + 1])
            elif e > s:
                short = words[s:e]
                yield _mix(np.array([sum(int(x) * (2 * k + 3) for k, x in enumerate(short)) + len(short) & (1 << 64) - 1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _class_key(grams: np.ndarray) -> int:
    """Signed 64-bit key of a set, from its size and the sum of its hashes."""
    total = len(grams) * _ODD + int(grams.sum(dtype=np.uint64)) & (1 << 64) - 1
    return int(_mix(np.array([total], np.uint64)).view(np.int64)[0])


def _scan(df: DataFrame, text: str, n: int) -> DataFrame:
    """The size and the class key of every text's set."""
    id_type = df.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(grams), _class_key(grams) if len(grams) else None) for grams in ngram_hashes(batch.column(1), n)]
            sizes, keys = zip(*sets) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=["_id", "n", "key"])

    return df.select("_id", text).mapInArrow(run, f"_id {id_type}, n long, key long")


def _summed(blocks: DataFrame, size: int, kind=np.uint32, op=np.add) -> np.ndarray:
    """Adds up (block, cells) rows to one array of fixed size; the blocks are added row by row."""
    per = BLOCK

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(cells.as_py(), kind)
                sums[block] = op(sums[block], part) if block in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "cells"]
        )

    out = np.zeros(size, kind)
    parts = max(1, min(128, size // per))
    for r in blocks.repartition(parts, "block").mapInArrow(add, "block int, cells binary").toLocalIterator():
        out[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["cells"], kind)
    return out


@lru_cache(maxsize=64)
def size_classes(t: Fraction) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Least size of every class of sizes, and per class the ranges of hashes and how many may be empty.

    The numbers of a class hold for pairs of that class and for pairs with the next one."""
    least, cuts = [1], []
    while least[-1] < 1 << 40:
        most = int(least[-1] / t)
        apart = int((most + int(most / t)) * (1 - t) / (1 + t))
        empty = 2 + apart // 32
        cuts.append((apart + 1 + empty, empty))
        least.append(most + 1)
    return np.array(least[:-1]), cuts


@lru_cache(maxsize=4096)
def _range_starts(k: int) -> np.ndarray:
    return np.array([(i << 64) // k for i in range(1, k)], np.uint64)


def part_hashes(grams: np.ndarray, t: Fraction) -> np.ndarray:
    """Hashes of a set that two linked sets share one of, for its own class of sizes and the one before.

    Their leading ``PART_BITS`` bits; two parts that agree in them by chance only make a pair more to verify."""
    m = len(grams)
    least, cuts = size_classes(t)
    own = int(np.searchsorted(least, m, "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams ^ np.uint64(_ODD)), dtype=np.uint64)])
    out, sparse = [], False
    for c in (own, own - 1) if own else (own,):
        k, empty = cuts[c]
        at = np.empty(k + 1, np.int64)
        at[0], at[-1] = 0, m
        at[1:-1] = np.searchsorted(grams, _range_starts(k))
        full = np.flatnonzero(at[1:] > at[:-1])
        sparse |= k - len(full) > empty
        place = (full.astype(np.uint64) + np.uint64((c + 1) << 40)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(_mix((sums[at[full + 1]] - sums[at[full]]) ^ _mix(place)))
    if sparse:
        out.append(_mix(grams[: m - ceil(t * m) + 1] * np.uint64(0x94D049BB133111EB)))
    return (np.concatenate(out) >> np.uint64(64 - PART_BITS)).view(np.int64)


def least_shared(grams: np.ndarray, t: Fraction) -> int:
    """Of how many parts, one at least, a set shares the hashes with any set that it links with."""
    least, cuts = size_classes(t)
    own = int(np.searchsorted(least, len(grams), "right")) - 1
    needs = []
    for c in (own, own - 1) if own else (own,):
        k, empty = cuts[c]
        ends = np.searchsorted(grams, _range_starts(k))
        full = int(np.count_nonzero(np.diff(ends, prepend=0, append=len(grams))))
        needs.append(empty + 1 - (k - full))
    parts = part_hashes(grams, t)
    return max(1, min(needs) - (len(parts) - len(np.unique(parts))))


def parity_bits(grams: np.ndarray) -> bytes:
    """Parity of the n-grams per slot, two slots or more for an n-gram; longer bitmaps fold onto shorter ones."""
    slots = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distances(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Different bits of the bitmaps row by row: at most the different n-grams of the sets."""
    sides = []
    for col in (left, right):
        _, at, data = col.buffers()
        sides.append((np.frombuffer(at, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64), np.frombuffer(data, np.uint8)))
    (at, a), (bt, b) = sides
    la, lb = np.diff(at), np.diff(bt)
    out = np.empty(len(left), np.int64)
    for x, y in set(zip(la.tolist(), lb.tolist())):
        z = min(x, y)
        rows = np.flatnonzero((la == x) & (lb == y))
        for some in np.array_split(rows, -(-len(rows) * max(x, y) // (1 << 23))):
            mine = a[at[some][:, None] + np.arange(x)].reshape(len(some), -1, z)
            other = b[bt[some][:, None] + np.arange(y)].reshape(len(some), -1, z)
            bits = np.bitwise_xor.reduce(mine, axis=1) ^ np.bitwise_xor.reduce(other, axis=1)
            out[some] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return out


class Bits:
    """A bitmap of hashed 64-bit values: never misses one that was added."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 8).bit_length() + 1)

    @staticmethod
    def slots(values: np.ndarray, shift: np.uint64) -> np.ndarray:
        return (_mix(values.astype(np.int64).view(np.uint64) * np.uint64(_ODD)) >> shift).astype(np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = self.slots(values, self.shift)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(values: DataFrame, column: str, most_bits: int = 30) -> Bits:
    """Bitmap of a column of longs for a first, inexact filter; 16 bits per value up to 2^30 bits.

    Its size is bounded whatever the input; beyond the bound it only lets more rows pass.
    """
    bits = min(most_bits, max(20, (16 * values.count()).bit_length()))
    size, shift = 1 << (bits - 3), np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size, np.uint8)
        for batch in batches:
            at = Bits.slots(batch.column(0).to_numpy(zero_copy_only=False), shift)
            np.bitwise_or.at(words, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for b, block in enumerate(words.reshape(-1, BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "cells"])

    blocks = values.select(column).mapInArrow(run, "block int, cells binary")
    return Bits(_summed(blocks, size, np.uint8, np.bitwise_or))


class Join:
    """The scanned corpus: classes of equal sets, postings of shared prefix tokens, sets of their classes."""

    def __init__(self, df: DataFrame, text: str, doc_id: str, n: int, threshold: Fraction):
        self.t, self.n = threshold, n
        self.source = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
        spark = self.spark = df.sparkSession
        self.rows = written(_scan(self.source, "_text", n), "ngram-rows")
        parts = self._parts(None)
        shared = parts.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("part")
        self.shared = written(shared, "shared-parts")
        dropped(spark)
        found = spark.sparkContext.broadcast(bitmap(self.shared, "part"))
        postings = self._parts(found).join(self.shared, "part", "left_semi").distinct()
        self.postings = written(postings, "postings")
        dropped(spark, self.shared)
        keys = self.postings.select("key").distinct()
        wanted = spark.sparkContext.broadcast(bitmap(keys, "key"))
        self.sets = written(self._sets(wanted).join(keys, "key", "left_semi").dropDuplicates(["key"]), "ngram-sets")
        dropped(spark)

    def _parts(self, only) -> DataFrame:
        """(part, key, n) of the hashes of parts, of each class once per task.

        Sets too small to reach the threshold with any other set have no parts."""
        n, t = self.n, self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                part, key, size = [], [], []
                for grams in ngram_hashes(batch.column(0), n):
                    m = len(grams)
                    if not m or Fraction(m, m + 1) < t:
                        continue
                    k = _class_key(grams)
                    if k in seen:
                        continue
                    seen.add(k)
                    own = part_hashes(grams, t)
                    if only is not None:
                        own = own[only.value.has(own)]
                    if len(own):
                        part.append(own)
                        key.append(np.full(len(own), k))
                        size.append(np.full(len(own), m))
                if part:
                    columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (part, key, size)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "n"])

        return self.source.select("_text").mapInArrow(run, "part long, key long, n long")

    def _sets(self, wanted) -> DataFrame:
        """(key, n, need, parity, grams) of the wanted classes, of each once per task."""
        n, t = self.n, self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                keys, sizes, needs, parity, sets = [], [], [], [], []
                for grams in ngram_hashes(batch.column(0), n):
                    m = len(grams)
                    if not m or Fraction(m, m + 1) < t:
                        continue
                    k = _class_key(grams)
                    if k in seen or not wanted.value.has(np.array([k]))[0]:
                        continue
                    seen.add(k)
                    keys.append(k)
                    sizes.append(m)
                    needs.append(least_shared(grams, t))
                    parity.append(parity_bits(grams))
                    sets.append(grams.view(np.int64))
                columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(needs, pa.int32()), pa.array(parity, pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "need", "parity", "grams"])

        return self.source.select("_text").mapInArrow(run, "key long, n long, need int, parity binary, grams array<long>")

    def _may_link(self, n: Column, m: Column) -> Column:
        """Length filter for sizes n and m."""
        num, den = self.t.numerator, self.t.denominator
        return (n * den >= m * num) & (m * den >= n * num)

    def _near(self, pairs: DataFrame) -> DataFrame:
        """(a, b, apart) of the pairs whose parity bitmaps allow a link."""
        num, den = self.t.numerator, self.t.denominator
        size = self.sets.select("key", "n", "parity")
        left = size.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
        right = size.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b, total, one, other = batch.columns
                    apart = parity_distances(one, other)
                    # |a ^ b| = na + nb - 2 * overlap <= (na + nb) * (1 - t) / (1 + t)
                    may = pa.array(apart * (num + den) <= total.to_numpy() * (den - num))
                    yield pa.RecordBatch.from_arrays([a.filter(may), b.filter(may), pa.array(apart).filter(may)], names=["a", "b", "apart"])

        both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "pa", "pb")
        return both.mapInArrow(run, "a long, b long, apart long")

    def _verified(self, near: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by the whole sets."""
        num, den = self.t.numerator, self.t.denominator
        one = near.select("a", "b").join(self.sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
        both = one.join(self.sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")

        overlap = F.size(F.array_intersect("ga", "gb"))
        return both.withColumn("o", overlap).filter(F.col("o") * den >= (F.size("ga") + F.size("gb") - F.col("o")) * num).select("a", "b")

    def _overlap(self, n: Column, m: Column) -> Column:
        """The n-grams that linked sets of sizes n and m have in common at least."""
        num, den = self.t.numerator, self.t.denominator
        return F.floor(((n + m) * num + (num + den - 1)) / F.lit(num + den)).cast("int")

    def _all_pairs(self, postings: DataFrame, apart: bool) -> DataFrame:
        """Distinct pairs (a < b) that share a part and pass the length filter; of two components, with ``apart``."""
        other = postings.select("part", F.col("key").alias("b"), F.col("n").alias("m"), F.col("comp").alias("_comp"))
        c = F.col
        on = (c("key") < c("b")) & self._may_link(c("n"), c("m"))
        if apart:
            on = on & (c("comp") != c("_comp"))
        return postings.withColumnRenamed("part", "_t").join(other, (c("_t") == c("part")) & on).select(c("key").alias("a"), "b").distinct()

    def _grams_of(self, sets: DataFrame, keys=None, only=None) -> DataFrame:
        """(key, grams) of the classes in the bitmap ``keys``; with ``only``, of n-grams in that bitmap, if they may be enough for a link."""
        num, den = self.t.numerator, self.t.denominator

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, grams = batch.columns
                if keys is not None:
                    mine = pa.array(keys.value.has(key.to_numpy()))
                    key, grams = key.filter(mine), grams.filter(mine)
                if only is not None and len(key):
                    flat = grams.flatten().to_numpy()
                    kept = only.value.has(flat)
                    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(grams).to_numpy())])
                    left = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[at]
                    enough = pa.array(np.diff(left) * den >= np.diff(at) * num)
                    key, grams = key.filter(enough), pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(flat[kept])).filter(enough)
                yield pa.RecordBatch.from_arrays([key, grams], names=["key", "grams"])

        return sets.select("key", "grams").mapInArrow(run, "key long, grams array<long>")

    def _open_pairs(self, postings: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) of classes of different components that may link, by their rarest n-grams in common.

        ``least`` bounds the sizes of a class's partners: all of them share a part with it. A class that goes makes
        n-grams of others private, so these are looked for more than once: by class, by component, and with their counts."""
        c, spark = F.col, self.spark
        parts = postings.groupBy("part").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("n").alias("_least"))
        parts = parts.filter("_lo <> _hi").select("part", "_least")
        met = postings.join(parts, "part").groupBy("key").agg(F.first("comp").alias("comp"), F.min("_least").alias("least"), F.count(F.lit(1)).alias("_times"))
        met = met.join(self.sets.select("key", "n", "need"), "key").filter("_times >= need").select("key", "comp", "n", "least")
        met = written(met, "ngram-met")
        keys = spark.sparkContext.broadcast(bitmap(met, "key"))
        enough = F.size("grams") >= self._overlap(c("n"), c("least"))
        several = self._grams_of(self.sets, keys).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
        several = written(several.filter("k > 1").select("gram"), "ngram-several")
        dropped(spark)
        # bitmaps pick the n-grams first, so that few sets travel
        found = spark.sparkContext.broadcast(bitmap(several, "gram"))
        left = written(met.join(self._grams_of(self.sets, keys, found), "key").filter(enough), "ngram-left")
        dropped(spark, met, several)

        several = left.select("comp", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
        several = written(several.filter("_lo <> _hi").select("gram"), "ngram-several")
        found = spark.sparkContext.broadcast(bitmap(several, "gram"))
        fewer = written(left.drop("grams").join(self._grams_of(left, None, found), "key").filter(enough), "ngram-left")
        dropped(spark, left, several)

        rows = fewer.select("key", "comp", F.explode("grams").alias("gram"))
        counts = rows.groupBy("gram").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("k"))
        counts = written(counts.filter("_lo <> _hi").select("gram", "k"), "ngram-several")
        ranked = rows.select("key", "gram").join(counts, "gram").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "gram"))).alias("ranked"))
        last = fewer.drop("grams").join(ranked, "key").withColumn("grams", c("ranked.gram")).drop("ranked").filter(enough)
        last = written(last, "ngram-left")
        dropped(spark, fewer, counts)
        first = F.slice("grams", F.lit(1), F.size("grams") - self._overlap(c("n"), c("least")) + 1)
        tokens = last.select("key", "comp", "n", F.size("grams").alias("e"), F.posexplode(first).alias("pos", "gram"))
        other = tokens.select("gram", *[c(x).alias(y) for x, y in (("key", "b"), ("comp", "_comp"), ("n", "m"), ("e", "_e"), ("pos", "at"))])
        most = F.least(c("e") - c("pos"), c("_e") - c("at"))  # if this is the first n-gram in common; one of them is
        on = (c("key") < c("b")) & self._may_link(c("n"), c("m")) & (c("comp") != c("_comp")) & (most >= self._overlap(c("n"), c("m")))
        pairs = tokens.withColumnRenamed("gram", "_t").join(other, (c("_t") == c("gram")) & on).select(c("key").alias("a"), "b").distinct()
        pairs = written(pairs, "ngram-open")
        dropped(spark, last)
        return pairs

    def links(self) -> DataFrame:
        """All linked pairs (a, b) of classes, a < b."""
        return self._verified(self._near(self._all_pairs(self.postings.withColumn("comp", F.col("key")), False)))

    def _drawn_pairs(self, postings: DataFrame, turn: int, partners: int) -> DataFrame:
        """Per class its nearest ``NEAREST`` of up to ``partners`` classes of other components.

        Every shared part draws one of its classes; a class takes those it meets at most parts.
        """
        c = F.col
        drawn = F.max(F.struct(F.xxhash64("key", "part", F.lit(turn)).alias("h"), c("key").alias("b"), c("n").alias("m"), c("comp").alias("_comp")))
        lists = postings.groupBy("part").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), drawn.alias("d")).filter("_lo <> _hi").select("part", "d.*")
        met = postings.join(lists, "part").filter((c("comp") != c("_comp")) & self._may_link(c("n"), c("m")))
        met = met.groupBy("key", "b").agg(F.count(F.lit(1)).alias("times"))
        best = met.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "b")), False), 1, partners).alias("best"))
        near = self._near(best.select(c("key").alias("a"), F.explode("best.b").alias("b")))
        first = near.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("apart", "b"))), 1, NEAREST).alias("first"))
        pairs = first.select("a", F.explode("first.b").alias("b"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def classes(self, partners: int = 4) -> DataFrame | None:
        """(key, comp) of the classes that have links; the component is its least key.

        Draws go on while one finds at least a twentieth of the links of the best one; what is in one component
        by then needs no comparison, and the last round compares all pairs of different components that may link."""
        comps, turn, drawing, most = None, 0, True, 0
        while True:
            postings = self.postings
            if comps is None:
                postings = postings.withColumn("comp", F.col("key"))
            else:
                postings = postings.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
            drawn = self._drawn_pairs(postings, turn, partners * min(4, turn + 1)) if drawing else self._near(self._open_pairs(postings))
            pairs = written(drawn, "ngram-pairs")
            found = written(self._verified(pairs), "ngram-links")
            dropped(self.spark, pairs)
            n = found.count()
            most = max(most, n)
            if not n:
                if not drawing:
                    return comps
                drawing = False
                continue
            # a component is a star by now: its classes hang on its least one
            stars = None if comps is None else comps.select(F.col("key").alias("a"), F.col("comp").alias("b"))
            now = components(found if stars is None else found.unionByName(stars))
            last, comps = comps, written(now.select(F.col("node").alias("key"), F.col("component").alias("comp")), "ngram-classes")
            dropped(self.spark, found, *([] if last is None else [last]))
            if not drawing:
                return comps
            turn, drawing = turn + 1, n * 20 >= most


def class_keys(df: DataFrame, text: str = "text", n: int = 4) -> DataFrame:
    """All columns and ``class_key``, the key of the text's set as ``near_duplicates`` gives it; null without words."""

    def start():
        return lambda cols: [pa.array([_class_key(g) if len(g) else None for g in ngram_hashes(cols[0], n)], pa.int64())]

    return append_columns(df, [text], None, "class_key long", start)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id, component_key) of every row.

    Words are runs of characters other than ASCII white space, lower-cased A-Z; a set holds the
    distinct ``n``-grams, a text of fewer words counts as one n-gram. Two texts link when
    100 * overlap >= percent * union. ``component_id`` is the least id that links reach, the row's
    own included, ``class_key`` names equal sets and ``component_key`` the component. Null, empty and blank texts have 0 shingles and link with nothing. Equal texts and
    repeated rows are one class; repeated ids are rows of their own; a null id never is the least
    one unless all are null. Extra columns are not read. An empty table gives an empty result.

    Sets are compared by 64-bit hashes of n-grams.
    """
    join = Join(df, text, doc_id, n, Fraction(percent, 100))
    comps = join.classes()
    rows = join.rows.filter("n > 0")
    least = rows.groupBy("key").agg(F.min("_id").alias("_least"))
    if comps is not None:
        least = least.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        least = least.join(least.groupBy("comp").agg(F.min("_least").alias("component_id")), "comp").select("key", "comp", "component_id")
    else:
        least = least.select("key", F.col("key").alias("comp"), F.col("_least").alias("component_id"))
    empty = join.rows.filter("n = 0").withColumns({"component_id": F.col("_id"), "comp": F.col("key")})
    out = rows.join(least, "key").unionByName(empty)
    names = {"_id": doc_id, "n": "n_shingles", "key": "class_key", "component_id": "component_id", "comp": "component_key"}
    return out.select(*[F.col(k).alias(v) for k, v in names.items()])
