"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are normalised to words with single blanks around them, so that an occurrence of a window of
words is an occurrence of its bytes. For all patterns of a table let m be their least length and B
the block length. A block shift table says for the block that ends at a position how far the search
may move on without passing the end of the first m bytes of any pattern. Where it says 0, the bucket
of the block's hash holds the patterns whose first m bytes end in it; their first block and then the
whole bytes are compared. Many positions ("lanes") of a buffer move on at once as numpy arrays.

Windows of full length and shorter items have tables of their own, as a short pattern would shorten
every shift.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindloom.llm.common import append_columns, byte_view, row_groups, written

WINDOW = 13
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
LANE_BYTES = 2048


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class ShiftTable:
    """Wu-Manber tables over byte patterns, all of at least one byte."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = min(8, m)
        self.mask = np.uint64((1 << 8 * b) - 1)
        entries = len(patterns) * (m - b + 1)
        self.bits = min(24, max(10, (8 * entries).bit_length()))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), np.uint8)
        blocks = _blocks(heads)
        first = np.arange(len(patterns), dtype=np.int64) * m
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for j in range(m - b + 1):  # later blocks give smaller shifts and overwrite larger ones
            self.shift[self._slot(blocks[first + j] & self.mask)] = m - b - j
        self.prefix = blocks[first] & self.mask
        self.suffix = blocks[first + m - b] & self.mask
        slots = self._slot(self.suffix)
        self.order = np.argsort(slots, kind="stable")
        self.begin = np.searchsorted(slots[self.order], np.arange((1 << self.bits) + 1))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, buffer: bytes) -> Iterable[tuple[int, int]]:
        """(start, index of the pattern) of every occurrence."""
        n, m, b = len(buffer), self.m, self.b
        if n < m:
            return
        data = np.frombuffer(buffer + bytes(8), np.uint8)
        blocks = _blocks(data)
        ends = np.arange(m - 1, n, LANE_BYTES, dtype=np.int64)
        stops = np.minimum(ends + LANE_BYTES, n)
        found = []
        while len(ends):
            shift = self.shift[self._slot(blocks[ends - (b - 1)] & self.mask)]
            hit = shift == 0
            if hit.any():
                found.append(ends[hit])
            ends = ends + np.maximum(shift, 1)
            on = ends < stops
            ends, stops = ends[on], stops[on]
        if not found:
            return
        ends = np.concatenate(found)
        block = blocks[ends - (b - 1)] & self.mask
        slot = self._slot(block)
        count = self.begin[slot + 1] - self.begin[slot]
        at = np.repeat(np.arange(len(ends)), count)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        which = self.order[self.begin[slot][at] + inner]
        starts = ends[at] - (m - 1)
        same = (self.suffix[which] == block[at]) & (self.prefix[which] == (blocks[starts] & self.mask))
        for s, w in zip(starts[same].tolist(), which[same].tolist()):
            p = self.patterns[w]
            if buffer[s : s + len(p)] == p:
                yield s, w


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; the buffer ends in eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def build_tables(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> list[tuple[ShiftTable, list[int], list[tuple[str, ...]]]]:
    """Per table: the shift table, the words and the sorted item ids of each of its patterns."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    words_in: dict[bytes, int] = {}
    for item, text in items:
        words = words_of(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            pattern = b" " + b" ".join(words[i : i + k]) + b" "
            owners[pattern].add(item)
            words_in[pattern] = k
    tables = []
    for full in (True, False):
        patterns = [p for p, k in words_in.items() if (k == window) == full]
        if patterns:
            tables.append((ShiftTable(patterns), [words_in[p] for p in patterns], [tuple(sorted(owners[p])) for p in patterns]))
    return tables


def _search(tables, texts: list[bytes]):
    """Per text: number of words, merged hit intervals of words, set of item ids."""
    spans, parts, at = [], [], 0
    for raw in texts:
        words = words_of(raw)
        norm = b" " + b" ".join(words) + b" " if words else b""
        spans.append((at, len(norm), len(words)))
        parts.append(norm)
        at += len(norm)
    buffer = b"".join(parts)
    starts = np.array([s for s, _, _ in spans] + [at], np.int64)
    hits = defaultdict(list)
    for table, sizes, owners in tables:
        for s, w in table.find(buffer):
            hits[int(np.searchsorted(starts, s, "right")) - 1].append((s, sizes[w], owners[w]))
    for i, (a, size, n) in enumerate(spans):
        found = hits.get(i)
        if not found:
            yield n, [], set()
            continue
        blanks = np.flatnonzero(np.frombuffer(buffer, np.uint8, size, a) == 32)
        first = np.searchsorted(blanks, np.array([f[0] for f in found]) - a)
        intervals = [(int(x), int(x) + f[1]) for x, f in zip(first, found)]
        yield n, _merged(intervals), set().union(*(f[2] for f in found))


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks_of_items(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The benchmark in blocks of at most ``limit`` bytes of text (or one item), one at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).filter("t is not null")
    for r in rows.toLocalIterator():
        raw = r.t.encode()
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append((r.i, raw))
        size += len(raw)
    if block:
        yield block


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Columns ``keep`` (None: all) and n_words, n_hit, hit_spans, items, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, lower-cased A-Z. A
    window is ``window`` consecutive words of an item, or all words of a shorter one. A word of a
    text is hit where it lies in an occurrence of a window; a text is contaminated if n_hit > 0 and
    20 * n_hit >= n_words. ``hit_spans`` lists merged [start, end) ranges of words.

    The benchmark goes over the driver in blocks of at most ``block_bytes`` of text, each of which
    is searched in all texts; the tables of one block are broadcast (about 150 bytes per word of the
    block). One block is one narrow pass; with more blocks, the table between two passes is written
    to the shared folder, so memory stays bounded for a benchmark of any size.

    Null and empty texts have no words and are clean. Items with null or empty texts have no window;
    a null item id counts as "null"; repeated items and windows count once. An empty benchmark
    leaves every text clean. Rows repeat as often as in the input. An input column with the name
    of a new one gives way to it.
    """
    spark = df.sparkSession
    spans = "array<struct<start:bigint,stop:bigint>>"
    state = f"n_words long, hit_spans {spans}, items array<string>"
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in {"n_words", "hit_spans", "items", "n_hit", "n_items", "items_sha256", "contaminated"}]
    blocks = _blocks_of_items(benchmark, item_id, item_text, block_bytes)
    current, block, first = df, next(blocks, []), True
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(build_tables(block, window))

        def start(shared=shared):
            tables = shared.value

            def step(cols):
                data, offsets = byte_view(cols[0])
                n_words, ranges, items = [], [], []
                before = (cols[1].to_pylist(), cols[2].to_pylist()) if len(cols) > 1 else None
                for i, j in row_groups(offsets):
                    texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                    for n, merged, owners in _search(tables, texts):
                        if before:
                            k = len(n_words)
                            merged = _merged(merged + [(x["start"], x["stop"]) for x in before[0][k]])
                            owners = owners | set(before[1][k])
                        n_words.append(n)
                        ranges.append([{"start": a, "stop": b} for a, b in merged])
                        items.append(sorted(owners))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                return [pa.array(n_words, pa.int64()), pa.array(ranges, kind), pa.array(items, pa.list_(pa.string()))]

            return step

        more = following is not None
        held = [*carried, "_text"] if more and text not in carried else carried
        if more and text not in carried and first:
            current = current.withColumn("_text", F.col(text))
        source = text if text in carried or first else "_text"
        current = append_columns(current, [source] if first else [source, "hit_spans", "items"], held, state, start)
        if not more:
            break
        current, block, first = written(current, "decontaminate"), following, False
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    out = current.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(
        *carried, "n_words", "n_hit", "hit_spans", "items", "n_items", "items_sha256", "contaminated"
    )


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
