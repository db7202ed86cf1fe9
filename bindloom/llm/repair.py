"""Token ids in binary shards, compressed by Re-Pair grammars.

A shard holds consecutive documents. Its grammar is built by rounds: the most frequent id pairs of
the shard (at least ``MIN_COUNT`` times) become nonterminals, and all their occurrences that do not
overlap an earlier one are replaced from left to right; the rounds go on while they shorten the
sequence. Pairs never cross documents, and the expansion lengths of rules are stored, so any
document, and any range of ids in it, is decoded alone.

Payload of a shard, little-endian:
  4 bytes "RPR1", then 5 numbers of 4 bytes: bytes per symbol (2 or 4), first nonterminal, rules, documents, symbols
  rules:      left symbols, right symbols, expansion lengths (4 bytes each)
  documents:  symbols per document, ids per document (4 bytes each)
  sequence:   symbols of all documents
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from bindloom.llm.common import append_columns, byte_view, fresh_path, row_groups

MIN_COUNT = 16
ROUND_RULES = 4096  # rules made per round
GROUP_BYTES = 4 << 20  # text encoded at once
LEAST_GAIN = 0.02  # the rounds end when one shortens the sequence by less
SHARD_IDS = 1 << 20
HEAD = struct.Struct("<4sIIIII")


# ---- grammar


def compress(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> bytes:
    """Payload for the ids of consecutive documents (``lengths`` ids each), all below ``vocabulary``."""
    limit = 1 << 16 if vocabulary <= 1 << 15 or vocabulary + ROUND_RULES <= 1 << 16 else 1 << 31
    width = np.uint16 if limit == 1 << 16 else np.uint32
    pair = np.uint32 if width is np.uint16 else np.uint64
    by = pair(16 if width is np.uint16 else 32)
    seq = ids.astype(width)
    sizes = lengths.astype(np.int64)
    left, right, expand = [], [], []
    spans = np.empty(0, np.int64)  # expansion lengths of the rules so far
    top = vocabulary
    while len(seq) > 1 and top < limit:
        pairs = (seq[:-1].astype(pair) << by) | seq[1:]
        inner = np.ones(len(pairs), bool)
        ends = np.cumsum(sizes) - 1  # a pair may not start at the last symbol of a document
        ends = ends[(ends >= 0) & (ends < len(pairs))]
        inner[ends] = False
        ordered = np.sort(pairs[inner])
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(first, len(ordered)))
        frequent = np.flatnonzero(counts >= MIN_COUNT)
        room = min(ROUND_RULES, limit - top)
        if len(frequent) > room:
            frequent = frequent[np.argsort(-counts[frequent], kind="stable")[:room]]
        if not len(frequent):
            break
        chosen = np.sort(ordered[first[frequent]])
        picks, places = _occurrences(pairs, inner, chosen)
        if len(picks) < LEAST_GAIN * len(seq):
            break
        used = np.flatnonzero(np.bincount(places, minlength=len(chosen)))
        rule = (np.cumsum(np.bincount(used, minlength=len(chosen))) - 1)[places]
        a, b = (chosen[used] >> by).astype(np.int64), (chosen[used] & pair((1 << int(by)) - 1)).astype(np.int64)
        known = np.concatenate([np.ones(vocabulary, np.int64), spans])
        spans = np.concatenate([spans, known[a] + known[b]])
        left.append(a), right.append(b)
        seq[picks] = (top + rule).astype(width)
        gone = np.zeros(len(seq), bool)
        gone[picks + 1] = True
        removed = np.concatenate([[0], np.cumsum(gone)])
        stops = np.cumsum(sizes)
        starts = stops - sizes
        sizes = sizes - (removed[stops] - removed[starts])
        seq = seq[~gone]
        top += len(used)
    left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    head = HEAD.pack(b"RPR1", np.dtype(width).itemsize, vocabulary, len(left), len(lengths), len(seq))
    parts = [left.astype(width), right.astype(width), spans.astype("<u4"), sizes.astype("<u4"), lengths.astype("<u4"), seq]
    return head + b"".join(x.tobytes() for x in parts)


def _occurrences(pairs: np.ndarray, inner: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chosen pairs, without those that overlap the occurrence before (left to right), and their places in ``chosen``."""
    slots = 1 << 20
    spread = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
    marks = np.zeros(slots, bool)
    marks[chosen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)] = True
    at = np.flatnonzero(marks[spread] & inner)
    near = np.minimum(np.searchsorted(chosen, pairs[at]), len(chosen) - 1)
    same = chosen[near] == pairs[at]
    at, near = at[same], near[same]
    if not len(at):
        return at, near
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    run = np.repeat(begins, np.diff(np.append(begins, len(at))))
    free = (np.arange(len(at)) - run) % 2 == 0
    return at[free], near[free]


class Shard:
    """Reads a payload; documents and ranges of ids are decoded one by one or all together."""

    def __init__(self, payload: bytes):
        magic, size, self.vocabulary, rules, docs, symbols = HEAD.unpack_from(payload)
        if magic != b"RPR1":
            raise ValueError("not a shard")
        kind, at = np.dtype(f"<u{size}"), HEAD.size

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(payload, dtype, n, at)
            at += out.nbytes
            return out

        self.left, self.right = take(kind, rules), take(kind, rules)
        self.spans = take("<u4", rules).astype(np.int64)
        self.symbols, self.lengths = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.seq = take(kind, symbols)
        self.begins = np.concatenate([[0], np.cumsum(self.symbols)])

    @property
    def widths(self) -> np.ndarray:
        return np.concatenate([np.ones(self.vocabulary, np.int64), self.spans])

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rules in a row behind the plain ids, and where each symbol's ids begin."""
        starts = np.concatenate([np.arange(self.vocabulary), self.vocabulary + np.cumsum(self.spans) - self.spans]).astype(np.int64)
        flat = np.empty(self.vocabulary + int(self.spans.sum()), np.uint32)
        flat[: self.vocabulary] = np.arange(self.vocabulary)
        widths = self.widths
        # a rule only refers to earlier symbols, so the rules fill up in order
        for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            at, wa, wb = starts[self.vocabulary + k], widths[a], widths[b]
            flat[at : at + wa] = flat[starts[a] : starts[a] + wa]
            flat[at + wa : at + wa + wb] = flat[starts[b] : starts[b] + wb]
        return flat, starts

    def decode_all(self) -> np.ndarray:
        """Ids of all documents in a row."""
        flat, starts = self.expansions()
        widths = self.widths[self.seq]
        stops = np.cumsum(widths)
        total = int(stops[-1]) if len(stops) else 0
        return flat[np.repeat(starts[self.seq] - (stops - widths), widths) + np.arange(total)]

    def decode(self, doc: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Ids [start, stop) of one document; symbols outside the range are passed by their lengths."""
        stop = int(self.lengths[doc]) if stop is None else stop
        symbols = self.seq[self.begins[doc] : self.begins[doc + 1]].astype(np.int64)
        ends = np.cumsum(self.widths[symbols])
        i = int(np.searchsorted(ends, start, "right"))
        at = int(ends[i - 1]) if i else 0
        out: list[int] = []
        stack = symbols[i : int(np.searchsorted(ends, stop)) + 1][::-1].tolist()
        while stack and at < stop:
            s = stack.pop()
            if s < self.vocabulary:
                if at >= start:
                    out.append(s)
                at += 1
            else:
                k = s - self.vocabulary
                if at + self.spans[k] <= start:
                    at += int(self.spans[k])
                else:
                    stack += [int(self.right[k]), int(self.left[k])]
        return out


# ---- encoding


class ChunkEncoder:
    """Ids of whole texts with the tokenizers library, remembering the ids of parts between blanks.

    The tokenizer of the file drops white space before it merges, so parts between blanks and
    line ends have the same ids alone and in the text. It lower-cases and separates letters from marks,
    so a part of letters and marks behind them is looked up as its lower-cased letters and its marks. New
    words of letters go to the library many at once, with blanks between them, and their ids are cut behind
    the tokens that end a word. Other parts go to the library one by one, and a text with the string of a
    special token whole.
    """

    CACHE = 500_000  # words per generation and worker; an eviction only costs time
    TOGETHER = 1000  # words that go to the library as one text
    #: Letters whose lower case is one letter and that do not combine, then marks other than ' and <.
    LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+"
    MARKS = r"[!-&(-/:;=-@\[-`{-~]*"
    WORD_END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.width = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        self.known, self.old = {"": b""}, {}  # a full table of ids becomes the old one

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        size, out = np.dtype(self.width).itemsize, []
        for i in range(0, len(words), self.TOGETHER):
            some = words[i : i + self.TOGETHER]
            [raw] = self._ids([" ".join(some)])
            stops = ((np.flatnonzero(self.ends[np.frombuffer(raw, self.width)]) + 1) * size).tolist()
            if len(stops) == len(some) and stops[-1] == len(raw):
                out += [raw[s:e] for s, e in zip([0, *stops], stops)]
            else:  # a tokenizer that marks no ends of words
                out += self._ids(some)
        return out

    def _distinct_ids(self, texts: pa.Array) -> pa.Array:
        """Ids of distinct words, or other parts that the library takes as they are."""
        if len(self.known) >= self.CACHE:
            self.known, self.old = {"": b""}, self.known
        known, old, words, others = self.known, self.old, [], []
        every = texts.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, every))
        new = [i for i, x in enumerate(found) if x is None]
        for i, word in zip(new, pc.match_substring_regex(texts.take(pa.array(new, pa.int64())), rf"\A{self.LETTERS}\z").to_pylist()):
            x = every[i]
            if x in old:
                known[x] = old[x]
            else:
                (words if word else others).append(x)
        known.update(zip(words, self._word_ids(words)))
        known.update(zip(others, self._ids(others)))
        for i in new:
            found[i] = known[every[i]]
        return pa.array(found, pa.large_binary())

    def _part_ids(self, parts: pa.Array) -> pa.Array:
        """Ids of parts: those of the letters and those of the marks behind them."""
        cut = pc.extract_regex(parts, rf"\A(?P<word>{self.LETTERS})(?P<mark>{self.MARKS})\z")
        words = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "word")), parts).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(cut, "mark"), "").dictionary_encode()
        ids = [self._distinct_ids(x.dictionary).take(x.indices) for x in (words, marks)]
        return pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        whole = [any(s in t for s in self.special) for t in texts]
        split = pc.split_pattern(pc.replace_substring(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), "\n", " "), " ")
        places = split.values.dictionary_encode()
        ids = self._part_ids(places.dictionary).take(places.indices)
        _, at, data = ids.buffers()
        bounds = np.frombuffer(at, np.int64)[: len(ids) + 1][split.offsets.to_numpy()].tolist()
        flat = data.to_pybytes() if data else b""
        end = np.array([end_id], self.width).tobytes()
        return [(self._ids([t])[0] if w else flat[s:e]) + end for t, w, s, e in zip(texts, whole, bounds, bounds[1:])]


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode_ids(df: DataFrame, path: str, end_id: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, ids (binary, 2 or 4 bytes each, end id included), n_tokens and text_hash."""

    def start():
        encoder = chunk_encoder(path)
        size = np.dtype(encoder.width).itemsize

        def step(cols):
            data, offsets = byte_view(cols[0])
            ids, hashes = [], []
            for i, j in row_groups(offsets, GROUP_BYTES):
                raw = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                ids += encoder.encode([r.decode("utf-8", "replace") for r in raw], end_id)
                hashes += [zlib.crc32(r) for r in raw]
            return [pa.array(ids, pa.binary()), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(hashes, pa.int64())]

        return step

    return append_columns(df, [text], keep, "ids binary, n_tokens long, text_hash long", start)


# ---- files


def write_shards(
    df: DataFrame,
    path: str,
    tokenizer: str,
    vocabulary: int,
    end_id: int,
    text: str = "text",
    doc_id: str = "doc_id",
    shard_ids: int = SHARD_IDS,
    part_ids: int = 4 << 20,
) -> None:
    """Writes the ids of all texts to ``path`` as shards, in ascending order of ``doc_id``.

    The shard table is Parquet with (part, block, doc_ids, n_ids, payload): ``part`` and ``block``
    order the shards, ``payload`` is the grammar file of one shard. A shard ends with the document
    that reaches ``shard_ids`` ids, so a very long text makes a longer shard. Null and empty texts
    hold the end id only. Rows without ``doc_id`` come first, repeated ids in the order of a text
    hash; every row is stored. An empty table gives no shards. Extra columns are not read.

    The ids are written to the shared folder once, because range partitioning reads its input twice.
    """
    spark = df.sparkSession
    at = fresh_path(spark, "token-ids")
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encode_ids(source, tokenizer, end_id, "text", ["doc_id"]).write.option("compression", "zstd").parquet(at)
    encoded = spark.read.parquet(at)
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, min(10_000, -(-total // part_ids)))
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            lengths = np.array([len(x) for x in held], np.int64)
            payload = compress(np.concatenate(held), lengths, vocabulary)
            columns = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([docs], pa.list_(pa.int64()))]
            columns += [pa.array([int(lengths.sum())], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0), batch.column(1)):
                held.append(np.frombuffer(ids.as_py(), width))
                docs.append(doc.as_py())
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard()
                    block, docs, held, size = block + 1, [], [], 0
        if held:
            yield shard()

    ordered = encoded.repartitionByRange(parts, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "ids")
    ordered.mapInArrow(pack, "part long, block long, doc_ids array<long>, n_ids long, payload binary").write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """One row per document from the shards in ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum is over the ids as
    unsigned numbers of 4 bytes. Sizes of parts are summed in one small window, the rest by part.
    """
    shards = spark.read.parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, docs, payload in zip(*batch.columns):
                shard = Shard(payload.as_py())
                ids = shard.decode_all()
                stops = np.cumsum(shard.lengths)
                starts = stops - shard.lengths
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist())]
                n = len(sums)
                columns = [pa.array([part.as_py()] * n, pa.int64()), pa.array([block.as_py()] * n, pa.int64()), docs.values]
                columns += [pa.array(starts), pa.array(shard.lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "block", "doc_ids", "payload").mapInArrow(
        unpack, "part long, block long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    sizes = shards.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_block"))
    offsets = sizes.join(parts, "part").select("part", "block", (F.col("_part") + F.col("_block")).alias("_start"))
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("at") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
