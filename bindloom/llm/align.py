"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizations of the same bytes are two ascending lists of token ends. From a common end on, the lists are
compared at the current index shift over stretches that double in length; what is equal there is a stretch
of one-to-one groups and is jumped over at once. Where the ends differ, the one that lags moves on until
both meet again: one irregular group, behind which the shift is a new one.

The documents that hold a linked pair of ids are counted over all texts. Texts travel in chunks; a chunk
asks once for each of its distinct pairs, and no table of all pairs is sent anywhere.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from bindloom.llm.common import fresh_path, planes, unplanes

CHUNK_PAIRS = 1 << 21  # distinct pairs of texts, added up, that share a chunk
CHUNK_ROWS = 10_000
ID_BITS = 32
GROUP_CHARS = 1 << 22  # texts whose words are encoded together, about
WORDS = 1000  # distinct words that go to the libraries as one text
c = F.col


def diagonal_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of the groups on both sides, for ascending ends whose last ones are equal."""
    a, b = [*ends_a.tolist(), -1], [*ends_b.tolist(), -2]  # behind the last end nothing is equal
    left, right = ends_a.tobytes(), ends_b.tobytes()
    size = ends_a.itemsize
    first_a, first_b, groups = [], [], []  # of every stretch: where it starts and how many groups it has
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while i < n:
        first_a.append(i)
        first_b.append(j)
        x, y = a[i], b[j]
        i += 1
        j += 1
        if x != y:  # an irregular group, up to the next common end
            while x != y:
                if x < y:
                    x = a[i]
                    i += 1
                else:
                    y = b[j]
                    j += 1
            groups.append(1)
            continue
        if a[i] != b[j]:
            groups.append(1)
            continue
        start, width, most = i - 1, 2, min(n - i, m - j)
        i += 1
        j += 1
        most -= 1
        while most:  # doubles while all is equal
            width = min(width, most)
            if left[size * i : size * (i + width)] != right[size * j : size * (j + width)]:
                break
            i += width
            j += width
            most -= width
            width *= 2
        while width > 1 and most:  # halves up to the first difference
            width //= 2
            if left[size * i : size * (i + width)] == right[size * j : size * (j + width)]:
                i += width
                j += width
        groups.append(i - start)
    count = np.array(groups, np.int64)
    away = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.array(first_a, np.int64), count) + away, np.repeat(np.array(first_b, np.int64), count) + away


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the overlapping tokens of both sides: one pair for each piece between neighbouring ends."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Sides:
    """Both tokenizers, with the bytes and the decimal digits of every id.

    Where ``apart``, neither joins anything across a single blank between a character other than a blank and a visible one:
    on side A such a blank begins a match of the split pattern, on side B no piece holds a blank behind another
    character and texts are not normalized. So the words between such blanks are encoded once for a group of texts."""

    def __init__(self, bytes_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        ranks, pattern = byte_level_ranks(bytes_path)
        # the same merges in the same order as the file's library; a test compares both on all code points
        self.bytes_encoder = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.a_sizes[rank] = len(token)
        # fixed values of the piece file's format: U+2581 is a blank, <0xHH> one byte
        self.b_bytes = [
            bytes([int(self.pieces.id_to_piece(k)[3:5], 16)]) if self.pieces.is_byte(k) else self.pieces.id_to_piece(k).replace("▁", " ").encode()
            for k in range(self.pieces.get_piece_size())
        ]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.apart = words_apart(self.pieces, piece_path)
        self.words = re.compile(r"(?<=[^ ]) (?=\S)").split
        # ids with what may follow them in a spelt line, as rows of bytes with zeros behind
        top = max(len(self.a_sizes), len(self.b_bytes))
        lines = np.array([f"{k}{mark}" for k in range(top) for mark in ",|;"], dtype="S")
        self.spellings = lines.view(np.uint8).reshape(len(lines), -1)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides of a text; empty if there are none, or the pieces do not spell a blank and the text.

        The byte-level side always spells its text."""
        if text:
            whole, b = " " + text, self.pieces.encode(text)
            if b"".join(map(self.b_bytes.__getitem__, b)) == whole.encode():
                return self.bytes_encoder.encode_to_numpy(whole).astype(np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _apart(self, text: str | None) -> bool:
        """Whether the words of a text may stand between those of others; the pieces do not spell U+2581."""
        return self.apart and bool(text) and not text[0].isspace() and text[-1] != " " and "▁" not in text

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides of words that go to the libraries as one text, the places behind each word's, and whether it is spelt."""
        ends = np.cumsum([len(x.encode()) + 1 for x in words])
        a, b = self.encode(" ".join(words))
        sides = [np.concatenate([[0], np.cumsum(sizes[x])]) for sizes, x in ((self.a_sizes, a), (self.b_sizes, b))]
        at = [np.searchsorted(x, ends) for x in sides]
        if len(a) and all(np.array_equal(x[k], ends) for x, k in zip(sides, at)):
            return a, b, *at, np.ones(len(words), bool)
        if len(words) == 1:  # not spelt
            return a[:0], b[:0], np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
        ones = [self._block([x]) for x in words]
        a, b, at_a, at_b, spells = (np.concatenate(x) for x in zip(*ones))
        return a, b, np.cumsum(at_a), np.cumsum(at_b), spells

    def _encode_words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of texts by their words, each distinct one encoded once."""
        split = [self.words(x) for x in texts]
        coded = pa.array([w for x in split for w in x], pa.string()).dictionary_encode()
        first = np.concatenate([[0], np.cumsum([len(x) for x in split])])
        del split
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        blocks = [self._block(words[k : k + WORDS]) for k in range(0, len(words), WORDS)]
        flat = []
        for side in (0, 1):
            ids = np.concatenate([x[side] for x in blocks])
            sizes = np.concatenate([np.diff(x[2 + side], prepend=0) for x in blocks])
            starts, many = (np.cumsum(sizes) - sizes)[at], sizes[at]
            ends = np.cumsum(many)
            flat.append((ids[np.arange(many.sum()) + np.repeat(starts - ends + many, many)], np.concatenate([[0], ends])[first]))
        spelt = np.logical_and.reduceat(np.concatenate([x[4] for x in blocks])[at], first[:-1])
        (a, at_a), (b, at_b) = flat
        for k, good in enumerate(spelt.tolist()):
            yield (a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]]) if good else (a[:0], b[:0])

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of every text."""
        held: list[str | None] = []
        size = 0
        for k, text in enumerate(texts, 1):
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size >= GROUP_CHARS or k == len(texts):
                some = [x for x in held if self._apart(x)]
                by_words = self._encode_words(some) if some else iter(())
                for x in held:
                    yield next(by_words) if self._apart(x) else self.encode(x)
                held, size = [], 0

    def spelt(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
        if not len(a):
            return b""
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.append(first_a[1:], len(a)), np.append(first_b[1:], len(b))
        places = np.arange(len(a)) + np.repeat(first_b, last_a - first_a)
        order[places] = a * 3
        order[last_a - 1 + first_b] += 1
        places = np.arange(len(b)) + np.repeat(last_a, last_b - first_b)
        order[places] = b * 3
        order[last_b - 1 + last_a] += 2
        flat = self.spellings[order].reshape(-1)
        return flat[flat != 0].tobytes()[:-1]


def words_apart(pieces, path: str) -> bool:
    """Whether a piece file encodes words by themselves: texts as they are with a blank in front, and no piece with a
    blank behind another character."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    plain &= not model.trainer_spec.treat_whitespace_as_suffix
    return plain and not any("▁" in pieces.id_to_piece(k).lstrip("▁") for k in range(pieces.get_piece_size()))


#: Splits a text before the merges of a byte-level file; fixed value of that file format.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], str]:
    """Token bytes and ids of a byte-level BPE file whose merges are in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole["pre_tokenizer"]
    plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not whole["normalizer"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][x + y] for x, y in pairs]
    if not plain or model["type"] != "BPE" or made != sorted(made):
        raise ValueError("not a plain byte-level file with merges in the order of ids")
    # printable characters stand for themselves, the other bytes for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown}
    byte_of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    special = {t["content"] for t in whole["added_tokens"]}
    return {bytes(byte_of[ch] for ch in token): k for token, k in model["vocab"].items() if token not in special}, BYTE_LEVEL_PATTERN


@lru_cache(maxsize=1)
def sides(bytes_path: str, piece_path: str) -> Sides:
    return Sides(bytes_path, piece_path)


NEW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
GROUPS = "groups array<struct<a:array<int>,b:array<int>>>"


def _row(both: Sides, a: np.ndarray, b: np.ndarray, with_groups: bool) -> tuple:
    """(n_a, n_b, n_groups, n_links, digest, distinct pairs, their numbers, groups) of a text."""
    if not len(a):
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64), []
    ends_a, ends_b = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
    first_a, first_b = diagonal_runs(ends_a, ends_b)
    left, right = links(ends_a, ends_b)
    keys = a[left] << ID_BITS | b[right]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    digest = hashlib.sha256(both.spelt(a, b, first_a, first_b)).hexdigest()
    shown = []
    if with_groups:
        shown = [{"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(a, first_a[1:]), np.split(b, first_b[1:]))]
    return len(a), len(b), len(first_a), len(left), digest, keys[first], np.diff(np.append(first, len(keys))), shown


def _aligned_rows(flat: DataFrame, kept: T.StructType, bytes_path: str, piece_path: str, with_groups: bool, chunk_pairs: int) -> DataFrame:
    """Per text its kept columns, counts, digest, chunk and pairs; per chunk one row with its distinct pairs.

    ``at`` are the places of a text's pairs in the chunk's ascending list, ``times`` how often each is linked there."""
    new = T.StructType.fromDDL(f"{NEW}, chunk long, at binary, times binary, keys binary, docs binary" + (", " + GROUPS if with_groups else ""))
    schema = T.StructType([*kept.fields, *new.fields])
    names = schema.fieldNames()
    width = len(kept.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(bytes_path, piece_path)
        first = TaskContext.get().partitionId() << 33
        chunks = 0
        held: list[tuple] = []  # (batch of kept columns, rows)
        entries = n_rows = 0

        def flush():
            nonlocal chunks, entries, n_rows
            chunk, keys = first + chunks, [r[5] for _, rows in held for r in rows]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64),) * 2
            done = 0
            for columns, rows in held:
                at = []
                for r in rows:
                    at.append(planes(np.diff(inverse[done : done + len(r[5])], prepend=0).astype(np.uint32)))
                    done += len(r[5])
                n = len(rows)
                made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                made += [pa.array([r[4] for r in rows], pa.string()), pa.array([chunk] * n, pa.int64()), pa.array(at, pa.binary())]
                made += [pa.array([planes(r[6].astype(np.uint32)) for r in rows], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
                if with_groups:
                    made.append(pa.array([r[7] for r in rows], pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))
                yield pa.RecordBatch.from_arrays([*columns, *made], names=names)
            if len(distinct):
                docs = np.bincount(inverse, minlength=len(distinct))
                some = {"chunk": chunk, "keys": planes(np.diff(distinct, prepend=0)), "docs": planes(docs.astype(np.uint32))}
                kinds = [x.type for x in held[0][0]] + [pa.int64()] * 4 + [pa.string(), pa.int64()] + [pa.binary()] * 4
                kinds += [pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))] * with_groups
                yield pa.RecordBatch.from_arrays([pa.array([some.get(x)], k) if i >= width else pa.nulls(1, k) for i, (x, k) in enumerate(zip(names, kinds))], names=names)
            held.clear()
            chunks += 1
            entries = n_rows = 0

        for batch in batches:
            rows, start = [], 0
            texts = batch.column(0)
            for k, encoded in enumerate(both.encode_all(texts)):
                rows.append(_row(both, *encoded, with_groups))
                entries += len(rows[-1][5])
                n_rows += 1
                if entries >= chunk_pairs or n_rows >= CHUNK_ROWS:
                    held.append(([x.slice(start, k + 1 - start) for x in batch.columns[1:]], rows))
                    rows, start = [], k + 1
                    yield from flush()
            if rows:
                held.append(([x.slice(start) for x in batch.columns[1:]], rows))
        if held:
            yield from flush()

    return flat.mapInArrow(run, schema)


def _pair_rows(chunks: DataFrame) -> DataFrame:
    """(chunk, at, key, docs) of the distinct pairs of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, docs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                key = np.cumsum(unplanes(keys.as_py(), np.int64))
                n = unplanes(docs.as_py(), np.uint32).astype(np.int64)
                columns = [np.full(len(key), chunk), np.arange(len(key), dtype=np.int32), key, n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["chunk", "at", "key", "docs"])

    return chunks.filter("keys IS NOT NULL").select("chunk", "keys", "docs").mapInArrow(run, "chunk long, at int, key long, docs long")


def align(
    df: DataFrame,
    bytes_path: str,
    piece_path: str,
    text: str = "text",
    keep: list[str] | None = None,
    with_groups: bool = False,
    chunk_pairs: int = CHUNK_PAIRS,
) -> DataFrame:
    """Columns ``keep`` (None: all), n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, and groups on demand.

    Side A encodes a blank and the text with the byte-level file, side B the text with the piece file, both without special
    tokens. Byte offsets where tokens of both sides end cut them into groups; a link is a pair of
    tokens whose byte ranges overlap. The count of an id pair is the number of rows that hold it
    linked; ``count_sum`` adds the counts of a row's links, ``n_best`` counts its links with the highest count of their A id.

    A null or empty text, and one that a side does not spell byte by byte, has no tokens, zeros and an empty digest.
    Texts of any length are aligned whole; repeated rows count each time. An input column with the
    name of a new one gives way to it. An empty table gives an empty result. Both paths are
    installed with the Python environment of every worker.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", *["groups"] * with_groups]
    names = [x for x in (df.columns if keep is None else keep) if x.lower() not in new]
    quoted = lambda x: c("`" + x.replace("`", "``") + "`")
    flat = df.select(quoted(text).alias("_text"), *[quoted(x).alias(f"_k{i}") for i, x in enumerate(names)])
    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in flat.schema.fields[1:]])
    path = fresh_path(df.sparkSession, "aligned")
    _aligned_rows(flat, kept, bytes_path, piece_path, with_groups, chunk_pairs).write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.parquet(path)

    pairs = _pair_rows(rows)
    totals = pairs.groupBy("key").agg(F.sum("docs").alias("f")).withColumn("a", F.shiftright("key", ID_BITS))
    highest = totals.groupBy("a").agg(F.max("f").alias("top"))
    totals = totals.join(highest, "a").select("key", "f", (c("f") == c("top")).alias("best"))
    answers = pairs.select(c("chunk").alias("of"), "at", "key").join(totals, "key").select("of", "at", "f", "best")

    texts = rows.filter("keys IS NULL").drop("keys", "docs")
    out_schema = T.StructType([f for f in texts.schema.fields if f.name not in ("chunk", "at", "times")])
    out_schema = out_schema.add("n_best", "long").add("count_sum", "long")
    out_names = out_schema.fieldNames()

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        f, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        f[at] = right.column("f").to_numpy()
        best[at] = right.column("best").to_numpy()
        n_best, count_sum = [], []
        for places, times in zip(left.column("at"), left.column("times")):
            places = np.cumsum(unplanes(places.as_py(), np.uint32), dtype=np.int64)
            times = unplanes(times.as_py(), np.uint32).astype(np.int64)
            n_best.append(int(times @ best[places]))
            count_sum.append(int(times @ f[places]))
        made = left.select(out_names[:-2])
        return made.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    done = texts.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(answer, out_schema)
    return done.select(*[c(f"_k{i}").alias(x) for i, x in enumerate(names)], *new)
