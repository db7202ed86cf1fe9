"""Byte-level BPE with a hierarchical-bitmap rank queue.

Every piece of a text (a match of the split pattern) is a linked list of bytes. A queue has one
bucket per merge rank with the list positions whose pair has that rank; a two-level bitmap over the
ranks gives the least rank that has entries by find-first-set. An entry is stale if the pair at its
position changed meanwhile; it is skipped when it comes up. A merge touches two neighbours, so a
piece of n bytes takes O(n log n) steps however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bindloom.llm.common import append_columns, leaves

LEAF_BITS = 8  # a leaf of the bitmap covers 256 ranks
LEAF_MASK = (1 << LEAF_BITS) - 1


def ranks_of_pairs(ranks: dict[bytes, int]) -> list[int]:
    """Rank of every pair of bytes, at 256 * first + second; -1 for none."""
    return [ranks.get(bytes([i >> 8, i & 255]), -1) for i in range(1 << 16)]


class Remembered:
    """Values of recent keys, in two generations: a full one becomes the old one, and what is used again moves on."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def again(self, key):
        """Value of a key that is not among the young ones, or None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ByteBpe:
    """Encoder and decoder over ``ranks`` (token bytes to id, the id being the merge rank)."""

    CACHE = 500_000  # pieces and chunks per generation and worker; an eviction only costs time

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        self.pairs = ranks_of_pairs(ranks)
        self.bytes_of = {str(i): t for t, i in ranks.items()}
        self.pieces = Remembered(self.CACHE)
        self.chunks = Remembered(self.CACHE)
        self.odd = re.compile(r" \s|\s \Z").search

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: a whole token if there is one, else merges in rank order, leftmost first."""
        ranks, longest = self.ranks, self.longest
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, rank_of = len(piece), ranks.get
        stop = list(range(1, n + 1))  # end of the node that starts here
        before = list(range(-1, n - 1))  # start of the node before
        # rank of the pair that starts here, -1 if none: entries of other ranks are stale
        pairs = self.pairs
        wanted = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        wanted.append(-1)
        buckets: dict[int, list[int]] = {}  # heaps of positions
        leaves: dict[int, int] = {}
        top = 0
        changed = [i for i, r in enumerate(wanted) if r >= 0]
        while True:
            for i in changed:
                r = wanted[i]
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    word = r >> LEAF_BITS
                    leaves[word] = leaves.get(word, 0) | 1 << (r & LEAF_MASK)
                    top |= 1 << word
            if not top:
                break
            changed = []
            word = (top & -top).bit_length() - 1
            leaf = leaves[word]
            r = (word << LEAF_BITS) + (leaf & -leaf).bit_length() - 1
            i = heappop(buckets[r])
            if not buckets[r]:
                del buckets[r]
                leaves[word] = leaf = leaf & (leaf - 1)
                if not leaf:
                    top &= top - 1
            if wanted[i] != r:
                continue
            j = stop[i]  # the right half joins the left one
            stop[i] = end = stop[j]
            wanted[i] = wanted[j] = -1
            if end < n:
                before[end] = i
                if stop[end] - i <= longest and (q := rank_of(piece[i : stop[end]])) is not None:
                    wanted[i] = q
                    changed.append(i)
            h = before[i]
            if h >= 0:
                q = rank_of(piece[h:end]) if end - h <= longest else None
                if q is None:
                    wanted[h] = -1
                else:
                    wanted[h] = q
                    changed.append(h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return ids

    def _joined(self, text: str) -> str:
        """Ids of a text by its pattern matches, joined by blanks."""
        pieces, out = self.pieces, []
        for piece in self.split(text):
            ids = pieces.young.get(piece) or pieces.again(piece)
            if ids is None:
                ids = " ".join(map(str, self.encode_piece(piece.encode())))
                if len(piece) <= 64:
                    pieces.put(piece, ids)
            out.append(ids)
        return " ".join(out)

    def encode(self, text: str) -> str:
        """Ids of a whole text, joined by blanks.

        A match never continues behind a single blank that a visible character follows, so
        the parts between such blanks, each with its blank, split as they do within the text.
        """
        if not text:
            return ""
        if self.odd(text):
            return self._joined(text)
        first, *rest = text.split(" ")
        chunks = self.chunks
        out = [self._joined(first)] if first else []
        for part in rest:
            ids = chunks.young.get(part) or chunks.again(part)
            if ids is None:
                ids = self._joined(" " + part)
                if len(part) <= 64:
                    chunks.put(part, ids)
            out.append(ids)
        return " ".join(out)

    def decode(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, joined.split(" "))) if joined else b""


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its id per line; the path is readable on every worker."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(load_ranks(path), pattern)


leaves(__name__, encoder.cache_clear)


def encode_decode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    keep: list[str] | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Columns ``keep`` (None: all), ids (with ``with_ids``), n_tokens, ids_sha256, decoded_sha256.

    Every match of ``pattern`` is encoded by itself, without special tokens; the ids are decoded
    again to bytes. ``path`` is the rank file of a public vocabulary, installed with the Python
    environment of every worker. Null and empty texts have no ids; a text of any length is one row. The
    digests are SHA-256 of the decimal ids joined by one blank and of the decoded bytes. Rows are
    independent, so ties, repeated rows and empty tables need no rule. An input column with
    the name of a new one gives way to it.
    """

    def start():
        bpe = encoder(path, pattern)

        def step(cols):
            ids, n, digest, decoded = [], [], [], []
            for value in cols[0]:
                joined = bpe.encode(value.as_py() or "")
                n.append(joined.count(" ") + 1 if joined else 0)
                digest.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(joined)).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32))
            out = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            return [pa.array(ids, pa.list_(pa.int32())), *out] if with_ids else out

        return step

    new = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return append_columns(df, [text], keep, f"ids array<int>, {new}" if with_ids else new, start)
