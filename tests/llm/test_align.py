"""Cross-tokenizer alignment against the libraries and a plain search for overlaps."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bindloom.llm import align as A
from bindloom.llm.queries import QUERIES
from conftest import ROWS

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "▁ already ▁",
    "a\x00b",
    "  two  blanks \t\n\r ",
    "été é ﬁ ①",
    "​﻿\u0085\x1c",
    "的的 漢字 😀😀 مرحبا",
    "x" * 3000 + " " * 500,
    "the of the of the",
    "don't I'LL we'll 12345 1,000.50",
]


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(rows, libraries):
    one, two = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    found, docs = [], Counter()
    for i, text in rows:
        a, b, sa, sb = [], [], [], []
        if text:
            a = one.encode(" " + text, add_special_tokens=False).ids
            b = two.encode(text)
            sa = [bytes(byte[ch] for ch in one.id_to_token(x)) for x in a]
            sb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
            if b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
                a, b = [], []
        ends = [np.cumsum([len(x) for x in s]).tolist() if ids else [] for s, ids in ((sa, a), (sb, b))]
        starts = [[0, *e[:-1]] for e in ends]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i2, j2 = [], [], 0, 0
        for cut in cuts:
            i1, j1 = i2, j2
            while i2 < len(a) and ends[0][i2] <= cut:
                i2 += 1
            while j2 < len(b) and ends[1][j2] <= cut:
                j2 += 1
            groups.append((a[i1:i2], b[j1:j2]))
            links += [(a[x], b[y]) for x in range(i1, i2) for y in range(j1, j2) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]]
        docs.update(set(links))
        found.append((i, a, b, groups, links))
    top = {}
    for (x, _), k in docs.items():
        top[x] = max(top.get(x, 0), k)
    out = []
    for i, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), digest, sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=str)


def test_alignment(spark, odd, nothing, libraries):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(TEXTS)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more).selectExpr("doc_id", "text", "1 AS n_a", "2 AS chunk", "3 AS at", "4 AS keys", "'x' AS groups_sha256", "5 AS f")
    got = A.align(df.repartition(3), *PATHS, with_groups=True)
    assert got.columns == ["doc_id", "text", "chunk", "at", "keys", "f", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "groups"]
    assert rows_of(got) == plain(rows, libraries)
    assert rows_of(A.align(df, *PATHS, chunk_pairs=40)) == plain(rows, libraries)
    assert all(len(r.groups) == r.n_groups and r.f == 5 for r in got.collect())
    assert A.align(nothing, *PATHS).count() == 0


def test_alignment_of_the_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_alignment"](spark, sf)) == plain(rows, libraries)


def test_diagonal_runs():
    rng = random.Random(2)
    for turn in range(400):
        total = rng.randint(1, 60) if turn % 4 else 3000
        a, b = (np.array(sorted({total, *(rng.randint(1, total) for _ in range(rng.randint(0, 40)))})) for _ in "ab")
        if turn % 3 == 0:  # long equal stretches
            same = np.array(sorted(rng.sample(range(total + 1, total + 4000), 1000)))
            a, b = np.concatenate([a, same, same[-1] + a]), np.concatenate([b, same, same[-1] + b])
        first_a, first_b = A.diagonal_runs(a, b)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert first_a[0] == first_b[0] == 0
        assert a[first_a[1:] - 1].tolist() == b[first_b[1:] - 1].tolist() == common[:-1]
        left, right = A.links(a, b)
        begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if begin_a[i] < b[j] and begin_b[j] < a[i]} if len(a) < 200 else None
        assert want is None or sorted(zip(left.tolist(), right.tolist())) == sorted(want)
        assert len(left) == len(a) + len(b) - len(common)


def test_both_libraries_agree(libraries):
    """The byte-level side is the library of its file, on every code point."""
    both, points = A.sides(*PATHS), [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(x)}1 {chr(x)}{chr(x)} b {chr(x)}.{chr(x)}x  {chr(x)} \t{chr(x)}" for x in points[at : at + 50_000]]
        want = libraries[0].encode_batch_fast(texts, add_special_tokens=False)
        assert all(both.bytes_encoder.encode_ordinary(t) == w.ids for t, w in zip(texts, want))


def test_words_are_encoded_once(monkeypatch):
    """Texts by their words have the ids of whole texts, and repeated words go to the libraries once."""
    both, rng = A.sides(*PATHS), random.Random(4)
    assert both.apart
    bits = [" ", " ", " ", "  ", "\n", "\t", "a", "the", "é", "的", "▁", " ", "　", "\x1c", "\u0085", "'s", "12", ".", "<s>", "<unk>", "́", "\x00", "😀", "Word"]
    texts = [None, "", *TEXTS, *("".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(20_000))]
    monkeypatch.setattr(A, "WORDS", 7)
    monkeypatch.setattr(A, "GROUP_CHARS", 5000)
    for text, got in zip(texts, list(both.encode_all(pa.array(texts))), strict=True):
        assert [x.tolist() for x in got] == [x.tolist() for x in both.encode(text)], repr(text)

    class Counted:
        def __init__(self, pieces):
            self.pieces, self.size = pieces, 0

        def encode(self, text):
            self.size += len(text)
            return self.pieces.encode(text)

    counted = Counted(both.pieces)
    monkeypatch.setattr(both, "pieces", counted)
    monkeypatch.setattr(A, "GROUP_CHARS", 1 << 22)
    list(both.encode_all(pa.array(["some words again and again"] * 500)))
    assert counted.size < 100
