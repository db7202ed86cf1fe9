"""Phrase collocations against a plain count of all word runs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bindloom.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = set()
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and a >= f[lang, p[i:j]]:
                    inside.add((lang, p[i:j]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) in inside:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    got = []
    for lang, found in out.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            got.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(got)


def made(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "of", "a", "b", "\x1fx", "é", "É", "\x00", "A", "#c"] + [f"r{i}" for i in range(40)]
    rows = []
    for i in range(docs):
        text = "".join(rng.choices(words, [9, 7, 5, 4, 2, 2, 2, 2, 2, 2] + [0.3] * 40)[0] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r\n"]) for _ in range(rng.choice([0, 1, 30, 200])))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("fr", "..,\n"), ("en", "the of the of the of"), ("en", "the of the of the of")]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("common", [1, 8, 100])
def test_collocations(spark, monkeypatch, common):
    monkeypatch.setattr(P, "COMMON_SHARE", common)  # at 1 few, at 100 all frequent words route by more words
    monkeypatch.setattr(P, "PART_ROWS", 300)
    rows = made(common)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 AS f", "2 AS chunk", "3 AS ids", "4 AS n").repartition(5)
    assert rows_of(P.collocations(df, least=6)) == plain(rows, 6)
    assert rows_of(P.collocations(df, least=9, longest=3, top=4)) == plain(rows, 9, 3, 4)


@pytest.mark.parametrize("passes", [1, 3])
def test_collocations_in_turns(spark, monkeypatch, passes):
    monkeypatch.setattr(P, "PASSES", passes)
    monkeypatch.setattr(P, "PART_ROWS", 300)
    rows = made(8)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert rows_of(P.collocations(df, least=6)) == plain(rows, 6)


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert P.collocations(df).count() == 0
    odd = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t ,,"), ("en", "w " * 300)], "lang string, text string")
    assert rows_of(P.collocations(odd)) == plain([("en", "w " * 300)], 100)


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    for n in (1, 2, 700):
        runs = np.sort(rng.choice([0, 1, 5, 2**33 + 1, 7 * 2**33, 2**62], (5, n)), axis=0)[::-1].copy()
        weights, depth = rng.integers(1, 2**31, n), rng.integers(2, 6, n)
        back = P.unpack_runs(P.pack_runs(runs, weights, depth), 5)
        rows = lambda x: sorted(zip(x[0].T.tolist(), x[1].tolist(), x[2].tolist()))
        assert rows(back) == rows((runs, weights, depth))


def test_quicksort_counts():
    rng = np.random.default_rng(3)
    runs = np.sort(rng.integers(0, 4, (5, 3000)), axis=0)[::-1].copy()  # zeros only behind words
    weights = rng.integers(1, 5, 3000)
    want = Counter()
    for k in range(2, 6):
        for column, weight in zip(runs.T.tolist(), weights.tolist()):
            if column[k - 1]:
                want[tuple(column[:k])] += weight
    got = {tuple(p.tolist()): n for p, n in P.frequent_phrases(runs, weights, 2, 50)}
    assert got == {p: n for p, n in want.items() if n >= 50}


def test_very_large_counts_stay_exact(spark):
    words = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "id long, lang string, word string")
    big = 3 * 10**12
    counts = spark.createDataFrame([([1], big), ([2], big + 1), ([1, 2], big - 1)], "ids array<long>, f long")
    sizes = spark.createDataFrame([("en", 10**13 + 7)], "lang string, n long")
    [row] = P._best_cuts(counts, words, sizes, 100).collect()
    assert row.score == 1000 * (big - 1) * (10**13 + 7) // (big * (big + 1))
