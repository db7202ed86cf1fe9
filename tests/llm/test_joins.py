"""Joins, searches and graph operators against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from bindloom.llm import cross_polytope, graph, line_dedup, ngram_join, pii
from conftest import ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_copies(seed, groups=6, size=12, words=60):
    """Groups of copies with a few words changed each, exact copies and unrelated texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [" ".join(f"u{rng.randrange(300)}" for _ in range(rng.randrange(1, 50))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def plain_components(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [near_copies(1), ROWS], ids=["copies", "odd"])
def test_near_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_links_are_complete(spark):
    rows = near_copies(2, 3, 8)
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", 4, ngram_join.Fraction(85, 100))
    key = {r["_id"]: r["key"] for r in join.rows.collect()}
    want = {tuple(sorted((key[a], key[b]))) for (a, x), (b, y) in combinations(rows, 2) if key[a] != key[b] and 100 * len(grams(x) & grams(y)) >= 85 * len(grams(x) | grams(y))}
    assert want and {(r.a, r.b) for r in join.links().collect()} == want


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(4)
    t, n_links = ngram_join.Fraction(85, 100), 0
    for _ in range(1500):
        m = int(rng.choice([6, 7, 9, 14, 30, 80, 400, 5000], p=[0.15] * 6 + [0.09, 0.01]))
        pool = rng.integers(0, 1 << 64, 2 * m, dtype=np.uint64)
        if rng.random() < 0.3:  # hashes on few ranges, so that parts are empty
            pool >>= np.uint64(5)
        off = int(rng.integers(0, m // 6 + 2))
        a = np.unique(pool[:m])
        b = np.unique(np.concatenate([pool[off:m], pool[m : m + int(rng.integers(0, m // 6 + 2))]]))
        both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        x, y = (ngram_join.pa.array([ngram_join.parity_bits(s)], ngram_join.pa.binary()) for s in (a, b))
        assert ngram_join.parity_distances(x, y)[0] <= every - both
        if 100 * both >= 85 * every:
            n_links += 1
            assert np.intersect1d(ngram_join.part_hashes(a, t), ngram_join.part_hashes(b, t)).size
    assert n_links > 300


def test_parts_travel_in_few_bits():
    grams = np.unique(np.random.default_rng(5).integers(0, 1 << 64, 500, np.uint64))
    parts = ngram_join.part_hashes(grams, ngram_join.Fraction(85, 100))
    assert len(np.unique(parts)) == len(parts) and 0 <= parts.min() and 1 << 30 < parts.max() < 1 << 40


def test_texts_with_common_ngrams_do_not_meet(spark):
    rng = random.Random(11)
    common = [" ".join(f"c{i}x{k}" for k in range(6)) for i in range(12)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.1 else f"u{rng.randrange(10**9)}" for _ in range(90))) for i in range(300)]
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", "doc_id", 4, ngram_join.Fraction(85, 100))
    pairs = join._all_pairs(join.postings.withColumn("comp", ngram_join.F.col("key")), False).count()
    assert pairs < 300


def around(seed, size=150, words=120, changes=(4, 5, 6, 7, 8)):
    """Texts around one text that share parts with each other, most of them without a link, and links between a few."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.choice(changes)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        texts.append(own)
        if rng.random() < 0.2:  # a near copy of the changed text
            other = list(own)
            other[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts.append(other)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_texts_around_one_do_not_meet_in_pairs(spark):
    rows = around(21)
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", "doc_id", 4, ngram_join.Fraction(85, 100))
    postings = join.postings.withColumn("comp", ngram_join.F.col("key"))
    every, few = join._all_pairs(postings, True), join._open_pairs(postings)
    linked = {tuple(r) for r in join._verified(every).collect()}
    assert linked and {tuple(r) for r in join._verified(few).collect()} == linked
    assert 5 * few.count() < every.count()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_linked_sets_share_the_parts_they_need():
    rng = np.random.default_rng(14)
    t, needs = ngram_join.Fraction(85, 100), set()
    for _ in range(1500):
        m = int(rng.choice([6, 9, 14, 30, 80, 150, 400, 1500]))
        pool = rng.integers(0, 1 << 64, 2 * m, dtype=np.uint64) >> np.uint64(rng.integers(0, 2))
        off, more = int(rng.integers(0, m // 6 + 2)), int(rng.integers(0, m // 6 + 2))
        a, b = np.unique(pool[:m]), np.unique(np.concatenate([pool[off:m], pool[m : m + more]]))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            shared = np.intersect1d(ngram_join.part_hashes(a, t), ngram_join.part_hashes(b, t)).size
            need = max(ngram_join.least_shared(x, t) for x in (a, b))
            assert shared >= need
            needs.add(need)
    assert max(needs) > 3


def test_near_duplicates_of_nothing(nothing):
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def plain_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = [], set()
    for i, text in order:
        for k, line in enumerate((text or "").split("\n")):
            w = line.lower().split()
            if not w:
                continue
            s = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.add((i, k))
            seen.append(s)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in order}


def test_line_dedup(spark):
    lines = [t for _, t in near_copies(3, 4, 10, 40)]
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice([rng.choice(lines), "", "short one", "Short\tone ", "one short", "of", f"new line {i} {rng.random()} of words"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "'q' AS removed")
    got = line_dedup.dedup_lines(df.repartition(3)).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "h", "removed", "n_lines", "n_removed", "n_worded"}
    assert {r.doc_id: r.text for r in got} == plain_lines(rows) and sum(r.n_removed for r in got) > 10


def test_line_dedup_of_other_separators(spark):
    words = [f"w{i}" for i in range(12)]
    forms = [" ".join(words), "\t".join(words), "  ".join(words), " " + " ".join(words) + " ", " ".join(words).upper() + "\r", "\x0b \f".join(words)]
    rows = [(i, x) for i, x in enumerate([*forms, " ".join(words[:4]), "\t".join(words[:4])])]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 1}


def test_line_dedup_of_few_shingles(spark):
    lines = [" ".join(f"w{n}x{i}" for i in range(n)) for n in (5, 6, 7)] + ["- - - - -", "a b a b a b a b a"]
    forms = [lambda x: x, lambda x: x.replace(" ", "\t"), lambda x: x.replace(" ", "  "), lambda x: "  " + x, lambda x: x.upper() + "\r", lambda x: x + " "]
    rows = [(100 * k + i, f(x)) for k, x in enumerate(lines) for i, f in enumerate(forms)]
    rows += [(900, "- - - - - - -"), (901, "- " * 40), (902, "b a b a b a"), (903, "w5x0 w5x1 w5x2 w5x3 w5x5"), (904, "w7x0 w7x1 w7x2 w7x3 w7x4 w7x5")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows)
    assert {r.doc_id for r in got if not r.n_removed} == {0, 100, 200, 300, 400, 903, 904}


def test_unlike_lines_with_passages_in_common_do_not_meet(spark, monkeypatch):
    rng = random.Random(8)
    passages = [" ".join(f"p{i}x{k}" for k in range(9)) for i in range(14)]
    lines = [" ".join(rng.sample(passages, 7)) for _ in range(160)]
    lines += [f"{x} {rng.randrange(10**6)}" for x in rng.sample(lines, 20)]
    rows = list(enumerate(lines))
    compared, real = [], line_dedup._matches
    monkeypatch.setattr(line_dedup, "_matches", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows) and sum(r.n_removed for r in got) >= 20
    assert len(compared) == 2 and compared[1] < 300  # 413 with all tokens that two lines share


def test_line_dedup_of_odd_rows(odd, nothing):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].text == ROWS[0][1] and by[5].text == "" and by[2].text is None and by[2].n_lines == 0 and by[4].text == " \n\t "
    assert line_dedup.dedup_lines(nothing).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m.group().split("."))
            if kind == "card":
                double = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(digits))]
                ok = 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0
            if kind == "phone":
                ok = 9 <= len(digits) <= 15
            out += [f"{kind}:{m.start()}:{m.end()}"] * ok
    return ",".join(out)


def test_base_spans(spark, odd, nothing):
    rng = random.Random(2)
    parts = ["a@b.c", "_x@y.org", "1.2.3.4", ".5", "300.1.1.1", "4111111111111111", "4111-1111 1111-1111", " ", "+1 (499) 555-6503", "+", "12", "@", ".", "é😀", "x", "--", "(", "00255.0.0.1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(400)] + [(900, "a" * 60_000 + "@b" + ".c" * 9000), (901, "1 " * 40_000), (902, "7" * 60_000)]
    df = spark.createDataFrame(rows + [(i, t) for i, t in ROWS], "doc_id long, text string")
    got = pii.find(df).collect()
    assert len(got) == len(rows) + len(ROWS)
    want = sorted(hashlib.sha256(plain_spans(t).encode()).hexdigest() for _, t in rows + ROWS)
    assert sorted(r.base_sha256 for r in got) == want
    assert pii.find(nothing).count() == 0 and pii.find(odd).count() == len(ROWS)


def test_contexts_discover_new_identifiers(spark):
    seeds = [(i, f"He said: please call +1 212 555-01{i:02d} today. My write to me{i}@mail.org now") for i in range(10, 30)]
    new = [(50, "so please call 555-0199 today"), (51, "then write to joe(at)home@ltd or not"), (52, "page please 555-0100 x 12"), (53, "please call 12 today")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:15:23" and got[51].spans == "email:14:29"
    assert got[52].n_found == 0 and got[53].n_found == 0 and all(got[i].n_found == 0 for i, _ in seeds)


def test_contexts_of_the_second_generation(spark):
    seeds = [(i, f"He said: please call +1 212 555-01{i:02d} today") for i in range(10, 40)]
    both = [(100 + i, f"so please call 555-02{i:02d} today") for i in range(4)] + [(200 + i, f"the fax number 555-02{i:02d} here") for i in range(4)]
    # the third generation rests on what only the second one finds; two instances vouch for nothing
    more = [(300 + i, f"the fax number 555-03{i:02d} here") for i in range(2)] + [(400 + i, f"or dial direct 555-0{i}00 now") for i in (2, 3)]
    last = [(400 + i, f"or dial direct 555-030{i - 10} now") for i in (11,)] + [(500, "or dial direct 555-0999 now"), (600, "fax number 12 x"), (700, "room code 555-0200 x"), (701, "room code 555-0201 x"), (702, "room code 555-0888 x")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(seeds + both + more + last, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:15:23" and got[200].spans == "phone:15:23" and got[300].spans == got[301].spans == "phone:15:23"
    assert got[500].spans == "phone:15:23" and got[600].n_found == 0 and got[702].n_found == 0


def plain_search(rows, step, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in good:
        if i % step == 0:
            near = sorted((-float(q @ v), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_search_recall(spark, scaled):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) + rng.normal(size=(12, 24))[rng.integers(0, 12, 1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x * rng.uniform(0.5, 2, (1500, 1)) if scaled else x
    x[200:700] = x[199]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 20, 20).collect()
    want = plain_search(rows, 20, 20)
    assert len(got) == 20 * len(want) == len({(r.query_id, r.rank) for r in got}) and all(r.query_id != r.vec_id for r in got)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(got)
    assert all(abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12 for r in got)
    hot = {r.rank: r.vec_id for r in got if r.query_id == 220}
    assert [hot[k] for k in range(1, 21)] == want[220]


@pytest.mark.parametrize("norms", ["outlier", "lognormal", "narrow"])
def test_search_recall_of_unequal_norms(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[7] *= 10
    else:
        x *= np.exp((1.0 if norms == "lognormal" else 0.05) * rng.normal(size=(4000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 40, 20).collect()
    want = plain_search(rows, 40, 20)
    assert len(got) == 20 * len(want)
    recall = sum(r.vec_id in want[r.query_id] for r in got) / len(got)
    print("recall", norms, recall)
    assert recall >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, i / 10000]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = cross_polytope.search(df, 1000, 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}
    scores = np.array([[3.0, 1.0, 3.0, 3.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]])
    best = cross_polytope.first_best(scores, np.array([9, 8, 7, 6, 5, 4]), 2)
    assert [set(x) for x in best.tolist()] == [{3, 5}, {4, 5}]


def test_search_recall_of_wide_vectors(spark):
    rng = np.random.default_rng(12)
    rows = list(enumerate(rng.normal(size=(3000, 128)).tolist()))
    got = cross_polytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 30, 20).collect()
    want = plain_search(rows, 30, 20)
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    assert np.mean([len(found[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_search_of_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [-1.0, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS id")
    got = cross_polytope.search(df, 20, 20).collect()
    want = plain_search(rows, 20, 20)
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    assert cross_polytope.search(df.limit(0)).count() == 0
