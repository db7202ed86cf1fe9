"""Row-wise operators against plain versions: words, tokens, pages, records, shards."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from bindloom.llm import byte_bpe, common, decontaminate as D, main_text as M, quality as Q, repair as R, warc as W
from conftest import ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_contamination(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(window, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        at = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams] if k else []
        hit.update(j for i in at for j in range(i, i + k))
        if at:
            found.add("null" if item is None else str(item))
    n = len(hit)
    return len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)


ITEMS = [(1, "two THREE four"), (2, " ".join(f"w{i} x{i}" for i in range(10))), (3, ""), (4, None), (None, "déjà"), (4, "Zwei, zeilen"), (4, "a"), (12, "a"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_decontamination(spark, odd, nothing, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.decontaminate(odd, bench, keep=["doc_id", "n_words", "h"], block_bytes=block_bytes)
    assert got.columns[:3] == ["doc_id", "h", "n_words"]
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    assert rows == sorted(((i, *plain_contamination(t, ITEMS)) for i, t in ROWS), key=str)
    assert D.decontaminate(nothing, bench).count() == 0
    assert {r.n_hit for r in D.decontaminate(odd, bench.limit(0)).collect()} == {0}


def test_shift_table_finds_all(seed=4):
    rng = np.random.default_rng(seed)
    text = bytes(rng.choice(list(b"ab "), 30_000).tolist())
    for size in (1, 2, 9, 40):
        patterns = sorted({text[i : i + size + int(rng.integers(0, 4))] for i in rng.integers(0, 29_000, 50).tolist()})
        want = {(m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
        assert set(D.ShiftTable(patterns).find(text)) == want


def test_byte_bpe(odd, nothing):
    path = P.path("byte_bpe_50k.tiktoken")
    tik = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = byte_bpe.encode_decode(odd, path, P.PATTERN, keep=["doc_id", "text", "n_tokens"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = tik.encode_ordinary(r.text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(nothing, path, P.PATTERN).count() == 0
    bpe = byte_bpe.encoder(path, P.PATTERN)
    rng = np.random.default_rng(1)
    parts = ["a", "b", " ", "\n", "\t", "  ", "'s", "'", "1", "é", "the", "!", "\r\n", "日", "😀", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert bpe.encode(text) == " ".join(map(str, tik.encode_ordinary(text))), repr(text)
    for piece in ("ab" * 5000, "a" * 3001, "abcabcab" * 700):
        assert bpe.encode_piece(piece.encode()) == tik.encode_ordinary(piece)


def test_main_text(spark, nothing):
    article = "<article><h1>Head &amp; line</h1><p><b>First  para" + " of words" * 30 + "<br><p>Second\n para.</p></article>"
    page = f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=/x>menu</a></nav><div class=\"ad\">buy</div>{article}<div id='comments'><p>me too</p></div><footer>&copy; us</footer>"
    want = "Head & line First para" + " of words" * 30 + " Second para."
    assert M.main_text(page) == want
    plain = page.replace("<article>", "<div class=content>").replace("</article>", "</div>")
    assert M.main_text(plain) == want
    assert M.main_text("just text") == "just text" and M.main_text("") == "" and M.main_text("<nav>x</nav>") == ""
    assert M.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    df = spark.createDataFrame([(1, page, "u"), (2, None, None), (3, "", "u")], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in M.extract(df).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}
    assert M.extract(nothing, "text").count() == 0


ARTICLE = "<h1>Head</h1><p>" + "First long paragraph of the text. " * 8 + "</p><p>" + "Second paragraph, <b>as long</b>. " * 8 + "</p>"
ARTICLE_TEXT = "Head " + ("First long paragraph of the text. " * 8).strip() + " " + ("Second paragraph, as long. " * 8).strip()
CHROME = "<nav><a href=1>Home</a></nav><ul class='menu-list'><li><a href=2>More</a></ul>", "<div class='ad'>Buy it now.</div><footer>All rights.</footer>"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("wrapper", ["<div class='layout-sidebar-right'>", "<div class='elementor-widget-container'>", "<div id='related-theme'>", "<div class=x>"])
def test_wrappers_do_not_take_the_article_along(wrapper, tag):
    page = f"<html><head><title>T</title></head><body>{CHROME[0]}{wrapper}<{tag}>{ARTICLE}</{tag}></div>{CHROME[1]}</body></html>"
    assert M.main_text(page) == ARTICLE_TEXT
    assert M.main_text(page.replace("</head><body>", "")) == ARTICLE_TEXT  # the head ends by itself
    assert M.main_text(page.replace("<html><head>", "").replace("</head><body>", "")) == ARTICLE_TEXT
    assert M.main_text(f"<head><meta charset=x><div>{ARTICLE}</div>") == ARTICLE_TEXT


def test_small_article_beside_much_else():
    page = f"<body><article><p>Short news.</p></article><div class='ad banner'>{ARTICLE}</div><aside>{ARTICLE}</aside></body>"
    assert M.main_text(page) == "Short news."


def test_density_sifts_neighbours():
    links = "<div>" + "".join(f"<a href={i}>one link</a> " for i in range(30)) + "</div>"
    page = f"<body>{links}<div><div class=a>{ARTICLE}</div><div class=b>{ARTICLE}</div>{links}</div><p>ok</p></body>"
    assert M.main_text(page) == ARTICLE_TEXT + " " + ARTICLE_TEXT


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<!--", "<", "</", "<p", "<p>", "<b>", "</b>", "<b><div>", "</b></i>", "&#9", "&", "<a href='", '<a href="x', "<a x='>\"", "<i></b>", "<td>", "<!", "<?", "<script>", "<title>", "<a b=c ", "<li><ul>", "<option><th>", "a<b "],
)
def test_time_is_linear_in_the_markup(unit):
    """A megabyte of anything takes seconds at most, alone, inside an article and before one."""
    import time

    long = unit * (1_000_000 // len(unit))
    for page in (long, f"<article><p>{long}</p></article>", "<b><div>" + "<i>" * 1000 + long, long + ">" + ARTICLE):
        start = time.process_time()
        M.main_text(page)
        assert time.process_time() - start < 20


def test_odd_markup():
    assert M.main_text("a < b &amp; c &lt;p&gt; 1<2") == "a < b & c <p> 1<2"
    assert M.main_text("<p>a<!-- <p>no --> b<!--> c<!---> d<![CDATA[x]]> e<?php no ?> f</ no> g</p>") == "a b c d e f g"
    assert M.main_text("<P CLASS=x>Up<BR/>per</P><script>if (a</b>c) '<p>'</script><style>p</style>") == "Up per"
    assert M.main_text("<p title='>'>quoted</p><p title=a>b>bare</p><p hidden>no</p>") == "quoted b>bare"
    assert M.main_text("<div>&#233;&#xE9;&eacute; &#" + "9" * 6000 + "; &#x" + "F" * 20 + ";</div>") == "ééé \ufffd \ufffd"
    assert M.main_text("<p>one<p>two<table><tr><td>three<td>four</table><ul><li>five<li>six</ul>") == "one two three four five six"


def test_warc(spark, tmp_path, nothing):
    html = "<html lang='en'><head><title>A &amp; B</title></head><body><p>x <b>y</b>z<p><a href='/q?a=1&amp;b=2'>li\r\nnk</a><script>no</script></body>"
    df = spark.createDataFrame([(1, "http://a/ b\r\nX: y", html), (2, None, None), (3, "http://c/", ""), (3, "http://c/", "")], "page_id long, url string, html string")
    derived = W.derive(W.page_responses(df))
    assert derived.count() == 4 and W.derive(W.page_responses(df)).filter("record_id IS NULL").count() == 0
    W.write_records(derived, f"{tmp_path}/w")
    records = W.read_records(spark, f"{tmp_path}/w")
    assert records.count() == 8 and records.filter("NOT whole").count() == 0
    got = {r.page_id: r for r in W.linked(records).collect()}
    assert got[1].title == "A & B" and got[1].n_links == 1 and got[1].uri == "http://a/%20b%0D%0AX:%20y"
    assert got[1].payload_digest == W.digest(html.encode()) and got[1].conversion_digest == W.digest(b"x yz\nli nk")
    assert got[3].copies == 2 and got[2].uri is None and got[2].text_bytes == 0
    text = records.filter("type = 'metadata' AND uri LIKE '%X:%'").first().block
    assert "http-content-type: text/html; charset=utf-8\r\n" in text and "link: /q?a=1&b=2\r\n" in text
    assert W.derive(W.page_responses(df.limit(0))).count() == 0


def test_records_with_version_lines_stay_whole(spark, tmp_path):
    pages = [
        (1, "http://a/", "<title>All about WARC/1.0</title><p>one WARC/1.0<p>WARC/1.0<a href='WARC/1.0'>x</a><a href='/b WARC/1.0'>y</a>"),
        (2, "WARC/1.0", "<p>WARC/1.0\r\nWARC/1.0\r\n\r\nWARC/1.0"),
        (3, "http://c/", "<title>WARC/1.0</title>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    W.write_records(W.derive(W.page_responses(df)).coalesce(1), f"{tmp_path}/w")
    records = W.read_records(spark, f"{tmp_path}/w")
    assert records.count() == 6 and records.filter("NOT whole OR type IS NULL").count() == 0
    got = {r.page_id: r for r in W.linked(records).collect()}
    assert got[1].title == "All about WARC/1.0" and got[3].title == "WARC/1.0" and got[1].n_links == 2 and got[2].uri == "WARC/1.0"


@pytest.mark.parametrize("block", ["", "a", "WARC/1.0\r\n", "WARC/1.0\r\nWARC/1.0\r\n", "x\r\n\r\nWARC/1.0\r\nWARC-Type: no\r\n\r\ny\r\n\r\n", "\r\n\r\n", "é WARC/1.0\r\n\r\n"])
def test_pieces_of_any_block(block):
    records = [W.record("conversion", f"<{i}>", "<r>", "u", None, "text/plain", b) for i, b in enumerate([block, "next", block])]
    pieces = "".join(r + "\r\n\r\n" for r in records).split("WARC/1.0\r\n")
    found = list(W._pieces([("f", p) for p in pieces] + [("g", p) for p in pieces]))
    assert [b for _, _, b, _ in found] == [block, "next", block] * 2
    assert [f["warc-record-id"] for f, *_ in found] == ["<0>", "<1>", "<2>"] * 2


PARTS = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|>", "<|endoftext|", "Foo, foo. FOO! don't. DON'T; 1st. é. É, ²! ½? ...", "Ａ. ǅ, ﬁ. e\u0301. =\u0338", "a.b. .a \x1c\x85 \u2028 q."]


def test_parts_are_encoded_as_the_whole_text():
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    encoder = R.ChunkEncoder(path)
    encoder.CACHE = 3
    for _ in range(2):
        for text in PARTS + [" ".join(PARTS)]:
            ids = tok.encode(text, add_special_tokens=False).ids
            assert encoder.encode([text], 2) == [np.array([*ids, 2], np.uint16).tobytes()], text
    rng = np.random.default_rng(8)
    letters = list("aAbBzZ.,;:!?'<|> \té²\u0301ß-_\n")
    for _ in range(500):
        text = "".join(rng.choice(letters, 30))
        assert encoder.encode([text], 2) == [np.array([*tok.encode(text, add_special_tokens=False).ids, 2], np.uint16).tobytes()], text


def test_new_words_go_to_the_library_together(monkeypatch):
    path = P.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), R.ChunkEncoder(path)
    asked, plain = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or plain(texts))
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeéßñ"), 9)) for _ in range(4500)]
    texts = [" ".join(words), "\n".join(w.upper() + m for w, m in zip(words, ["", "###", ",", "!!"] * 1200)), "İstanbul ŉx ªº µm a\u0301b x² 'll's <|endoftext|> </w> ab</w> _a -", "", "  "]
    want = [np.array([*tok.encode(t, add_special_tokens=False).ids, 2], np.uint16).tobytes() for t in texts]
    assert encoder.encode(texts, 2) == want and len(asked) < 40
    monkeypatch.setattr(encoder, "CACHE", 100)
    assert [encoder.encode([t], 2)[0] for t in texts] == want
    encoder.ends[:] = False  # a tokenizer without marked ends of words
    encoder.known, encoder.old = {"": b""}, {}
    assert encoder.encode(texts, 2) == want


def test_shards(spark, odd, nothing, tmp_path):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    R.write_shards(odd, f"{tmp_path}/s", path, 49_408, 2, shard_ids=3000, part_ids=9000)
    got = sorted(R.read_shards(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in ROWS}
    at = 0
    for r in got:
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    R.write_shards(nothing, f"{tmp_path}/e", path, 49_408, 2)
    assert R.read_shards(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("vocabulary", [40, 49_408, 100_000])
def test_grammar_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary)
    ids = np.concatenate([np.tile([1, 2, 3, 1, 2], 900), np.full(501, 7), rng.integers(0, 40, 4000)])
    lengths = np.array([1, 0, 2499, 2500, len(ids) - 5000])
    payload = R.compress(ids, lengths, vocabulary)
    shard = R.Shard(payload)
    assert (shard.decode_all() == ids).all() and len(shard.seq) < 0.7 * len(ids)
    ends = np.cumsum(lengths)
    for doc in range(5):
        own = ids[ends[doc] - lengths[doc] : ends[doc]].tolist()
        assert shard.decode(doc) == own and shard.decode(doc, 100, 131) == own[100:131]


def test_quality(spark, odd, nothing):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "house", "of", "a", "river", "ran", "by"], 60)) + "." for _ in range(300)]
    bad = [" ".join(x + "###" for x in rng.choice(["the", "house", "of", "a", "river", "ran", "by"], 60)) for _ in range(300)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2] if zlib.crc32(str(r[0]).encode()) % 4 != 2 else 1 - r[2], None) for r in rows], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels, sample=400)
    got = {r.doc_id: r for r in Q.classify(docs, model, keep=["doc_id"]).withColumn("held", Q.is_held_out()).collect()}
    held = [i for i, r in got.items() if r.held]
    assert {i for i in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.95
    odd_rows = Q.classify(odd, model).collect()
    assert len(odd_rows) == len(ROWS) and all(0 <= r.score <= 1 for r in odd_rows)
    assert len({r.score for r in odd_rows if not (r.text or "").strip()}) == 1
    assert Q.classify(nothing, model).count() == 0
    assert {r.score for r in Q.classify(odd, Q.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_workers_do_not_keep_the_encoder():
    """What another operator's task enters next gives the encoder's memory back; the encoder's own tasks keep it."""
    path = P.path("byte_bpe_50k.tiktoken")
    byte_bpe.encoder(path, P.PATTERN)
    common.enter(byte_bpe.__name__)
    assert byte_bpe.encoder.cache_info().currsize == 1

    class Rows:  # runs the tasks of a map here
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            list(run(iter([])))
            raise StopIteration

    with pytest.raises(StopIteration):
        Q.context_vectors(Rows())
    assert byte_bpe.encoder.cache_info().currsize == 0


def test_ids_of_the_encoder(spark):
    rows = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "doc_id long, text string")
    got = byte_bpe.encode_decode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("doc_id").collect()
    assert [hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got] == [r.ids_sha256 for r in got]
    assert [len(r.ids) for r in got] == [r.n_tokens for r in got] and got[0].n_tokens > 0
