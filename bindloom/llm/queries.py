"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindloom.llm import align, byte_bpe, cross_polytope, decontaminate, language, line_dedup, main_text, ngram_join, phrases, pii, quality, repair, warc
from bindloom.llm.common import fresh_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
END_ID = 2


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op1_decontamination",
    f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
    lambda i: array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' '))) AS t FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, win.k AS k, item_id FROM pos JOIN win ON pos.t = win.t AND pos.k = win.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_main_text")
def _(spark, sf):
    return main_text.extract(table(spark, sf, "pages"), keep=["page_id", "url"])


@query("op3_cross_polytope")
def _(spark, sf):
    return cross_polytope.search(table(spark, sf, "embeddings"))


@query("op4_line_dedup")
def _(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents"), keep=["doc_id", "text"]).select("doc_id", "text", "n_lines", "n_removed")


@query("op5_ngram_join")
def _(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_byte_bpe")
def _(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)


@query("op7_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.classify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", "predicted")


@query("op8_warc")
def _(spark, sf):
    path = fresh_path(spark, "warc")
    warc.write_records(warc.derive(warc.page_responses(table(spark, sf, "pages"))), path)
    return warc.linked(warc.read_records(spark, path))


@query("op9_pii")
def _(spark, sf):
    return pii.find(table(spark, sf, "documents"))


@query("op10_repair")
def _(spark, sf):
    path = fresh_path(spark, "shards")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    size = repair.chunk_encoder(tokenizer).vocabulary
    repair.write_shards(table(spark, sf, "documents"), path, tokenizer, size, END_ID)
    return repair.read_shards(spark, path)


@query("op11_alignment")
def _(spark, sf):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(table(spark, sf, "documents"), *paths, keep=["doc_id"])


@query(
    "op12_phrases",
    f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM ws GROUP BY lang),
runs AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM ws, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM runs GROUP BY 1, 2 HAVING count(*) >= 100),
cand AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM cand),
scored AS (SELECT cuts.lang, cuts.p, cuts.a, k, x.f AS l, y.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.p = list_slice(cuts.p, 1, k)
  JOIN f AS y ON y.lang = cuts.lang AND y.p = list_slice(cuts.p, k + 1, len(cuts.p)) JOIN sizes ON sizes.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, list_slice(p, i, j) AS p, max(a) AS f FROM (SELECT lang, p, a, i, unnest(range(i + 1, len(p) + 1)) AS j
    FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM cand)) WHERE j - i + 1 < len(p) GROUP BY 1, 2),
free AS (SELECT best.* FROM best LEFT JOIN held ON held.lang = best.lang AND held.p = best.p WHERE held.f IS NULL OR 100 * held.f < 100 * best.a),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM free)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM named QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
)
def _(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op13_language")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.fit(docs), keep=["doc_id"])
    return found.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score")


@query("pipeline")
def _(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
