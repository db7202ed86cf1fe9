"""Alignment, template and training-set queries on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.operators import alignments as A, templates as T

c = F.col
U = D.uniform_sql
M = D.with_sql(D.MSA)

TURNS = """t AS (SELECT 'Q' || (conv_id % 20) AS query, CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS msa, conv_id * 100 + turn AS idx, """ + D.LETTERS + """ AS s FROM conversations)"""


def turns(spark, sf):
    msa = F.when(c("role") == "user", 0).when(c("role") == "system", 1).otherwise(2)
    return D.table(spark, sf, "conversations").select(
        F.concat(F.lit("Q"), c("conv_id") % 20).alias("query"), msa.alias("msa"), (c("conv_id") * 100 + c("turn")).alias("idx"), D.letters("text").alias("s")
    )


CODES = "map {" + ", ".join(f"'{k}': {v}" for k, v in A.CODES.items()) + "}"


@query(
    "msa_merge",
    "WITH " + TURNS + f""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, s ORDER BY msa, idx) AS rn FROM t) WHERE rn = 1)
    SELECT query, msa, idx, row_number() OVER (PARTITION BY query ORDER BY msa, idx) - 1 AS seq_idx, count(*) OVER (PARTITION BY query) AS num_alignments,
      CASE WHEN s = '' THEN '' ELSE array_to_string(list_transform(string_split(s, ''), lambda x: {CODES}[x]), ',') END AS codes FROM f""",
)
def _(spark, sf):
    x = A.merge(turns(spark, sf), "query", "s", ["msa", "idx"])
    return x.select("query", "msa", "idx", "seq_idx", "num_alignments", F.array_join("codes", ",").alias("codes"))


CHAINS = """ch AS (SELECT conv_id AS cid, turn AS chain, """ + D.LETTERS + """ AS s FROM conversations),
  ly AS (SELECT *, length(s) AS len, coalesce(sum(length(s)) OVER (PARTITION BY cid ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(length(s)) OVER (PARTITION BY cid ORDER BY chain ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after, (row_number() OVER (PARTITION BY cid ORDER BY chain) - 1) * 200 AS shift FROM ch)"""


def chains(spark, sf):
    return D.table(spark, sf, "conversations").select(c("conv_id").alias("cid"), c("turn").alias("chain"), D.letters("text").alias("s"))


@query("msa_pair_chains", "WITH " + CHAINS + " SELECT cid, chain, repeat('-', CAST(before AS INT)) || s || repeat('-', CAST(after AS INT)) AS s FROM ly")
def _(spark, sf):
    x = chains(spark, sf)
    return A.padded(A.pair_chains(x, A.chain_layout(x, "cid", "chain", "s"), "cid", "chain", "s"), "s").select("cid", "chain", "s")


@query(
    "msa_residue_index",
    "WITH " + CHAINS + " SELECT cid, chain, CAST(before AS BIGINT) + i AS pos, CAST(before AS BIGINT) + i + shift AS residue_index FROM (SELECT *, unnest(range(len)) AS i FROM ly)",
)
def _(spark, sf):
    return A.residue_index(A.chain_layout(chains(spark, sf), "cid", "chain", "s"), "cid", "chain")


PROFILE = "pf AS (SELECT query_id, pos, aa, count(*) / sum(count(*)) OVER (PARTITION BY query_id, pos) AS share FROM msa GROUP BY 1, 2, 3)"


@query("msa_profile", M + ", " + PROFILE + " SELECT query_id, pos, aa, round(share, 6) AS share FROM pf")
def _(spark, sf):
    return D.rounded(A.profile(D.msa(spark, sf), "query_id"))


SAMPLE = """sm AS (SELECT query_id, seq_idx, CASE WHEN rn <= 16 THEN 'sample' ELSE 'extra' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN seq_idx = q THEN '' ELSE md5('7|' || query_id || '|' || seq_idx) END, seq_idx) AS rn
    FROM (SELECT *, min(seq_idx) OVER (PARTITION BY query_id) AS q FROM seqs)))"""


def rows(spark, sf):
    return D.msa(spark, sf).filter("pos = 0").select("query_id", "seq_idx")


@query(
    "msa_sample",
    M + ", " + SAMPLE + """ SELECT query_id, seq_idx, part FROM (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY md5('8|' || query_id || '|' || seq_idx), seq_idx) AS rn FROM sm) WHERE part = 'sample' OR rn <= 20""",
)
def _(spark, sf):
    return A.sample(rows(spark, sf), "query_id", "seq_idx", 16, 20)


BLOCK = " AND ".join(f"NOT (i >= floor({U(7, 'query_id', f"'{b}'")} * n) AND i < floor({U(7, 'query_id', f"'{b}'")} * n) + floor(n * 0.2::DOUBLE))" for b in range(2))


@query(
    "msa_block_delete",
    M + f""" SELECT query_id, seq_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq_idx) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM seqs) WHERE i = 0 OR ({BLOCK})""",
)
def _(spark, sf):
    return A.block_delete(rows(spark, sf), "query_id", "seq_idx", 0.2, 2)


NEAREST = """mp AS (SELECT msa.*, part FROM msa JOIN sm USING (query_id, seq_idx)),
  ag AS (SELECT e.query_id, e.seq_idx, s.seq_idx AS centre, count(*) FILTER (e.aa <> '-') AS a FROM mp e JOIN mp s ON e.part = 'extra' AND s.part = 'sample' AND e.query_id = s.query_id AND e.pos = s.pos AND e.aa = s.aa GROUP BY 1, 2, 3),
  asg AS (SELECT query_id, seq_idx, arg_max(centre, (a, -centre)) AS centre FROM ag GROUP BY 1, 2)"""


def parted(spark, sf):
    return D.msa(spark, sf).join(A.sample(rows(spark, sf), "query_id", "seq_idx", 16), ["query_id", "seq_idx"])


@query("msa_nearest_cluster", M + ", " + SAMPLE + ", " + NEAREST + " SELECT * FROM asg")
def _(spark, sf):
    return A.nearest_cluster(parted(spark, sf), "query_id", "seq_idx")


@query(
    "msa_cluster_summary",
    M + ", " + SAMPLE + ", " + NEAREST + """, al AS (SELECT query_id, seq_idx AS centre, pos, aa, n_deleted FROM mp WHERE part = 'sample' UNION ALL SELECT mp.query_id, centre, pos, aa, n_deleted FROM mp JOIN asg ON asg.query_id = mp.query_id AND asg.seq_idx = mp.seq_idx)
    SELECT query_id, centre, pos, aa, round(count(*) / (sum(count(*)) OVER w + 1e-6), 6) AS share, round(sum(sum(n_deleted)) OVER w / (sum(count(*)) OVER w + 1e-6), 6) AS deletion_mean FROM al GROUP BY 1, 2, 3, 4 WINDOW w AS (PARTITION BY query_id, centre, pos)""",
)
def _(spark, sf):
    x = parted(spark, sf)
    return D.rounded(A.cluster_summary(x, A.nearest_cluster(x, "query_id", "seq_idx"), "query_id", "seq_idx"))


@query(
    "deletion_feats",
    M + "SELECT query_id, seq_idx, pos, CAST(least(greatest(n_deleted, 0), 1) AS DOUBLE) AS has_deletion, round(atan(n_deleted / 3.0) * (2 / pi()), 6) AS deletion_value FROM msa",
)
def _(spark, sf):
    has, value = A.deletion_features(c("n_deleted"))
    return D.rounded(D.msa(spark, sf).select("query_id", "seq_idx", "pos", has.alias("has_deletion"), value.alias("deletion_value")))


U1, U2, U3 = (U(7 + k, "query_id", "seq_idx", "pos") for k in range(3))


@query(
    "msa_mask",
    M + ", " + PROFILE + f""", cu AS (SELECT query_id, pos, list(struct_pack(aa := aa, hi := hi) ORDER BY aa) AS p FROM (SELECT *, sum(share) OVER (PARTITION BY query_id, pos ORDER BY aa) AS hi FROM pf) GROUP BY 1, 2),
      d AS (SELECT msa.*, p, {U1} AS u1, {U2} AS u2, {U3} AS u3 FROM msa JOIN cu USING (query_id, pos))
    SELECT query_id, seq_idx, pos, aa AS true_aa, u1 < 0.15 AS bert_mask, CASE WHEN u1 >= 0.15 THEN aa WHEN u2 < 0.1 THEN substr('ACDEFGHIKLMNPQRSTVWY', CAST(floor(u3 * 20) AS INT) + 1, 1)
      WHEN u2 < 0.2 THEN coalesce(list_filter(p, lambda x: x.hi > u3)[1].aa, aa) WHEN u2 < 0.3 THEN aa ELSE '*' END AS aa FROM d""",
)
def _(spark, sf):
    m = D.msa(spark, sf)
    out = A.mask(m, A.profile(m, "query_id"), "query_id", "seq_idx", 0.15, 0.1, 0.1, 0.1)
    return out.select("query_id", "seq_idx", "pos", "true_aa", "bert_mask", "aa")


@query("msa_replace_unknown", M + f"SELECT query_id, seq_idx, pos, CASE WHEN {U1} < 0.1 AND aa <> '-' THEN 'X' ELSE aa END AS aa FROM msa")
def _(spark, sf):
    return A.replace_unknown(D.msa(spark, sf), "query_id", "seq_idx", 0.1).select("query_id", "seq_idx", "pos", "aa")


@query(
    "seq_crop",
    f"""WITH s AS (SELECT doc_id, {D.LETTERS} AS s FROM documents), n AS (SELECT *, greatest(length(s) - 256, 0) AS n FROM s), x AS (SELECT *, floor({U(7, 'doc_id')} * (n + 1)) AS x FROM n),
      y AS (SELECT *, CAST(floor({U(8, 'doc_id')} * (n - x + 1)) AS BIGINT) AS start FROM x) SELECT doc_id, start, substr(s, start + 1, 256) AS s FROM y""",
)
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", D.letters("text").alias("s"))
    return A.crop(d, "doc_id", "s", 256)


# ---- templates: turns of a conversation are hits of its first turn

HITS = """q AS (SELECT conv_id, """ + D.LETTERS + """ AS qs FROM conversations WHERE turn = 0),
  h AS (SELECT c.conv_id AS query_id, c.turn AS hit_id, qs AS query_sequence, 'p' || (c.conv_id % 50) AS query_pdb, CASE WHEN c.conv_id % 4 = 0 THEN DATE '2000-06-01' END AS query_date, 'P' || ((c.conv_id + c.turn * 7) % 60) AS hit_pdb,
      CASE WHEN c.turn % 3 = 1 THEN substr(qs, 1, CAST(floor(length(qs) * 0.97::DOUBLE) AS INT)) WHEN c.conv_id % 9 = 2 THEN 'AC-DEF' ELSE regexp_replace(text, '[^A-Za-z]', '-', 'g') END AS hit_sequence,
      length(text) % 97 AS aligned_cols, (length(text) * 31 % 1000) / 10.0::DOUBLE AS sum_probs FROM conversations c JOIN q ON q.conv_id = c.conv_id WHERE c.turn > 0 AND qs <> ''),
  dt AS (SELECT 'P' || (o_custkey % 45) AS pdb, CAST(min(o_orderdate) + INTERVAL (min(o_custkey % 45) * 40) DAY AS DATE) AS date FROM orders GROUP BY 1), rp AS (SELECT DISTINCT 'P' || (45 + c_custkey % 11) AS from_id, 'P' || (c_custkey % 11) AS to_id FROM customer)"""


def hits(spark, sf):
    conv = D.table(spark, sf, "conversations")
    qs = conv.filter("turn = 0").select("conv_id", D.letters("text").alias("qs"))
    x = conv.filter("turn > 0").join(qs, "conv_id").filter("qs <> ''")
    n, k, t = F.length("text"), c("conv_id"), c("turn")
    seq = F.when(t % 3 == 1, F.substring(c("qs"), F.lit(1), F.floor(F.length("qs") * 0.97).cast("int"))).when(k % 9 == 2, "AC-DEF").otherwise(F.regexp_replace("text", "[^A-Za-z]", "-"))
    return x.select(
        k.alias("query_id"), t.alias("hit_id"), c("qs").alias("query_sequence"), F.concat(F.lit("p"), k % 50).alias("query_pdb"),
        F.when(k % 4 == 0, F.lit("2000-06-01").cast("date")).alias("query_date"), F.concat(F.lit("P"), (k + t * 7) % 60).alias("hit_pdb"),
        seq.alias("hit_sequence"), (n % 97).alias("aligned_cols"), (n * 31 % 1000 / 10.0).alias("sum_probs"),
    )


@query(
    "template_prefilter",
    "WITH " + HITS + """, r AS (SELECT h.*, CASE WHEN k.pdb IS NULL THEN coalesce(to_id, hit_pdb) ELSE hit_pdb END AS pdb FROM h LEFT JOIN dt k ON k.pdb = hit_pdb LEFT JOIN rp ON from_id = hit_pdb),
      z AS (SELECT r.*, date, replace(hit_sequence, '-', '') AS l FROM r LEFT JOIN dt ON dt.pdb = r.pdb),
      y AS (SELECT query_id, hit_id, pdb, sum_probs, CASE WHEN date > least(DATE '1997-01-01', query_date - 60) THEN 'after cut-off date' WHEN lower(query_pdb) = lower(pdb) THEN 'same structure'
        WHEN aligned_cols / length(query_sequence) <= 0.1 THEN 'align ratio too small' WHEN contains(query_sequence, l) AND length(l) / length(query_sequence) > 0.95 THEN 'exact subsequence' WHEN length(l) < 10 THEN 'too short' END AS reason FROM z)
    SELECT query_id, hit_id, pdb, reason, CASE WHEN reason IS NULL AND rn <= 2 THEN rn END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, reason IS NULL ORDER BY sum_probs DESC, hit_id) AS rn FROM y)""",
)
def _(spark, sf):
    n = c("o_custkey") % 45
    released = F.date_add(F.min("o_orderdate").cast("date"), (F.min(n) * 40).cast("int"))
    dates = D.table(spark, sf, "orders").groupBy(F.concat(F.lit("P"), n).alias("pdb")).agg(released.alias("date"))
    k = c("c_custkey") % 11
    old = D.table(spark, sf, "customer").select(F.concat(F.lit("P"), k + 45).alias("from_id"), F.concat(F.lit("P"), k).alias("to_id")).distinct()
    out = T.prefilter(hits(spark, sf), dates, old, "1997-01-01", 2)
    return out.select("query_id", "hit_id", "pdb", "reason", "rank")


LOC = """pc AS (SELECT p_partkey, p_size, upper(replace(p_name, ' ', '')) AS w FROM part),
  chn AS (SELECT 'S' || (p_partkey // 4) AS pdb, chr(CAST(65 + p_partkey % 4 AS INT)) AS chain, p_partkey % 4 AS ord, w || CASE WHEN p_size % 3 = 0 THEN 'XX' ELSE w END AS seqres FROM pc),
  hi AS (SELECT p_partkey AS hit_id, 'S' || (p_partkey // 4) AS pdb, chr(CAST(65 + (p_partkey + p_size) % 4 AS INT)) AS chain, CASE WHEN p_size % 4 = 0 THEN replace(substr(w, 2, 6), 'E', 'X') WHEN p_size % 7 = 1 THEN substr(w, 3, 9) || 'QQ' ELSE substr(w, 3, 9) END AS sequence FROM pc)"""


@query(
    "template_locate",
    "WITH " + LOC + """, x AS (SELECT hit_id, hi.chain, sequence, chn.chain AS fc, ord, seqres, strpos(seqres, sequence) AS e, list_filter(range(1, length(seqres) - length(sequence) + 2),
        lambda i: len(list_filter(range(1, length(sequence) + 1), lambda j: NOT (substr(sequence, j, 1) = 'X' OR substr(seqres, i + j - 1, 1) IN ('X', substr(sequence, j, 1))))) = 0)[1] AS z FROM hi JOIN chn ON chn.pdb = hi.pdb),
      y AS (SELECT *, CASE WHEN e > 0 AND chain = fc THEN 0 WHEN e > 0 THEN 1 WHEN z > 0 THEN 2 END AS tier FROM x), b AS (SELECT hit_id, arg_min(struct_pack(tier := tier, fc := fc, o := CASE WHEN tier < 2 THEN e - 1 ELSE z - 1 END), (tier, ord)) FILTER (tier IS NOT NULL) AS b FROM y GROUP BY 1)
    SELECT hit_id, b.tier AS tier, b.fc AS found_chain, b.o AS "offset", b IS NOT NULL AS found FROM b""",
)
def _(spark, sf):
    w, z, k = F.upper(F.replace(c("p_name"), F.lit(" "), F.lit(""))), c("p_size"), c("p_partkey")
    p = D.table(spark, sf, "part").select("p_partkey", "p_size", w.alias("w"))
    pdb = F.concat(F.lit("S"), F.floor(k / 4))
    chains_ = p.select(pdb.alias("pdb"), F.char((65 + k % 4).cast("int")).alias("chain"), (k % 4).alias("ord"), F.concat("w", F.when(z % 3 == 0, "XX").otherwise(c("w"))).alias("seqres"))
    seq = F.when(z % 4 == 0, F.translate(F.substring("w", 2, 6), "E", "X")).when(z % 7 == 1, F.concat(F.substring("w", 3, 9), F.lit("QQ"))).otherwise(F.substring("w", 3, 9))
    hi = p.select(k.alias("hit_id"), pdb.alias("pdb"), F.char((65 + (k + z) % 4).cast("int")).alias("chain"), seq.alias("sequence"))
    return T.locate(hi, chains_, "hit_id").select("hit_id", "tier", "found_chain", "offset", "found")


@query(
    "template_map",
    """WITH s AS (SELECT o_orderkey AS id, md5('q' || o_orderkey) AS q, 3 + o_orderkey % 7 AS a FROM orders),
      e AS (SELECT *, unnest(range(12)) AS i FROM s), g AS (SELECT *, CASE WHEN i = 4 THEN -1 ELSE 100 + a + i - CASE WHEN i > 4 THEN 1 ELSE 0 END END AS iq, CASE WHEN i = 7 THEN -1 ELSE 40 + i - CASE WHEN i > 7 THEN 1 ELSE 0 END END AS ih FROM e)
    SELECT id, iq - 100 - a + a - 1 + 0 AS query_pos, ih - 40 AS hit_pos FROM g WHERE iq > -1 AND ih > -1 AND ih - 40 < 9 AND iq - 100 - a + a - 1 < 32""",
)
def _(spark, sf):
    k = c("o_orderkey")
    s = D.table(spark, sf, "orders").select(k.alias("id"), F.md5(F.concat(F.lit("q"), k)).alias("q"), (3 + k % 7).alias("a"))
    # the hit query is the part of the query from position a on, with one gap; the hit lacks one column
    part = F.concat(F.substring(c("q"), c("a").cast("int"), F.lit(4)), F.lit("-"), F.substring(c("q"), (c("a") + 4).cast("int"), F.lit(7)))
    i = F.sequence(F.lit(0), F.lit(11))
    iq = F.transform(i, lambda j: F.when(j == 4, -1).otherwise(100 + c("a") + j - F.when(j > 4, 1).otherwise(0)))
    ih = F.transform(i, lambda j: F.when(j == 7, -1).otherwise(40 + j - F.when(j > 7, 1).otherwise(0)))
    x = s.withColumn("hq", part).withColumn("hs", F.lit("ACDEFGH-IK")).withColumn("iq", iq).withColumn("ih", ih)
    out = T.map_indices(x, "hq", "hs", "iq", "ih", "q")
    return out.select("id", c("query_pos").cast("long").alias("query_pos"), c("hit_pos").cast("long").alias("hit_pos"))


@query(
    "template_gap_check",
    D.with_sql(D.ATOMS) + """, ca AS (SELECT structure_id, vec_id, x, y, z FROM prot WHERE atom = 'CA')
    SELECT a.structure_id, round(max(d), 6) AS max_step, coalesce(bool_or(d > 60), FALSE) AS rejected FROM (SELECT a.structure_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM ca a LEFT JOIN ca b ON b.structure_id = a.structure_id AND b.vec_id = a.vec_id + 1) a GROUP BY 1""",
)
def _(spark, sf):
    ca = D.atoms(spark, sf).filter("kind = 'protein' and atom = 'CA'").select("structure_id", "vec_id", "x", "y", "z")
    return D.rounded(T.gap_check(ca, ["structure_id"], "vec_id", 60.0))


@query(
    "meta_dates_resolution",
    """SELECT o_custkey AS id, strftime(min(o_orderdate), '%Y-%m-%d') AS release_date, coalesce(CASE WHEN o_custkey % 3 = 0 THEN max(o_totalprice) END, CASE WHEN o_custkey % 4 = 0 THEN o_custkey / 10.0::DOUBLE END) AS resolution FROM orders GROUP BY o_custkey""",
)
def _(spark, sf):
    k = c("o_custkey")
    days = F.date_format("o_orderdate", "yyyy-MM-dd")
    # two dates stand for the revisions; the oldest of them is the release date
    m = D.table(spark, sf, "orders").groupBy(k.alias("id")).agg(F.array(F.max(days), F.min(days)).alias("rev"), F.max("o_totalprice").alias("v"))
    m = m.select("id", "rev", F.when(c("id") % 4 == 0, (c("id") / 10.0).cast("string")).otherwise("?").alias("r1"), F.lit(".").alias("r2"), F.when(c("id") % 3 == 0, c("v").cast("string")).alias("r3"))
    return T.dates_and_resolution(m, "rev", ["r1", "r2", "r3"]).select("id", "release_date", "resolution")


LET = f"""s AS (SELECT doc_id, {D.LETTERS} AS s, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 25) / 2.0::DOUBLE END AS resolution FROM documents),
  l AS (SELECT doc_id, max(n) / sum(n) AS share FROM (SELECT doc_id, a, count(*) AS n FROM (SELECT doc_id, unnest(string_split(s, '')) AS a FROM s WHERE s <> '') GROUP BY 1, 2) GROUP BY 1),
  ok AS (SELECT s.doc_id, length(s.s) AS len, round(share, 6) AS largest_share FROM s JOIN l ON l.doc_id = s.doc_id WHERE (resolution IS NULL OR resolution <= 9) AND share <= 0.16)"""


def good_chains(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", D.letters("text").alias("s"), F.when(c("doc_id") % 3 != 0, (c("doc_id") % 25) / 2.0).alias("resolution"))
    return T.train_filter(d.filter("s <> ''"), "s", "resolution", 9.0, 0.16)


@query("train_filter", "WITH " + LET + " SELECT doc_id, largest_share FROM ok")
def _(spark, sf):
    return D.rounded(good_chains(spark, sf).select("doc_id", "largest_share"))


DRAW = f"dr AS (SELECT doc_id FROM ok WHERE {U(7, 'doc_id')} < 1.0::DOUBLE / (doc_id % 3 + 1) * least(greatest(len, 256), 512) / 512.0::DOUBLE)"


@query("train_draw", "WITH " + LET + ", " + DRAW + " SELECT doc_id FROM dr")
def _(spark, sf):
    return T.train_draw(good_chains(spark, sf), "doc_id", F.length("s"), c("doc_id") % 3 + 1).select("doc_id")


@query(
    "train_sample",
    "WITH " + LET + ", " + DRAW + f""", it AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM dr JOIN documents USING (doc_id)),
      wt AS (SELECT * FROM (VALUES (1, 'en', 4), (2, 'fr', 3), (3, 'de', 2), (4, 'es', 1), (5, 'xx', 6)) AS t(o, lang, w) WHERE lang IN (SELECT lang FROM it)),
      cu AS (SELECT lang, (sum(w) OVER (ORDER BY o) - w)::DOUBLE / sum(w) OVER () AS lo, (sum(w) OVER (ORDER BY o))::DOUBLE / sum(w) OVER () AS hi FROM wt),
      sl AS (SELECT slot, lang FROM (SELECT slot, {U(1007, 'slot')} AS u FROM (SELECT unnest(range(2000)) AS slot)) JOIN cu ON lo <= u AND u < hi),
      sr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY slot) AS k FROM sl)
    SELECT 0 AS epoch, slot, sr.lang, doc_id FROM sr JOIN it ON it.lang = sr.lang AND it.i = (k - 1) % n + 1""",
)
def _(spark, sf):
    x = T.train_draw(good_chains(spark, sf), "doc_id", F.length("s"), c("doc_id") % 3 + 1).select("doc_id")
    x = x.join(D.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return T.mix_epoch(x, "lang", "doc_id", {"en": 4, "fr": 3, "de": 2, "es": 1, "xx": 6}, 2000)
