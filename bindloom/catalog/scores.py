"""Score and designed-sequence analysis on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.operators import designs as E, scores as R

c = F.col
SC = D.with_sql(D.SCORES)
CELL = ["sample", "run", "batch", "residue"]


def soft(spark, sf):
    return R.with_softmax(D.scores(spark, sf), CELL)


@query("softmax_logprob", SC + "SELECT sample, run, batch, residue, aa, round(log_prob, 6) AS log_prob, round(prob, 6) AS prob FROM soft")
def _(spark, sf):
    return D.rounded(soft(spark, sf).select(*CELL, "aa", "log_prob", "prob"))


@query("score_mean_std", SC + "SELECT sample, residue, aa, round(avg(prob), 6) AS mean, round(stddev_pop(prob), 6) AS std FROM soft GROUP BY 1, 2, 3")
def _(spark, sf):
    return D.rounded(R.mean_std(soft(spark, sf), ["sample", "residue", "aa"]))


MEANS = """mm AS (SELECT sample, residue, aa, avg(l) AS logit FROM (SELECT sample, run, residue, aa, avg(logit) AS l FROM scores GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


def means(spark, sf):
    return R.mean_of_means(D.scores(spark, sf), ["sample", "residue", "aa"], "run")


@query("score_mean_of_means", SC + ", " + MEANS + " SELECT sample, residue, aa, round(logit, 6) AS logit FROM mm")
def _(spark, sf):
    return D.rounded(means(spark, sf))


# off-targets of a sample: the two following labels
FUSE = """off AS (SELECT t.sample, o.residue, o.aa, o.logit FROM (SELECT DISTINCT sample, label FROM scores) t JOIN (SELECT m.*, CAST(substr(sample, 2) AS INT) AS l FROM mm m) o ON o.l IN ((t.label + 1) % 10, (t.label + 2) % 10)),
  om AS (SELECT sample, residue, aa, avg(logit) AS o FROM off GROUP BY 1, 2, 3), tm AS (SELECT * FROM mm),
  fu AS (SELECT tm.sample, tm.residue, tm.aa, 1.0 * tm.logit - 0.5::DOUBLE * CASE WHEN tm.residue = 1 THEN 0 ELSE 1 END * o AS logit FROM tm JOIN om USING (sample, residue, aa)),
  fs AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY sample, residue)) AS log_prob FROM (SELECT *, CASE WHEN aa <> 'X' THEN logit END AS x FROM fu))"""


def offs(spark, sf):
    m = means(spark, sf)
    lab = F.substring("sample", 2, 9).cast("int")
    steps = F.explode(F.array(F.lit(1), F.lit(2)))
    # the score of label l is an off-target of labels l - 1 and l - 2
    return m.withColumn("_k", steps).withColumn("sample", F.concat(F.lit("S"), F.pmod(lab - c("_k"), F.lit(10)))).drop("_k")


def mask(spark, sf):
    return means(spark, sf).select("sample", "residue").distinct().withColumn("mask", F.when(c("residue") == 1, 0.0).otherwise(1.0))


def fused(spark, sf):
    return R.fuse(means(spark, sf), offs(spark, sf), mask(spark, sf), ["sample"], 1.0, 0.5)


@query("score_fuse", SC + ", " + MEANS + ", " + FUSE + " SELECT sample, residue, aa, round(logit, 6) AS logit, round(log_prob, 6) AS log_prob FROM fs")
def _(spark, sf):
    return D.rounded(fused(spark, sf).select("sample", "residue", "aa", "logit", "log_prob"))


@query(
    "score_penalty_mask",
    D.with_sql(D.ATOMS) + f""", r AS (SELECT DISTINCT structure_id, vec_id FROM prot), hit AS (SELECT DISTINCT p.vec_id FROM lig l JOIN prot p ON l.structure_id = p.structure_id AND l.element <> 'H' AND p.element <> 'H' AND {D.D2} <= 64)
    SELECT r.structure_id, r.vec_id, CASE WHEN r.vec_id IN (SELECT vec_id FROM hit) AND r.vec_id % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM r""",
)
def _(spark, sf):
    from bindloom.operators import spatial as A

    at = D.atoms(spark, sf)
    r = at.filter("kind = 'protein'").select("structure_id", "vec_id", *A.RESIDUE[1:]).distinct()
    # residues near a ligand, and a list of residues by number
    auto = A.pocket_residues(at.filter("kind = 'ligand'"), at.filter("kind = 'protein'"), ["structure_id"], 8.0).withColumn("mask", F.lit(1))
    manual = r.select(*A.RESIDUE, (c("vec_id") % 2).alias("mask"))
    return R.penalty_mask(r, [auto, manual], A.RESIDUE).select("structure_id", "vec_id", "mask")


PK = """pk AS (SELECT DISTINCT sample, residue FROM scores WHERE residue <> 0), nat AS (SELECT sample, residue, substr('ACDEFGHIKLMNPQRSTVWYX', CAST((label * 3 + residue) % 20 + 1 AS INT), 1) AS aa FROM (SELECT DISTINCT sample, label, residue FROM scores))"""


def pocket(spark, sf):
    return D.scores(spark, sf).filter("residue <> 0").select("sample", "residue").distinct()


def native(spark, sf):
    aa = F.substring(F.lit(D.AA), ((c("label") * 3 + c("residue")) % 20 + 1).cast("int"), F.lit(1))
    return D.scores(spark, sf).select("sample", "label", "residue").distinct().select("sample", "residue", aa.alias("aa"))


def off_mean(spark, sf):
    return offs(spark, sf).groupBy("sample", "residue", "aa").agg(F.avg("logit").alias("logit"))


@query(
    "score_pocket_delta",
    SC + ", " + MEANS + ", " + FUSE + ", " + PK + """ SELECT sample, residue, aa, round(mm.logit, 6) AS logit, round(o, 6) AS off_logit, round(mm.logit - o, 6) AS delta FROM mm JOIN om USING (sample, residue, aa) JOIN pk USING (sample, residue) JOIN nat USING (sample, residue, aa)""",
)
def _(spark, sf):
    return D.rounded(R.pocket_delta(means(spark, sf), off_mean(spark, sf), ["sample"], pocket(spark, sf), native(spark, sf)))


@query(
    "score_delta_matrix",
    SC + ", " + MEANS + ", " + FUSE + ", " + PK + """ SELECT sample, residue, aa, round(mm.logit - o, 6) AS delta FROM mm JOIN om USING (sample, residue, aa) JOIN pk USING (sample, residue) WHERE aa <> 'X'""",
)
def _(spark, sf):
    x = R.delta_matrix(means(spark, sf), off_mean(spark, sf), ["sample"], pocket(spark, sf))
    return D.rounded(x.select("sample", "residue", "aa", "delta"))


@query(
    "score_topk_success",
    SC + """, k AS (SELECT *, row_number() OVER (PARTITION BY sample, run, batch, residue ORDER BY logit DESC, strpos('ACDEFGHIKLMNPQRSTVWYX', aa)) AS rn FROM scores WHERE aa <> 'X' AND label <> 4 AND residue IN (0, 2)),
      w AS (SELECT *, CASE residue WHEN 0 THEN 'E' ELSE 'V' END AS wanted_aa FROM k),
      p AS (SELECT sample, residue, wanted_aa, count(*) FILTER (rn = 1 AND aa = wanted_aa) AS top1, count(*) FILTER (rn <= 3 AND aa = wanted_aa) AS top3, count(*) FILTER (rn = 1) AS total FROM w GROUP BY 1, 2, 3)
    SELECT * FROM p UNION ALL SELECT 'ALL', residue, wanted_aa, CAST(sum(top1) AS BIGINT), CAST(sum(top3) AS BIGINT), CAST(sum(total) AS BIGINT) FROM p GROUP BY 2, 3""",
)
def _(spark, sf):
    s = D.scores(spark, sf)
    wanted = s.filter("residue in (0, 2)").select("residue").distinct().withColumn("wanted_aa", F.when(c("residue") == 0, "E").otherwise("V"))
    return R.topk_success(s, s.filter("label <> 4"), ["run", "batch"], wanted)


@query(
    "score_off_fallback",
    SC + ", " + MEANS + """, a AS (SELECT residue, aa, avg(l) AS logit FROM (SELECT run, sample, residue, aa, avg(logit) AS l FROM scores GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
    SELECT sample, residue, aa, round(logit, 6) AS logit FROM mm WHERE sample NOT IN ('S3', 'S8') UNION ALL SELECT s, residue, aa, round(logit, 6) FROM a, (SELECT DISTINCT sample AS s FROM scores WHERE sample IN ('S3', 'S8'))""",
)
def _(spark, sf):
    s = D.scores(spark, sf)
    own = means(spark, sf).filter("sample not in ('S3', 'S8')")
    every = R.mean_of_means(s.withColumn("run", F.concat_ws("/", "sample", "run")), ["residue", "aa"], "run")
    return D.rounded(R.with_fallback(means(spark, sf), own, every))


@query(
    "score_margin_js",
    SC + ", " + MEANS + ", " + FUSE + ", " + PK + """, z AS (SELECT mm.sample, mm.residue, aa, mm.logit AS t, o FROM mm JOIN om USING (sample, residue, aa)),
      p AS (SELECT *, CASE WHEN aa <> 'X' THEN exp(t / 0.5) / sum(CASE WHEN aa <> 'X' THEN exp(t / 0.5) END) OVER w ELSE 0 END AS p, CASE WHEN aa <> 'X' THEN exp(o / 0.5) / sum(CASE WHEN aa <> 'X' THEN exp(o / 0.5) END) OVER w ELSE 0 END AS q FROM z WINDOW w AS (PARTITION BY sample, residue)),
      j AS (SELECT *, 0.5 * greatest(p, 1e-12) * (ln(greatest(p, 1e-12)) - ln(greatest(0.5 * (p + q), 1e-12))) + 0.5 * greatest(q, 1e-12) * (ln(greatest(q, 1e-12)) - ln(greatest(0.5 * (p + q), 1e-12))) AS js FROM p),
      g AS (SELECT sample, residue, sum(js) AS js, sum(CASE WHEN aa = 'X' THEN 0 ELSE t - o END) AS ms, arg_max(aa, t) FILTER (aa <> 'X') AS ta FROM j GROUP BY 1, 2),
      f AS (SELECT sample, residue, arg_max(aa, logit) FILTER (aa <> 'X') AS af FROM fu GROUP BY 1, 2),
      d AS (SELECT j.sample, j.residue, ln(p) - ln(q) AS dr FROM j JOIN f ON f.sample = j.sample AND f.residue = j.residue AND f.af = j.aa)
    SELECT sample, round(sum(ms) / (21 * count(*)), 6) AS margin, round(avg(js), 6) AS js, round(count(*) FILTER (residue <> 0 AND ta <> af) / count(*) FILTER (residue <> 0), 6) AS site_change_rate, round(avg(dr), 6) AS off_drop
    FROM g JOIN f USING (sample, residue) JOIN d USING (sample, residue) GROUP BY 1""",
)
def _(spark, sf):
    return D.rounded(R.margin_js(means(spark, sf), off_mean(spark, sf), fused(spark, sf), ["sample"], pocket(spark, sf), 0.5))


@query(
    "score_keysite",
    SC + """, s AS (SELECT * FROM soft WHERE residue = 1 AND aa <> 'X'), b AS (SELECT sample, aa, count(*) AS n FROM (SELECT sample, run, batch, arg_max(aa, prob) AS aa FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT s.sample, s.aa, round(avg(ln(greatest(prob, 1e-12))), 6) AS mean_log_prob, round(avg(logit), 6) AS mean_logit, count(*) AS total_reps, coalesce(max(n), 0) AS count, round(coalesce(max(n), 0) / count(*), 6) AS fraction
    FROM s LEFT JOIN b ON b.sample = s.sample AND b.aa = s.aa GROUP BY 1, 2""",
)
def _(spark, sf):
    return D.rounded(R.keysite(soft(spark, sf), ["sample"], ["run", "batch"], c("residue") == 1))


@query(
    "score_site_window",
    SC + " SELECT sample, residue, round(avg(p), 6) AS mean_chosen_prob FROM (SELECT sample, run, batch, residue, max(prob) AS p FROM soft WHERE abs(residue - 0) <= 1 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2",
)
def _(spark, sf):
    return D.rounded(R.confidence_profile(soft(spark, sf), ["sample"], ["run", "batch"], F.lit(0), 1))


VER = """v AS (SELECT conv_id % 40 AS mutation, role AS version, conv_id * 100 + turn AS batch, chr(CAST(65 + length(text) % 4 AS INT)) AS aa, length(text) / 10.0::DOUBLE AS logit FROM conversations)"""


def versions(spark, sf):
    n = F.length("text")
    return D.table(spark, sf, "conversations").select(
        (c("conv_id") % 40).alias("mutation"), c("role").alias("version"), (c("conv_id") * 100 + c("turn")).alias("batch"),
        F.char((65 + n % 4).cast("int")).alias("aa"), (n / 10.0).alias("logit"),
    )


@query(
    "score_version_summary",
    "WITH " + VER + """, k AS (SELECT mutation, version, aa, count(*) AS n, min(batch) AS f, sum(logit) AS l FROM v GROUP BY 1, 2, 3)
    SELECT mutation, version, arg_max(aa, (n, -f)) AS majority_aa, max(n) AS majority_count, round(sum(l) / sum(n), 6) AS mean_logit FROM k GROUP BY 1, 2""",
)
def _(spark, sf):
    return D.rounded(R.version_summary(versions(spark, sf), ["mutation", "version"], "batch"))


@query(
    "score_agreement",
    "WITH " + VER + """, r AS (SELECT *, row_number() OVER (PARTITION BY mutation, version ORDER BY batch) AS i FROM v)
    SELECT a.mutation, a.version AS version_a, b.version AS version_b, count(*) AS n, round(avg(CASE WHEN a.aa = b.aa THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM r a JOIN r b ON a.mutation = b.mutation AND a.i = b.i AND a.version < b.version GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return D.rounded(R.version_agreement(versions(spark, sf), "mutation", "version", "batch"))


SITE = """r AS (SELECT structure_id, chain, resseq, row_number() OVER (PARTITION BY structure_id ORDER BY vec_id) - 1 AS idx, substr('ACDEFGHIKLMNPQRSTVWYX', CAST(vec_id % 20 + 1 AS INT), 1) AS aa FROM prot WHERE atom = 'CA'),
  l AS (SELECT 'S' || label AS structure_id, CASE vec_id % 3 WHEN 0 THEN 'A:' WHEN 1 THEN 'b:' ELSE '' END AS cp, CASE WHEN vec_id % 2 = 0 THEN substr('ACDEFGHIKLMNPQRSTVWYX', CAST(vec_id % 20 + 1 AS INT), 1) ELSE NULL END AS wt, vec_id // 4 AS pos FROM embeddings),
  m AS (SELECT DISTINCT structure_id, cp || coalesce(wt, '') || pos || 'V' AS label, wt, pos, CASE cp WHEN '' THEN NULL ELSE upper(cp[1:1]) END AS chain FROM l),
  g AS (SELECT m.structure_id, m.label, any_value(m.wt) AS wt, count(idx) AS n, count(*) FILTER (m.wt = r.aa) AS s, min(idx) AS a, min(idx) FILTER (m.wt = r.aa) AS b FROM m LEFT JOIN r ON r.structure_id = m.structure_id AND r.resseq = m.pos AND (m.chain IS NULL OR m.chain = r.chain) GROUP BY 1, 2)"""


@query(
    "score_site_map",
    D.with_sql(D.ATOMS) + ", " + SITE + """ SELECT structure_id, label, CASE WHEN n = 1 THEN a WHEN s = 1 THEN b END AS idx, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 AND s <> 1 THEN 'ambiguous' WHEN wt IS NOT NULL AND s = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM g""",
)
def _(spark, sf):
    from bindloom.functions import sequences as Q
    from bindloom.plans import skew as S

    v = c("vec_id")
    letter = F.substring(F.lit(D.AA), (v % 20 + 1).cast("int"), F.lit(1))
    ca = D.atoms(spark, sf).filter("kind = 'protein' and atom = 'CA'").withColumn("aa", letter)
    res = S.ranked(ca, ["structure_id"], [v], "idx").withColumn("idx", c("idx") - 1)
    text = F.concat(
        F.when(v % 3 == 0, "A:").when(v % 3 == 1, "b:").otherwise(""), F.when(v % 2 == 0, letter).otherwise(""), F.floor(v / 4).cast("string"), F.lit("V")
    )
    lab = D.table(spark, sf, "embeddings").select(F.concat(F.lit("S"), "label").alias("structure_id"), text.alias("label")).distinct()
    lab = lab.withColumn("_m", Q.parse_label(c("label"))).select("structure_id", "label", "_m.chain", "_m.wt", "_m.pos")
    return R.map_sites(lab, res.select("structure_id", "chain", "resseq", "idx", "aa"), "structure_id")


@query(
    "reshape_scores",
    SC + " SELECT sample, run, batch, residue, " + ", ".join(f"round(max(logit) FILTER (aa = '{a}'), 6) AS \"{a}\"" for a in D.AA) + " FROM scores GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    return D.rounded(R.to_wide(D.scores(spark, sf), CELL, "logit"))


@query("reshape_scores_long", SC + " SELECT sample, run, batch, residue, aa, round(logit, 6) AS logit FROM scores")
def _(spark, sf):
    return D.rounded(R.to_long(R.to_wide(D.scores(spark, sf), CELL, "logit"), CELL, "logit"))


@query(
    "seq_score_confidence",
    SC + """, b AS (SELECT sample, run, batch, residue, max(log_prob) AS lp FROM soft WHERE aa <> 'X' GROUP BY 1, 2, 3, 4),
      l AS (SELECT sample, run, batch, sum(-lp * m) / (sum(m) + 1e-8) AS loss, sum(-lp * m * p) / (sum(m * p) + 1e-8) AS pl FROM (SELECT *, CASE WHEN run % 4 = residue THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m, CASE WHEN residue <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM b) GROUP BY 1, 2, 3)
    SELECT sample, run, batch, round(loss, 6) AS loss, round(exp(-loss), 6) AS confidence, round(pl, 6) AS pocket_loss, round(exp(-pl), 6) AS pocket_confidence FROM l""",
)
def _(spark, sf):
    best = R.argmax(soft(spark, sf), CELL, "log_prob")
    out = R.sequence_confidence(best, CELL[:3], "log_prob", c("run") % 4 != c("residue"), c("residue") != 0)
    return D.rounded(out)


# ---- designed sequences

DS = D.with_sql(D.DESIGNS)
POCKET = "substr(s, i, 1)"
MASKED = """x AS (SELECT d.label, conv_id, turn, least(length(seq), length(ref)) AS n, list_transform(range(1, least(length(seq), length(ref)) + 1), lambda i: substr(seq, i, 1) = substr(ref, i, 1)) AS eq, length(ref) AS nr FROM designs d JOIN refs r ON d.label = r.label),
  y AS (SELECT *, list_filter(eq, lambda e, i: i % 5 = 1) AS pe, list_filter(eq, lambda e, i: i % 5 <> 1) AS re FROM x)"""


def against_reference(spark, sf):
    ref = D.references(spark, sf).withColumnRenamed("seq", "ref")
    every_fifth = F.transform(F.sequence(F.lit(1), F.greatest(F.length("ref"), F.lit(1))), lambda i: F.when(i % 5 == 1, 1).otherwise(0))
    return D.designs(spark, sf).join(ref.withColumn("pocket", every_fifth), "label")


@query(
    "seq_recovery",
    DS + ", " + MASKED + " SELECT label, conv_id, turn, round(len(list_filter(pe, lambda e: e)) / (nr // 5 + CASE WHEN nr % 5 > 0 THEN 1 ELSE 0 END), 6) AS seq_rec FROM y",
)
def _(spark, sf):
    return D.rounded(E.recovery(against_reference(spark, sf), "ref", "seq", "pocket").select("label", "conv_id", "turn", "seq_rec"))


IDS = """ids AS (SELECT label, conv_id, turn, CASE WHEN n = 0 THEN 0 ELSE len(list_filter(eq, lambda e: e)) / n END AS identity, CASE WHEN len(pe) = 0 THEN 0 ELSE len(list_filter(pe, lambda e: e)) / len(pe) END AS pocket_identity,
  CASE WHEN len(re) = 0 THEN 0 ELSE len(list_filter(re, lambda e: e)) / len(re) END AS rest_identity FROM y)"""


@query("seq_identity", DS + ", " + MASKED + ", " + IDS + " SELECT label, conv_id, turn, round(identity, 6) AS identity, round(pocket_identity, 6) AS pocket_identity, round(rest_identity, 6) AS rest_identity FROM ids")
def _(spark, sf):
    x = E.regional_identity(against_reference(spark, sf), "ref", "seq", "pocket")
    return D.rounded(x.select("label", "conv_id", "turn", "identity", "pocket_identity", "rest_identity"))


PROFILE = """ch AS (SELECT label, unnest(string_split(seq, '')) AS aa, unnest(range(length(seq))) AS pos FROM designs WHERE seq <> ''),
  k AS (SELECT label, pos, aa, count(*) AS n FROM ch GROUP BY 1, 2, 3), rp AS (SELECT label, unnest(string_split(ref, '')) AS ra, unnest(range(length(ref))) AS pos FROM refs),
  pr AS (SELECT k.label, k.pos, coalesce(sum(n) FILTER (aa = ra), 0) / sum(n) AS similarity, 1 - max(n) / sum(n) AS variability FROM k JOIN rp ON k.label = rp.label AND k.pos = rp.pos GROUP BY 1, 2)"""


def profile(spark, sf):
    return E.position_profile(D.designs(spark, sf), D.references(spark, sf), "label", "seq")


@query("seq_position_profile", DS + ", " + PROFILE + " SELECT label, pos, round(similarity, 6) AS similarity, round(variability, 6) AS variability FROM pr")
def _(spark, sf):
    return D.rounded(profile(spark, sf))


@query("seq_baseline_delta", DS + ", " + PROFILE + " SELECT p.label, p.pos, round(p.variability - b.variability, 6) AS delta FROM pr p JOIN pr b ON b.label = 'user' AND b.pos = p.pos WHERE p.label <> 'user'")
def _(spark, sf):
    return D.rounded(E.baseline_delta(profile(spark, sf), "label", "user").select("label", "pos", "delta"))


@query(
    "seq_region_summary",
    DS + ", " + MASKED + ", " + IDS + ", " + PROFILE + """ SELECT label, n, identity, pocket_identity, rest_identity, variability, pocket_variability, rest_variability FROM
      (SELECT label, count(*) AS n, round(avg(identity), 6) AS identity, round(avg(pocket_identity), 6) AS pocket_identity, round(avg(rest_identity), 6) AS rest_identity FROM ids GROUP BY 1) JOIN
      (SELECT label, round(avg(variability), 6) AS variability, round(avg(variability) FILTER (pos % 5 = 0), 6) AS pocket_variability, round(avg(variability) FILTER (pos % 5 <> 0), 6) AS rest_variability FROM pr GROUP BY 1) USING (label)""",
)
def _(spark, sf):
    ids = E.regional_identity(against_reference(spark, sf), "ref", "seq", "pocket")
    p = profile(spark, sf)
    return D.rounded(E.region_summary(ids, p, p.filter("pos % 5 = 0"), "label"))


@query(
    "pocket_union",
    """SELECT DISTINCT pos FROM (SELECT unnest([o_custkey - 1, o_orderkey % 4000 - 1]) AS pos FROM orders) WHERE pos >= 0 AND pos < 1200""",
)
def _(spark, sf):
    cell = F.concat(F.lit("A"), "o_custkey", F.lit(", B"), c("o_orderkey") % 4000, F.lit(",Cx,,"))
    lists = D.table(spark, sf, "orders").select(cell.alias("residues"))
    return E.pocket_union(lists, "residues", F.lit(1200)).select(c("pos").cast("long").alias("pos"))


@query(
    "batch_manifest",
    """WITH r AS (SELECT o_orderkey AS id, o_custkey % 90 AS n_atoms FROM orders), s AS (SELECT l_orderkey AS id, arg_min('p' || l_linenumber, l_linenumber) AS path FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT r.id, n_atoms, path AS structure_path, e.text AS sequence, CASE WHEN n_atoms = 0 THEN 'invalid_smiles' WHEN path IS NULL THEN 'structure_not_found' WHEN e.text IS NULL THEN 'sequences_not_found' END AS error, n_atoms > 56 AS exceeds_limit
    FROM r LEFT JOIN s ON s.id = r.id LEFT JOIN documents e ON e.doc_id = r.id""",
)
def _(spark, sf):
    r = D.table(spark, sf, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 90).alias("n_atoms"))
    s = D.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        c("l_orderkey").alias("id"), F.concat(F.lit("p"), "l_linenumber").alias("path"), c("l_linenumber").alias("priority")
    )
    q = D.table(spark, sf, "documents").select(c("doc_id").alias("id"), c("text").alias("sequence"))
    return E.batch_manifest(r, s, q, ["id"], 56)
