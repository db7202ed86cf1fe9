"""Similarity, sampling and statistics on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.functions import similarity as M
from bindloom.operators import sampling as G, similarity as N, statistics as T
from bindloom.session import written

c = F.col

# neighbours in the table: vector i with vector i + 1
NEXT = D.with_sql(D.VECS) + ", n AS (SELECT a.*, b.bits AS bits2, b.props AS props2, b.scaffold AS scaffold2 FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1)\n"
TANI = "CAST(len(list_intersect(bits, bits2)) AS DOUBLE) / (len(bits) + len(bits2) - len(list_intersect(bits, bits2)))"
PHYS = "exp(-2 * sqrt(CAST(len(list_filter(list_transform(props, lambda v, i: v <> props2[i]), lambda d: d)) AS DOUBLE)))"
SCAF = "CASE WHEN coalesce(scaffold = scaffold2, FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def neighbours(spark, sf):
    v = D.vecs(spark, sf)
    b = v.select((c("vec_id") - 1).alias("vec_id"), c("bits").alias("bits2"), c("props").alias("props2"), c("scaffold").alias("scaffold2"))
    return v.join(b, "vec_id")


def phys():
    return M.physchem([c("props")[i] for i in range(9)], [c("props2")[i] for i in range(9)])


@query("sim_tanimoto", NEXT + f"SELECT vec_id, round({TANI}, 6) AS words, round({TANI}, 6) AS sets FROM n")
def _(spark, sf):
    x = neighbours(spark, sf)
    words = M.tanimoto(M.pack_bits(c("bits"), 1), M.pack_bits(c("bits2"), 1))
    return x.select("vec_id", F.round(words, 6).alias("words"), F.round(M.tanimoto_sets(c("bits"), c("bits2")), 6).alias("sets"))


@query("sim_scaffold", NEXT + f"SELECT vec_id, {SCAF} AS sim FROM n")
def _(spark, sf):
    return neighbours(spark, sf).select("vec_id", M.scaffold(c("scaffold"), c("scaffold2")).alias("sim"))


@query("sim_physchem", NEXT + f"SELECT vec_id, round({PHYS}, 6) AS sim FROM n")
def _(spark, sf):
    return neighbours(spark, sf).select("vec_id", F.round(phys(), 6).alias("sim"))


@query(
    "sim_composite",
    NEXT + f"SELECT vec_id, round(0.4 * {TANI} + 0.3 * {SCAF} + 0.3 * {PHYS}, 6) AS all_three, round((0.4 * {TANI} + 0.3 * {SCAF}) / 0.7, 6) AS two FROM n",
)
def _(spark, sf):
    t, s = M.tanimoto_sets(c("bits"), c("bits2")), M.scaffold(c("scaffold"), c("scaffold2"))
    return neighbours(spark, sf).select(
        "vec_id", F.round(M.composite(d2=t, scaffold=s, physchem=phys()), 6).alias("all_three"),
        F.round(M.composite(d2=t, scaffold=s), 6).alias("two"),
    )


@query(
    "ifp_similarity",
    D.with_sql(D.VECS)
    + """, e AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN [] ELSE bits[1:vec_id % 9] END AS b1 FROM vecs), n AS (SELECT a.vec_id, a.b1 AS bits, b.b1 AS bits2 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, CASE WHEN len(bits) = 0 AND len(bits2) = 0 THEN 1 WHEN len(bits) = 0 OR len(bits2) = 0 THEN 0 ELSE round("""
    + TANI + ", 6) END::DOUBLE AS sim FROM n",
)
def _(spark, sf):
    cut = F.when(c("vec_id") % 11 == 0, F.array().cast("array<int>")).otherwise(F.slice("bits", F.lit(1), (c("vec_id") % 9).cast("int")))
    v = D.vecs(spark, sf).select("vec_id", cut.alias("b1"))
    w = v.select((c("vec_id") - 1).alias("vec_id"), c("b1").alias("b2"))
    return v.join(w, "vec_id").select("vec_id", F.round(M.set_similarity(c("b1"), c("b2")), 6).alias("sim"))


@query(
    "pairs_target_off",
    D.with_sql(D.VECS)
    + f"""SELECT * FROM (SELECT protein, vec_id_1, vec_id_2, round({TANI}, 6) AS similarity_2d, {TANI} AS s FROM
      (SELECT a.protein, a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, a.bits, b.bits AS bits2 FROM vecs a JOIN vecs b
        ON a.protein = b.protein AND a.target_type = 'target' AND b.target_type = 'off_target')) WHERE s >= 0.45""".replace("SELECT * FROM", "SELECT protein, vec_id_1, vec_id_2, similarity_2d FROM", 1),
)
def _(spark, sf):
    v = D.vecs(spark, sf)
    out = N.similar_pairs(v.filter("target_type = 'target'"), v.filter("target_type = 'off_target'"), ["protein"], "vec_id", 0.45)
    return D.rounded(out)


@query(
    "pairs_all",
    D.with_sql(D.VECS)
    + f""", s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY md5('42|' || protein || '|' || vec_id)) AS i FROM vecs) WHERE i <= 30)
    SELECT protein, vec_id_1, vec_id_2, round({TANI}, 6) AS similarity_2d FROM (SELECT a.protein, a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, a.bits, b.bits AS bits2
      FROM s a JOIN s b ON a.protein = b.protein AND a.vec_id < b.vec_id)""",
)
def _(spark, sf):
    words = D.vecs(spark, sf).select("protein", "vec_id", M.pack_bits(c("bits"), 1).alias("fp"))
    pairs = N.sampled_pairs(words, ["protein"], "vec_id", 30)
    return pairs.select("protein", "vec_id_1", "vec_id_2", F.round(M.tanimoto(c("fp_1"), c("fp_2")), 6).alias("similarity_2d"))


@query(
    "pairs_all_similar",
    D.with_sql(D.VECS)
    + f"""SELECT protein, vec_id_1, vec_id_2, round(s, 6) AS similarity_2d FROM (SELECT protein, vec_id_1, vec_id_2, {TANI} AS s FROM
      (SELECT a.protein, a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, a.bits, b.bits AS bits2 FROM vecs a JOIN vecs b ON a.protein = b.protein AND a.vec_id < b.vec_id)) WHERE s >= 0.5""",
)
def _(spark, sf):
    v = D.vecs(spark, sf)
    return D.rounded(N.similar_pairs(v, v, ["protein"], "vec_id", 0.5, once=True))


@query(
    "bucket_difficulty",
    D.with_sql(D.PAIRTAB)
    + """SELECT pair_id, protein, CASE WHEN rn <= floor(n * 0.30::DOUBLE) THEN 'easy' WHEN rn > floor(n * 0.70::DOUBLE) THEN 'hard' ELSE 'medium' END AS bucket
    FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY sim, pair_id) AS rn, count(*) OVER (PARTITION BY protein) AS n FROM pt)""",
)
def _(spark, sf):
    return N.difficulty_bucket(D.pair_table(spark, sf), ["protein"], "sim", [c("pair_id")]).select("pair_id", "protein", "bucket")


@query("diversity_sample")
def _(spark, sf):
    v = D.vecs(spark, sf)
    feats = [f"f{i}" for i in range(7)]
    v = v.select("vec_id", "protein", F.lit(6).alias("n"), *[c("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)])
    return G.diversity_sample(v, ["protein"], "vec_id", feats, "n").select("protein", "vec_id", "_cluster").withColumnRenamed("_cluster", "cluster")


@query("sample_priority")
def _(spark, sf):
    # sampling starts from the curated table, which is read several times
    x = written(D.labelled(spark, sf).withColumn("mw", F.substring("ligand", 2, 9).cast("double")), "pairs")
    out = G.sample_by_priority(x, "protein", "ligand", "median_px", ["mw", "median_px"], 3)
    return out.select("protein", "ligand", "target_type", F.round("median_px", 6).alias("median_px"))


@query(
    "sample_stratified",
    """WITH s AS (SELECT p_type AS fam, count(*) AS size FROM part GROUP BY 1), q AS (SELECT *, least(greatest(3, floor(200 * size / sum(size) OVER ())), size) AS q0 FROM s),
      r AS (SELECT fam, CAST(CASE WHEN sum(q0) OVER () > 200 THEN greatest(1, floor(q0 * (200.0 / sum(q0) OVER ()))) ELSE q0 END AS BIGINT) AS quota FROM q)
    SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('42|' || p_partkey)) AS rn FROM part) JOIN r ON fam = p_type WHERE rn <= quota""",
)
def _(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", "p_type")
    return G.sample_stratified(p, "p_partkey", "p_type", 200)


# ---- statistics on the pair table

PT = D.with_sql(D.PAIRTAB)


@query(
    "activity_cliff",
    PT + """SELECT protein, n_pairs, n_cliffs, round(n_cliffs / n_pairs, 6) AS cliff_rate FROM (
      SELECT protein, count(*) AS n_pairs, count(*) FILTER (sim >= 0.7 AND delta >= 1) AS n_cliffs FROM pt GROUP BY 1
      UNION ALL SELECT 'ALL', count(*), count(*) FILTER (sim >= 0.7 AND delta >= 1) FROM pt)""",
)
def _(spark, sf):
    return D.rounded(T.cliff_rate(D.pair_table(spark, sf), "sim", "delta", "protein"))


EDGES = "e AS (SELECT quantile_cont(sim, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS es, quantile_cont(delta, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ed FROM pt)"
BINNED = f", {EDGES}, b AS (SELECT pt.*, len(list_filter(es, lambda x: x < sim)) + 1 AS sim_bin, len(list_filter(ed, lambda x: x < delta)) + 1 AS delta_bin FROM pt, e)"


def binned(spark, sf):
    x = T.quantile_bins(D.pair_table(spark, sf), "sim", 10, "sim_bin")
    return T.quantile_bins(x, "delta", 10, "delta_bin")


@query(
    "quantile_bins",
    PT + BINNED + " SELECT sim_bin, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, count(*) AS count FROM b GROUP BY 1",
)
def _(spark, sf):
    return D.rounded(T.bin_profile(T.quantile_bins(D.pair_table(spark, sf), "sim", 10, "sim_bin"), "sim_bin", "delta"))


@query("quantile_bin_counts", PT + BINNED + " SELECT sim_bin, delta_bin, count(*) AS n FROM b GROUP BY 1, 2")
def _(spark, sf):
    return binned(spark, sf).groupBy("sim_bin", "delta_bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "equal_width_bins",
    PT + """, l AS (SELECT min(sim) AS lo, max(sim) AS hi FROM pt)
    SELECT bin, count(*) AS n, round(avg(delta), 6) AS mean FROM (SELECT len(list_filter([lo + (hi - lo) / 5, lo + (hi - lo) / 5 * 2, lo + (hi - lo) / 5 * 3, lo + (hi - lo) / 5 * 4], lambda x: x < sim)) + 1 AS bin, delta FROM pt, l) GROUP BY 1""",
)
def _(spark, sf):
    x = T.equal_width_bins(D.pair_table(spark, sf), "sim", 5, "bin")
    return D.rounded(x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean")))


@query(
    "group_tertiles",
    PT + """, e AS (SELECT protein, list_distinct(quantile_cont(v, [0, 1/3, 2/3, 1])) AS d FROM (SELECT protein, floor(delta) AS v FROM pt) GROUP BY 1),
      x AS (SELECT pair_id, pt.protein, floor(delta) AS v, list_sort(d) AS d FROM pt JOIN e ON e.protein = pt.protein)
    SELECT pair_id, CASE WHEN len(d) > 1 THEN (['Low', 'Mid', 'High'])[len(list_filter(d[2:len(d) - 1], lambda y: y < v)) + 1 + 3 - (len(d) - 1)] END AS bin FROM x""",
)
def _(spark, sf):
    x = D.pair_table(spark, sf).withColumn("v", F.floor("delta").cast("double"))
    return T.group_tertiles(x, "protein", "v", "bin").select("pair_id", "bin")


@query("stat_pearson", PT + "SELECT round(corr(sim, delta), 6) AS r, count(*) AS n FROM pt")
def _(spark, sf):
    return D.rounded(T.pearson(D.pair_table(spark, sf), "sim", "delta").select("r", "n"))


RANKS = """, r AS (SELECT protein, rank() OVER (PARTITION BY protein ORDER BY sim) + (count(*) OVER (PARTITION BY protein, sim) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY protein ORDER BY delta) + (count(*) OVER (PARTITION BY protein, delta) - 1) / 2.0 AS ry FROM pt),
  rho AS (SELECT protein, corr(rx, ry) AS rho, count(*) AS n_pairs FROM r GROUP BY 1 HAVING count(*) >= 20)"""


@query("stat_spearman", PT + RANKS + " SELECT protein, round(rho, 6) AS rho, n_pairs FROM rho")
def _(spark, sf):
    return D.rounded(T.spearman(D.pair_table(spark, sf), "protein", "sim", "delta").select("protein", "rho", "n_pairs"))


@query(
    "stat_chi2",
    PT + BINNED + """, k AS (SELECT sim_bin, delta_bin, count(*) AS n FROM b GROUP BY 1, 2), ra AS (SELECT sim_bin, sum(n) AS ra FROM k GROUP BY 1), cb AS (SELECT delta_bin, sum(n) AS cb FROM k GROUP BY 1),
      g AS (SELECT coalesce(n, 0) AS o, ra * cb / (SELECT sum(n) FROM k) AS e FROM ra CROSS JOIN cb LEFT JOIN k USING (sim_bin, delta_bin))
    SELECT round(sum((o - e) * (o - e) / e), 4) AS chi2, CAST(81 AS BIGINT) AS dof FROM g""",
)
def _(spark, sf):
    return D.rounded(T.chi_square(binned(spark, sf), "sim_bin", "delta_bin").select("chi2", "dof"), 4)


@query(
    "stat_mannwhitney",
    PT + """, k AS (SELECT same_bin, rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS r FROM pt)
    SELECT CAST(sum(r) FILTER (same_bin) - count(*) FILTER (same_bin) * (count(*) FILTER (same_bin) + 1) / 2 AS DOUBLE) AS u, count(*) FILTER (same_bin) AS n_a, count(*) FILTER (NOT same_bin) AS n_b FROM k""",
)
def _(spark, sf):
    return T.mann_whitney(D.pair_table(spark, sf), "sim", c("same_bin")).select("u", "n_a", "n_b")


@query(
    "summary_pairs",
    PT + RANKS + """, f AS (SELECT count(*)::DOUBLE AS pairs, count(DISTINCT protein)::DOUBLE AS proteins, avg(sim) AS mean_similarity, avg(delta) AS mean_delta,
        count(*) FILTER (sim >= 0.7 AND delta >= 1)::DOUBLE AS cliffs, count(*) FILTER (sim >= 0.7 AND delta >= 1) / count(*) * 100 AS cliff_rate_percent, median(sim) AS median_similarity,
        median(delta) AS median_delta, (SELECT median(rho) FROM rho) AS median_rho FROM pt)
    SELECT figure, round(value, 6) AS value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME figure VALUE value)""",
)
def _(spark, sf):
    return D.rounded(T.summary(D.pair_table(spark, sf), "protein", "sim", "delta").filter("figure <> 'significant_share'"))


@query("stat_pvalues")
def _(spark, sf):
    x = D.pair_table(spark, sf)
    a = T.pearson(x, "sim", "delta").select(F.lit("pearson").alias("test"), "p")
    b = T.mann_whitney(x, "sim", c("same_bin")).select(F.lit("mann_whitney").alias("test"), "p")
    d = T.chi_square(binned(spark, sf), "sim_bin", "delta_bin").select(F.lit("chi_square").alias("test"), "p")
    return a.unionByName(b).unionByName(d)
