"""Pose, decoy and ensemble rankings on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.operators import ranking as R

c = F.col
P = D.with_sql(D.POSES)
BY = ["config_id"]


@query(
    "top_pose_window",
    P + """, b AS (SELECT *, min(score) OVER (PARTITION BY config_id) AS best FROM poses)
    SELECT config_id, pose_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY coalesce(score, 999), com_distance, pose_id) AS rank FROM b
      WHERE com_distance <= 4 AND coalesce(score <= best + 3, TRUE) AND min_distance >= 2) WHERE rank <= 5""",
)
def _(spark, sf):
    return R.window_poses(D.poses(spark, sf), BY, "pose_id").select("config_id", "pose_id", "rank")


@query(
    "top_pose_filter",
    P + """SELECT config_id, pose_id, rank, com_distance > 10 OR pocket_overlap < 0.3 AS possible_allosteric FROM (
      SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY score, pose_id) AS rank FROM poses WHERE score <= -5 AND NOT has_clash) WHERE rank <= 20""",
)
def _(spark, sf):
    out = R.filter_poses(D.poses(spark, sf), BY, "pose_id", -5.0, 20)
    return out.select("config_id", "pose_id", "rank", "possible_allosteric")


@query("pose_cluster_select")
def _(spark, sf):
    v = D.vecs(spark, sf)
    xyz = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double") * 10)
    poses = v.select(
        "protein", "vec_id", xyz.alias("xyz"), (c("vec_id") % 3).alias("n_clashes"), ((c("vec_id") * 7 % 200) / 10.0).alias("com_distance")
    )
    return R.cluster_poses(poses, "protein", "vec_id", "xyz", 10, 15.0, 0)


def seeds(spark, sf):
    """Five consecutive vectors are the seeds of one complex; 21 atoms each."""
    xyz = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double") * 10)
    return D.table(spark, sf, "embeddings").select(
        F.floor(c("vec_id") / 5).alias("complex_id"), (c("vec_id") % 5).cast("int").alias("seed"),
        F.when(c("vec_id") % 17 == 0, F.slice(xyz, 1, 60)).otherwise(xyz).alias("xyz"),
        (c("vec_id") * 13 % 101 / 1.0).alias("total_before"), (c("vec_id") * 7 % 89 / 1.0).alias("total_after"),
        (c("vec_id") * 5 % 31 / 1.0).alias("rep_before"), (c("vec_id") * 3 % 29 / 1.0).alias("rep_after"),
    )


AXES = [u + v for u in "xyz" for v in "xyz"]
NEWTON = "((l * l + p2) * l + p1) * l + p0", "(4 * l * l + 2 * p2) * l + p1"
RMSD = f"""s AS (SELECT CAST(vec_id // 5 AS BIGINT) AS complex_id, CAST(vec_id % 5 AS INT) AS seed,
    list_transform(list_slice(embedding, 1, CASE WHEN vec_id % 17 = 0 THEN 60 ELSE 63 END), lambda v: v::DOUBLE * 10) AS c FROM embeddings),
  ax AS (SELECT complex_id, seed, list_filter(c, lambda v, i: i % 3 = 1) AS x, list_filter(c, lambda v, i: i % 3 = 2) AS y, list_filter(c, lambda v, i: i % 3 = 0) AS z FROM s),
  m AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my, list_avg(z) AS mz FROM ax),
  ce AS (SELECT complex_id, seed, list_transform(x, lambda v: v - mx) AS x, list_transform(y, lambda v: v - my) AS y, list_transform(z, lambda v: v - mz) AS z FROM m),
  ng AS (SELECT *, list_inner_product(x, x) + list_inner_product(y, y) + list_inner_product(z, z) AS g, len(x) AS n FROM ce),
  su AS (SELECT a.complex_id, a.seed, b.seed AS other, a.n, (a.g + b.g) / 2 AS l0, {", ".join(f"CASE WHEN a.n = b.n THEN list_inner_product(a.{p[0]}, b.{p[1]}) END AS {p}" for p in AXES)}
    FROM ng a JOIN ng b ON a.complex_id = b.complex_id AND a.seed < b.seed),
  ky AS (SELECT *, xx + yy + zz AS a, yz - zy AS b, zx - xz AS c, xy - yx AS d, xx - yy - zz AS e, xy + yx AS f, zx + xz AS g, yy - xx - zz AS h, yz + zy AS i, zz - xx - yy AS j FROM su),
  co AS (SELECT complex_id, seed, other, n, l0, -2 * ({" + ".join(f"{p} * {p}" for p in AXES)}) AS p2,
    -8 * (xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx)) AS p1,
    a * (e * (h * j - i * i) - f * (f * j - i * g) + g * (f * i - h * g)) - b * (b * (h * j - i * i) - f * (c * j - i * d) + g * (c * i - h * d))
      + c * (b * (f * j - i * g) - e * (c * j - i * d) + g * (c * g - f * d)) - d * (b * (f * i - h * g) - e * (c * i - h * d) + f * (c * g - f * d)) AS p0 FROM ky),
  pr AS (SELECT complex_id, seed, other, CASE WHEN p2 IS NOT NULL THEN sqrt(greatest((l0 - list_reduce(list_concat([l0], list_transform(range(50), lambda v: 0::DOUBLE)),
    lambda l, v: CASE WHEN {NEWTON[1]} > 0 THEN l - ({NEWTON[0]}) / ({NEWTON[1]}) ELSE l END)) * 2 / n, 0)) END AS rmsd FROM co)"""


@query("pose_rmsd", "WITH " + RMSD + " SELECT complex_id, round(avg(rmsd), 6) AS mean_rmsd, count(rmsd) AS n_pairs FROM pr GROUP BY 1")
def _(spark, sf):
    return D.rounded(R.pose_rmsd(seeds(spark, sf), ["complex_id"], "seed", "xyz"))


@query(
    "relax_delta",
    "WITH " + RMSD + """, bo AS (SELECT complex_id, seed, rmsd FROM pr UNION ALL SELECT complex_id, other, rmsd FROM pr),
      sp AS (SELECT complex_id, seed, round(avg(rmsd), 6) AS rmsd_mean, round(stddev_pop(rmsd), 6) AS rmsd_std FROM bo GROUP BY 1, 2),
      ch AS (SELECT CAST(vec_id // 5 AS BIGINT) AS complex_id, CAST(vec_id % 5 AS INT) AS seed, vec_id * 13 % 101 / 1.0::DOUBLE AS total_before, vec_id * 7 % 89 / 1.0::DOUBLE AS total_after,
        vec_id * 5 % 31 / 1.0::DOUBLE AS rep_before, vec_id * 3 % 29 / 1.0::DOUBLE AS rep_after FROM embeddings)
    SELECT ch.*, total_after - total_before AS d_total, rep_after - rep_before AS d_rep, rmsd_mean, rmsd_std FROM ch LEFT JOIN sp ON sp.complex_id = ch.complex_id AND sp.seed = ch.seed""",
)
def _(spark, sf):
    return D.rounded(R.relax_delta(seeds(spark, sf), ["complex_id"], "seed", "xyz").drop("xyz"))


@query(
    "relax_change",
    """SELECT CAST(vec_id // 5 AS BIGINT) AS complex_id, CAST(vec_id % 5 AS INT) AS seed, CAST(vec_id * 7 % 89 - vec_id * 13 % 101 AS DOUBLE) AS d_total,
      CAST(vec_id * 3 % 29 - vec_id * 5 % 31 AS DOUBLE) AS d_rep FROM embeddings""",
)
def _(spark, sf):
    return R.relax_delta(seeds(spark, sf), ["complex_id"], "seed", "xyz").select("complex_id", "seed", "d_total", "d_rep")


@query(
    "ifp_counts",
    """SELECT user_id AS pose, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'error') AS error,
      count(*) FILTER (event_type IN ('click', 'view', 'error')) AS total FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = D.table(spark, sf, "events").withColumnRenamed("user_id", "pose")
    return R.interaction_counts(e, "pose", "event_type", ["click", "view", "error"])


@query(
    "norm_minmax",
    P + """SELECT pose_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score_norm,
      round((energy - min(energy) OVER w) / (max(energy) OVER w - min(energy) OVER w), 6) AS energy_norm FROM poses WINDOW w AS (PARTITION BY config_id)""",
)
def _(spark, sf):
    x = R.minmax(D.poses(spark, sf), BY, {"score_norm": "score", "energy_norm": "energy"})
    return D.rounded(x.select("pose_id", "score_norm", "energy_norm"))


ROBUST = """q AS (SELECT config_id, quantile_cont(score, 0.05) AS s1, quantile_cont(score, 0.95) AS s2, quantile_cont(com_distance, 0.05) AS d1, quantile_cont(com_distance, 0.95) AS d2,
    min(n_int) AS i1, max(n_int) AS i2 FROM poses GROUP BY 1),
  n AS (SELECT p.*, (least(greatest(score, s1), s2) - s1) / (s2 - s1) AS score_norm, (least(greatest(com_distance, d1), d2) - d1) / (d2 - d1) AS distance_norm,
    1 - (n_int - i1) / (i2 - i1) AS interactions_norm FROM (SELECT * FROM poses) p JOIN q ON p.config_id = q.config_id)"""


@query(
    "norm_robust",
    P + ", " + ROBUST + "SELECT pose_id, round(CASE WHEN score IS NOT NULL THEN score_norm END, 6) AS score_norm, round(distance_norm, 6) AS distance_norm FROM n",
)
def _(spark, sf):
    x = R.robust_minmax(D.poses(spark, sf), BY, {"score_norm": "score", "distance_norm": "com_distance"})
    return D.rounded(x.select("pose_id", "score_norm", "distance_norm"))


@query(
    "rank_composite",
    P + ", " + ROBUST
    + """SELECT config_id, pose_id, rank, round(total, 9) AS composite_score FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY round(total, 9) NULLS LAST, pose_id) AS rank
      FROM (SELECT *, CASE WHEN score IS NOT NULL THEN 0.5::DOUBLE * score_norm + 0.2::DOUBLE * distance_norm + 0.3::DOUBLE * interactions_norm END AS total FROM n)) WHERE rank <= 10""",
)
def _(spark, sf):
    x = R.composite_rank(D.poses(spark, sf), BY, "pose_id", "score", "com_distance", "n_int", 10)
    return x.select("config_id", "pose_id", "rank", "composite_score")


@query(
    "filter_qc_final",
    P + """, f AS (SELECT * FROM poses WHERE drift <= 2 AND hbonds >= 2 AND contacts >= 5),
      t AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.config_id ORDER BY energy, pose_id) AS rn FROM f
        JOIN (SELECT config_id, quantile_cont(energy, 0.25) AS cut FROM f GROUP BY 1) q ON q.config_id = f.config_id WHERE energy <= cut) WHERE rn <= 10),
      m AS (SELECT *, (energy - min(energy) OVER w) / (max(energy) OVER w - min(energy) OVER w + 1e-6) AS e, (drift - min(drift) OVER w) / (max(drift) OVER w - min(drift) OVER w + 1e-6) AS d,
        1 - (hbonds - min(hbonds) OVER w) / (max(hbonds) OVER w - min(hbonds) OVER w + 1e-6) AS h, 1 - (contacts - min(contacts) OVER w) / (max(contacts) OVER w - min(contacts) OVER w + 1e-6) AS k
        FROM t WINDOW w AS (PARTITION BY config_id)),
      s AS (SELECT *, round(0.4::DOUBLE * e + 0.2::DOUBLE * d + 0.2::DOUBLE * h + 0.2::DOUBLE * k, 9) AS fs, round(0.6::DOUBLE * e + 0.4::DOUBLE * d, 9) AS ss FROM m)
    SELECT config_id, pose_id, round(fs, 6) AS final_score, round(ss, 6) AS short_score, row_number() OVER (PARTITION BY config_id ORDER BY fs, pose_id) AS rank FROM s""",
)
def _(spark, sf):
    x = R.final_quality(D.poses(spark, sf), BY, "pose_id")
    return D.rounded(x.select("config_id", "pose_id", "final_score", "short_score", "rank"))


DECOYS = """q AS (SELECT config_id, quantile_cont(energy, 0.25) e1, quantile_cont(energy, 0.75) e3, quantile_cont(interface, 0.25) i1, quantile_cont(interface, 0.75) i3 FROM poses GROUP BY 1),
  f AS (SELECT p.*, energy <= e3 + 1.5 * (e3 - e1) AS oke, coalesce(interface <= i3 + 2.0 * (i3 - i1), FALSE) AS oki, ca_rmsd BETWEEN 0.3 AND 2.0 AND all_atom_rmsd <= 3.5 AS okr
    FROM (SELECT * FROM poses) p JOIN q ON p.config_id = q.config_id),
  l AS (SELECT *, CASE WHEN oke AND oki AND okr THEN 0 WHEN oke AND oki THEN 1 WHEN oke THEN 2 ELSE 3 END AS lv FROM f),
  n AS (SELECT config_id AS cid, count(*) FILTER (lv <= 0) n0, count(*) FILTER (lv <= 1) n1, count(*) FILTER (lv <= 2) n2 FROM l GROUP BY 1),
  g AS (SELECT l.*, CASE WHEN n0 >= 260 THEN 0 WHEN n1 >= 260 THEN 1 WHEN n2 >= 260 THEN 2 ELSE 3 END AS level FROM l JOIN n ON l.config_id = n.cid),
  k AS (SELECT * FROM g WHERE lv <= level), m AS (SELECT config_id AS cid, median(interface) AS med FROM k GROUP BY 1)"""


@query(
    "filter_decoys_iqr",
    P + ", " + DECOYS
    + """SELECT config_id, pose_id, level, rank, round(s, 6) AS score_eff FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY s NULLS LAST, pose_id) AS rank FROM
      (SELECT k.*, CASE WHEN interface IS NOT NULL THEN energy + 0.1::DOUBLE * greatest(interface - med, 0) END AS s FROM k JOIN m ON k.config_id = m.cid)) WHERE rank <= 260""",
)
def _(spark, sf):
    x = R.filter_decoys(D.poses(spark, sf), BY, "pose_id", 260)
    return D.rounded(x.select("config_id", "pose_id", "level", "rank", "score_eff"))


@query(
    "filter_decoys_beta",
    P + """, d AS (SELECT config_id, file, arg_min(pose_id, pose_id) AS pose_id, arg_min(energy, pose_id) AS totalscore, arg_min(com_distance, pose_id) AS fa_rep, min(pose_id) AS p0 FROM poses GROUP BY 1, 2),
      e AS (SELECT d.*, p.interface AS ddg FROM d JOIN poses p ON p.pose_id = d.p0),
      a AS (SELECT e.* FROM e JOIN (SELECT config_id, quantile_cont(totalscore, 0.25) q1, quantile_cont(totalscore, 0.75) q3 FROM e GROUP BY 1) q ON q.config_id = e.config_id WHERE totalscore <= q3 + 1.5 * (q3 - q1)),
      b AS (SELECT a.* FROM a JOIN (SELECT config_id, quantile_cont(fa_rep, 0.25) q1, quantile_cont(fa_rep, 0.75) q3 FROM a GROUP BY 1) q ON q.config_id = a.config_id WHERE fa_rep <= q3 + 1.5 * (q3 - q1))
    SELECT config_id, pose_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY totalscore, ddg NULLS LAST, pose_id) AS rank FROM b) WHERE rank <= 15""",
)
def _(spark, sf):
    x = D.poses(spark, sf).withColumnsRenamed({"energy": "totalscore", "com_distance": "fa_rep", "interface": "ddg"})
    return R.filter_decoys_second(x, BY, "file", "pose_id", 15).select("config_id", "pose_id", "rank")


ENS = """o AS (SELECT 'C' || s_suppkey AS config_id, CASE WHEN s_suppkey % 3 = 0 THEN 2.5 END AS rt, CASE WHEN s_suppkey % 4 = 0 THEN 0.3 END AS pt FROM supplier),
  c AS (SELECT p.*, CASE WHEN config_id NOT LIKE '%3' THEN pocket_overlap WHEN pose_id % 2 = 0 THEN drift / 4 END AS conf FROM (SELECT * FROM poses) p),
  k AS (SELECT c.config_id, pose_id, ca_rmsd FROM c LEFT JOIN o ON o.config_id = c.config_id WHERE ca_rmsd <= coalesce(rt, 1.5) AND conf >= coalesce(pt, 0.5)),
  r AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY ca_rmsd, pose_id) AS rn FROM k)"""


def ensemble(spark, sf):
    s = D.table(spark, sf, "supplier").select(
        F.concat(F.lit("C"), "s_suppkey").alias("config_id"),
        F.when(c("s_suppkey") % 3 == 0, 2.5).alias("rmsd_threshold"), F.when(c("s_suppkey") % 4 == 0, 0.3).alias("plddt_threshold"),
    )
    p = D.poses(spark, sf).select(
        "config_id", "pose_id", c("ca_rmsd").alias("rmsd"), F.when(~c("config_id").endswith("3"), c("pocket_overlap")).alias("plddt"),
        F.when(c("pose_id") % 2 == 0, c("drift") / 4).alias("plddt_pde"),
    )
    return R.filter_ensemble(p, s, "config_id", "pose_id", 1.5, 0.5, 5)


@query("filter_ensemble", P + ", " + ENS + "SELECT config_id, pose_id, CASE WHEN rn <= 5 THEN rn END AS rank FROM r")
def _(spark, sf):
    return ensemble(spark, sf).select("config_id", "pose_id", "rank")


@query(
    "filter_ensemble_summary",
    P + ", " + ENS + """SELECT config_id, count(*) AS filtered_count, count(*) FILTER (rn <= 5) AS ranked_count,
      string_agg(CAST(pose_id + 1 AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 5) AS ranked_model_indices FROM r GROUP BY 1""",
)
def _(spark, sf):
    return R.ensemble_summary(ensemble(spark, sf), "config_id", "pose_id")


@query(
    "select_ranked_models",
    """WITH l AS (SELECT o_orderkey AS label, [o_custkey % 12, o_orderkey % 120] AS i FROM orders),
      e AS (SELECT label, unnest([0, 1]) AS pos, unnest(i) AS k FROM l), f AS (SELECT DISTINCT l_orderkey || '_recovered_' || lpad(CAST(l_partkey % 13 AS VARCHAR), 2, '0') || '.pdb' AS path FROM lineitem)
    SELECT label, CAST(pos AS BIGINT) AS pos, k + 1 AS model, label || '_recovered_' || substr(CASE WHEN k + 1 < 10 THEN '0' ELSE '' END || (k + 1), 1, 2) || '.pdb' AS path,
      label || '_recovered_' || substr(CASE WHEN k + 1 < 10 THEN '0' ELSE '' END || (k + 1), 1, 2) || '.pdb' IN (SELECT path FROM f) AS found FROM e WHERE k < 99""",
)
def _(spark, sf):
    k = F.when(c("o_orderkey") % 120 < 99, (c("o_orderkey") % 120).cast("string"))
    labels = D.table(spark, sf, "orders").select(c("o_orderkey").alias("label"), F.concat(F.lit("["), F.concat_ws(", ", c("o_custkey") % 12, k), F.lit("]")).alias("idx"))
    files = D.table(spark, sf, "lineitem").select(
        F.concat("l_orderkey", F.lit("_recovered_"), F.lpad((c("l_partkey") % 13).cast("string"), 2, "0"), F.lit(".pdb")).alias("path")
    )
    return R.select_models(labels, "label", "idx", files, "%d_recovered_%s.pdb", 1)


@query(
    "assign_ids",
    "SELECT o_orderkey, 'P' || (o_custkey % 30) || '_tar_' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) AS VARCHAR), 6, '0') AS complex_id FROM orders",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("P"), c("o_custkey") % 30).alias("protein"))
    return R.assign_ids(o, "protein", "tar", "o_orderkey").select("o_orderkey", "complex_id")
