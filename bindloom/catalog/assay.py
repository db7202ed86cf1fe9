"""Assay curation, group filters, aggregates and reports on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.functions import affinity as A, text as X
from bindloom.operators import assay as O
from bindloom.plans import skew as S
from bindloom.session import written

c = F.col
KEYS = ["protein", "ligand"]
CHAIN = D.with_sql(*D.ASSAY_CHAIN)
CHAIN_CURATED = D.with_sql(*D.ASSAY_CHAIN, D.CURATED)
PAIR_OUT = "protein, ligand, target_type, round(representative_nM, 4) AS representative_nM"


def pair_out(df):
    return df.select("protein", "ligand", "target_type", F.round("representative_nM", 4).alias("representative_nM"))


@query("parse_multi_number", CHAIN.split(",\npairs AS")[0] + " SELECT row_id, nM FROM meas")
def _(spark, sf):
    return D.measurements(spark, sf).select("row_id", "nM")


@query(
    "agg_pairs",
    D.with_sql(D.ASSAY, D.MEAS, D.PAIRS)
    + """SELECT p.protein, p.ligand, n_measurements, round(min_nM, 3) AS min_nM, round(max_nM, 3) AS max_nM,
      round(std_px, 6) AS std_px, round(median_px, 6) AS median_px, l_returnflag, flags, parts, CAST(0 AS BIGINT) AS part
    FROM pairs p JOIN (SELECT protein, ligand, arg_min(l_returnflag, row_id) AS l_returnflag,
        string_agg(DISTINCT l_returnflag || l_linestatus, ';' ORDER BY l_returnflag || l_linestatus) AS flags,
        string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ';' ORDER BY CAST(l_partkey AS VARCHAR)) AS parts
      FROM meas GROUP BY protein, ligand) j ON p.protein = j.protein AND p.ligand = j.ligand""",
)
def _(spark, sf):
    m = D.measurements(spark, sf).withColumn("fl", F.concat("l_returnflag", "l_linestatus"))
    out = O.aggregate_pairs(m, KEYS, "nM", "row_id", ["l_returnflag"], {"flags": "fl", "parts": "l_partkey"})
    return out.select(
        *KEYS, "n_measurements", F.round("min_nM", 3).alias("min_nM"), F.round("max_nM", 3).alias("max_nM"),
        F.round("std_px", 6).alias("std_px"), F.round("median_px", 6).alias("median_px"), "l_returnflag", "flags", "parts", "part",
    )


@query(
    "agg_validate",
    D.with_sql(D.ASSAY, D.MEAS, D.PAIRS, D.VALID)
    + "SELECT protein, ligand, reason, round(representative_nM, 4) AS representative_nM FROM valid",
)
def _(spark, sf):
    pairs = O.aggregate_pairs(D.measurements(spark, sf), KEYS, "nM", "row_id")
    return O.validate_replicates(pairs).select(*KEYS, "reason", F.round("representative_nM", 4).alias("representative_nM"))


@query("cls_affinity", CHAIN + f"SELECT {PAIR_OUT} FROM labelled")
def _(spark, sf):
    return pair_out(D.labelled(spark, sf))


@query("flt_both_types", CHAIN_CURATED + f"SELECT {PAIR_OUT} FROM curated")
def _(spark, sf):
    return pair_out(O.keep_both_types(D.labelled(spark, sf), "protein"))


@query(
    "flt_min_counts",
    CHAIN
    + f"""SELECT {PAIR_OUT} FROM labelled WHERE protein IN (SELECT protein FROM labelled GROUP BY protein
      HAVING count(*) FILTER (target_type = 'target') >= 10 AND count(*) FILTER (target_type = 'off_target') >= 8)""",
)
def _(spark, sf):
    x = D.labelled(spark, sf)
    few = (F.count_if(c("target_type") == "target") >= 10) & (F.count_if(c("target_type") == "off_target") >= 8)
    return pair_out(O.keep_groups(x, ["protein"], few))


# labels per (protein, ligand, order status) can contradict each other
CONFLICT = """one AS (SELECT protein, ligand, l_returnflag, CASE WHEN med <= 31.6 THEN 'target' WHEN med >= 3160 THEN 'off_target' END AS target_type
  FROM (SELECT protein, ligand, l_returnflag, min(nM) * 4 AS med FROM meas GROUP BY ALL))"""


@query(
    "flt_conflicts",
    D.with_sql(D.ASSAY, D.MEAS, CONFLICT)
    + """SELECT * FROM one WHERE target_type IS NOT NULL AND (protein, ligand) NOT IN (SELECT (protein, ligand) FROM one
      WHERE target_type IS NOT NULL GROUP BY protein, ligand HAVING count(DISTINCT target_type) > 1)""",
)
def _(spark, sf):
    one = D.measurements(spark, sf).groupBy(*KEYS, "l_returnflag").agg((F.min("nM") * 4).alias("med"))
    x = O.label_pairs(one, "med").drop("med")
    return O.drop_conflicts(x, KEYS)


@query(
    "flt_any_structure",
    CHAIN
    + f"""SELECT {PAIR_OUT} FROM labelled WHERE protein IN (SELECT protein FROM labelled
      WHERE target_type = 'target' AND ligand IN ('L3', 'L5'))""",
)
def _(spark, sf):
    x = D.labelled(spark, sf).withColumn("pdb", F.when(c("ligand").isin("L3", "L5"), c("ligand")).otherwise(" "))
    return pair_out(O.keep_with_structure(x, "protein", "pdb", targets_only=True))


@query(
    "flt_has_target",
    CHAIN + f"SELECT {PAIR_OUT} FROM labelled WHERE protein IN (SELECT protein FROM labelled WHERE target_type = 'target')",
)
def _(spark, sf):
    return pair_out(O.keep_with_target(D.labelled(spark, sf), "protein"))


@query(
    "flt_same_mutation",
    CHAIN
    + f"""SELECT {PAIR_OUT} FROM labelled l WHERE EXISTS (SELECT 1 FROM labelled t WHERE t.protein = l.protein
      AND t.target_type = 'target' AND CAST(substr(t.ligand, 2) AS INT) % 6 = CAST(substr(l.ligand, 2) AS INT) % 6)""",
)
def _(spark, sf):
    m = F.concat(F.lit("A"), (F.substring("ligand", 2, 9).cast("int") % 6).cast("string"), F.lit("G"))
    # the same mutations in different order must match
    muts = F.when(c("target_type") == "target", F.array(F.lit("C1T"), m)).otherwise(F.array(m, F.lit("C1T")))
    return pair_out(O.keep_same_mutation(D.labelled(spark, sf).withColumn("muts", muts), "protein", "muts"))


@query(
    "flt_ligand_overlap",
    D.with_sql(D.ASSAY)
    + """, b AS (SELECT protein, l_partkey FROM assay GROUP BY ALL HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A'))
    SELECT protein, l_partkey, row_id FROM assay JOIN b USING (protein, l_partkey)
    WHERE protein IN (SELECT protein FROM b GROUP BY 1 HAVING count(*) >= 2)""",
)
def _(spark, sf):
    x = D.assay(spark, sf).withColumn("is_reference", c("l_returnflag") == "A")
    return O.keep_ligand_overlap(x, "protein", "l_partkey", "is_reference").select("protein", "l_partkey", "row_id")


@query(
    "flt_multi_variant",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) >= 2)",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    return O.keep_multi_variant(o, "o_custkey", "o_orderstatus").select("o_orderkey", "o_custkey")


VARIANT_ROWS = """v AS (SELECT o_orderkey, o_custkey % 200 AS protein, CAST(o_totalprice AS BIGINT) % 50 AS ligand,
  o_orderstatus = 'F' AS is_reference, o_orderkey % 5 AS n_subs, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS n_ins,
  CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS n_del, CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS pdb, o_totalprice AS nM FROM orders)"""


def variant_rows(spark, sf):
    o = D.table(spark, sf, "orders")
    k = c("o_orderkey")
    return o.select(
        k, (c("o_custkey") % 200).alias("protein"), (F.round("o_totalprice").cast("long") % 50).alias("ligand"),
        (c("o_orderstatus") == "F").alias("is_reference"), (k % 5).alias("n_subs"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("n_ins"), F.when(k % 13 == 0, 1).otherwise(0).alias("n_del"),
        F.when(k % 3 != 0, "x").alias("pdb"), c("o_totalprice").alias("nM"),
    )


VARIANT_ROWS = VARIANT_ROWS.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)")


@query(
    "flt_subs_only",
    "WITH " + VARIANT_ROWS
    + """, n AS (SELECT * FROM v WHERE NOT is_reference AND n_ins = 0 AND n_del = 0 AND n_subs > 0 AND pdb IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM v r WHERE r.is_reference AND r.protein = v.protein AND r.ligand = v.ligand))
    SELECT o_orderkey, protein, is_reference FROM n UNION ALL
    SELECT o_orderkey, protein, is_reference FROM v WHERE is_reference AND protein IN (SELECT protein FROM n)""",
)
def _(spark, sf):
    return O.keep_substitutions(variant_rows(spark, sf), "protein", "ligand", "pdb", "nM").select(
        "o_orderkey", "protein", "is_reference"
    )


@query(
    "flt_shared_ligand",
    "WITH " + VARIANT_ROWS
    + """, n AS (SELECT *, n_subs * 10 AS s FROM v WHERE n_subs * 10 < 30)
    SELECT o_orderkey, protein, ligand FROM n WHERE (protein, ligand) IN (SELECT (protein, ligand) FROM n GROUP BY protein, ligand
      HAVING count(DISTINCT s) > 1 AND bool_or(s > 0))""",
)
def _(spark, sf):
    x = variant_rows(spark, sf).withColumn("s", c("n_subs") * 10)
    return O.keep_shared_ligands(x, "protein", "ligand", "s", "s").select("o_orderkey", "protein", "ligand")


@query(
    "chk_cardinality",
    D.with_sql(D.MODELS)
    + """SELECT entry_id, count(*) AS n_models, count(DISTINCT flag) = 1 AS one_flag, count(DISTINCT all_passed) = 1 AS one_all_passed,
      count(*) = 3 AND count(DISTINCT flag) = 1 AND count(DISTINCT all_passed) = 1 AS ok FROM models GROUP BY 1""",
)
def _(spark, sf):
    return O.check_cardinality(D.models(spark, sf), "entry_id", ["flag", "all_passed"], 3)


@query(
    "flt_confidence",
    D.with_sql(D.MODELS)
    + """SELECT entry_id, idx FROM models WHERE coalesce(confidence_score, 0) >= 0.55 AND coalesce(number_clashes, 0) >= 1""",
)
def _(spark, sf):
    return O.keep_confident(D.models(spark, sf), {"confidence_score": 0.55, "number_clashes": 1.0}).select("entry_id", "idx")


BEST = """ranks AS (SELECT *, row_number() OVER (PARTITION BY protein, target_type ORDER BY
  CASE WHEN target_type = 'target' THEN round(representative_nM, 6) ELSE -round(representative_nM, 6) END, ligand) AS rn FROM curated)"""


@query(
    "top_best_pair",
    D.with_sql(*D.ASSAY_CHAIN, D.CURATED, BEST) + f"SELECT {PAIR_OUT} FROM ranks WHERE rn = 1",
)
def _(spark, sf):
    cur = O.curate(D.assay(spark, sf), "protein", "ligand", "cell", "row_id")
    return pair_out(O.best_pair(cur.withColumn("representative_nM", F.round("representative_nM", 6)), "protein", "ligand", "representative_nM"))


@query(
    "top_best_model",
    D.with_sql(D.MODELS)
    + """, t AS (SELECT *, CASE WHEN ok AND number_clashes = 0 THEN 2 WHEN ok THEN 1 ELSE 0 END AS tier FROM
        (SELECT *, all_passed AND passes_valence_checks AND passes_kekulization AS ok FROM models)),
      b AS (SELECT *, max(tier) OVER (PARTITION BY entry_id) AS best FROM t),
      m AS (SELECT *, max(confidence_score) OVER (PARTITION BY entry_id) AS top FROM b WHERE tier = best)
    SELECT entry_id, idx, tier FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY
        CASE WHEN best > 0 AND NOT near THEN 1 ELSE 0 END, CASE WHEN best > 0 AND near THEN vina_score_min END NULLS LAST,
        confidence_score DESC NULLS LAST, idx) AS rn
      FROM (SELECT *, coalesce(confidence_score >= top - 0.02, top IS NULL) AS near FROM m)) WHERE rn = 1""",
)
def _(spark, sf):
    ok = c("all_passed") & c("passes_valence_checks") & c("passes_kekulization")
    tier = F.when(ok & (c("number_clashes") == 0), 2).when(ok, 1).otherwise(0)
    return O.best_model(D.models(spark, sf), "entry_id", "idx").select("entry_id", "idx", tier.alias("tier"))


@query(
    "snk_audit",
    CHAIN_CURATED
    + """, s AS (SELECT 0 AS step, 'measurements' AS name, count(*) AS n_after FROM meas
      UNION ALL SELECT 1, 'pairs', count(*) FROM pairs
      UNION ALL SELECT 2, 'valid', count(*) FROM valid WHERE reason IN ('single_value', 'valid_std')
      UNION ALL SELECT 3, 'labelled', count(*) FROM labelled UNION ALL SELECT 4, 'both_types', count(*) FROM curated)
    SELECT *, lag(n_after) OVER (ORDER BY step) AS n_before, lag(n_after) OVER (ORDER BY step) - n_after AS dropped FROM s""",
)
def _(spark, sf):
    m = D.measurements(spark, sf)
    # read by four steps
    pairs = written(O.aggregate_pairs(m, KEYS, "nM", "row_id"), "pairs")
    valid = O.validate_replicates(pairs).filter("is_valid")
    lab = O.label_pairs(valid)
    return O.audit(
        {"measurements": m, "pairs": pairs, "valid": valid, "labelled": lab, "both_types": O.keep_both_types(lab, "protein")}
    )


# ---- scalar functions

@query(
    "px_convert",
    D.with_sql(D.ASSAY, D.MEAS)
    + "SELECT row_id, nM, round(px, 6) AS px, round(pow(10.0::DOUBLE, -px) / 1e-9::DOUBLE, 4) AS back FROM meas",
)
def _(spark, sf):
    px = A.nm_to_px(c("nM"))
    return D.measurements(spark, sf).select(
        "row_id", "nM", F.round(px, 6).alias("px"), F.round(A.px_to_nm(px), 4).alias("back")
    )


@query(
    "bin_tier",
    CHAIN
    + """SELECT protein, ligand, CASE WHEN target_type = 'target' THEN CASE WHEN median_px >= 8.5 THEN 'tight_binder' ELSE 'moderate_binder' END
      ELSE CASE WHEN median_px <= 4.5 THEN 'non_binder' ELSE 'weak_binder' END END AS tier FROM labelled""",
)
def _(spark, sf):
    from bindloom.operators.sampling import affinity_tier

    return D.labelled(spark, sf).select(*KEYS, affinity_tier(c("target_type"), c("median_px")).alias("tier"))


@query(
    "bin_size",
    """SELECT doc_id, CASE WHEN n_chars < 150 THEN 'small' WHEN n_chars < 300 THEN 'medium' WHEN n_chars < 500 THEN 'large' ELSE 'very_large' END AS size_category,
      CASE WHEN n_chars / 10.0 < 250 THEN 'small' WHEN n_chars / 10.0 < 400 THEN 'medium' WHEN n_chars / 10.0 < 600 THEN 'large' ELSE 'very_large' END AS ligand_size FROM documents""",
)
def _(spark, sf):
    from bindloom.operators.sampling import ligand_size, protein_size

    n = c("n_chars")
    return D.table(spark, sf, "documents").select(
        "doc_id", protein_size(n).alias("size_category"), ligand_size(n / 10.0).alias("ligand_size")
    )


@query(
    "cluster_id",
    """SELECT p_partkey, concat_ws('_', p_type, p_brand, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END) AS cluster_id FROM part""",
)
def _(spark, sf):
    from bindloom.operators.sampling import cluster_id

    p = D.table(spark, sf, "part").withColumn("b", A.bins(c("p_size"), [10, 30], ["small", "medium", "large"]))
    return p.select("p_partkey", cluster_id("p_type", "p_brand", "b").alias("cluster_id"))


# ---- aggregates

@query(
    "agg_join_limited",
    """SELECT o_custkey, string_agg(v, '; ' ORDER BY f) AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY f) AS rn
      FROM (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1""",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "v")
    return O.first_seen_joined(o, ["o_custkey"], "v", "o_orderkey", 3)


@query(
    "agg_mode",
    """SELECT o_custkey, arg_max(v, (n, -f)) AS v, max(n) AS n FROM (SELECT o_custkey, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS f
      FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "v")
    return O.mode_value(o, ["o_custkey"], "v", "o_orderkey")


@query(
    "agg_stats_per_protein",
    D.with_sql(D.ASSAY)
    + """SELECT protein, count(DISTINCT l_partkey) AS n_seq, count(DISTINCT l_partkey) FILTER (l_returnflag <> 'A') AS n_seq_mut,
      count(DISTINCT ligand) AS n_lig, count(DISTINCT ligand) FILTER (l_returnflag = 'A') AS n_lig_ref,
      count(DISTINCT ligand) FILTER (l_returnflag <> 'A') AS n_lig_mut FROM assay GROUP BY 1""",
)
def _(spark, sf):
    x = D.assay(spark, sf).withColumn("is_reference", c("l_returnflag") == "A")
    return O.stats_per_protein(x, "protein", "l_partkey", "ligand", "is_reference")


@query(
    "agg_entropy",
    "SELECT round(sum(-p * log2(p + 1e-10)), 6) AS entropy, count(*) AS n_categories FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY source)",
)
def _(spark, sf):
    return D.rounded(O.entropy(D.table(spark, sf, "documents"), "source"))


@query(
    "agg_share_compare",
    """SELECT lang, n_before, round(n_before / sum(n_before) OVER (), 6) AS share_before, n_after, round(n_after / sum(n_after) OVER (), 6) AS share_after
      FROM (SELECT lang, count(*) AS n_before FROM documents GROUP BY 1) FULL JOIN
      (SELECT lang, count(*) AS n_after FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1) USING (lang)""",
)
def _(spark, sf):
    d = D.table(spark, sf, "documents")
    good = d.join(D.table(spark, sf, "labels").filter("quality = 1"), "doc_id")
    return D.rounded(O.share_comparison(d, good, "lang"))


@query(
    "agg_histogram",
    CHAIN
    + """SELECT target_type, CAST(least(len(list_filter([4.0, 5.0, 5.5, 6.5, 7.5, 8.5, 11.0], lambda e: e <= median_px)) - 1, 5) AS BIGINT) AS bin, count(*) AS n
      FROM labelled WHERE median_px BETWEEN 4.0 AND 11.0 GROUP BY 1, 2""",
)
def _(spark, sf):
    return O.histogram(D.labelled(spark, sf), c("median_px"), [4.0, 5.0, 5.5, 6.5, 7.5, 8.5, 11.0], "target_type")


@query(
    "agg_minmaxmed",
    """SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
      round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1""",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    q = S.exact_quantiles(o, ["o_custkey"], "o_totalprice", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    lim = o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return D.rounded(lim.join(q, "o_custkey"), 4)
