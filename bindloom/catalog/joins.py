"""Joins with structure metadata, files, stages and other sources on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.operators import structures as J
from bindloom.plans import skew as S

c = F.col


def star_tables(spark, sf):
    t = lambda n: D.table(spark, sf, n)
    cust, nation, part = t("customer"), t("nation"), t("part")
    return {
        "activities": t("lineitem").select(
            c("l_orderkey").alias("assay_id"), c("l_partkey").alias("molregno"), c("l_suppkey").alias("activity_no"),
            c("l_linenumber").alias("line"), F.when(c("l_linenumber") % 3 != 0, c("l_suppkey")).alias("doc_id"),
            F.when(c("l_tax") > 0, c("l_quantity")).alias("standard_value"),
            F.when(c("l_returnflag") == "R", "uM").otherwise("nM").alias("standard_units"),
            F.when(c("l_linestatus") == "O", "Kd").otherwise("IC50").alias("standard_type"),
        ),
        "assays": t("orders").select(
            c("o_orderkey").alias("assay_id"), c("o_custkey").alias("tid"), (c("o_orderkey") % 10).alias("confidence_score")
        ),
        "target_dictionary": cust.select(
            c("c_custkey").alias("tid"), c("c_name").alias("target_name"),
            F.when(c("c_mktsegment") == "MACHINERY", "CELL-LINE").otherwise("SINGLE PROTEIN").alias("target_type"),
        ),
        "target_components": cust.select(
            c("c_custkey").alias("tid"), c("c_nationkey").alias("component_id"), (c("c_custkey") % 4 % 2).alias("homologue")
        ),
        "component_sequences": nation.select(
            c("n_nationkey").alias("component_id"), c("n_name").alias("sequence"),
            F.when(c("n_regionkey") == 4, "NUCLEIC").otherwise("PROTEIN").alias("component_type"),
        ),
        "molecule_dictionary": part.select(c("p_partkey").alias("molregno"), c("p_name").alias("pref_name")),
        "compound_structures": part.select(
            c("p_partkey").alias("molregno"), F.when(c("p_size") % 5 != 0, c("p_brand")).alias("standard_inchi_key")
        ),
        "docs": t("supplier").select(c("s_suppkey").alias("doc_id"), c("s_name").alias("doi")),
    }


@query(
    "join_activity_star",
    """SELECT DISTINCT l_orderkey AS assay_id, l_partkey AS molregno, l_suppkey AS activity_no, l_linenumber AS line, l_quantity AS standard_value,
      c_name AS target_name, n_name AS sequence, p_name AS pref_name, p_brand AS standard_inchi_key, s_name AS doi
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_linenumber % 3 <> 0 AND l_suppkey = s_suppkey
    WHERE l_tax > 0 AND l_returnflag <> 'R' AND l_linestatus = 'O' AND o_orderkey % 10 >= 6 AND c_mktsegment <> 'MACHINERY'
      AND c_custkey % 4 % 2 = 0 AND n_regionkey <> 4 AND p_size % 5 <> 0""",
)
def _(spark, sf):
    out = J.activity_star(star_tables(spark, sf), "Kd", 6)
    return out.select(
        "assay_id", "molregno", "activity_no", "line", "standard_value", "target_name", "sequence", "pref_name", "standard_inchi_key", "doi"
    )


STAGE_SQL = """st AS (SELECT *, CASE WHEN l_suppkey * 7 % 5 <> 0 AND lig % 6 <> 0 THEN 'b' END AS blurred, CASE WHEN lig % 7 <> 0 THEN 'H' END AS het,
  CASE WHEN lig % 4 <> 0 THEN 'p' || lig END AS path, lig FROM (SELECT *, CAST(substr(ligand, 2) AS INT) AS lig, CAST(substr(protein, 2) AS INT) AS l_suppkey FROM labelled))"""


@query(
    "join_target_offtarget",
    D.with_sql(*D.ASSAY_CHAIN, STAGE_SQL)
    + """SELECT t.protein, count(DISTINCT t.ligand) AS n_targets, count(DISTINCT o.ligand) AS n_offtargets, count(*) AS n_configs,
      count(*) FILTER (t.blurred IS NOT NULL AND t.het IS NOT NULL AND o.path IS NOT NULL) AS n_success,
      count(*) FILTER (NOT (t.blurred IS NOT NULL AND t.het IS NOT NULL AND o.path IS NOT NULL)) AS n_failed
    FROM st t JOIN st o ON t.protein = o.protein AND t.target_type = 'target' AND o.target_type = 'off_target' GROUP BY 1""",
)
def _(spark, sf):
    lig, sup = F.substring("ligand", 2, 9).cast("int"), F.substring("protein", 2, 9).cast("int")
    x = D.labelled(spark, sf).select(
        "protein", "ligand", "target_type",
        F.when((sup * 7 % 5 != 0) & (lig % 6 != 0), "b").alias("blurred"), F.when(lig % 7 != 0, "H").alias("het"),
        F.when(lig % 4 != 0, F.concat(F.lit("p"), lig.cast("string"))).alias("path"),
    )
    return J.config_plan(x, ["protein"], "blurred", "het", "path")


@query(
    "join_offtarget_lookup",
    """WITH t AS (SELECT o_custkey % 130 AS key, o_orderkey AS id, [CAST(o_orderkey % 17 AS VARCHAR), CAST(o_orderkey % 13 AS VARCHAR), CAST(o_orderkey % 17 AS VARCHAR)] AS ids FROM orders),
      l AS (SELECT l_suppkey % 100 AS key, CAST(l_partkey % 25 AS VARCHAR) AS het, arg_min('f' || l_orderkey, l_orderkey * 100000 + l_partkey) AS off_path FROM lineitem
        WHERE l_returnflag = 'A' GROUP BY 1, 2),
      e AS (SELECT key, id, h.het AS het, h.pos AS pos FROM (SELECT key, id, unnest(list_transform(CASE WHEN ids[1] = ids[2] THEN ids[1:1] ELSE ids[1:2] END, lambda x, i: {'het': x, 'pos': i - 1})) AS h FROM t)),
      f AS (SELECT e.*, off_path, count(off_path) OVER (PARTITION BY e.key, id) AS n FROM e LEFT JOIN l ON l.key = e.key AND l.het = e.het)
    SELECT key, id, CAST(pos AS BIGINT) AS pos, het, off_path, CAST(NULL AS VARCHAR) AS reason FROM f WHERE off_path IS NOT NULL
    UNION ALL SELECT DISTINCT key, id, CAST(NULL AS BIGINT), NULL, NULL, 'no matching off-target' FROM f WHERE n = 0""",
)
def _(spark, sf):
    k = c("o_orderkey")
    ids = F.concat((k % 17).cast("string"), F.lit(" ; "), (k % 13).cast("string"), F.lit(";;"), (k % 17).cast("string"))
    t = D.table(spark, sf, "orders").select((c("o_custkey") % 130).alias("key"), k.alias("id"), ids.alias("ids"))
    l = D.table(spark, sf, "lineitem").select(
        (c("l_suppkey") % 100).alias("key"), (c("l_partkey") % 25).cast("string").alias("het"),
        F.when(c("l_returnflag") == "A", F.concat(F.lit("f"), "l_orderkey")).alias("path"),
        (c("l_orderkey") * 100000 + c("l_partkey")).alias("ord"),
    )
    return J.offtarget_lookup(t, l, "key", "id", "ids", "het", "path", "ord")


TWO = """a AS (SELECT 'P' || l_suppkey AS protein, 'L' || (l_partkey % 300) AS ligand, CASE WHEN l_linenumber = 1 THEN 'S' || l_partkey END AS pdb FROM lineitem WHERE l_returnflag <> 'R'),
  b AS (SELECT 'P' || (l_suppkey + 3) AS protein, 'L' || (l_partkey % 300) AS ligand FROM lineitem WHERE l_returnflag = 'R')"""


def two_sources(spark, sf):
    li = D.table(spark, sf, "lineitem")
    lig = F.concat(F.lit("L"), c("l_partkey") % 300).alias("ligand")
    # the proteins of the second source are shifted, so some occur on one side only
    first, second = (F.concat(F.lit("P"), c("l_suppkey") + shift).alias("protein") for shift in (0, 3))
    pdb = F.when(c("l_linenumber") == 1, F.concat(F.lit("S"), "l_partkey")).alias("pdb")
    return li.filter("l_returnflag <> 'R'").select(first, lig, pdb), li.filter("l_returnflag = 'R'").select(second, lig)


@query(
    "join_common_entities",
    "WITH " + TWO
    + """, x AS (SELECT protein, ligand, count(*) AS n_a, string_agg(DISTINCT pdb, ';' ORDER BY pdb) AS structure_ids FROM a GROUP BY 1, 2),
      y AS (SELECT protein, ligand, count(*) AS n_b FROM b GROUP BY 1, 2)
    SELECT x.protein, x.ligand, n_a, n_b, n_a * n_b AS n_matches, structure_ids IS NOT NULL AS has_structure, structure_ids, CAST(0 AS BIGINT) AS part
    FROM x JOIN y ON x.protein = y.protein AND x.ligand = y.ligand""",
)
def _(spark, sf):
    a, b = two_sources(spark, sf)
    return J.common_pairs(a, b, "protein", "ligand", "pdb").withColumn("part", c("part").cast("long"))


@query(
    "join_common_proteins",
    "WITH " + TWO
    + """SELECT coalesce(x.protein, y.protein) AS protein, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b,
      CASE WHEN n_a IS NULL THEN 'only_b' WHEN n_b IS NULL THEN 'only_a' ELSE 'common' END AS found_in
    FROM (SELECT protein, count(*) AS n_a FROM a GROUP BY 1) x FULL JOIN (SELECT protein, count(*) AS n_b FROM b GROUP BY 1) y ON x.protein = y.protein""",
)
def _(spark, sf):
    a, b = two_sources(spark, sf)
    return J.compare_sources(a, b, "protein")


@query(
    "path_lookup",
    """WITH f AS (SELECT DISTINCT '/d' || (l_linenumber % 2) || '/' || l_partkey AS path FROM lineitem WHERE l_discount > 0.08)
    SELECT p_partkey, CASE WHEN '/d0/' || p_partkey IN (SELECT path FROM f) THEN '/d0/' || p_partkey WHEN '/d1/' || p_partkey IN (SELECT path FROM f) THEN '/d1/' || p_partkey END AS path,
      '/d0/' || p_partkey IN (SELECT path FROM f) OR '/d1/' || p_partkey IN (SELECT path FROM f) AS found FROM part""",
)
def _(spark, sf):
    files = D.table(spark, sf, "lineitem").filter("l_discount > 0.08").select(
        F.concat(F.lit("/d"), c("l_linenumber") % 2, F.lit("/"), "l_partkey").alias("path")
    )
    cand = [F.concat(F.lit(f"/d{i}/"), "p_partkey") for i in (0, 1)]
    return J.resolve_paths(D.table(spark, sf, "part").select("p_partkey"), cand, files, "p_partkey")


# structures: parts; the ids of a pair come from the lines of an order
META_SQL = """meta AS (SELECT 'S' || p_partkey AS pdb_id, p_size % 9 AS mu, p_size % 6 = 0 AS mutated, CASE WHEN p_size % 8 = 0 THEN 0 WHEN p_size % 8 = 1 THEN NULL ELSE p_retailprice / 500 END AS resolution,
    p_brand AS mhet FROM part),
  ids AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS ord FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
  x AS (SELECT o_orderkey AS row_id, o_orderkey % 9 AS u, 'BRAND#' || (o_custkey % 4 + 1) AS het, ids.ord, meta.*, upper(meta.mhet) = 'BRAND#' || (o_custkey % 4 + 1) AS hit FROM orders LEFT JOIN ids ON l_orderkey = o_orderkey
    LEFT JOIN meta ON meta.pdb_id = 'S' || l_partkey),"""


def structure_tables(spark, sf):
    p = D.table(spark, sf, "part")
    z = c("p_size")
    pid = F.concat(F.lit("S"), "p_partkey")
    meta = p.select(
        pid.alias("pdb_id"), F.array((z % 9).cast("string"), F.lit("none")).alias("uniprot_ids"),
        F.when(z % 6 == 0, F.array(F.lit("A1G"))).when(z % 6 == 1, F.array().cast("array<string>")).alias("mutations"),
        F.when(z % 8 == 0, 0.0).when(z % 8 != 1, c("p_retailprice") / 500).alias("resolution"), c("p_name").alias("title"),
    )
    ligands = p.select(pid.alias("pdb_id"), c("p_brand").alias("het_id"), c("p_type").alias("inchikey"))
    ids = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: F.concat(F.lit("S"), x)), ";").alias("ids")
    )
    o = D.table(spark, sf, "orders")
    pairs = o.join(ids, c("l_orderkey") == c("o_orderkey"), "left").select(
        c("o_orderkey").alias("row_id"), (c("o_orderkey") % 9).cast("string").alias("uniprot"),
        F.concat(F.lit("brand#"), c("o_custkey") % 4 + 1).alias("het"), "ids",
        F.when(c("o_custkey") % 2 == 0, "ECONOMY").otherwise("PROMO").alias("inchikey"),
    )
    return pairs, meta, ligands


@query(
    "join_structure_funnel",
    "WITH " + META_SQL
    + """ s AS (SELECT row_id, ord, pdb_id, pdb_id IS NOT NULL AND mu = u AS s1, hit, mutated, resolution FROM x)
    SELECT row_id, count(pdb_id) AS n_ids, count(*) FILTER (s1) AS n_protein, count(*) FILTER (s1 AND hit) AS n_ligand, count(*) FILTER (s1 AND hit AND NOT mutated) AS n_wild_type,
      arg_min(pdb_id, (coalesce(nullif(resolution, 0), 999.9), ord)) FILTER (s1 AND hit AND NOT mutated) AS valid_pdb_id,
      CASE WHEN count(pdb_id) = 0 THEN 'no ids' WHEN count(*) FILTER (s1) = 0 THEN 'no protein match' WHEN count(*) FILTER (s1 AND hit) = 0 THEN 'no ligand match'
        WHEN count(*) FILTER (s1 AND hit AND NOT mutated) = 0 THEN 'no wild-type structure' ELSE 'valid' END AS status FROM s GROUP BY 1""",
)
def _(spark, sf):
    pairs, meta, ligands = structure_tables(spark, sf)
    return J.structure_funnel(pairs, meta, ligands, "row_id", "ids", "uniprot", "het")


@query(
    "structure_ligand_union",
    """WITH e AS (SELECT 'S' || p_partkey AS pdb_id, unnest([p_brand, p_type, CASE WHEN p_size % 5 = 0 THEN 'UNK' ELSE 'M' || p_size END]) AS het_id FROM part)
    SELECT DISTINCT pdb_id, het_id FROM e WHERE het_id <> 'UNK' AND het_id NOT IN ('Brand#1', 'Brand#7', 'PROMO')""",
)
def _(spark, sf):
    p = D.table(spark, sf, "part")
    meta = p.select(
        F.concat(F.lit("S"), "p_partkey").alias("pdb_id"), F.array("p_brand", F.lit("")).alias("f1"), F.array("p_type", "p_brand").alias("f2"),
        F.array(F.when(c("p_size") % 5 == 0, "UNK").otherwise(F.concat(F.lit("M"), "p_size"))).alias("f3"), F.lit(None).cast("array<string>").alias("f4"),
    )
    brands = p.select(c("p_brand").alias("het_id")).filter(c("het_id").isin("Brand#1", "Brand#7"))
    solvents = brands.unionByName(p.select(c("p_type").alias("het_id")).filter("het_id = 'PROMO'")).distinct()
    return J.structure_ligands(meta, ["f1", "f2", "f3", "f4"], solvents)


@query(
    "structure_flags",
    """WITH x AS (SELECT l_orderkey AS row_id, 'S' || p_partkey AS pdb_id, p_size % 3 <> 0 AS has, p_size % 3 <> 0 AND p_type = CASE WHEN o_custkey % 2 = 0 THEN 'ECONOMY' ELSE 'PROMO' END AS same,
        p_name LIKE '%small%' AS mut FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
    SELECT row_id, bool_or(has) AS has_ligand, bool_or(same) AS ligand_matches, bool_or(mut) AS is_mutant, coalesce(string_agg(pdb_id, ';' ORDER BY pdb_id) FILTER (has), '') AS ligand_ids,
      coalesce(string_agg(pdb_id, ';' ORDER BY pdb_id) FILTER (same), '') AS match_ids, coalesce(string_agg(pdb_id, ';' ORDER BY pdb_id) FILTER (mut), '') AS mutant_ids FROM x GROUP BY 1""",
)
def _(spark, sf):
    pairs, meta, ligands = structure_tables(spark, sf)
    part = D.table(spark, sf, "part").select(F.concat(F.lit("S"), "p_partkey").alias("pdb_id"), "p_size")
    lig = ligands.join(part.filter("p_size % 3 <> 0"), "pdb_id", "left_semi")
    title = F.when(c("title").contains("small"), F.concat(F.lit("Mutant "), "title")).otherwise(c("title"))
    return J.structure_flags(pairs, lig, meta.withColumn("title", title), "row_id", "ids", "inchikey")


@query(
    "join_affinity_pairs",
    D.with_sql(*D.ASSAY_CHAIN)
    + """, q AS (SELECT DISTINCT protein, 'L' || (l_partkey % 40) AS ligand_1, 'L' || (l_partkey % 37) AS ligand_2 FROM assay WHERE l_partkey % 40 <> l_partkey % 37)
    SELECT q.protein, ligand_1, ligand_2, round(a.median_px, 6) AS px_1, round(b.median_px, 6) AS px_2, round(abs(a.median_px - b.median_px), 6) AS delta_px
    FROM q JOIN labelled a ON a.protein = q.protein AND a.ligand = ligand_1 JOIN labelled b ON b.protein = q.protein AND b.ligand = ligand_2""",
)
def _(spark, sf):
    return D.rounded(affinity_pair_rows(spark, sf))


def affinity_pair_rows(spark, sf):
    a, b = F.concat(F.lit("L"), c("l_partkey") % 40), F.concat(F.lit("L"), c("l_partkey") % 37)
    q = D.table(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_suppkey").alias("protein"), a.alias("ligand_1"), b.alias("ligand_2"))
    q = q.filter("ligand_1 <> ligand_2").distinct()
    return J.affinity_pairs(q, D.labelled(spark, sf).select("protein", "ligand", "median_px"), "protein", "ligand", "median_px")


@query(
    "merge_similarity_back",
    """WITH d AS (SELECT o_orderkey AS row_id, 'P' || (o_custkey % 50) AS protein, 'L' || (o_orderkey % 30) AS ligand, CASE WHEN o_orderkey % 3 = 0 THEN 'target' ELSE 'off_target' END AS target_type FROM orders),
      s AS (SELECT DISTINCT 'P' || (c_custkey % 50) AS protein, 'L' || (c_custkey % 23) AS ligand, 'L' || (c_nationkey + 100) AS target_ligand, c_mktsegment AS bucket FROM customer),
      j AS (SELECT d.*, s.target_ligand, s.bucket FROM d LEFT JOIN s ON d.protein = s.protein AND d.ligand = s.ligand),
      f AS (SELECT protein, arg_min(target_ligand, (row_id, target_ligand)) AS first FROM j WHERE target_type = 'off_target' AND target_ligand IS NOT NULL GROUP BY 1)
    SELECT j.row_id, j.protein, j.ligand, j.target_type, CASE WHEN target_type = 'target' THEN coalesce(target_ligand, first) ELSE target_ligand END AS target_ligand, coalesce(bucket, 'target') AS bucket
    FROM j LEFT JOIN f ON j.protein = f.protein""",
)
def _(spark, sf):
    k = c("o_orderkey")
    d = D.table(spark, sf, "orders").select(
        k.alias("row_id"), F.concat(F.lit("P"), c("o_custkey") % 50).alias("protein"), F.concat(F.lit("L"), k % 30).alias("ligand"),
        F.when(k % 3 == 0, "target").otherwise("off_target").alias("target_type"),
    )
    s = D.table(spark, sf, "customer").select(
        F.concat(F.lit("P"), c("c_custkey") % 50).alias("protein"), F.concat(F.lit("L"), c("c_custkey") % 23).alias("off_ligand"),
        F.concat(F.lit("L"), c("c_nationkey") + 100).alias("target_ligand"), c("c_mktsegment").alias("bucket"),
    ).distinct()
    return J.merge_similarity(d, s, "protein", "ligand", "row_id")


STAGES = """orig AS (SELECT o_orderkey AS row_id, 'P' || (o_custkey % 40) || '_h' AS protein_key, CASE WHEN o_orderkey % 3 = 0 THEN 'target' ELSE 'off_target' END AS target_type, 'K' || o_orderkey AS ligand_inchikey, o_orderstatus FROM orders),
  s2 AS (SELECT *, CASE WHEN target_type = 'target' THEN 't' ELSE 'o' END || row_id AS complex_id FROM orig WHERE o_orderstatus <> 'P'),
  s6 AS (SELECT 'P' || (l_suppkey % 40) || '_x' AS protein_key, 'c' || l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS config_id, 't' || (l_orderkey // 3 * 3) AS target_complex_id, 'o' || l_orderkey AS offtarget_complex_id FROM lineitem WHERE l_returnflag = 'A')"""


@query(
    "merge_after_stages",
    "WITH " + STAGES
    + """ SELECT row_id, o.protein_key, o.target_type, o.ligand_inchikey, NULL AS config_id, 't' || row_id AS target_complex_id FROM orig o WHERE target_type = 'target' AND o_orderstatus <> 'P'
       AND 't' || row_id IN (SELECT target_complex_id FROM s6)
    UNION ALL SELECT o.row_id, o.protein_key, o.target_type, o.ligand_inchikey, s6.config_id, s6.target_complex_id FROM orig o JOIN s2 USING (row_id)
      JOIN s6 ON s6.offtarget_complex_id = s2.complex_id AND split_part(s6.protein_key, '_', 1) = split_part(o.protein_key, '_', 1) WHERE o.target_type = 'off_target'""",
)
def _(spark, sf):
    k = c("o_orderkey")
    kind = F.when(k % 3 == 0, "target").otherwise("off_target")
    orig = D.table(spark, sf, "orders").select(
        k.alias("row_id"), F.concat(F.lit("P"), c("o_custkey") % 40, F.lit("_h")).alias("protein_key"), kind.alias("target_type"), F.concat(F.lit("K"), k).alias("ligand_inchikey"), "o_orderstatus",
    )
    s2 = orig.filter("o_orderstatus <> 'P'").drop("o_orderstatus").withColumn("complex_id", F.concat(F.when(c("target_type") == "target", "t").otherwise("o"), "row_id"))
    s6 = D.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        F.concat(F.lit("P"), c("l_suppkey") % 40, F.lit("_x")).alias("protein_key"),
        F.concat_ws("_", F.concat(F.lit("c"), "l_orderkey"), "l_partkey", "l_suppkey", "l_linenumber").alias("config_id"),
        F.concat(F.lit("t"), F.floor(c("l_orderkey") / 3) * 3).alias("target_complex_id"), F.concat(F.lit("o"), "l_orderkey").alias("offtarget_complex_id"),
    )
    return J.merge_after_stages(orig, s2, s6).select("row_id", "protein_key", "target_type", "ligand_inchikey", "config_id", "target_complex_id")
