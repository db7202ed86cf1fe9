"""Cleaning expressions, variants and reshaping on the mapped tables."""

import pandas as pd
from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.functions import affinity as A, sequences as Q, text as X
from bindloom.operators import assay as O, features as FT, variants as V

c = F.col


@query("col_resolve", "SELECT o_orderkey AS entry, o_orderpriority AS label, CAST(NULL AS VARCHAR) AS doi, o_totalprice AS value FROM orders")
def _(spark, sf):
    names = {"entry": ["id", "O_ORDERKEY"], "label": ["Priority", "o_orderpriority"], "doi": ["Article DOI"], "value": ["o_totalPrice"]}
    return O.resolve_columns(D.table(spark, sf, "orders"), names)


@query(
    "txt_norm",
    """SELECT doc_id, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), '') AS clean,
      upper(regexp_replace(regexp_replace(text, '[^ -~\\n]', '', 'g'), '\\s+', '', 'g')) AS seq FROM documents""",
)
def _(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select(
        "doc_id", X.clean_text(c("text")).alias("clean"), X.clean_sequence(F.regexp_replace("text", "[^ -~\\n]", "")).alias("seq")
    )


@query(
    "seq_md5",
    """SELECT doc_id, md5(s) AS seq_md5, length(s) AS n FROM
      (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)""",
)
def _(spark, sf):
    s = D.letters("text")
    return D.table(spark, sf, "documents").select("doc_id", F.md5(s).alias("seq_md5"), F.length(s).cast("long").alias("n"))


@query(
    "key_build",
    """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 1 THEN p_name END, 'UNSPECIFIED_TARGET')
      || ' | ' || CASE WHEN p_size % 4 = 0 THEN 'UNSPECIFIED_ORG' ELSE p_type END AS key,
      CASE WHEN p_size % 3 = 0 AND p_size % 4 <> 0 THEN p_brand || '_' || p_type END AS strict FROM part""",
)
def _(spark, sf):
    p = D.table(spark, sf, "part")
    brand, name = F.when(c("p_size") % 3 == 0, F.concat(F.lit("  "), "p_brand")), F.when(c("p_size") % 3 == 1, c("p_name"))
    org = F.when(c("p_size") % 4 == 0, F.lit(" ")).otherwise(c("p_type"))
    key = X.identity_key([F.lit(""), brand, name], org, "UNSPECIFIED_TARGET", "UNSPECIFIED_ORG")
    return p.select("p_partkey", key.alias("key"), X.strict_key(F.trim(brand), org).alias("strict"))


@query(
    "ligand_key",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_type WHEN p_size % 4 = 2 THEN p_name END AS ligand_key FROM part""",
)
def _(spark, sf):
    z = c("p_size") % 4
    key = X.first_filled(F.when(z == 0, c("p_brand")), F.when(z == 1, c("p_type")).otherwise("  "), F.when(z == 2, c("p_name")))
    return D.table(spark, sf, "part").select("p_partkey", key.alias("ligand_key"))


CHAINS = "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'chains: ' || (l_suppkey % 4) ELSE 'n/a' END"


@query(
    "flt_single_chain",
    f"""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem
      WHERE coalesce(try_cast(regexp_extract({CHAINS}, '([0-9]+)', 1) AS INT), 1) <= 1""",
)
def _(spark, sf):
    n = c("l_linenumber") % 3
    cell = F.when(n == 1, F.concat(F.lit("chains: "), (c("l_suppkey") % 4).cast("string"))).when(n == 2, "n/a")
    return D.table(spark, sf, "lineitem").filter(X.single_chain(cell)).select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "parse_first_number",
    """SELECT event_id, try_cast(nullif(regexp_extract(props, '([-+]?[0-9]*[.]?[0-9]+)', 1), '') AS DOUBLE) AS k FROM events""",
)
def _(spark, sf):
    return D.table(spark, sf, "events").select("event_id", X.first_number(c("props")).alias("k"))


@query(
    "pick_affinity",
    """SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'Ki' WHEN l_linenumber = 1 THEN 'Kd' WHEN l_returnflag = 'A' THEN 'IC50'
      WHEN l_linestatus = 'O' THEN 'EC50' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity WHEN l_linenumber = 1 THEN l_tax
      WHEN l_returnflag = 'A' THEN l_discount WHEN l_linestatus = 'O' THEN l_extendedprice END AS value FROM lineitem""",
)
def _(spark, sf):
    pick = A.pick_affinity(
        Ki=F.when(c("l_suppkey") % 2 == 0, c("l_quantity")), Kd=F.when(c("l_linenumber") == 1, c("l_tax")),
        IC50=F.when(c("l_returnflag") == "A", c("l_discount")), EC50=F.when(c("l_linestatus") == "O", c("l_extendedprice")),
    )
    x = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", pick.alias("p"))
    return x.select("l_orderkey", "l_partkey", "l_suppkey", c("p.type").alias("kind"), c("p.value").alias("value"))


@query(
    "mut_from_name",
    """SELECT o_orderkey, array_to_string(list_filter([chr(CAST(65 + o_custkey % 20 AS INT)) || o_custkey || 'T', 'del5', 'A' || o_orderkey || 'V'],
      lambda t: regexp_full_match(t, '[A-Z][0-9]+[A-Z]')), ';') AS muts FROM orders""",
)
def _(spark, sf):
    o = D.table(spark, sf, "orders")
    aa = F.char((65 + c("o_custkey") % 20).cast("int"))
    name = F.concat(
        F.lit("Kinase (x) ["), aa, c("o_custkey").cast("string"), F.lit("T, del5]/Partner [A"), c("o_orderkey").cast("string"), F.lit("V] 7")
    )
    return o.select("o_orderkey", F.array_join(Q.mutations_in_name(name), ";").alias("muts"))


@query(
    "mut_parse_label",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN k IN (1, 2) THEN 'A' WHEN k = 3 THEN 'B' END AS chain,
      CASE WHEN k IN (0, 1, 3) THEN 'E' END AS wt, CAST(l_partkey AS INT) AS pos, CASE WHEN k <> 2 THEN 'V' END AS mut
    FROM (SELECT *, l_linenumber % 4 AS k FROM lineitem)""",
)
def _(spark, sf):
    pos, k = c("l_partkey").cast("string"), c("l_linenumber") % 4
    label = (
        F.when(k == 0, F.concat(F.lit(" E"), pos, F.lit("v")))
        .when(k == 1, F.concat(F.lit("A:E"), pos, F.lit("V")))
        .when(k == 2, F.concat(F.lit("A:"), pos))
        .otherwise(F.concat(F.lit("B:"), pos, F.lit(":E>V")))
    )
    # lower-case mutants are accepted in upper case only by the first grammar
    label = F.when(k == 0, F.upper(label)).otherwise(label)
    x = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", Q.parse_label(label).alias("m"))
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "m.*")


SEQ = "seq AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)"


@query(
    "mut_diff",
    f"""WITH {SEQ}, v AS (SELECT doc_id, s, CASE WHEN doc_id % 5 = 0 THEN s || 'A' ELSE replace(s, 'V', 'K') END AS t FROM seq),
    m AS (SELECT doc_id, length(s) <> length(t) AS has_indel, list_filter(list_transform(string_split(s, ''), lambda x, i:
      CASE WHEN x = 'V' THEN 'V' || i || 'K' END), lambda y: y IS NOT NULL) AS l FROM v)
    SELECT doc_id, has_indel, CASE WHEN NOT has_indel THEN len(l) END AS n_subs, NOT has_indel AND len(l) <= 100 AS within_limit,
      CASE WHEN NOT has_indel THEN array_to_string(l, ';') END AS mutations FROM m""",
)
def _(spark, sf):
    s = D.table(spark, sf, "documents").select("doc_id", D.letters("text").alias("s"))
    t = F.when(c("doc_id") % 5 == 0, F.concat("s", F.lit("A"))).otherwise(F.translate("s", "V", "K"))
    out = V.mark_substitutions(s.withColumn("t", t), "s", "t")
    return out.select("doc_id", "has_indel", "n_subs", "within_limit", F.array_join("mutations", ";").alias("mutations"))


@query("mut_align")
def _(spark, sf):
    x = D.table(spark, sf, "conversations").select("conv_id", "turn", D.letters("text").alias("reference"))
    x = x.withColumn("variant", F.regexp_replace(F.regexp_replace("reference", "TH", "D"), "OU", "OXU"))
    return V.Q.align_variants(x, "reference", "variant").select("conv_id", "turn", "diffs", "n_subs", "n_ins", "n_del")


@query(
    "het_normalise",
    """WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(substr(p_name, 1, 3)) WHEN 1 THEN CAST(100 + p_size AS VARCHAR)
        WHEN 2 THEN 'TOOLONG' ELSE upper(substr(p_type, 1, 2)) END AS h, p_size FROM part),
      q AS (SELECT *, CASE WHEN regexp_full_match(h, '[A-Z0-9]{1,3}') AND NOT regexp_full_match(h, '[0-9]+') THEN h END AS het FROM p)
    SELECT p_partkey, het, CASE WHEN het IS NOT NULL THEN '1ABC:' || het || ';2DE' || (p_size % 10) || ':' || het END AS pairs,
      CASE WHEN het IS NOT NULL THEN het END AS first_code FROM q""",
)
def _(spark, sf):
    z = c("p_size") % 4
    raw = (
        F.when(z == 0, F.substring("p_name", 1, 3)).when(z == 1, (100 + c("p_size")).cast("string"))
        .when(z == 2, "toolong").otherwise(F.substring("p_type", 1, 2))
    )
    ids = F.concat(F.lit("2de"), (c("p_size") % 10).cast("string"), F.lit(", 1abc;1ABC xyz"))
    p = D.table(spark, sf, "part").select("p_partkey", Q.het_code(raw).alias("het"), Q.structure_code_pairs(ids, raw).alias("pairs"))
    return p.withColumn("first_code", F.try_element_at(Q.code_map(c("pairs")), F.lit("1ABC")))


@query(
    "split_ids",
    """SELECT o_orderkey, 'ID' || o_custkey AS id FROM orders UNION ALL SELECT o_orderkey, 'X' || (o_orderkey % 97) FROM orders
       UNION ALL SELECT o_orderkey, upper(o_orderstatus) FROM orders""",
)
def _(spark, sf):
    cell = F.concat(F.lit(" id"), "o_custkey", F.lit(";, x"), c("o_orderkey") % 97, F.lit("\t"), F.lower("o_orderstatus"), F.lit(";"))
    return D.table(spark, sf, "orders").select("o_orderkey", F.explode(X.split_ids(cell)).alias("id"))


@query(
    "set_equal",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 3 = 0 END AS same FROM orders""",
)
def _(spark, sf):
    k = c("o_custkey").cast("string")
    a = F.concat(F.lit("b;"), k, F.lit(", a"))
    b = F.when(c("o_orderkey") % 7 == 0, " ").otherwise(F.concat(F.lit("a;b,"), F.when(c("o_custkey") % 3 == 0, k).otherwise("z"), F.lit("; a")))
    return D.table(spark, sf, "orders").select("o_orderkey", X.same_id_set(a, b, c("o_orderstatus") == "F").alias("same"))


@query(
    "featurize_distinct",
    """SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS heavy_atoms, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS BIGINT) AS rings,
      p_name LIKE 's%' AS failed FROM part WHERE p_name NOT LIKE 's%' UNION ALL SELECT p_partkey, NULL, NULL, TRUE FROM part WHERE p_name LIKE 's%'""",
)
def _(spark, sf):
    @F.pandas_udf("heavy_atoms long, rings long")
    def describe(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"heavy_atoms": names.str.len(), "rings": names.str.count("e")})

    def compute(name):
        return F.when(~name.startswith("s"), describe(name))

    x = FT.featurize_distinct(D.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", compute)
    return x.select("p_partkey", "features.heavy_atoms", "features.rings", "failed")


@query(
    "impute_median",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS a, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey * 1.0 END AS b FROM orders)
    SELECT o_orderkey, round(coalesce(a, (SELECT median(a) FROM v)), 4) AS a, round(coalesce(CAST(b AS DOUBLE), (SELECT median(b) FROM v)), 4) AS b FROM v""",
)
def _(spark, sf):
    v = D.table(spark, sf, "orders").select(
        "o_orderkey", F.when(c("o_orderkey") % 7 != 0, c("o_totalprice")).alias("a"),
        F.when(c("o_custkey") % 5 != 0, c("o_custkey").cast("double")).alias("b"),
    )
    return D.rounded(FT.impute_median(v, ["a", "b"]), 4)


# ---- variants

REF = """SELECT s.*, l FROM (SELECT p, q, count(*) AS n, length(q) AS l FROM v GROUP BY p, q) s"""
VSEQ = "v AS (SELECT c_nationkey AS p, c_mktsegment AS q FROM customer)"


@query(
    "agg_reference_seq",
    f"""WITH {VSEQ}, k AS (SELECT p, q, count(*) AS n, length(q) AS l FROM v GROUP BY p, q),
      a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, md5(q)) AS rn FROM k) WHERE rn = 1),
      m AS (SELECT p, arg_max(l, (s, -l)) AS l FROM (SELECT p, l, sum(n) AS s FROM k GROUP BY 1, 2) GROUP BY 1),
      b AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.p ORDER BY n DESC, q) AS rn FROM k JOIN m ON k.p = m.p AND k.l = m.l) WHERE rn = 1)
    SELECT a.p, a.q AS by_count, a.n AS n_count, b.q AS by_length, b.n AS n_length FROM a JOIN b ON a.p = b.p""",
)
def _(spark, sf):
    v = D.table(spark, sf, "customer").select(c("c_nationkey").alias("p"), c("c_mktsegment").alias("q"))
    a = V.reference_sequence(v, ["p"], "q").select("p", c("q").alias("by_count"), c("n_records").alias("n_count"))
    b = V.reference_by_length(v, ["p"], "q").select("p", c("q").alias("by_length"), c("n_records").alias("n_length"))
    return a.join(b, "p")


WT = """m AS (SELECT protein, l_linestatus AS org, ligand, CASE WHEN l_partkey % 3 = 0 THEN 'MKVLAT' WHEN l_partkey % 3 = 1 THEN 'MRVLAT' ELSE 'MKVIAS' END AS s,
    l_linenumber % 2 AS assay, min(nM) AS nM FROM meas GROUP BY ALL),
  w AS (SELECT protein, org, s AS wt FROM (SELECT protein, org, s, row_number() OVER (PARTITION BY protein, org ORDER BY count(*) DESC, md5(s)) AS rn FROM m
    GROUP BY protein, org, s) WHERE rn = 1),
  p AS (SELECT m.*, wt, b.nM AS wt_nM, log10(b.nM / m.nM) AS delta FROM m JOIN w USING (protein, org)
    JOIN m b ON b.protein = m.protein AND b.org = m.org AND b.s = w.wt AND b.ligand = m.ligand AND b.assay = m.assay WHERE m.s <> wt)"""


def wt_pairs(spark, sf):
    m = D.measurements(spark, sf)
    s = F.when(c("l_partkey") % 3 == 0, "MKVLAT").when(c("l_partkey") % 3 == 1, "MRVLAT").otherwise("MKVIAS")
    m = m.groupBy("protein", c("l_linestatus").alias("org"), "ligand", s.alias("s"), (c("l_linenumber") % 2).alias("assay")).agg(
        F.min("nM").alias("nM")
    )
    return V.pair_with_wild_type(m, ["protein", "org"], "s", "ligand", "assay", "nM")


@query(
    "join_wt_mutant",
    D.with_sql(D.ASSAY, D.MEAS, WT) + "SELECT protein, org, ligand, s, assay, wt AS wildtype_seq, nM, wt_nM, round(delta, 6) AS delta_pX FROM p",
)
def _(spark, sf):
    return wt_pairs(spark, sf).select(
        "protein", "org", "ligand", "s", "assay", "wildtype_seq", "nM", "wt_nM", F.round("delta_pX", 6).alias("delta_pX")
    )


@query(
    "cls_delta",
    D.with_sql(D.ASSAY, D.MEAS, WT)
    + """SELECT protein, org, ligand, s, assay, CASE WHEN delta >= 1 THEN 'target' WHEN abs(delta) < 0.3 THEN 'nochange' WHEN delta <= -1 THEN 'negative' ELSE 'below_par' END AS fine,
      CASE WHEN delta >= 1 THEN 'target' ELSE 'off_target' END AS coarse, CASE WHEN delta >= 0.5 THEN 'target' WHEN delta <= -0.5 THEN 'negative' ELSE 'nochange' END AS second
      FROM p""",
)
def _(spark, sf):
    fine = A.label_delta(c("delta_pX"))
    return wt_pairs(spark, sf).select(
        "protein", "org", "ligand", "s", "assay", fine.alias("fine"),
        F.when(fine == "target", "target").when(fine.isNotNull(), "off_target").alias("coarse"),
        A.label_delta(c("delta_pX"), 0.5, -0.5, None).alias("second"),
    )


# ---- set operations and reshaping

@query(
    "set_concat",
    """SELECT l_orderkey, l_partkey, l_suppkey, 'Ki' AS assay_type, l_quantity AS affinity_nM FROM lineitem
      UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'Kd', l_tax FROM lineitem WHERE l_tax > 0""",
)
def _(spark, sf):
    li = D.table(spark, sf, "lineitem").withColumn("kd", F.when(c("l_tax") > 0, c("l_tax")))
    return V.best_affinity_long(li, {"Ki": "l_quantity", "Kd": "kd"}, ["l_orderkey", "l_partkey", "l_suppkey"])


@query(
    "set_intersect_except",
    """SELECT 'common' AS part, count(*) AS n FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'only_b', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT 'only_a', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""",
)
def _(spark, sf):
    a = D.table(spark, sf, "lineitem").select(c("l_orderkey").alias("k"))
    b = D.table(spark, sf, "orders").select(c("o_orderkey").alias("k"))
    parts = {"common": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "set_dedup",
    "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2",
)
def _(spark, sf):
    from bindloom.plans import skew as S

    o = D.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return S.first_per(o, ["o_custkey", "o_orderstatus"], [F.asc("o_orderkey")])


@query("sort_output", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC NULLS LAST, p_brand")
def _(spark, sf):
    p = D.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return p.orderBy(F.desc_nulls_last("n"), F.asc_nulls_last("p_brand"))
