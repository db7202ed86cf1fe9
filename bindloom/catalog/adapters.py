"""Projections of the given tables to the shapes the operators need, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # whole texts go through costly expressions in every query that reads them
    return spread(df) if name in ("documents", "conversations") else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that comes in fewer splits than there are cores, dealt out to all of them.

    Large tables have many splits and are left alone; one small file would keep costly
    expressions in a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- affinity measurements: lineitem as (protein, ligand, cell of numbers, row id)

ASSAY = """assay AS (
  SELECT 'P' || l_suppkey AS protein, 'L' || (l_partkey % 40) AS ligand, l_suppkey, l_partkey % 40 AS lig,
    l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey, l_quantity,
    (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS row_id, pm,
    CASE WHEN l_linenumber = 1 THEN '>' || pm || 'e-3'
         WHEN l_linenumber = 2 THEN pm || 'e-3; ' || (pm + 7) || 'e-3'
         WHEN l_linenumber = 3 THEN '<' || pm || 'e-3, 0 -4;n/a'
         ELSE pm || 'e-3' END AS cell
  FROM (SELECT *, CAST(round(pow(10.0::DOUBLE, 12 - (4.003::DOUBLE
      + ((l_suppkey * 7 + (l_partkey % 40) * 13) % 60) / 10.0::DOUBLE
      + (l_quantity - 25) / (CASE WHEN l_suppkey % 5 = 0 THEN 20.0::DOUBLE ELSE 100.0::DOUBLE END)))) AS BIGINT) AS pm
    FROM lineitem))"""


def assay(spark, sf) -> DataFrame:
    li = spread(table(spark, sf, "lineitem"))
    lig = F.col("l_partkey") % 40
    px = (
        F.lit(4.003)
        + ((F.col("l_suppkey") * 7 + lig * 13) % 60) / 10.0
        + (F.col("l_quantity") - 25) / F.when(F.col("l_suppkey") % 5 == 0, 20.0).otherwise(100.0)
    )
    pm = F.round(F.pow(F.lit(10.0), 12 - px)).cast("long")
    num = F.concat(F.col("pm").cast("string"), F.lit("e-3"))
    cell = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit(">"), num))
        .when(F.col("l_linenumber") == 2, F.concat(num, F.lit("; "), (F.col("pm") + 7).cast("string"), F.lit("e-3")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("<"), num, F.lit(", 0 -4;n/a")))
        .otherwise(num)
    )
    return li.withColumn("pm", pm).select(
        F.concat(F.lit("P"), "l_suppkey").alias("protein"),
        F.concat(F.lit("L"), lig).alias("ligand"),
        "l_suppkey",
        lig.alias("lig"),
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        "l_partkey",
        "l_quantity",
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("row_id"),
        "pm",
        cell.alias("cell"),
    )


MEAS = """meas AS (
  SELECT *, -log10(nM * 1e-9) AS px FROM (
    SELECT *, unnest(list_filter(list_transform(regexp_split_to_array(trim(cell), '[;,\\s]+'),
      lambda t: try_cast(regexp_replace(t, '^[<>]', '') AS DOUBLE)), lambda v: v > 0)) AS nM FROM assay))"""

PAIRS = """pairs AS (
  SELECT protein, ligand, count(*) AS n_measurements, min(nM) AS min_nM, max(nM) AS max_nM,
    min(px) AS min_px, max(px) AS max_px, stddev_samp(px) AS std_px, median(px) AS median_px
  FROM meas GROUP BY protein, ligand)"""

VALID = """valid AS (
  SELECT *, CASE WHEN reason = 'single_value' THEN min_nM
                 WHEN reason = 'valid_std' THEN pow(10.0::DOUBLE, -median_px) / 1e-9::DOUBLE END AS representative_nM
  FROM (SELECT *, CASE
      WHEN min_nM = max_nM AND min_nM > 31.6 AND min_nM < 3160 THEN 'median_in_gray_zone'
      WHEN min_nM = max_nM THEN 'single_value'
      WHEN std_px >= 0.5 THEN 'high_std'
      WHEN min_px <= 5.5 AND max_px >= 7.5 THEN 'crosses_categories'
      WHEN median_px > 5.5 AND median_px < 7.5 THEN 'median_in_gray_zone'
      ELSE 'valid_std' END AS reason FROM pairs))"""

LABELLED = """labelled AS (
  SELECT * FROM (SELECT *, CASE WHEN representative_nM <= 31.6 THEN 'target'
    WHEN representative_nM >= 3160 THEN 'off_target' END AS target_type FROM valid) WHERE target_type IS NOT NULL)"""

CURATED = """curated AS (
  SELECT * FROM labelled WHERE protein IN (SELECT protein FROM labelled GROUP BY protein
    HAVING count(DISTINCT target_type) = 2))"""

ASSAY_CHAIN = [ASSAY, MEAS, PAIRS, VALID, LABELLED]


def measurements(spark, sf) -> DataFrame:
    from bindloom.operators.assay import parse_measurements

    return parse_measurements(assay(spark, sf), "cell")


def labelled(spark, sf) -> DataFrame:
    """Validated, labelled protein-ligand pairs."""
    from bindloom.operators import assay as O

    pairs = O.aggregate_pairs(measurements(spark, sf), ["protein", "ligand"], "nM", "row_id")
    return O.label_pairs(O.validate_replicates(pairs).filter("is_valid"))


# ---- predicted models: lineitem as (entry, index, flags, scores)

MODELS = """models AS (
  SELECT l_orderkey AS entry_id, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey AS idx,
    l_returnflag <> 'R' AS all_passed, l_partkey % 4 <> 0 AS passes_valence_checks, l_suppkey % 7 <> 0 AS passes_kekulization,
    CAST(l_partkey % 3 AS BIGINT) AS number_clashes,
    CASE WHEN l_tax > 0 THEN -l_quantity / 5 - l_partkey / 100000.0::DOUBLE END AS vina_score_min,
    CASE WHEN l_linenumber <> 5 THEN 0.5::DOUBLE + l_discount * 4 + l_suppkey / 10000.0::DOUBLE END AS confidence_score,
    'P' || l_suppkey AS protein, l_returnflag AS flag FROM lineitem)"""


def models(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    c = F.col
    return li.select(
        c("l_orderkey").alias("entry_id"),
        ((c("l_linenumber") * 100000 + c("l_partkey")) * 1000 + c("l_suppkey")).alias("idx"),
        (c("l_returnflag") != "R").alias("all_passed"),
        (c("l_partkey") % 4 != 0).alias("passes_valence_checks"),
        (c("l_suppkey") % 7 != 0).alias("passes_kekulization"),
        (c("l_partkey") % 3).alias("number_clashes"),
        F.when(c("l_tax") > 0, -c("l_quantity") / 5 - c("l_partkey") / 100000.0).alias("vina_score_min"),
        F.when(c("l_linenumber") != 5, 0.5 + c("l_discount") * 4 + c("l_suppkey") / 10000.0).alias("confidence_score"),
        F.concat(F.lit("P"), "l_suppkey").alias("protein"),
        c("l_returnflag").alias("flag"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison with the SQL twin."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    )


def letters(text: str):
    """Letters A–Z of a text in upper case: the sequences of the mapped tables."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


# ---- fingerprints and features: embeddings as (vec_id, protein, on-bits, descriptors)

VECS = """vecs AS (
  SELECT vec_id, 'P' || label AS protein, embedding, list_filter(list_transform(embedding, lambda v, i: CASE WHEN v > 0 THEN i - 1 END), lambda b: b IS NOT NULL) AS bits,
    list_transform(embedding[1:9], lambda v: CAST(round(CAST(v AS DOUBLE) * 10) AS BIGINT)) AS props,
    CASE WHEN vec_id % 5 <> 0 THEN 'scaf' || (vec_id % 7) END AS scaffold, CASE WHEN vec_id % 3 = 0 THEN 'target' ELSE 'off_target' END AS target_type
  FROM embeddings)"""


def vecs(spark, sf) -> DataFrame:
    e = spread(table(spark, sf, "embeddings"))
    on = F.transform("embedding", lambda v, i: F.when(v > 0, i))
    return e.select(
        "vec_id",
        F.concat(F.lit("P"), "label").alias("protein"),
        F.filter(on, lambda b: b.isNotNull()).alias("bits"),
        F.transform(F.slice("embedding", 1, 9), lambda v: F.round(v.cast("double") * 10).cast("long")).alias("props"),
        F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("scaf"), F.col("vec_id") % 7)).alias("scaffold"),
        F.when(F.col("vec_id") % 3 == 0, "target").otherwise("off_target").alias("target_type"),
        "embedding",
    )


# ---- ligand pairs with similarity and affinity difference: one pair per line item

PAIRTAB = """pt AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS pair_id, 'P' || l_suppkey AS protein,
    ((l_partkey * 37 + l_orderkey * 11) % 1000) / 1000.0::DOUBLE AS sim,
    ((l_partkey * 53 + l_orderkey * 29 + CAST(l_quantity AS BIGINT) * 7 + (l_partkey * 37 + l_orderkey * 11) % 1000 // 4) % 300) / 100.0::DOUBLE AS delta,
    l_returnflag = 'A' AS same_bin FROM lineitem)"""


def pair_table(spark, sf) -> DataFrame:
    li = spread(table(spark, sf, "lineitem"))
    c = F.col
    s = (c("l_partkey") * 37 + c("l_orderkey") * 11) % 1000
    d = (c("l_partkey") * 53 + c("l_orderkey") * 29 + c("l_quantity").cast("long") * 7 + F.floor(s / 4)) % 300
    return li.select(
        ((c("l_orderkey") * 10 + c("l_linenumber")) * 100000000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("pair_id"),
        F.concat(F.lit("P"), "l_suppkey").alias("protein"),
        (s / 1000.0).alias("sim"),
        (d / 100.0).alias("delta"),
        (c("l_returnflag") == "A").alias("same_bin"),
    )


# ---- poses and decoys: one pose per line item, grouped by supplier

POSES = """poses AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS pose_id, 'C' || l_suppkey AS config_id,
    CASE WHEN l_tax > 0.01 THEN -l_quantity / 5 - (l_partkey % 97) / 100.0::DOUBLE END AS score,
    l_discount * 60 + (l_orderkey % 50) / 10.0::DOUBLE AS com_distance, l_linenumber * 0.6::DOUBLE + (l_partkey % 10) / 10.0::DOUBLE AS min_distance,
    l_partkey % 3 = 0 AS has_clash, l_partkey % 5 AS n_clashes, (l_orderkey % 10) / 10.0::DOUBLE AS pocket_overlap,
    l_orderkey % 23 AS n_int, l_quantity * 3 - l_extendedprice / 1000 AS energy, (l_partkey % 40) / 10.0::DOUBLE AS drift,
    l_orderkey % 6 AS hbonds, l_partkey % 12 AS contacts, (l_orderkey % 29) / 10.0::DOUBLE AS ca_rmsd, (l_partkey % 43) / 10.0::DOUBLE AS all_atom_rmsd,
    CASE WHEN l_partkey % 13 <> 0 THEN -(l_orderkey % 37) / 2.0::DOUBLE END AS interface, 'f' || (l_orderkey % 500) AS file, l_linenumber AS seed
  FROM lineitem)"""


def poses(spark, sf) -> DataFrame:
    li = spread(table(spark, sf, "lineitem"))
    c = F.col
    part, order, line = c("l_partkey"), c("l_orderkey"), c("l_linenumber")
    return li.select(
        ((order * 10 + line) * 100000000 + part * 1000 + c("l_suppkey")).alias("pose_id"),
        F.concat(F.lit("C"), "l_suppkey").alias("config_id"),
        F.when(c("l_tax") > 0.01, -c("l_quantity") / 5 - (part % 97) / 100.0).alias("score"),
        (c("l_discount") * 60 + (order % 50) / 10.0).alias("com_distance"),
        (line * 0.6 + (part % 10) / 10.0).alias("min_distance"),
        (part % 3 == 0).alias("has_clash"),
        (part % 5).alias("n_clashes"),
        ((order % 10) / 10.0).alias("pocket_overlap"),
        (order % 23).alias("n_int"),
        (c("l_quantity") * 3 - c("l_extendedprice") / 1000).alias("energy"),
        ((part % 40) / 10.0).alias("drift"),
        (order % 6).alias("hbonds"),
        (part % 12).alias("contacts"),
        ((order % 29) / 10.0).alias("ca_rmsd"),
        ((part % 43) / 10.0).alias("all_atom_rmsd"),
        F.when(part % 13 != 0, -(order % 37) / 2.0).alias("interface"),
        F.concat(F.lit("f"), order % 500).alias("file"),
        line.alias("seed"),
    )


# ---- status events: events as (complex, stage, status, error, ts)

STAGE_NAMES = ["click", "error", "purchase", "signup", "view"]

STATUS = """status AS (
  SELECT user_id AS complex_id, event_type AS stage, CASE WHEN value < 20 THEN 'failed' WHEN value < 25 THEN 'skip' ELSE 'success' END AS status,
    CASE WHEN value < 20 THEN CASE CAST(floor(value * 100) AS BIGINT) % 6 WHEN 0 THEN 'File not found: x' WHEN 1 THEN 'Vina run FAILED' WHEN 2 THEN 'no poses in file'
      WHEN 3 THEN 'Timeout after 5 s' WHEN 4 THEN 'out of memory' ELSE 'strange' END END AS error, ts, event_id FROM events),
  latest AS (SELECT complex_id, stage, arg_max(status, (ts, event_id)) AS status, arg_max(coalesce(error, ''), (ts, event_id)) AS error0 FROM status GROUP BY 1, 2),
  lst AS (SELECT complex_id, stage, status, nullif(error0, '') AS error FROM latest)"""


def status_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    v = F.col("value")
    k = F.floor(v * 100) % 6
    error = (
        F.when(k == 0, "File not found: x").when(k == 1, "Vina run FAILED").when(k == 2, "no poses in file")
        .when(k == 3, "Timeout after 5 s").when(k == 4, "out of memory").otherwise("strange")
    )
    return e.select(
        F.col("user_id").alias("complex_id"),
        F.col("event_type").alias("stage"),
        F.when(v < 20, "failed").when(v < 25, "skip").otherwise("success").alias("status"),
        F.when(v < 20, error).alias("error"),
        "ts",
        "event_id",
    )


# ---- atoms: every embedding is one residue of the structure named by its label

ATOM_NAMES = ["N", "CA", "C", "O", "CB", "CG", "CD", "H1", "CE", "NZ"]
RES3 = ["ALA", "CYS", "ASP", "GLU", "PHE", "GLY", "HIS", "ILE", "LYS", "LEU", "MET", "ASN", "PRO", "GLN", "ARG", "SER", "THR", "VAL", "TRP", "TYR"]

ATOMS = f"""atoms AS (
  SELECT 'S' || label AS structure_id, CASE WHEN vec_id % 10 IN (0, 5) THEN 'HETATM' ELSE 'ATOM' END AS record, CASE WHEN vec_id % 3 < 2 THEN 'A' ELSE 'B' END AS chain,
    vec_id // 4 AS resseq, ['', 'A', 'B', 'C'][vec_id % 4 + 1] AS icode,
    CASE WHEN vec_id % 10 = 0 THEN 'LG' || (vec_id % 3) WHEN vec_id % 10 = 5 THEN 'HOH' ELSE ({RES3})[vec_id % 20 + 1] END AS resname,
    CASE WHEN vec_id % 10 = 0 THEN 'ligand' WHEN vec_id % 10 = 5 THEN 'water' ELSE 'protein' END AS kind,
    ({ATOM_NAMES})[i + 1] AS atom, substr(({ATOM_NAMES})[i + 1], 1, 1) AS element, CASE WHEN vec_id % 13 = 4 AND i > 5 THEN 'B' ELSE ' ' END AS altloc,
    vec_id, i, vec_id * 10 + i AS serial,
    round(CAST(embedding[1] AS DOUBLE) * 100 + CAST(embedding[3 * i + 4] AS DOUBLE) * 8, 3) AS x,
    round(CAST(embedding[2] AS DOUBLE) * 100 + CAST(embedding[3 * i + 5] AS DOUBLE) * 8, 3) AS y,
    round(CAST(embedding[3] AS DOUBLE) * 100 + CAST(embedding[3 * i + 6] AS DOUBLE) * 8, 3) AS z
  FROM (SELECT *, unnest(range(10)) AS i FROM embeddings) WHERE NOT (vec_id % 10 = 5 AND i > 0) AND NOT (vec_id % 7 = 3 AND i = 4) AND NOT (vec_id % 11 = 6 AND i = 3)),
 lig AS (SELECT * FROM atoms WHERE kind = 'ligand'), prot AS (SELECT * FROM atoms WHERE kind = 'protein')"""


def atoms(spark, sf) -> DataFrame:
    c = F.col
    v, i = c("vec_id"), c("i")
    e = spread(table(spark, sf, "embeddings")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    names, res = F.array(*[F.lit(a) for a in ATOM_NAMES]), F.array(*[F.lit(r) for r in RES3])

    def axis(k):
        near = F.element_at("embedding", i * 3 + 3 + k).cast("double") * 8
        return F.round(F.element_at("embedding", F.lit(k)).cast("double") * 100 + near, 3)

    kind = F.when(v % 10 == 0, "ligand").when(v % 10 == 5, "water").otherwise("protein")
    return e.filter(~((v % 10 == 5) & (i > 0)) & ~((v % 7 == 3) & (i == 4)) & ~((v % 11 == 6) & (i == 3))).select(
        F.concat(F.lit("S"), "label").alias("structure_id"),
        F.when(v % 10 % 5 == 0, "HETATM").otherwise("ATOM").alias("record"),
        F.when(v % 3 < 2, "A").otherwise("B").alias("chain"),
        F.floor(v / 4).alias("resseq"),
        F.element_at(F.array(*[F.lit(x) for x in ["", "A", "B", "C"]]), (v % 4 + 1).cast("int")).alias("icode"),
        F.when(v % 10 == 0, F.concat(F.lit("LG"), v % 3)).when(v % 10 == 5, "HOH").otherwise(F.element_at(res, (v % 20 + 1).cast("int"))).alias("resname"),
        kind.alias("kind"),
        F.element_at(names, i + 1).alias("atom"),
        F.substring(F.element_at(names, i + 1), 1, 1).alias("element"),
        F.when((v % 13 == 4) & (i > 5), "B").otherwise(" ").alias("altloc"),
        "vec_id",
        "i",
        (v * 10 + i).alias("serial"),
        axis(1).alias("x"),
        axis(2).alias("y"),
        axis(3).alias("z"),
    )


D2 = "((l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) + (l.z - p.z) * (l.z - p.z))"


# ---- scores: 63 values of an embedding are three residues of 21 letters

AA = "ACDEFGHIKLMNPQRSTVWYX"

SCORES = f"""scores AS (
  SELECT 'S' || label AS sample, vec_id // 2 AS run, vec_id % 2 AS batch, i // 21 AS residue, substr('{AA}', CAST(i % 21 + 1 AS INT), 1) AS aa, CAST(v AS DOUBLE) * 10 AS logit, label
  FROM (SELECT label, vec_id, unnest(embedding[1:63]) AS v, unnest(range(63)) AS i FROM embeddings)),
 soft AS (SELECT *, x - ln(sum(exp(x)) OVER w) AS log_prob, CASE WHEN aa = 'X' THEN 0 ELSE exp(x) / sum(exp(x)) OVER w END AS prob
  FROM (SELECT *, CASE WHEN aa <> 'X' THEN logit END AS x FROM scores) WINDOW w AS (PARTITION BY sample, run, batch, residue))"""


def scores(spark, sf) -> DataFrame:
    c = F.col
    e = spread(table(spark, sf, "embeddings")).select("label", "vec_id", F.posexplode(F.slice("embedding", 1, 63)).alias("i", "v"))
    return e.select(
        F.concat(F.lit("S"), "label").alias("sample"), F.floor(c("vec_id") / 2).alias("run"), (c("vec_id") % 2).alias("batch"),
        F.floor(c("i") / 21).alias("residue"), F.substring(F.lit(AA), c("i") % 21 + 1, F.lit(1)).alias("aa"), (c("v").cast("double") * 10).alias("logit"), "label",
    )


# ---- designed sequences: conversation turns, the role is the design set

DESIGNS = """designs AS (SELECT role AS label, conv_id, turn, """ + LETTERS + """ AS seq FROM conversations),
 refs AS (SELECT label, arg_min(seq, (conv_id, turn)) AS ref FROM designs WHERE seq <> '' GROUP BY 1)"""


def designs(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("role").alias("label"), "conv_id", "turn", letters("text").alias("seq"))


def references(spark, sf) -> DataFrame:
    d = designs(spark, sf).filter("seq <> ''")
    return d.groupBy("label").agg(F.min_by("seq", F.struct("conv_id", "turn")).alias("seq"))


# ---- alignment: every embedding is one aligned sequence of 64 columns, the label is the query

MSA_LETTERS = "ACDEFGHIKLMNPQRSTVWY-"

MSA = f"""msa AS (
  SELECT 'Q' || label AS query_id, vec_id AS seq_idx, i AS pos, substr('{MSA_LETTERS}', CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.3) * 35), 0), 20) AS INT) + 1, 1) AS aa,
    CASE WHEN (vec_id * 7 + i * 3) % 11 < 3 THEN (vec_id * 7 + i * 3) % 11 ELSE 0 END AS n_deleted
  FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)),
 seqs AS (SELECT query_id, seq_idx FROM msa WHERE pos = 0)"""


def msa(spark, sf) -> DataFrame:
    c = F.col
    e = spread(table(spark, sf, "embeddings")).select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    code = F.least(F.greatest(F.floor((c("v").cast("double") + 0.3) * 35), F.lit(0)), F.lit(20)).cast("int")
    d = (c("vec_id") * 7 + c("i") * 3) % 11
    return e.select(
        F.concat(F.lit("Q"), "label").alias("query_id"), c("vec_id").alias("seq_idx"), c("i").cast("long").alias("pos"),
        F.substring(F.lit(MSA_LETTERS), code + 1, F.lit(1)).alias("aa"), F.when(d < 3, d).otherwise(0).alias("n_deleted"),
    )


def uniform_sql(seed: int, *parts: str) -> str:
    """SQL twin of the seeded draw from [0, 1)."""
    text = f"'{seed}|' || " + " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
