"""Status, coverage and report queries on the mapped tables."""

from pyspark.sql import functions as F

from bindloom.catalog import adapters as D, query
from bindloom.operators import progress as G
from bindloom.session import fresh_path
from bindloom.streaming import progress as live

c = F.col
ST = D.with_sql(D.STATUS)
CATEGORY = """CASE WHEN error LIKE 'File not%' THEN 'File Not Found' WHEN error LIKE 'Timeout%' THEN 'Timeout' WHEN error LIKE 'Vina%' THEN 'Vina Execution Failed'
  WHEN error LIKE 'no poses%' THEN 'No Poses Generated' WHEN error LIKE '%memory' THEN 'Memory Error' WHEN error IS NOT NULL THEN 'Other Error' END"""


def latest(spark, sf):
    return G.latest_status(D.status_events(spark, sf), ["ts", "event_id"])


@query("error_category", ST + f"SELECT event_id, {CATEGORY} AS category FROM status")
def _(spark, sf):
    return D.status_events(spark, sf).select("event_id", G.error_category(c("error")).alias("category"))


def _matrix_sql():
    cols = [f"coalesce(max(status) FILTER (stage = '{s}'), 'pending') AS \"{s}\"" for s in D.STAGE_NAMES]
    errs = [f"max(error) FILTER (stage = '{s}' AND status = 'failed') AS {s}_error" for s in D.STAGE_NAMES]
    return f"m AS (SELECT complex_id, {', '.join(cols)}, {', '.join(errs)}, count(*) FILTER (status = 'success') = 5 AS all_success FROM lst GROUP BY 1)"


@query("agg_progress", ST + ", " + _matrix_sql() + " SELECT * FROM m")
def _(spark, sf):
    return G.progress_matrix(latest(spark, sf), D.STAGE_NAMES)


@query("agg_progress_rate", ST + ", " + _matrix_sql() + " SELECT count(*) AS n_complexes, count(*) FILTER (all_success) AS n_success, round(avg(all_success::INT), 6) AS success_rate FROM m")
def _(spark, sf):
    return D.rounded(G.success_rate(G.progress_matrix(latest(spark, sf), D.STAGE_NAMES)))


@query(
    "agg_failures",
    ST + f""", b AS (SELECT *, {CATEGORY} AS category FROM lst WHERE status = 'failed')
    SELECT stage, category, n, round(n / sum(n) OVER (PARTITION BY stage), 6) AS share, examples FROM (SELECT stage, category, count(*) AS n,
      string_agg(CAST(complex_id AS VARCHAR), ',' ORDER BY complex_id) FILTER (rn <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY stage, category ORDER BY complex_id) AS rn FROM b) GROUP BY 1, 2)""",
)
def _(spark, sf):
    return D.rounded(G.failures(latest(spark, sf)))


@query(
    "agg_stage_survival",
    ST + """, n AS (SELECT stage, CASE stage WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS pos, count(*) FILTER (status = 'success') AS n FROM lst GROUP BY 1)
    SELECT stage, pos, n, lag(n) OVER (ORDER BY pos) - n AS lost, round(n / lag(n) OVER (ORDER BY pos) * 100, 6) AS survival_percent FROM n""",
)
def _(spark, sf):
    pos = F.when(c("stage") == "view", 0).when(c("stage") == "click", 1).when(c("stage") == "signup", 2).when(c("stage") == "purchase", 3).otherwise(4)
    counts = latest(spark, sf).groupBy("stage", pos.alias("pos")).agg(F.count_if(c("status") == "success").alias("n"))
    return D.rounded(G.stage_survival(counts, "pos", "n"))


@query(
    "retry_selection",
    ST + "SELECT c_custkey AS complex_id, c_name FROM customer WHERE c_custkey IN (SELECT complex_id FROM lst WHERE stage = 'click' AND status = 'failed')",
)
def _(spark, sf):
    inputs = D.table(spark, sf, "customer").select(c("c_custkey").alias("complex_id"), "c_name")
    return G.retry_selection(inputs, latest(spark, sf), "click")


@query("stream_progress", ST + "SELECT stage, status, count(*) AS n FROM lst GROUP BY 1, 2")
def _(spark, sf):
    source, target, mark = (fresh_path(spark, n) for n in ("status", "progress", "marks"))
    D.status_events(spark, sf).repartition(8, "complex_id").write.parquet(source)
    live.start(live.read_events(spark, source, 4), target, mark).awaitTermination()
    return live.progress_counts(spark, target)


CONF = """cf AS (SELECT o_orderkey AS config_id, o_custkey % 70 AS protein_key, 't' || (o_custkey % 500) AS target_complex_id, 'o' || (o_orderkey % 3001) AS offtarget_complex_id FROM orders)"""


def configs(spark, sf):
    k, u = c("o_orderkey"), c("o_custkey")
    return D.table(spark, sf, "orders").select(
        k.alias("config_id"), (u % 70).alias("protein_key"), F.concat(F.lit("t"), u % 500).alias("target_complex_id"), F.concat(F.lit("o"), k % 3001).alias("offtarget_complex_id")
    )


@query(
    "agg_final_dataset",
    "WITH " + CONF + """, f AS (SELECT count(*)::DOUBLE AS total_complexes, count(DISTINCT protein_key)::DOUBLE AS unique_proteins, count(DISTINCT target_complex_id)::DOUBLE AS unique_targets,
      count(DISTINCT offtarget_complex_id)::DOUBLE AS unique_offtargets FROM cf), g AS (SELECT count(DISTINCT l_orderkey)::DOUBLE AS configs_with_poses, count(*)::DOUBLE AS total_poses,
      round(count(*) / count(DISTINCT l_orderkey), 6) AS avg_poses_per_config FROM lineitem), h AS (SELECT * FROM f, g)
    SELECT figure, value FROM (UNPIVOT h ON COLUMNS(*) INTO NAME figure VALUE value)""",
)
def _(spark, sf):
    poses = D.table(spark, sf, "lineitem").select(c("l_orderkey").alias("config_id"))
    return D.rounded(G.final_report(configs(spark, sf), poses))


@query("agg_final_top", "WITH " + CONF + " SELECT protein_key, count(*) AS n FROM cf GROUP BY 1 ORDER BY n DESC, protein_key LIMIT 10")
def _(spark, sf):
    return G.top_proteins(configs(spark, sf), 10)


COV = """e AS (SELECT o_custkey AS protein, CASE WHEN o_orderkey % 3 = 0 THEN 'target' ELSE 'off_target' END AS target_type, o_orderstatus FROM orders),
  x AS (SELECT protein, count(*) FILTER (target_type = 'target') AS target_expected, count(*) FILTER (target_type <> 'target') AS off_target_expected,
    count(*) FILTER (target_type = 'target' AND o_orderstatus <> 'F') AS target_actual, count(*) FILTER (target_type <> 'target' AND o_orderstatus <> 'F') AS off_target_actual FROM e GROUP BY 1),
  y AS (SELECT *, target_expected + off_target_expected - target_actual - off_target_actual AS missing, (target_expected > 0 AND target_actual = 0) OR (off_target_expected > 0 AND off_target_actual = 0) AS lost_side FROM x)"""


def cov(spark, sf):
    e = D.table(spark, sf, "orders").select(c("o_custkey").alias("protein"), F.when(c("o_orderkey") % 3 == 0, "target").otherwise("off_target").alias("target_type"), "o_orderstatus")
    return G.coverage(e, e.filter("o_orderstatus <> 'F'"), "protein")


@query("agg_coverage", "WITH " + COV + " SELECT * FROM y")
def _(spark, sf):
    return cov(spark, sf)


@query(
    "agg_coverage_rate",
    "WITH " + COV + """ SELECT CAST(sum(target_expected + off_target_expected) AS BIGINT) AS expected, CAST(sum(missing) AS BIGINT) AS missing,
      round(100 * (1 - sum(missing) / sum(target_expected + off_target_expected)), 6) AS success_rate, count(*) FILTER (lost_side) AS n_lost_side FROM y""",
)
def _(spark, sf):
    return D.rounded(G.coverage_rate(cov(spark, sf)))


OFF = """d AS (SELECT 'P' || l_suppkey AS protein, 'L' || (l_partkey % 60) AS ligand, CASE WHEN l_partkey % 4 = 0 THEN 'target' ELSE 'off_target' END AS target_type, CASE WHEN l_partkey % 60 < 30 THEN 'S' || (l_partkey % 60) END AS pdb FROM lineitem),
  t AS (SELECT DISTINCT protein, ligand AS target_id, pdb AS target_structure FROM d WHERE target_type = 'target' AND pdb IS NOT NULL),
  f AS (SELECT protein, count(DISTINCT ligand) AS n_off_targets, string_agg(DISTINCT ligand, ';' ORDER BY ligand) AS off_target_ids FROM d WHERE target_type = 'off_target' GROUP BY 1),
  s AS (SELECT t.protein, target_id, target_structure, n_off_targets, count(*) OVER (PARTITION BY t.protein) AS n_targets, off_target_ids, CAST(0 AS BIGINT) AS part FROM t JOIN f ON t.protein = f.protein)"""


def off(spark, sf):
    m = c("l_partkey") % 60
    d = D.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), "l_suppkey").alias("protein"), F.concat(F.lit("L"), m).alias("ligand"),
        F.when(c("l_partkey") % 4 == 0, "target").otherwise("off_target").alias("target_type"), F.when(m < 30, F.concat(F.lit("S"), m)).alias("pdb"),
    )
    return G.off_summary(d, "protein", "ligand", "pdb")


@query("agg_off_summary", "WITH " + OFF + " SELECT * FROM s")
def _(spark, sf):
    return off(spark, sf)


@query(
    "agg_off_thresholds",
    "WITH " + OFF + """ SELECT k AS threshold, count(DISTINCT protein) FILTER (n_targets >= k AND n_off_targets >= k) AS n_proteins FROM s, (SELECT unnest([1, 3, 5, 7, 10]) AS k) GROUP BY 1""",
)
def _(spark, sf):
    return G.off_thresholds(off(spark, sf), "protein", [1, 3, 5, 7, 10])


@query(
    "agg_per_complex",
    "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1",
)
def _(spark, sf):
    return D.rounded(G.per_complex(D.table(spark, sf, "orders"), "o_custkey", "o_totalprice"), 4)


@query("agg_seed_success", "SELECT l_linenumber AS seed, count(*) AS n, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = D.table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "seed")
    return D.rounded(G.seed_success(li, "seed", c("l_discount") < 0.05))


SRC = """s AS (SELECT l_orderkey AS row_id, 'src' || l_linenumber AS source, l_linenumber AS priority, 'p' || l_linenumber || '_' || min(l_partkey) AS path,
  CASE WHEN min(l_partkey) % 3 = 0 THEN CASE WHEN min(l_partkey) % 2 = 0 THEN 'HTTP 404' ELSE 'empty file' END END AS error, max(l_quantity) AS n_atoms FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def sources(spark, sf):
    x = D.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("n_atoms"))
    n = c("l_linenumber")
    return x.select(
        c("l_orderkey").alias("row_id"), F.concat(F.lit("src"), n).alias("source"), n.alias("priority"), F.concat(F.lit("p"), n, F.lit("_"), "p").alias("path"),
        F.when(c("p") % 3 == 0, F.when(c("p") % 2 == 0, "HTTP 404").otherwise("empty file")).alias("error"), "n_atoms",
    )


@query(
    "agg_fallback_source",
    "WITH " + SRC + """ SELECT row_id, arg_min(source, priority) FILTER (error IS NULL AND n_atoms <= 40) AS source, arg_min(path, priority) FILTER (error IS NULL AND n_atoms <= 40) AS path,
      count(error) AS n_errors, bool_or(error IS NULL AND n_atoms > 40) AS size_rejected FROM s GROUP BY 1""",
)
def _(spark, sf):
    return G.fallback_source(sources(spark, sf), "row_id", 40)


@query(
    "agg_source_errors",
    "WITH " + SRC + """ SELECT source, error, count(*) AS n, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) FILTER (rn <= 10) AS examples
      FROM (SELECT *, row_number() OVER (PARTITION BY source, error ORDER BY row_id) AS rn FROM s WHERE error IS NOT NULL) GROUP BY 1, 2""",
)
def _(spark, sf):
    return G.source_errors(sources(spark, sf), "row_id")
