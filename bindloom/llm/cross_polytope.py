"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector;
its bucket is the nearest signed axis. Every table has signs of its own. A query probes, per table,
the buckets of its largest signed coordinates, and meets the vectors there in blocks: one matrix
product per block gives the inner products of the original vectors, from which the best are kept.

For the largest inner product among vectors of different norms, vectors are parted into bands whose norms
differ by at most a quarter of a power of two, so that inside a band the nearest direction is about the
largest product. Every band has buckets of its own and every query probes all bands of its length.
Equal vectors are one class, of which no more ids travel than a result can hold. Large buckets are
cut into blocks of at most ``BLOCK`` vectors and queries, so no task holds a whole bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from bindloom.llm.common import written

BLOCK = 4096


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of the rows of x, whose width is a power of two."""
    n, d = x.shape
    signs = np.random.default_rng([31, table, d]).choice([-1.0, 1.0], (3, d))
    for row in signs:
        x = x * row
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            h *= 2
        x = x.reshape(n, d) / np.sqrt(d)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, padded to a power of two."""
    n, d = x.shape
    out = np.zeros((n, _width(d)))
    out[:, :d] = x / np.linalg.norm(x, axis=1)[:, None]
    return out


def _width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def _matrix(col: pa.Array, kind) -> np.ndarray:
    """Rows of a binary column of equally long vectors."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).astype(np.float64).reshape(len(col), -1)


def first_best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest scores of every row, ties to the smaller id."""
    best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    least = np.take_along_axis(scores, best, axis=1).min(axis=1)
    reach = scores >= least[:, None]
    for row in np.flatnonzero(reach.sum(axis=1) > n).tolist():
        tied = np.flatnonzero(reach[row])
        best[row] = tied[np.lexsort((ids[tied], -scores[row, tied]))[:n]]
    return best


def search(
    df: DataFrame,
    query_step: int = 20,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = 10,
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``query_step`` its ``k`` nearest found.

    ``probes`` buckets are probed per table, if None 7 for each 32 of the padded width and 14 at least.
    Nearness is the inner product in double precision, ties go to the smaller id, the query's own
    row is no candidate. Rows with a null id or a vector that is null, empty, zero or holds null or
    non-finite components take no part; vectors of different lengths never meet. A query that found
    fewer than ``k`` searches all buckets of one table, which is exact. Rows that repeat (id and
    vector) count once; one id with several vectors is one candidate per vector, and one query per
    vector. Extra columns are not read. An empty table gives an empty result.
    """
    c = F.col
    kind = np.float32 if "float" in df.schema[vector].dataType.simpleString() else np.float64
    rows = df.select(c(vec_id).cast("long").alias("id"), c(vector).alias("v")).filter("id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    first = W.partitionBy("v").orderBy("id")
    classes = rows.distinct().withColumn("rn", F.row_number().over(first)).filter(c("rn") <= k + 1).groupBy("v")
    classes = classes.agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter(c("id") % query_step == 0).distinct()
    classes = classes.join(asked.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left")
    # several vectors may share an id, so the vector's hash is part of the class's name
    # bands are centred on the powers, so that rounded unit vectors are one band
    band = F.coalesce(F.floor(4 * F.log2(norm) + 0.5), F.lit(-5000)).cast("long")
    classes = classes.select(F.struct(c("vid"), F.xxhash64("v").alias("h")).alias("cls"), "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks"), band.alias("band"))
    classes = written(classes, "vectors")
    # one row per length and band: as many as quarters of powers of two the norms span, whatever the input
    bands = {}
    for number, row in enumerate(classes.select(F.size("v").alias("d"), "band").distinct().orderBy("d", "band").collect()):
        bands.setdefault(row["d"], {})[row["band"]] = number

    def hashed(limit: int, query: bool):
        """Rows (bucket, id, h, vec) of data (one bucket per table) or queries (``limit`` buckets per table)."""

        def run(batches):
            for batch in batches:
                vid, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                vectors, lengths = batch.column(2), batch.column(3).to_numpy()
                for d in np.unique(lengths):
                    at = np.flatnonzero(lengths == d)
                    values = vectors.take(pa.array(at))
                    x = np.array(values.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(at), int(d))
                    raw = pa.array([r.tobytes() for r in x], pa.binary())
                    unit = _unit(x.astype(np.float64))
                    mine = None if query else batch.column(4).to_numpy()[at]
                    for t in range(tables if limit >= 0 else 1):
                        y = rotate(unit, t)
                        both = np.concatenate([y, -y], axis=1)
                        if not query:
                            axes = both.argmax(axis=1)[:, None]
                        elif limit < 0:
                            axes = np.broadcast_to(np.arange(both.shape[1]), both.shape)
                        else:
                            m = min(limit or max(14, 7 * y.shape[1] // 32), both.shape[1])
                            axes = np.argpartition(-both, m - 1, axis=1)[:, :m]
                        for band, number in bands[d].items():
                            to = np.arange(len(at)) if query else np.flatnonzero(mine == band)
                            bucket = (np.int64(number) << np.int64(32)) + (np.int64(t) << np.int64(24)) + axes[to]
                            back = np.repeat(to, axes.shape[1])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(bucket.reshape(-1)), pa.array(vid[at][back]), pa.array(h[at][back]), raw.take(pa.array(back))],
                                names=["bucket", "id", "h", "vec"],
                            )

        return run

    plain = ["cls.vid", "cls.h", "v", F.size("v").cast("long").alias("d"), "band"]
    schema = "bucket long, id long, h long, vec binary"

    def found(queries: DataFrame, limit: int) -> DataFrame:
        """Best classes per query class and block."""
        data = classes.select(*plain).mapInArrow(hashed(limit, False), schema)
        probe = queries.select(*plain).mapInArrow(hashed(limit, True), schema)
        sizes = data.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("cuts"))
        asks = probe.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("turns"))
        cuts = sizes.join(asks, "bucket")
        series = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), c(n) - 1))
        data = data.join(cuts, "bucket").withColumn("cut", F.pmod(F.xxhash64("id", "h"), c("cuts"))).withColumn("turn", series("turns"))
        probe = probe.join(cuts, "bucket").withColumn("turn", F.pmod(F.xxhash64("id", "h"), c("turns"))).withColumn("cut", series("cuts"))
        block = ["bucket", "cut", "turn"]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            x, q = (_matrix(t["vec"].combine_chunks(), kind) if t.num_rows else np.zeros((0, 1)) for t in (left, right))
            if not len(x) or not len(q):
                scores, at, best = np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
                n = 0
            else:
                full = q @ x.T
                n = min(k + 1, len(x))
                best = first_best(full, left["id"].to_numpy(), n)
                scores = np.take_along_axis(full, best, axis=1).reshape(-1)
                at = np.repeat(np.arange(len(q)), n)
            hit = pa.array(best.reshape(-1).astype(np.int64))
            mine, theirs = right.take(pa.array(at)), left.take(hit)
            return pa.table({"q": mine["id"], "qh": mine["h"], "id": theirs["id"], "h": theirs["h"], "score": pa.array(scores, pa.float64())})

        picked = data.select(*block, "id", "h", "vec").groupBy(*block).cogroup(probe.select(*block, "id", "h", "vec").groupBy(*block))
        return picked.applyInArrow(meet, "q long, qh long, id long, h long, score double")

    def ranked(hits: DataFrame, queries: DataFrame) -> DataFrame:
        hits = hits.groupBy("q", "qh", "id", "h").agg(F.max("score").alias("score"))
        w = W.partitionBy("q", "qh").orderBy(F.desc("score"), "id", "h")
        hits = hits.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= k + 1)
        ids = classes.select(c("cls.vid").alias("id"), c("cls.h").alias("h"), "ids")
        hits = hits.join(ids, ["id", "h"]).select("q", "qh", "score", F.explode("ids").alias("vec_id"))
        # every query row of a class gets the class's hits without its own id
        w = W.partitionBy("q", "qh").orderBy(F.desc("score"), "vec_id")
        hits = hits.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= k + 1)
        mine = hits.join(queries, ["q", "qh"]).filter(c("vec_id") != c("query_id"))
        w = W.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
        return mine.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)

    names = classes.filter("asks").select("v", c("cls.vid").alias("q"), c("cls.h").alias("qh"))
    queries = written(asked.join(names, "v").select(c("id").alias("query_id"), "q", "qh"), "queries")
    result = ["query_id", "qh", "rank", "vec_id", "score"]
    near = written(ranked(found(classes.filter("asks"), probes or 0), queries).select(*result), "neighbours")
    full = near.filter(c("rank") == k).select("query_id", "qh")
    short = written(queries.join(full, ["query_id", "qh"], "left_anti"), "short-queries")
    if not short.isEmpty():
        again = classes.join(short.select(F.struct(c("q").alias("vid"), c("qh").alias("h")).alias("cls")).distinct(), "cls", "left_semi")
        rest = ranked(found(again, -1), short).select(*result)
        near = near.join(short.select("query_id", "qh"), ["query_id", "qh"], "left_anti").select(*result).unionByName(rest)
    return near.select("query_id", c("rank").cast("int").alias("rank"), "vec_id", "score")
