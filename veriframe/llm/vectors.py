"""Query-block by candidate-block grid over vectors, shared by the two vector searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components; repeated rows count once. Floats stay floats: they move as such."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine
    )
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "v"])


def grid_topk(
    rows: DataFrame,
    every: int,
    k: int,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple],
    score_type: pa.DataType,
    query_block: int = 16384,
    candidate_block: int = 16384,
) -> DataFrame:
    """Top k of every query (vec_id divisible by `every`) among all other rows of equal dimension.

    Queries and candidates are dealt into blocks by a hash of the id; a task holds one query block
    and one candidate block, so memory does not depend on the table. It returns k rows a query;
    the best k over all candidate blocks are ranked with a partial limit before the shuffle.
    """
    n, q = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    nc, nq = -(-max(n, 1) // candidate_block), -(-max(q, 1) // query_block)
    h = F.xxhash64("vec_id")
    qb, cb = F.pmod(h, F.lit(nq)), F.pmod(F.shiftright(h, 20), F.lit(nc))
    base = rows.withColumn("dim", F.size("v"))
    every_c = F.sequence(F.lit(0), F.lit(nc - 1))
    every_q = F.sequence(F.lit(0), F.lit(nq - 1))
    asked = base.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim", F.lit(True).alias("asks"), qb.cast("int").alias("qb"), F.explode(every_c).alias("cb"))
    given = base.select("vec_id", "v", "dim", F.lit(False).alias("asks"), F.explode(every_q).alias("qb"), cb.cast("int").alias("cb"))
    kind = "long" if pa.types.is_integer(score_type) else "double"

    def cell(key, t):
        dim = key[0].as_py()
        ids = t.column("vec_id").to_numpy()
        flat = t.column("v").combine_chunks()
        x = np.asarray(flat.flatten()).astype(np.float64).reshape(len(ids), dim)
        asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        qid, rank, vid, score = search(ids[asks], x[asks], ids[~asks], x[~asks])
        return pa.table({"query_id": pa.array(qid, pa.int64()), "vec_id": pa.array(vid, pa.int64()), "score": pa.array(score, score_type)})

    found = asked.unionByName(given).groupBy("dim", "qb", "cb").applyInArrow(cell, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
