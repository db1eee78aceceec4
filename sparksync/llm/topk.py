"""Exact top-k inner products by norm buckets.

Vectors are cut into buckets of similar length, each a few thousand vectors in
descending length. A query's running k-th score and a bucket's longest vector
give a local cosine threshold. If it is above 1 no vector of the bucket can
enter the result. If it is near 1 few directions qualify, and coordinate
pruning looks at the query's largest coordinates: a vector whose coordinates lie
outside the feasible interval cannot reach the cosine. Otherwise length pruning
takes the prefix of the bucket that is long enough. What is left is verified by
exact integer products.

The first pass lets every query meet the longest vectors only, which gives its
starting threshold; the second meets all buckets. Queries travel in packed
blocks to every bucket, so neither side is ever whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparksync.session import checkpointed

BUCKET = 4096  # vectors in a bucket
QUERY_BLOCK = 512
STEEP = 0.9  # local thresholds from here on use coordinates
FOCUS = 4  # coordinates looked at


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of whole vectors; rows with nulls or non-finite components are left out."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    sound = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda c: c.isNotNull()), F.lit(False))
    finite = F.forall(x, lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(sound & finite).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with its ids and vectors side by side; a group has a bounded number of vectors."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("id", "v")).alias("rows"))


def _matrix(rows: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    inner = rows.values
    ids = np.asarray(inner.field("id"))
    vectors = np.asarray(inner.field("v").flatten()).reshape(len(ids), dim) if dim else np.zeros((len(ids), 0), np.int64)
    return ids, vectors


def search_bucket(ids, vectors, norms, query_ids, queries, floor, k):
    """(query row, id, score) of what may be among each query's k best, given its floor so far.

    ``vectors`` are in descending length, ``floor`` may be minus infinity.
    """
    out_q, out_id, out_s = [], [], []
    lengths = np.sqrt((queries.astype(float) ** 2).sum(1))
    for i, q in enumerate(queries):
        reach = lengths[i] * norms[0]
        n, need = len(ids), floor[i]
        if need > 0:
            # A hair below, so that rounding never loses an equal score.
            local = need / reach * (1 - 1e-9) if reach > 0 else np.inf
            if local > 1:
                continue
            n = int(np.searchsorted(-norms, -(need / lengths[i]) * (1 - 1e-9), "right"))  # length pruning
            if local >= STEEP and n > 64:
                unit = q / lengths[i]
                keep = np.ones(n, bool)
                rest = np.sqrt(max(0.0, 1 - local * local))
                for f in np.argsort(-np.abs(unit))[:FOCUS]:
                    # cos(p, q) >= local bounds each coordinate of the unit vector p.
                    middle, spread = unit[f] * local, np.sqrt(max(0.0, 1 - unit[f] ** 2)) * rest
                    at = vectors[:n, f] / np.maximum(norms[:n], 1e-300)
                    # Within the feasible cap the coordinate goes up to 1 where the query itself points.
                    low = middle - spread
                    high = 1.0 if unit[f] >= local else middle + spread
                    low = -1.0 if -unit[f] >= local else low
                    keep &= (at >= low - 1e-9) & (at <= high + 1e-9)
                chosen = np.flatnonzero(keep)
            else:
                chosen = np.arange(n)
        else:
            chosen = np.arange(n)
        scores = vectors[chosen] @ q
        found = ids[chosen]
        good = (found != query_ids[i]) & (scores >= need)
        scores, found = scores[good], found[good]
        if len(scores) > k:
            edge = np.partition(scores, -k)[-k]
            good = scores >= edge
            scores, found = scores[good], found[good]
            best = np.lexsort((found, -scores))[:k]
            scores, found = scores[best], found[best]
        out_q.append(np.full(len(found), query_ids[i]))
        out_id.append(found)
        out_s.append(scores)
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_id), join(out_s)


def _search(buckets: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each query in each bucket."""
    pairs = buckets.join(blocks, ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, asked, floors in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, vectors = _matrix(rows, dim.as_py())
                query_ids, queries = _matrix(asked, dim.as_py())
                norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
                order = np.argsort(-norms, kind="stable")
                by_id = dict(zip(floors.values.field("id").to_pylist(), floors.values.field("floor").to_pylist(), strict=True))
                floor = np.array([-np.inf if by_id.get(q) is None else by_id[q] for q in query_ids.tolist()])
                found = search_bucket(ids[order], vectors[order], norms[order], query_ids, queries, floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])

    return pairs.select("dim", "rows", "asked", "floors").mapInArrow(run, "query_id long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024
) -> DataFrame:
    """(query_id, rank, id, score) of the k largest integer inner products of each query.

    Ties go to the smaller id. All rows but those with the query's own id are
    candidates; repeated candidate rows are candidates each, a repeated query
    asks once. Vectors meet only vectors of as many components. Empty vectors
    score 0 with each other. Other columns are not read.
    """
    rows = quantised(vectors, id_col, vec_col, scale).withColumn("dim", F.size("v"))
    rows = checkpointed(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))))
    # Buckets are quantiles of length; a bucket of equal lengths is cut by a hash.
    total = rows.count()
    parts = -(-total // BUCKET) or 1
    cuts = [c for c in (rows.approxQuantile("norm", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else [])]
    level = F.aggregate(F.array(*map(F.lit, sorted(set(cuts)))), F.lit(0), lambda n, c: n + (F.col("norm") > c).cast("int")) if cuts else F.lit(0)
    rows = rows.withColumn("level", level)
    sizes = {(r.dim, r.level): r["count"] for r in rows.groupBy("dim", "level").count().collect()}
    if not sizes:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    slices = F.create_map(*(F.lit(x) for (d, lv), n in sizes.items() for x in (f"{d}/{lv}", -(-n // BUCKET))))
    slot = F.pmod(F.xxhash64("id"), slices[F.concat_ws("/", "dim", "level")])
    buckets = _packed(rows.withColumn("slot", slot), ["dim", "level", "slot"])
    asked = rows.filter(is_query).dropDuplicates(["id", "dim"])
    n_blocks = -(-asked.count() // QUERY_BLOCK) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    blocks = checkpointed(_packed(asked, ["dim", "block"]).withColumnRenamed("rows", "asked"))
    buckets = checkpointed(buckets).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    none = blocks.withColumn("floors", F.expr("cast(array() as array<struct<id:long,floor:long>>)"))
    top_level = rows.groupBy("dim").agg(F.max("level").alias("level"))
    first = _best(_search(buckets.join(F.broadcast(top_level), ["dim", "level"]), none, k), k)
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    floors = asked.select("id", "dim", "block").join(floors, "id").groupBy("dim", "block").agg(F.collect_list(F.struct("id", "floor")).alias("floors"))
    known = blocks.join(floors, ["dim", "block"], "left").withColumn("floors", F.coalesce("floors", F.expr("cast(array() as array<struct<id:long,floor:long>>)")))
    return _best(_search(buckets, checkpointed(known), k), k).select("query_id", "rank", "id", "score")
