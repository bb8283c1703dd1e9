"""Exact top-k inner-product search by norm buckets.

Candidates are grouped by length into buckets. From the k-th best score so far, the query's length
and the bucket's greatest length follows a local cosine threshold: a bucket in which it exceeds 1 is
skipped with all shorter ones; a low threshold scans the bucket's vectors that are long enough
(length pruning); a high one keeps those whose value on the query's largest coordinates lies in the
range that the threshold allows (coordinate pruning). What is left is verified by exact products.

The whole table is dealt into stripes by length, longest first. Every query meets the first stripe;
its k-th best score there says how many further stripes can hold a better one, and only these it is
sent to. Queries that need about as many stripes share a block, and a stripe goes only to blocks
that need it. A task has one stripe and one block, searches the stripe's own buckets as above, and
returns k rows a query, which are merged by score and id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.common import durable

#: Above this local cosine threshold, coordinate pruning is tried.
COORDINATE_FROM = 0.75
BUCKET = 1024
_NONE = -(2**62)  # below every score


def bucket_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k greatest scores, ties to the smaller id. A candidate
    with the query's id and vector is the query itself and no answer. least: for each query a score
    under which nothing is wanted. All int64; the scores are exact."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    vectors, ids, lengths = vectors[order], ids[order], lengths[order]
    exact = len(vectors) == 0 or float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2**52
    if len(vectors) and len(queries) and float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(vectors.astype(np.float64)).max()) * vectors.shape[1] >= 2**62:
        raise OverflowError("scores must fit 62 bits")
    as_float = vectors.astype(np.float64)
    own = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    best_score = np.full((len(queries), k), _NONE)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def products(rows: np.ndarray, start: int, stop: int) -> np.ndarray:
        if exact:
            return (queries[rows].astype(np.float64) @ as_float[start:stop].T).astype(np.int64)
        return queries[rows] @ vectors[start:stop].T

    def merge(rows: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
        """Takes scores (rows x candidates) of the candidates at `at` into the best k."""
        found = np.broadcast_to(ids[at], scores.shape)
        for i, j in zip(*np.nonzero(found == query_ids[rows, None])):
            if np.array_equal(queries[rows[i]], vectors[at[j]]):
                scores[i, j] = _NONE
        all_scores, all_ids = np.hstack((best_score[rows], scores)), np.hstack((best_id[rows], found))
        if all_scores.shape[1] > 4 * k:  # all that may be among the k: at least the k-th score
            kth = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
            width = int((all_scores >= kth[:, None]).sum(axis=1).max())
            top = np.argpartition(-all_scores, min(width, all_scores.shape[1]) - 1, axis=1)[:, :width]
            all_scores, all_ids = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best_score[rows], best_id[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    live = np.arange(len(queries))
    for start in range(0, len(vectors), bucket):
        stop = min(start + bucket, len(vectors))
        longest = lengths[start]
        kth = np.maximum(best_score[live, k - 1], least[live]).astype(np.float64)
        # a candidate needs length * own length >= score; a little slack for rounding
        reach = own[live] * longest * (1 + 1e-9) + 1e-6
        live = live[reach >= kth]
        if not len(live):
            break
        kth = np.maximum(best_score[live, k - 1], least[live]).astype(np.float64)
        local = np.where(kth > 0, kth / np.maximum(own[live] * longest, 1e-12), 0)
        sharp = (local >= COORDINATE_FROM) & (own[live] > 0)
        for rows in np.array_split(live[~sharp], max(1, np.count_nonzero(~sharp) // 256)):
            if len(rows):
                need = np.maximum(best_score[rows, k - 1], least[rows]).min() / max(own[rows].max(), 1e-12) * (1 - 1e-9) - 1e-6
                end = start + int(np.searchsorted(-lengths[start:stop], -need, side="right")) if need > 0 else stop
                if end > start:
                    merge(rows, products(rows, start, end), np.arange(start, end))
        if sharp.any():
            part, size = as_float[start:stop], np.maximum(lengths[start:stop], 1e-12)
            for row, t in zip(live[sharp].tolist(), np.minimum(local[sharp], 1).tolist()):
                unit = queries[row] / own[row]
                keep = np.ones(stop - start, dtype=bool)
                for f in np.argsort(-np.abs(unit))[:3]:
                    # cosine t at least: x * unit[f] + sqrt(1 - x^2) * sqrt(1 - unit[f]^2) >= t
                    spread = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-9
                    middle = t * unit[f]
                    x = part[:, f] / size
                    low = middle - spread if unit[f] > -t else -1.0
                    high = middle + spread if unit[f] < t else 1.0
                    keep &= (x >= low - 1e-9) & (x <= high + 1e-9)
                at = start + np.nonzero(keep)[0]
                if len(at):
                    scores = vectors[at] @ queries[row]
                    merge(np.array([row]), scores[None, :], at)
    rows, ranks = np.nonzero(best_id != np.iinfo(np.int64).max)
    real = (best_score[rows, ranks] != _NONE) & (best_score[rows, ranks] >= least[rows])
    rows, ranks = rows[real], ranks[real]
    return rows, best_id[rows, ranks], best_score[rows, ranks]


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v array<long>, dim): floor(scale * x) of every component. Rows with a null id, a null
    vector or a component that is null, infinite or not a number are left out."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("scores must fit 62 bits")).cast("long"))
    return rows.where(~F.coalesce(bad, F.lit(False))).select("id", F.transform("v", whole).alias("v"), F.size("v").alias("dim"))


def _edges(rows: DataFrame, value: str, parts: int) -> DataFrame:
    """(dim, edges): for each dimension the values, falling, that cut its rows into equal parts."""
    cuts = [1 - i / parts for i in range(1, parts)]
    edges = F.percentile_approx(value, cuts, max(10_000, 20 * parts)) if cuts else F.collect_list(F.lit(None).cast("double"))
    return F.broadcast(rows.groupBy("dim").agg(edges.alias("edges")))  # one row a dimension


def _dealt(value: str) -> Column:
    """The part that value falls into; rows on an edge are spread over the parts that meet there."""
    low = F.size(F.filter("edges", lambda e: e > F.col(value)))
    high = F.size(F.filter("edges", lambda e: e >= F.col(value)))
    return (low + F.pmod(F.monotonically_increasing_id(), high - low + 1)).cast("int")


def _largest(rows: DataFrame, part: str, value: str, parts: int) -> DataFrame:
    """(dim, tops): for each dimension an array of the parts' largest values, -1 where a part is empty."""
    own = rows.groupBy("dim", part).agg(F.max(value).cast("double").alias("top")).groupBy("dim").agg(F.map_from_entries(F.collect_list(F.struct(part, "top"))).alias("m"))
    tops = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(-1.0)))
    return F.broadcast(own.select("dim", tops.alias("tops")))  # one row a dimension


def top_k(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", stripe: int = 16384, block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k greatest
    integer inner products with all other rows, fewer if there are fewer rows; ties to smaller ids.

    Vectors of different dimensions are never compared. A row is known by its id and its vector: of
    rows that share an id each is a query, with its own k answers, and each may answer the others;
    rows equal in both are one query, which none of them answers. The largest components' product times the dimension
    must stay below 2 ** 62, or the job fails: scores never wrap. Rows that
    whole_vectors leaves out take no part.
    """
    from lemmaflow.llm.topk import bucket_search as search

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = whole_vectors(table, id_col, vector_col).select("dim", "id", "v", F.xxhash64("v").alias("h"))
    counts = rows.groupBy("dim").count().collect()  # a row for each dimension that occurs
    most = max((r["count"] for r in counts), default=0)
    stripes, blocks = max(1, -(-most // stripe)), max(1, -(-most // every // block))
    striped = rows.withColumns({"norm": F.lit(0.0), "s": F.lit(0)})
    if stripes > 1:
        longs = durable(rows.withColumn("norm", length))
        striped = durable(longs.join(_edges(longs, "norm", stripes), "dim").withColumn("s", _dealt("norm")).drop("edges"))
    queries = striped.where(F.col("id") % every == 0).drop("s").dropDuplicates(["id", "h", "v"])

    def matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
        values = t.column("v").combine_chunks()
        flat = values.flatten() if isinstance(values, pa.ListArray) else pa.concat_arrays([x.flatten() for x in values.chunks])
        return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dim), t.column("id").to_numpy().astype(np.int64)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        dim = key[0].as_py()
        (qs, q_ids), (vs, v_ids) = matrix(left, dim), matrix(right, dim)
        at, found, scores = search(qs, q_ids, vs, v_ids, k, left.column("least").to_numpy().astype(np.int64))
        return pa.table({"query_id": pa.array(q_ids[at]), "h": pa.array(left.column("h").to_numpy()[at]), "vec_id": pa.array(found), "score": pa.array(scores)})

    def meet(q: DataFrame, c: DataFrame) -> DataFrame:
        keys = ["dim", "b", "s"]
        q, c = q.select(*keys, "id", "h", "v", "least"), c.select(*keys, "id", "v")
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(answer, "query_id long, h long, vec_id long, score long")

    all_blocks = F.sequence(F.lit(0), F.lit(blocks - 1))
    near = meet(
        queries.withColumns({"b": F.pmod("h", F.lit(blocks)).cast("int"), "s": F.lit(0), "least": F.lit(_NONE)}),
        striped.where("s = 0").withColumn("b", F.explode(all_blocks)),
    )
    if stripes > 1:
        near = durable(near)
        kth = near.groupBy("query_id", "h").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        reach = lambda t: t * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.coalesce("kth", F.lit(_NONE))
        depth = F.coalesce(F.array_max(F.transform("tops", lambda t, i: F.when((i > 0) & reach(t), i))), F.lit(0))  # the last stripe that may help
        far = queries.withColumnRenamed("id", "query_id").join(kth, ["query_id", "h"], "left").join(_largest(striped, "s", "norm", stripes), "dim")
        far = durable(far.select("dim", F.col("query_id").alias("id"), "h", "v", F.coalesce("kth", F.lit(_NONE)).alias("least"), depth.alias("depth")).where("depth > 0"))
        far = durable(far.join(_edges(far, "depth", blocks), "dim").withColumn("b", _dealt("depth")).drop("edges"))
        needs = F.filter(all_blocks, lambda b: F.get("tops", b) >= F.col("s"))
        more = meet(far.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("depth")))), striped.where("s > 0").join(_largest(far, "b", "depth", blocks), "dim").withColumn("b", F.explode(needs)))
        near = near.union(more)
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
