"""Similarity and novelty of embedded candidates, within their island or among all."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, FloatType, IntegerType, StructField, StructType

from lemmaflow.operators import rounds


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(0.0)


#: Rows of a block, about.
BLOCK = 4096
#: Similarities are rounded to so many digits, so that equal vectors tie wherever they are compared.
DIGITS = 12


class Cells:
    """Unit vectors around pivots. A cell's greatest angle to its pivot bounds what any of its rows can
    have in common with a query, by the triangle inequality of angles."""

    def __init__(self, units: np.ndarray) -> None:
        self.units = units
        pivots = np.arange(0, len(units), max(1, int(len(units) ** 0.5)))
        closeness = units @ units[pivots].T
        own = closeness.argmax(axis=1)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(pivots) + 1))
        self.cells = [order[low:high] for low, high in zip(cuts, cuts[1:])]
        angle = np.arccos(np.clip(closeness[np.arange(len(units)), own], -1, 1))
        self.radius = np.array([angle[c].max() if len(c) else 0.0 for c in self.cells])
        self.pivots = units[pivots]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell, what no row of the cell exceeds."""
        apart = np.arccos(np.clip(queries @ self.pivots.T, -1, 1)) - self.radius
        return np.cos(np.clip(apart, 0, np.pi)) + 1e-7  # arccos is coarse near 1

    def products(self, queries: np.ndarray, cell: int, which: np.ndarray) -> np.ndarray:
        return np.round(queries[which] @ self.units[self.cells[cell]].T, DIGITS)


def _matrices(t: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """ids, and by dimension the row numbers and unit vectors of the usable rows: not empty, of finite numbers, not all 0."""
    ids, by = t.column("id").to_numpy(), {}
    lengths = pc.fill_null(pc.list_value_length(t.column("v")), 0).to_numpy()
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.nonzero(lengths == dim)[0]
        flat = pc.list_flatten(t.column("v").take(pa.array(at))).combine_chunks()
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(np.float64)
        norm = np.sqrt((values**2).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            by[dim] = at[good], values[good] / norm[good, None]
    return ids, by


def _blocks(df: DataFrame, group: str | None, block: int) -> DataFrame:
    """(g, b, rows): the table (id, v) of each block as one binary value, written once. What is held for a group is its number of blocks."""
    kind = df.schema["embedding"].dataType.elementType
    own = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if isinstance(kind, FloatType) else "array<double>").alias("v"))
    sizes = own.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = own.join(F.broadcast(sizes), "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t, out = t.select(["id", "v"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as stream:
            stream.write_table(t.combine_chunks())
        return pa.table({"g": [key[0].as_py()], "b": [key[1].as_py()], "rows": [out.getvalue().to_pybytes()]}, packed)

    packed = pa.schema([("g", to_arrow_type(own.schema["g"].dataType)), ("b", pa.int32()), ("rows", pa.binary())])
    return rounds.written(dealt.groupBy("g", "b").applyInArrow(pack, StructType([own.schema["g"], StructField("b", IntegerType()), StructField("rows", BinaryType())])))


def _compared(queries: DataFrame, rows: DataFrame, group: str | None, block: int, answer: Callable, schema: str) -> DataFrame:
    """Each block of queries meets each block of rows of its group. Tasks read the files of two parts of the blocks: no row is copied
    and shuffled for the blocks that it meets, so disk grows with the rows, not with their square. answer(left, rights) is given a block of
    queries and, one after the other, the blocks that meet it in a task, and yields columns."""
    right = _blocks(rows, group, block)
    left = right if queries is rows else _blocks(queries, group, block)
    q, r = left.select("g", F.col("b").alias("qb"), F.col("rows").alias("left")), right.select("g", F.col("rows").alias("right"))
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda value: pa.ipc.open_stream(value.as_buffer()).read_all()
        pairs = ((b.column("g")[k].as_py(), b.column("qb")[k].as_py(), b.column("left")[k], b.column("right")[k]) for b in batches for k in range(b.num_rows))
        for _, met in itertools.groupby(pairs, lambda pair: pair[:2]):
            first = next(met)
            for columns in answer(table(first[2]), (table(pair[3]) for pair in itertools.chain([first], met))):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    pairs = q.join(r.hint("shuffle_replicate_nl"), "g") if group else q.crossJoin(r.drop("g").hint("shuffle_replicate_nl"))
    return pairs.select("g", "qb", "left", "right").mapInArrow(run, schema)


def _by_pair(answer: Callable) -> Callable:
    return lambda left, rights: (answer(left, right) for right in rights)


def most_similar(queries: DataFrame, rows: DataFrame, k: int = 1, group: str | None = "island_idx", block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of its group that are most like each query, a row of its id left
    out; ties to the smaller id. group None: of all rows. Vectors that are null, empty, of another
    length, all 0 or not finite have similarity 0, as in cosine(). ids are whole numbers.

    Blocks of queries and rows meet as matrices, and a task keeps the k best so far; within a block, cells of rows whose bound is below a
    query's k-th best are skipped. Where a group's vectors lie equally far from each other nothing is skipped: queries times rows."""

    def answer(left: pa.Table, rights: Iterator[pa.Table]) -> Iterator[list]:
        q_ids, q_by = _matrices(left)
        score, found = np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64)

        def take(which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
            ids = np.broadcast_to(ids, scores.shape)
            scores = np.where(ids == q_ids[which, None], -np.inf, scores)
            scores, ids = np.hstack((score[which], scores)), np.hstack((found[which], ids))
            best = np.lexsort((ids, -scores), axis=1)[:, :k]
            score[which], found[which] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)

        for right in rights:
            r_ids, r_by = _matrices(right)
            for dim, (at, units) in r_by.items():
                if dim not in q_by:
                    continue
                which, own = q_by[dim]
                cells = Cells(units)
                bounds = cells.bounds(own)
                nearest = bounds.argmax(axis=1)
                for first in (True, False):  # the most promising cell of each query, then those that may still help
                    for c in range(len(cells.cells)):
                        some = np.nonzero((nearest == c) if first else (nearest != c) & (bounds[:, c] >= score[which, k - 1]))[0]
                        if len(some) and len(cells.cells[c]):
                            raw = own[some] @ cells.units[cells.cells[c]].T
                            better = raw.max(axis=1) >= score[which[some], k - 1] - 10.0 ** (1 - DIGITS)  # rounding takes no more
                            if better.any():
                                take(which[some[better]], np.round(raw[better], DIGITS), r_ids[at[cells.cells[c]]])
            # what cannot be compared has similarity 0; of these only the smallest ids can count
            fit = {int(w): dim for dim, (which, _) in q_by.items() for w in which}
            for dim in {*fit.values(), None}:
                which = np.array([w for w in range(len(q_ids)) if fit.get(w) == dim])
                alike = np.zeros(len(r_ids), bool)
                if dim in r_by:
                    alike[r_by[dim][0]] = True
                others = np.sort(r_ids[~alike])[: k + 1]
                if len(which) and len(others):
                    take(which, np.zeros((len(which), len(others))), others)
        rows_, ranks = np.nonzero(score > -np.inf)
        yield [q_ids[rows_], found[rows_, ranks], score[rows_, ranks]]

    met = _compared(queries, rows, group, block, answer, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def similarities(queries: DataFrame, rows: DataFrame, group: str | None = "island_idx", block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity) of each query with every row of its group, its own id too: the whole list. Made for a stated set of
    queries; a row for each pair is the result."""

    def answer(left: pa.Table, right: pa.Table) -> list:
        (q_ids, q_by), (r_ids, r_by) = _matrices(left), _matrices(right)
        out = np.zeros((len(q_ids), len(r_ids)))
        for dim in q_by.keys() & r_by.keys():
            out[np.ix_(q_by[dim][0], r_by[dim][0])] = np.round(q_by[dim][1] @ r_by[dim][1].T, DIGITS)
        return [np.repeat(q_ids, len(r_ids)), np.tile(r_ids, len(q_ids)), out.ravel()]

    return _compared(queries, rows, group, block, _by_pair(answer), "query_id long, id long, similarity double")


def novelty(queries: DataFrame, rows: DataFrame, threshold: float = 0.95, generation: str | None = None, group: str | None = "island_idx", block: int = BLOCK) -> DataFrame:
    """(query_id, similarity, novel): each query's greatest similarity with an earlier row of its group, and whether it is novel:
    at most the threshold, nothing to compare, or of generation 0 (a column of queries, if named), which is not
    compared. Blocks meet as matrices and keep one maximum a query."""
    tested = queries.where(F.coalesce(F.col(generation) != 0, F.lit(True))) if generation else queries

    def answer(left: pa.Table, right: pa.Table) -> list:
        (q_ids, q_by), (r_ids, r_by) = _matrices(left), _matrices(right)
        best = np.where(r_ids.min() < q_ids, -2.0, -np.inf)
        for dim in q_by.keys() & r_by.keys():
            (which, own), (at, units) = q_by[dim], r_by[dim]
            cells = Cells(units)
            bounds = cells.bounds(own)
            for c in np.argsort(-bounds.max(axis=0)):
                some = np.nonzero(bounds[:, c] > best[which])[0]
                some = some[r_ids[at[cells.cells[c]]].min() < q_ids[which[some]]] if len(some) and len(cells.cells[c]) else some[:0]
                if len(some):
                    earlier = r_ids[at[cells.cells[c]]] < q_ids[which[some], None]
                    best[which[some]] = np.maximum(best[which[some]], np.where(earlier, cells.products(own, c, some), -2.0).max(axis=1))
        # an earlier row that cannot be compared counts with 0
        fit = {int(w): dim for dim, (which, _) in q_by.items() for w in which}
        first = {None: r_ids.min()}
        for dim in q_by:
            apart = np.delete(r_ids, r_by[dim][0]) if dim in r_by else r_ids
            first[dim] = apart.min() if len(apart) else np.iinfo(np.int64).max
        for w in np.nonzero((best > -np.inf) & (best < 0))[0].tolist():
            if first[fit.get(w)] < q_ids[w]:
                best[w] = 0.0
        some = best > -2.0
        return [q_ids[some], best[some]]

    met = _compared(tested, rows, group, block, _by_pair(answer), "query_id long, similarity double").groupBy("query_id").agg(F.max("similarity").alias("similarity"))
    out = queries.select(F.col("id").alias("query_id")).join(met, "query_id", "left")
    return out.withColumn("novel", F.coalesce(F.col("similarity") <= threshold, F.lit(True)).cast("int"))


def similar_pairs(rows: DataFrame, threshold: float, group: str = "island_idx", block: int = BLOCK) -> DataFrame:
    """(island_idx, a, b, similarity) of all pairs of a group, a before b, whose cosine is at least the threshold;
    vectors that cannot be compared have no pairs. Blocks meet as matrices, cells whose bound is below the
    threshold are skipped, and only pairs over the threshold leave a task."""

    def answer(left: pa.Table, right: pa.Table) -> list:
        (a_ids, a_by), (b_ids, b_by) = _matrices(left), _matrices(right)
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for dim in a_by.keys() & b_by.keys():
            (which, own), (at, units) = a_by[dim], b_by[dim]
            cells = Cells(units)
            bounds = cells.bounds(own)
            for c, members in enumerate(cells.cells):
                some = np.nonzero(bounds[:, c] >= threshold)[0]
                if len(some) and len(members):
                    scores, ids = cells.products(own, c, some), b_ids[at[members]]
                    i, j = np.nonzero((scores >= threshold) & (a_ids[which[some], None] < ids))
                    for column, values in zip(out, (a_ids[which[some[i]]], ids[j], scores[i, j])):
                        column.append(values)
        return [np.concatenate(c) for c in out]

    pairs = _compared(rows, rows, group, block, _by_pair(answer), "a long, b long, similarity double")
    return pairs.join(rows.select(F.col("id").alias("a"), group), "a").select(F.col(group).alias("island_idx"), "a", "b", "similarity")


def principal_components(rows: DataFrame, dims: int = 2) -> DataFrame:
    """(id, pca): standardised vectors on their first principal components. The sign of a component is
    arbitrary. Vectors that are null or hold nulls or non-finite numbers are left out."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    table = rows.where(good).select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(table).transform(table)
    return PCA(k=dims, inputCol="scaled", outputCol="pca").fit(scaled).transform(scaled).select("id", vector_to_array("pca").alias("pca"))


def clusters(rows: DataFrame, k: int = 4, dims: int = 3, seed: int = 0) -> DataFrame:
    """(id, cluster) by a Gaussian mixture over the first principal components; cluster is null where
    there are fewer than k usable vectors."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    table = principal_components(rows, dims).select("id", array_to_vector("pca").alias("features"))
    if table.count() < k:
        return rows.select("id", F.lit(None).cast("int").alias("cluster"))
    return GaussianMixture(k=k, seed=seed, predictionCol="cluster").fit(table).transform(table).select("id", "cluster")
