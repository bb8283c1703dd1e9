"""Hard negatives: rows of other labels that score almost as high against an anchor as its positives.

Candidates are dealt into blocks. A block's task lifts its vectors onto a sphere, by one more
coordinate that makes all lengths equal, and builds a cover tree over them: nets of halving radii, each
holding the last one's centres, a new centre lying farther than the level's radius from all others.
The tree is written as a row. On the sphere an inner product follows from a distance, so a node's
covering radius bounds the products of all that lies under it from above and from below. An anchor
descends a block's tree best bound first, skips the nodes whose bounds miss all of its windows or
cannot improve them, and verifies the rest exactly. Blocks' answers are merged by score and id.

Two descents are made: for an anchor's positives (one window without limits over its own label), then for
the negatives (a window for each positive over the other labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.common import durable

#: Nodes of so few rows are verified whole; a descent opens so many nodes at once, and among them leaves until so many rows
#: are verified.
LEAF, OPEN, VERIFY = 16, 64, 64
_LOW, _HIGH = -(2**62), 2**62  # beyond every score

TREE = "dim int, c int, ids binary, labels binary, rows binary, centre binary, radius binary, start binary, stop binary, child binary"
ANSWER = "id long, h long, w int, found long, score long"


def nets(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The cover tree's levels: owner[x], the centre (a row number) that covers row x, level by level.

    A level's radius is half the last one's; its centres are farther than that from each other, and
    each was covered by its parent within the last radius. Rows whose node has no more than `leaf` rows
    become no centres of their own."""
    sizes = (points**2).sum(axis=1)
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    near, parents, radius = np.zeros(len(points), np.int64), [], float(far.max())
    while len(parents) < 64:
        radius /= 2
        big = np.bincount(near, minlength=len(points))[near] > leaf
        if not (big & (far > 0)).any():
            break
        parent, before = np.arange(len(points)), near.copy()
        waiting = np.nonzero(big & (far > radius))[0]
        while len(waiting):
            some = waiting[:256]
            between = np.sqrt(np.maximum(sizes[some, None] + sizes[some] - 2 * points[some] @ points[some].T, 0.0))
            free, chosen = np.ones(len(some), bool), []
            for i in range(len(some)):
                if free[i]:
                    chosen.append(i)
                    free &= between[i] > radius
            new = some[chosen]
            parent[new] = before[new]
            apart = np.sqrt(np.maximum(sizes[:, None] + sizes[new] - 2 * points @ points[new].T, 0.0))
            at = apart.argmin(axis=1)
            least = apart[np.arange(len(points)), at]
            closer = least < far
            far[closer], near[closer] = least[closer], new[at[closer]]
            far[new], near[new] = 0.0, new
            waiting = waiting[far[waiting] > radius]
        parents.append(parent)
    owner = [near]
    for parent in reversed(parents):
        owner.insert(0, parent[owner[0]])
    return owner


def lifted(rows: np.ndarray) -> np.ndarray:
    """rows with a coordinate more, which makes all lengths equal to the greatest."""
    sizes = (rows**2).sum(axis=1)
    return np.column_stack((rows, np.sqrt(np.maximum(sizes.max(initial=0.0) - sizes, 0.0))))


def cover_tree(rows: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """order: the rows' numbers, so that a node's rows lie together; longest: the greatest length; and for
    every node, the root first, its centre (a place in that order), covering radius, rows start to stop and
    children (two numbers, from and to; equal for a leaf). Lengths beyond the range of floats give one leaf."""
    with np.errstate(over="ignore", invalid="ignore"):
        points, longest = lifted(rows), np.sqrt((rows**2).sum(axis=1).max(initial=0.0))
    owner = nets(points, leaf) if len(rows) and np.isfinite(points).all() and np.isfinite((points**2).sum(axis=1)).all() else [np.zeros(len(rows), np.int64)]
    order = np.lexsort(owner[::-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    levels, fresh, sorted_points = [], np.zeros(len(rows), bool), points[order]
    for own in owner:
        fresh[:1] = True
        fresh[1:] |= own[order][1:] != own[order][:-1]
        start = np.nonzero(fresh)[0]
        stop = np.append(start[1:], len(rows)) if len(rows) else start
        centre = place[own[order][start]]
        with np.errstate(over="ignore", invalid="ignore"):
            spread = np.sqrt(((sorted_points - sorted_points[np.repeat(centre, stop - start)]) ** 2).sum(axis=1))
        levels.append((start, stop, centre, np.maximum.reduceat(spread, start) if len(start) else spread))
    child, offset = [], 0
    for k, (start, stop, _, _) in enumerate(levels):
        offset += len(start)
        last = k + 1 == len(levels)
        child.append(np.full(len(start) + 1, offset) if last else offset + np.searchsorted(levels[k + 1][0], np.append(start, len(rows))))
    start, stop, centre, radius = (np.concatenate([x[i] for x in levels]) for i in range(4))
    pairs = np.concatenate([np.column_stack((c[:-1], c[1:])) for c in child])
    pairs[stop - start <= leaf] = 0
    return {"order": order, "longest": longest, "start": start, "stop": stop, "centre": centre, "radius": radius, "child": pairs}


def products(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows with q, as int64; OverflowError beyond 62 bits."""
    if len(a) == 0:
        return np.zeros(0, np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**53:
        return (a @ q).astype(np.int64)
    whole = [int(x) for x in q]
    scores = [sum(int(x) * y for x, y in zip(row, whole)) for row in a]
    if any(not _LOW < s < _HIGH for s in scores):
        raise OverflowError("scores must fit 62 bits")
    return np.array(scores, np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers low[0] to high[0], low[1] to high[1] and so on in one array."""
    n = high - low
    if not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def descend(tree: dict[str, np.ndarray], rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window low[j] to high[j] the scores and ids of the first k allowed rows in it, greater scores first, ties
    by id; and how many rows were verified. rows, ids and allowed lie in the tree's order."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
    least = low.astype(np.float64)
    if not len(rows) or not len(low):
        return best, 0
    with np.errstate(over="ignore", invalid="ignore"):
        whole = float((q**2).sum() + tree["longest"] ** 2)

    def bounds(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            at = tree["centre"][nodes]
            far = np.sqrt(np.maximum(whole - 2 * (rows[at] @ q), 0.0))  # from q, lifted by 0
            r = tree["radius"][nodes]
            slack = 1e-7 * whole + 1e-6  # rounding costs far up to 1e-8 of the root of whole
            upper = (whole - np.maximum(far - r, 0.0) ** 2) / 2 + slack
            lower = (whole - (far + r) ** 2) / 2 - slack
        return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)

    nodes, seen = np.zeros(1, np.int64), 0
    lower, upper = bounds(nodes)
    while len(nodes):
        useful = ((upper[:, None] >= least) & (lower[:, None] <= high)).any(axis=1)
        nodes, lower, upper = nodes[useful], lower[useful], upper[useful]
        if not len(nodes):
            break
        first = np.argsort(-upper, kind="stable")
        children, size = tree["child"][nodes[first[:OPEN]]], (tree["stop"] - tree["start"])[nodes[first[:OPEN]]]
        leaf = children[:, 0] == children[:, 1]
        before = np.cumsum(size * leaf) - size * leaf  # rows of better leaves, which are verified first
        open_now = ~leaf | (before < VERIFY)
        now, later = first[:OPEN][open_now], np.concatenate((first[:OPEN][~open_now], first[OPEN:]))
        opened, children, leaves = nodes[now], children[open_now], leaf[open_now]
        if leaves.any():
            at = _ranges(tree["start"][opened[leaves]], tree["stop"][opened[leaves]])
            at = at[allowed[at]]
            seen += len(at)
            scores = products(rows[at], q)
            for j in range(len(low)):
                inside = (scores >= low[j]) & (scores <= high[j])
                if inside.any():
                    s, i = np.append(best[j][0], scores[inside]), np.append(best[j][1], ids[at[inside]])
                    keep = np.lexsort((i, -s))[:k]
                    best[j] = (s[keep], i[keep])
                    if len(keep) == k:
                        least[j] = max(float(low[j]), float(best[j][0][-1]))
        down = _ranges(children[~leaves, 0], children[~leaves, 1])
        below = bounds(down) if len(down) else (np.zeros(0), np.zeros(0))
        nodes, lower, upper = (np.concatenate((x[later], y)) for x, y in zip((nodes, lower, upper), (down, *below)))
    return best, seen


def _matrix(values: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([x.flatten() for x in values.chunks]) if values.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), dim)


def labelled_vectors(table: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v array<double> of floor(scale * x), dim, h: a hash of the row). Rows with a null id, label
    or vector, or with a component that is null, infinite or not a number, are left out."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where("id is not null and label is not null and v is not null").where(~F.coalesce(bad, F.lit(False)))
    # doubles of 2 ** 53 and more are whole
    floored = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return whole.select("id", "label", floored.alias("v"), F.size("v").alias("dim"), F.xxhash64("id", "label", "v").alias("h"))


def hard_negatives(
    table: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = 4096, anchor_block: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the vectors' components, each floor(scale * x). anchors: a condition on
    (id, label); label: what a row's label becomes, of the same columns. An anchor's positives are its
    first `positives` other rows of the same label; for each of them come the first k rows of other labels with
    low * positive score <= 100 * negative score <= high * positive score. Greater scores come first,
    ties by smaller id; fewer rows come where there are fewer.

    Vectors of different dimensions are never compared. Rows equal in id, label and vector are one row;
    rows that share only an id are different rows, each an anchor of its own. Rows that labelled_vectors
    leaves out take no part. Scores must fit 62 bits, or the job fails with an OverflowError. Labels
    are whole numbers. Other columns are not read. No rows give no rows.

    Every anchor meets every block of rows: the work is anchors times rows where the bounds skip nothing, as
    on vectors that lie about equally far from each other.
    """
    rows = labelled_vectors(table, id_col, label_col, vector_col, scale)
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    counts = {r["dim"]: (r["n"], r["a"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.when(anchors, 1).otherwise(0)).alias("a")).collect()}  # a row for each dimension
    parts = max([1, *(-(-n // block) for n, _ in counts.values())])
    groups = max([1, *(-(-a // anchor_block) for _, a in counts.values())])

    def build(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        vectors, ids, labels = _matrix(t.column("v"), dim), t.column("id").to_numpy().astype(np.int64), t.column("label").to_numpy().astype(np.int64)
        _, one = np.unique(np.column_stack((vectors.view(np.int64).reshape(len(ids), dim), ids, labels)), axis=0, return_index=True)
        vectors, ids, labels = vectors[one], ids[one], labels[one]
        tree = cover_tree(vectors)
        order = tree["order"]
        blobs = {"ids": ids[order], "labels": labels[order], "rows": vectors[order], **{x: tree[x] for x in ("centre", "radius", "start", "stop", "child")}}
        return pa.table({"dim": pa.array([dim], pa.int32()), "c": pa.array([key[1].as_py()], pa.int32()), **{x: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for x, v in blobs.items()}})

    trees = durable(rows.withColumn("c", F.pmod("h", F.lit(parts)).cast("int")).groupBy("dim", "c").applyInArrow(build, TREE))
    everywhere = trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = durable(rows.where(anchors).dropDuplicates(["id", "label", "h", "v"]).withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(groups)).cast("int")))

    def search(queries: DataFrame, same: bool, most: int) -> DataFrame:
        """The first `most` rows in each of the windows of each query, over all blocks."""

        def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], [], []]
            if left.num_rows and right.num_rows:
                dim = key[0].as_py()
                one = {x: right.column(x)[0].as_py() for x in right.column_names if pa.types.is_binary(right.column(x).type)}
                tree = {x: np.frombuffer(one[x], np.float64 if x == "radius" else np.int64) for x in ("centre", "radius", "start", "stop", "child")}
                tree["child"] = tree["child"].reshape(-1, 2)
                ids, labels = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["labels"], np.int64)
                vectors = np.frombuffer(one["rows"], np.float64).reshape(len(ids), dim)
                with np.errstate(over="ignore"):
                    tree["longest"] = np.sqrt((vectors**2).sum(axis=1).max(initial=0.0))
                qs = _matrix(left.column("v"), dim)
                for q, id_, h, own, lows, highs in zip(qs, *(left.column(x).to_pylist() for x in ("id", "h", "label", "low", "high"))):
                    allowed = labels == own if same else labels != own
                    if same:  # the anchor itself is no other row
                        twin = np.nonzero(ids == id_)[0]
                        allowed[twin[(vectors[twin] == q).all(axis=1)]] = False
                    best, _ = descend(tree, vectors, ids, allowed, q, np.array(lows, np.int64), np.array(highs, np.int64), most)
                    for j, (scores, found) in enumerate(best):
                        for column, values in zip(out, ([id_] * len(found), [h] * len(found), [j] * len(found), found.tolist(), scores.tolist())):
                            column += values
            return pa.table({n: pa.array(x, pa.int32() if n == "w" else pa.int64()) for n, x in zip(("id", "h", "w", "found", "score"), out)})

        meeting = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = meeting.groupBy("dim", "b", "c").cogroup(everywhere.groupBy("dim", "b", "c")).applyInArrow(answer, ANSWER)
        rank = F.row_number().over(Window.partitionBy("id", "h", "w").orderBy(F.desc("score"), "found"))
        return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most)

    kind = "array<bigint>"
    near = durable(search(asked.withColumns({"low": F.array(F.lit(_LOW)).cast(kind), "high": F.array(F.lit(_HIGH)).cast(kind)}), True, positives).select("id", "h", F.col("rank").alias("place"), "found", "score"))
    found = F.array_sort(F.collect_list(F.struct("place", "found", "score")))  # `positives` of an anchor at most
    windows = asked.join(near.groupBy("id", "h").agg(found.alias("found")), ["id", "h"])
    span = windows.select("dim", "b", "id", "h", "label", "v", F.transform("found", lambda x: _percent(x["score"], low, 99)).alias("low"), F.transform("found", lambda x: _percent(x["score"], high, 0)).alias("high"))
    far = search(span, False, k)
    chosen = far.join(near.select("id", "h", (F.col("place") - 1).alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), ["id", "h", "w"])
    return chosen.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _percent(score: Column, percent: int, more: int) -> Column:
    """percent / 100 of a score in whole numbers, rounded down with more = 0 and up with 99."""
    rest = F.pmod(score, F.lit(100).cast("long"))
    whole = F.call_function("div", score - rest, F.lit(100).cast("long"))
    return percent * whole + F.call_function("div", percent * rest + more, F.lit(100).cast("long"))
