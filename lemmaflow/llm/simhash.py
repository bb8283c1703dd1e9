"""SimHash near-duplicates by tiled exact comparison.

Every document gets a fingerprint of one or more 64-bit words. Distinct fingerprints are sorted
into blocks by population count, each block is packed into one binary row, and every pair of blocks
whose population counts come within the radius is one task, which compares all pairs with numpy
exclusive-or and bit counts. A task returns a spanning forest of the links it finds, never the
pairs themselves, so a group of k near copies costs at most k rows a task.

Near copies by Jaccard similarity are proposed so, with wide fingerprints and a wide radius, and
decided by their sets of shingles.

The comparison is quadratic in the number of distinct fingerprints, which is the nature of the
method; blocks grow with the input so that rows are sent to at most some tens of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import back, components, durable, join_spread, rest_of, row_key, slices

#: For each byte, its eight bits in the eight byte lanes of a word, lowest bit first.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).astype(np.uint8).view("<u8").ravel()
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of size words, repeats included, of a text in UTF-8 whose A-Z
    are lower-cased. Fewer words: the whole sequence; none: empty."""
    words = text.lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0D split
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def _totals(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, lowest bit first."""
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)  # a lane holds up to 255
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Further hashes from the first ones (splitmix64's finish), for fingerprints of several words."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * _GOLDEN % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: bytes | None, size: int = 4, words: int = 1) -> bytes:
    """Fingerprint, 8 * words bytes, highest bit first. A bit is 1 if set in over half the hashes."""
    return _print_of(shingle_hashes(text or b"", size), words)


def _print_of(hashes: np.ndarray, words: int) -> bytes:
    if not len(hashes):
        return bytes(8 * words)
    out = b""
    for k in range(words):
        bits = _totals(_mixed(hashes, k)) * 2 > len(hashes)
        out += np.packbits(bits[::-1]).tobytes()
    return out


def fingerprints(docs: DataFrame, size: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp binary, pop int), one row for every row of docs. Null and wordless texts get
    fingerprint zero; other columns, whatever their names, take no part."""
    from lemmaflow.llm.simhash import simhash as one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [one(t, size, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            pops = np.bitwise_count(np.frombuffer(b"".join(fps), dtype=np.uint8)).reshape(len(fps), -1).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(pops)], ["doc_id", "fp", "pop"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp binary, pop int")


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hooks the trees of linked rows together, larger root under smaller."""
    while True:
        ri, rj = _roots(parent, i), _roots(parent, j)
        apart = ri != rj
        if not apart.any():
            return
        i, j = ri[apart], rj[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 256, cols: int = 1024, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (child, root row numbers) of all links at radius or fewer differing bits
    between the rows of a and b, or within a if b is None; rows are (n, words) uint64. Tiles whose
    population counts, in all or summed over single words, differ beyond the radius are skipped.
    known: for each row the root of a component that it is known to belong to; no edge says so again."""
    def ordered(x):
        pops = np.bitwise_count(x).astype(np.int16)
        order = np.lexsort((*pops.T[1:], pops[:, 0], pops.sum(axis=1)))
        return x[order], np.column_stack((pops[order], pops[order].sum(axis=1))), order

    def boxes(pops, step):
        cuts = np.arange(0, len(pops), step)
        return cuts, np.minimum.reduceat(pops, cuts), np.maximum.reduceat(pops, cuts)

    xa, pa_, oa = ordered(a)
    xb, pb, ob = (xa, pa_, oa) if b is None else ordered(b)
    shift = 0 if b is None else len(a)
    known = np.arange(len(a) + (0 if b is None else len(b))) if known is None else known
    parent = known.copy()
    cut_a, low_a, high_a = boxes(pa_, rows)
    cut_b, low_b, high_b = boxes(pb, cols)
    first = 1  # words after which chance alone hardly lets a pair pass
    while first < min(3, a.shape[1]) and 32 * first - 15 * math.sqrt(first) < radius:
        first += 1
    for s, lo, hi in zip(cut_a, low_a, high_a):
        gap = np.maximum(0, np.maximum(low_b - hi, lo - high_b))
        near = np.maximum(gap[:, -1], gap[:, :-1].sum(axis=1)) <= radius
        left = xa[s : s + rows]
        for t in cut_b[near]:
            if b is None and t + cols <= s:
                continue  # the pair's mirror image comes in another tile
            right = xb[t : t + cols]
            bits = np.bitwise_count(left[:, :1] ^ right[:, 0])
            for w in range(1, first):
                bits += np.bitwise_count(left[:, w : w + 1] ^ right[:, w])
            if bits.min() > radius:
                continue
            i, j = np.nonzero(bits <= radius)
            if a.shape[1] > first:
                more = np.bitwise_count(left[i, first:] ^ right[j, first:]).sum(axis=1, dtype=np.int16) + bits[i, j] <= radius
                i, j = i[more], j[more]
            i, j = oa[i + s], ob[j + t] + shift
            if len(i):
                _join(parent, i, j)
    root = _roots(parent, np.arange(len(parent)))
    child = np.nonzero((root != known) & (known == np.arange(len(root))))[0]
    return child, root[child]


def _blocks(counts: dict[int, int], least: int, pieces: int, most: int) -> dict[int, tuple[int, int]]:
    """For each population count its first block and number of blocks. Neighbouring counts share a
    block while it is small; a frequent count is split by hash."""
    aim = min(most, max(least, sum(counts.values()) // pieces))
    out, block, room = {}, -1, 0
    for p in sorted(counts):
        if counts[p] <= room:
            room -= counts[p]
            out[p] = (block, 1)
            continue
        n = math.ceil(counts[p] / aim)
        out[p] = (block + 1, n)
        block += n
        room = aim - counts[p] if n == 1 else 0
    return out


def hamming_forest(nodes: DataFrame, radius: int, words: int, least: int = 1024, pieces: int = 32, most: int = 4_000_000) -> DataFrame:
    """Edges (a, b) of a graph that has the components of all links at radius or fewer differing
    bits between distinct fingerprints: a forest of each block, and for every two blocks no more edges than join
    components within them. nodes: (node binary, pop int), a node's last 8 * words bytes
    being its fingerprint and the bytes before, as many in each, any name; no fingerprint twice.

    Collects one count for each population count (64 * words + 1 at most), never a fingerprint.
    """
    from lemmaflow.llm.simhash import tile_forest as forest

    spark = nodes.sparkSession
    counts = {r["pop"]: r["count"] for r in nodes.groupBy("pop").count().collect()}
    if not counts:
        return spark.createDataFrame([], "a binary, b binary")
    blocks = _blocks(counts, least, pieces, most)
    reach = []
    for p, (start, n) in blocks.items():
        near = [blocks[q] for q in blocks if abs(p - q) <= radius]
        reach.append((p, start, n, min(s for s, _ in near), max(s + m - 1 for s, m in near)))
    table = F.broadcast(spark.createDataFrame(reach, "pop int, start int, n int, low int, high int"))  # a row per population count

    def prints_of(nodes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(nodes[:, -8 * words :]).view(">u8").astype(np.uint64)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        """A block as one row, compared in itself: roots are its nodes' roots among them."""
        data, n = b"".join(rows.column("node").to_pylist()), rows.num_rows
        roots = np.arange(n)
        child, root = forest(prints_of(np.frombuffer(data, dtype=np.uint8).reshape(n, -1)), None, radius)
        roots[child] = root
        own = {"block": [key[0].as_py()], "low": [min(rows.column("low").to_pylist())], "high": [max(rows.column("high").to_pylist())], "n": [n], "nodes": pa.array([data], pa.large_binary()), "roots": pa.array([roots.astype(np.int32).tobytes()], pa.large_binary())}
        return pa.table(own).cast(packed)

    packed = pa.schema([("block", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int32()), ("nodes", pa.binary()), ("roots", pa.binary())])
    keyed = nodes.join(table, "pop").select((F.col("start") + F.pmod(F.xxhash64("node"), F.col("n"))).cast("int").alias("block"), "low", "high", "node")
    whole = durable(keyed.groupBy("block").applyInArrow(pack, "block int, low int, high int, n int, nodes binary, roots binary"))
    # blocks p and q meet if either reaches the other; low and high of a shared block are its widest
    ends = whole.select("block", F.explode(F.sequence("low", "high")).alias("other")).where("block <> other")
    pairs = ends.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).distinct()
    sides = pairs.select("i", "j", F.explode(F.array("i", "j")).alias("block"))
    tiles = sides.join(whole.select("block", "n", "nodes", "roots"), "block")

    def edges(nodes: np.ndarray, child: np.ndarray, root: np.ndarray) -> dict:
        cut = lambda rows: pa.array([nodes[r].tobytes() for r in rows], pa.binary())
        return {"a": cut(child), "b": cut(root)}

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, x, r in zip(*[b.column(c).to_pylist() for c in range(3)]):
                roots = np.frombuffer(r, dtype=np.int32)
                child = np.nonzero(roots != np.arange(n))[0]
                yield pa.RecordBatch.from_pydict(edges(np.frombuffer(x, dtype=np.uint8).reshape(n, -1), child, roots[child]))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        """Two blocks: they return no more edges than join components of theirs."""
        data = {k: (np.frombuffer(x, dtype=np.uint8).reshape(n, -1), np.frombuffer(r, dtype=np.int32).astype(np.int64)) for k, n, x, r in zip(*[rows.column(c).to_pylist() for c in ("block", "n", "nodes", "roots")])}
        i, j = key[0].as_py(), key[1].as_py()
        if i not in data or j not in data:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        (left, known), (right, more) = data[i], data[j]
        child, root = forest(prints_of(left), prints_of(right), radius, known=np.concatenate((known, more + len(left))))
        return pa.table(edges(np.concatenate((left, right)), child, root))

    own = whole.select("n", "nodes", "roots").mapInArrow(inner, "a binary, b binary")
    return own.union(tiles.groupBy("i", "j").applyInArrow(compare, "a binary, b binary"))


def _named(doc_id: Column, fp: Column) -> Column:
    """A node's name: nodes are in the order of their ids, null last."""
    own = F.to_binary(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("hex"))
    return F.concat(F.when(doc_id.isNull(), F.lit(b"\x01" + bytes(8))).otherwise(F.concat(F.lit(b"\x00"), own)), fp)


def _id_of(node: Column) -> Column:
    own = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", own)


def simhash_components(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for every row of docs.

    Null or wordless text: fingerprint zero, linked like any other. Rows without a doc_id take part;
    component_id is the smallest id that is not null. Repeated rows come back repeated.
    """
    prints = durable(fingerprints(docs, size, 1))
    own = prints.groupBy("fp", "pop").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    own = durable(own.select("fp", "pop", "n", _named(F.col("first_id"), F.col("fp")).alias("node")))
    roots = components(hamming_forest(own.select("node", "pop"), radius, 1))  # a root has its component's smallest id
    named = durable(own.join(roots, "node", "left").select("fp", "n", _id_of(F.coalesce("root", "node")).alias("component_id")))
    return join_spread(prints.select("doc_id", "fp"), named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def radius_for(similarity: float, bits: int, widths: float = 5.4) -> int:
    """Differing bits that pairs of this Jaccard similarity hardly exceed: two sets with Jaccard j have
    cosine 2j / (1 + j) or more, each bit differs with chance angle / pi, and `widths` standard
    deviations are added; so many because bits of sets of a few shingles differ more often."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + widths * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", size))


def set_prints(docs: DataFrame, size: int, words: int) -> DataFrame:
    """(key_id, key_text, none: whether the id is null, set_id binary, fp binary, pop int), one row for
    every row of docs: a name of its set of shingles, and the fingerprint of that set."""
    from lemmaflow.llm.simhash import _print_of, shingle_set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, fps = [], []
            for text in b.column(3).cast(pa.binary()).to_pylist():
                own = shingle_set(text, size)
                ids.append(xxhash.xxh3_128_digest(own.tobytes()))
                fps.append(_print_of(own, words))
            pops = np.bitwise_count(np.frombuffer(b"".join(fps), dtype=np.uint8)).reshape(len(fps), -1).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary()), pa.array(fps, pa.binary()), pa.array(pops)], ["key_id", "key_text", "none", "set_id", "fp", "pop"])

    rows = docs.select(*row_key(), F.col("doc_id").isNull().alias("none"), "text")
    return rows.mapInArrow(run, "key_id long, key_text long, none boolean, set_id binary, fp binary, pop int")


def jaccard_forest(sets: list[np.ndarray], left: int | None, similarity: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges (child, root) of a forest that has the components of all links of exact Jaccard
    `similarity` or more between the first `left` sets and the others, or among all if left is None.
    known: for each set the root of a component that it is known to belong to; no edge says so again.
    Sets that are connected already are not compared; empty sets have no links."""
    n = len(sets)
    known = np.arange(n) if known is None else np.array(known)
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(sizes)[:-1])
    flags = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int32)
    root = known.copy()  # each set's root itself, so that whole rows compare at once
    for i in range(n if left is None else left):
        a = sizes[i]
        start = i + 1 if left is None else left
        # no pair at the similarity has sizes further apart; one is added against rounding
        fits = (np.minimum(sizes[start:], a) + 1 >= similarity * np.maximum(sizes[start:], a)) & (sizes[start:] > 0)
        others = start + np.nonzero(fits & (root[start:] != root[i]))[0]
        if not a or not len(others):
            continue
        flags[own[i]] = 1
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            both = np.add.reduceat(flags[np.concatenate([own[j] for j in some])], starts)
            for j in some[both >= similarity * (a + sizes[some] - both) - 1e-9]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
        flags[own[i]] = 0
    return [(int(k), int(root[k])) for k in np.nonzero((root != known) & (known == np.arange(n)))[0]]


def verified_links(docs: DataFrame, members: DataFrame, size: int, similarity: float, block: int = 1000) -> DataFrame:
    """Edges (a, b) of set_ids: a forest that has the components of all links of exact Jaccard
    `similarity` or more between members of the same group. members: (set_id, key_id, key_text of one
    row of docs that has the set, root: its group, n: the group's size).

    Small groups share tasks; a large one is dealt into blocks. Each block is compared in itself first;
    then every two blocks of a group are a task, which knows what is connected within them and returns
    no more edges than it joins components, so copies of one text are neither compared nor linked twice.
    """
    from lemmaflow.llm.simhash import jaccard_forest as forest
    from lemmaflow.llm.simhash import shingle_set as shingles

    total = members.count()
    deal = F.ceil(F.col("n") / block).cast("int")
    named = members.withColumn("parts", deal).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    named = named.withColumn("bin", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(total // block * 4 + 16))).otherwise(F.xxhash64("root", F.lit(1)))).drop("n")
    rows = durable(docs.select(*row_key(), "text").join(named, ["key_id", "key_text"]).drop("key_id", "key_text").dropDuplicates(["set_id"]))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        groups: dict[bytes, list[tuple]] = {}
        for root, part, name, known, text in zip(*[table.column(c).to_pylist() for c in ("root", "part", "set_id", "known")], table.column("text").cast(pa.binary()).to_pylist()):
            groups.setdefault(root, []).append((part != i, name, known, shingles(text, size)))
        a, b = [], []
        for own in groups.values():
            own.sort(key=lambda x: x[:2])
            left = None if i == j else sum(not x[0] for x in own)
            place = {x[1]: k for k, x in enumerate(own)}
            for child, root in forest([x[3] for x in own], left, similarity, [place[x[2]] for x in own]):
                a.append(own[child][1])
                b.append(own[root][1])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    def tiles(own: DataFrame, known: Column, i: Column, j: Column) -> DataFrame:
        own = own.select("bin", (F.col("parts") > 1).alias("big"), i.alias("i"), j.alias("j"), "part", "root", "set_id", known.alias("known"), "text")
        return own.groupBy("bin", "big", "i", "j").applyInArrow(compare, "a binary, b binary")

    part = F.when(F.col("parts") > 1, F.col("part")).otherwise(0)
    inner = durable(tiles(rows, F.col("set_id"), part, part))
    large = rows.where("parts > 1").join(inner.withColumnRenamed("a", "set_id"), "set_id", "left")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("part"))
    large = large.withColumn("other", F.explode(others))
    cross = tiles(large, F.coalesce("b", "set_id"), F.least("part", "other"), F.greatest("part", "other"))
    return inner.union(cross)


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """docs with one document of each group of near copies: the row with the smallest doc_id (null
    ids last; equal ids: smallest text hash; repeated rows: one of them). Two documents are linked if
    their sets of shingles have this Jaccard similarity or more; groups are the components of links.

    Fingerprints of 64 * words bits, of the sets, only propose: sets within a radius that pairs at the
    similarity hardly exceed are grouped, and the sets of a group are compared by their shingles.
    All wordless documents are one group. Columns, whatever their names, are returned as they are."""
    prints = durable(set_prints(docs, size, words))
    rank = F.struct("none", "key_id", "key_text")
    sets = durable(prints.groupBy("set_id", "fp", "pop").agg(F.min(rank).alias("k")))
    fps = durable(sets.groupBy("fp", "pop").agg(F.count("*").alias("n")))
    near = components(hamming_forest(fps.select(F.col("fp").alias("node"), "pop"), radius_for(similarity, 64 * words), words))
    near = durable(fps.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")))
    grouped = durable(join_spread(sets, near, "fp").select("set_id", "k.key_id", "k.key_text", "root"))
    several = durable(grouped.groupBy("root").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.col("size")))
    links = verified_links(docs, durable(join_spread(grouped, several, "root").withColumnRenamed("size", "n")), size, similarity)
    same = components(links).withColumnsRenamed({"node": "set_id", "root": "same"})
    keep = sets.join(same, "set_id", "left").groupBy(F.coalesce("same", "set_id").alias("same")).agg(F.min("k").alias("k"))
    rows = docs.select(rest_of(docs), *row_key()).dropDuplicates(["key_id", "key_text"])
    return rows.join(keep.select("k.key_id", "k.key_text"), ["key_id", "key_text"], "left_semi").select(*back(docs))
