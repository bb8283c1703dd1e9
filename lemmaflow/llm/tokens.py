"""Token ids of whole documents, and packed binary output of them.

`tokenize` yields pieces: a document's ids, an end id after them, cut only if longer than a
sequence. `pack_tokens` packs them best-fit-decreasing, with a segment tree over bin capacities,
and returns one row for each sequence: its id matrix row as little-endian unsigned 32-bit ids,
cumulative segment lengths, and position ids that start again with every segment.

Pieces are dealt into groups of about equal number, whatever the layout of the input's files, and each
group is packed in one task, whose memory does not grow with the input. Only the last few bins of a
group can stay part empty.
"""

from __future__ import annotations

import array
import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VOCABULARY = "byte_bpe_50k"
_BLANK, _TWO_BLANKS = re.compile(r"\s"), re.compile(r"\s\s")


class Encoder:
    """Ids by the tokenizer file. The same vocabulary's ranks, where given, compute them about five
    times as fast; texts that hold an added token's string, and those on which their pattern engine
    might be slow or fail, are left to the tokenizer file itself."""

    #: A longer stretch of white space only, or without any, goes to the tokenizer file.
    LONGEST_RUN = 20_000

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = self.faster = None
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # where white space never comes twice in a row the pattern's look-ahead decides nothing
            self.faster = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added) or len(text) > self.LONGEST_RUN and self._long_run(text):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = (self.fast if _TWO_BLANKS.search(text) else self.faster).encode_ordinary(text)
        return np.frombuffer(array.array("I", found), dtype=np.uint32)

    def _long_run(self, text: str) -> bool:
        """Might a stretch of white space, or of none, be longer than LONGEST_RUN?"""
        step = self.LONGEST_RUN // 2
        parts = [text[k : k + step] for k in range(0, len(text) - step + 1, step)]
        return not all(_BLANK.search(p) and not p.isspace() for p in parts)


@functools.cache
def public_encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a public vocabulary installed on every machine; one for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers as public

    return Encoder(public.path(f"{vocabulary}.json"), public.path(f"{vocabulary}.tiktoken"), public.PATTERN)


def pieces_of(ids: np.ndarray, size: int, first_short: bool = False) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences and the rest, which comes last, or
    first if first_short."""
    n = len(ids)
    rest = n % size
    if n <= size:
        return [(0, n)] if n else []
    starts = list(range(rest, n, size)) if first_short else list(range(0, n, size))
    if first_short and rest:
        starts = [0, *starts]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


class Room:
    """Segment tree over capacities 0..size: the smallest capacity, at least the one asked for, that
    some open bin has, found and updated in log(size) steps."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the tightest open bin with room for need; the bin is taken out."""
        node = self.leaves + need
        while not self.count[node]:
            while node > 1 and node & 1:
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.count[2 * node])
        capacity = node - self.leaves
        which = self.bins[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, which


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers. Longest first, each into the bin it fills best; ties by item number."""
    room, bins = Room(size), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = room.take(lengths[k])
        capacity, which = found or (size, len(bins))
        if not found:
            bins.append([])
        bins[which].append(k)
        if capacity > lengths[k]:
            room.add(capacity - lengths[k], which)
    return bins


def pieces_table(docs: DataFrame, size: int, end_id: int, first_short: bool, encoder: Callable[[], Encoder], keep_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids binary), one row for each piece
    of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().ids
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for doc, text in zip(b.column(0)[at : at + 256].to_pylist(), b.column(1)[at : at + 256].to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(pieces_of(ids, size, first_short)):
                        data = ids[start : start + length].tobytes()
                        rows.append((doc, piece, start, length, zlib.crc32(data), data))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def packing(size: int, pack: Callable[[list[int], int], list[list[int]]], block: int, finish: Callable[[pa.Table], pa.Table] | None = None) -> Callable:
    """The function, for mapInArrow, that packs a task's pieces and gives them sequence_id and offset; about `block` pieces are
    meant to come. finish, if given, makes rows from the pieces of some whole sequences, in order: where they were packed, so that no
    second Python worker of the task gets them."""
    step = 250 if finish else 1000  # finished rows are as long as a sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting = TaskContext.get().partitionId() << 33, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(waiting)
            lengths = table.column("length").to_pylist()
            bins = pack(lengths, size)
            for at in range(0, len(bins), step):
                some = bins[at : at + step]
                rows = [k for x in some for k in x]
                sequence = np.repeat(2 * np.arange(number + at, number + at + len(some)), [len(x) for x in some])
                offset = np.concatenate([np.cumsum([0, *(lengths[k] for k in x[:-1])]) for x in some])
                placed = table.take(rows).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
                yield from (finish(placed) if finish else placed).to_batches()
            number += len(bins)

        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= 2 * block:
                yield from flush()
                waiting = []
        if waiting:
            yield from flush()

    return run


def dealt(pieces: DataFrame, groups: int) -> DataFrame:
    """pieces dealt evenly to groups, in the order that a retried task finds again."""
    return pieces.repartition(groups).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")


def in_sequences(pieces: DataFrame, size: int, pack: Callable[[list[int], int], list[list[int]]], block: int) -> DataFrame:
    """pieces (a durable table) with sequence_id and offset. Whole sequences need no packing; the others
    are dealt evenly into groups of about `block`, each packed in one task."""
    short = pieces.where(F.col("length") < size)
    groups = max(1, round(short.count() / block))
    whole = pieces.where(F.col("length") == size).select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt(short, groups).mapInArrow(packing(size, pack, block), pieces.schema.add("sequence_id", "long").add("offset", "long")).unionByName(whole)


def pack_tokens(docs: DataFrame, size: int = 2048, end_id: int = 50256, block: int = 10_000, encoder: Callable[[], Encoder] = public_encoder) -> DataFrame:
    """One row for each packed sequence, a row of an id matrix: sequence_id, n_tokens (before padding),
    doc_ids and pieces (of its segments, in order), ids (binary, `size` unsigned 32-bit little-endian
    ids, end_id as padding), cu_seqlens (0 and the cumulative segment lengths), position_ids (binary, as
    ids: each segment counts from 0; padding is 0).

    Every id of every document is in exactly one sequence, so documents can be put together again.
    Null text counts as empty and still has its end id. Null and repeated doc_ids are kept. Other
    columns take no part; an empty table gives no row.

    Nothing is written between the two steps: ids go from the tokenizer through one shuffle to the task that packs them. The
    number of groups comes from the texts' bytes, so a group holds about `block` pieces, at most twice as many at a time.
    """
    schema = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, ids binary, cu_seqlens array<int>, position_ids binary"

    def finish(t: pa.Table) -> pa.Table:
        """One row for each sequence of t, whose pieces come one after the other."""
        sequence, length, offset = (t.column(c).to_numpy() for c in ("sequence_id", "length", "offset"))
        first = np.flatnonzero(np.diff(sequence, prepend=-1))
        cuts, n = np.append(first, len(sequence)), len(first)
        row = np.repeat(np.arange(n), np.diff(cuts))
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)  # each id's place in its piece
        place = np.repeat(row * size + offset, length) + within
        ids, places = np.full(n * size, end_id, "<u4"), np.zeros(n * size, "<u4")
        ids[place] = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<u4")
        places[place] = within
        lists = lambda c, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), t.column(c).combine_chunks().cast(kind))
        ends = pa.array(np.insert(offset + length, first, 0), pa.int32())
        rows = lambda m: pa.array([x.tobytes() for x in m.reshape(n, size)], pa.binary())
        return pa.table({
            "sequence_id": sequence[first], "n_tokens": pa.array(np.add.reduceat(length, first), pa.int32()), "doc_ids": lists("doc_id", pa.int64()), "pieces": lists("piece", pa.int32()),
            "ids": rows(ids), "cu_seqlens": pa.ListArray.from_arrays(pa.array(cuts + np.arange(n + 1), pa.int32()), ends), "position_ids": rows(places),
        })

        # ids are about as long as their text; a piece of a text is `size` ids of four bytes
    text_bytes = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    expected = docs.agg(F.sum(1 + F.floor(text_bytes / (4 * size)))).first()[0] or 0
    pieces = pieces_table(docs, size, end_id, False, encoder, True)
    return dealt(pieces, max(1, round(expected / block))).mapInArrow(packing(size, best_fit_decreasing, block, finish), schema)


def unpack_tokens(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, ids binary) of every segment: the way back from packed rows."""
    segment = F.explode(F.arrays_zip("doc_ids", "pieces", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("start"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("stop")))
    rows = packed.select("ids", segment.alias("s"))
    return rows.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.expr("substring(ids, 4 * s.start + 1, 4 * (s.stop - s.start))").alias("ids"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed sequences as Parquet files, the form trainers read; written anew each time. The ids of a
    file's rows, put together, are its id matrix."""
    packed.write.mode("overwrite").parquet(path)
