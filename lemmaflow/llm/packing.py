"""Packing pieces of documents into sequences by minimum bin slack.

For each bin in turn, a bitset subset-sum over the lengths that are still there finds the fullest
feasible combination, the longest piece always included, and takes it out. A bitset is one Python
integer whose bit s says that sum s can be reached, so one length costs one shift and one or; the
search ends as soon as the bin can be filled exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lemmaflow.llm.common import durable
from lemmaflow.llm.tokens import Encoder, in_sequences, pieces_table, public_encoder


def fullest(lengths: list[int], count: dict[int, int], room: int) -> list[int]:
    """Lengths, of those available (in falling order, with counts), whose sum is the greatest that
    is at most room."""
    if not lengths or lengths[-1] > room:
        return []
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        n, part = min(count[length], room // length), 1
        while n > 0:  # part copies at once: 1, 2, 4, ... and the rest
            part = min(part, n)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & mask
            n -= part
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * part
            total -= length * part
    return chosen


def minimum_bin_slack(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers; every item is in one bin, and no bin holds more than size."""
    by: dict[int, list[int]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        by.setdefault(lengths[k], []).append(k)
    left, count, bins = sorted(by, reverse=True), {n: len(v) for n, v in by.items()}, []
    while left:
        longest = left[0]
        count[longest] -= 1
        rest = left if count[longest] else left[1:]
        chosen = [longest, *fullest(rest, count, size - longest)]
        for n in chosen[1:]:
            count[n] -= 1
        bins.append([by[n].pop() for n in chosen])
        if any(not count[n] for n in chosen):
            left = [n for n in left if count[n]]
    return bins


def pack_minimum_slack(docs: DataFrame, size: int = 1024, end_id: int = 2, block: int = 20_000, encoder: Callable[[], Encoder] = public_encoder) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only longer ones than size are cut, into pieces of size of
    which the first may be shorter. Pieces shorter than size are dealt into groups of about `block`,
    each packed on its own; a group's loss is its last few bins. Their ids stay where they were made:
    only the columns above are shuffled. Null text counts as empty: its one piece holds end_id. Null
    and repeated doc_ids are kept, each row packed on its own; other columns take no part; an empty
    table gives no row.
    """
    return in_sequences(durable(pieces_table(docs, size, end_id, True, encoder, False)), size, minimum_bin_slack, block)
