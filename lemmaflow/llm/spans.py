"""Substring de-duplication by sliding sentence spans.

From every sentence on the shortest run of consecutive sentences that has a number of words is hashed.
So that passages whose ends are glued to other text, or that have few sentence ends, are found as
well, windows of words are hashed, too, of which winnowing keeps the smallest hash in any row of REACH
windows: a common passage of WINDOW + REACH - 1 words has a window kept on both sides. Hashes are joined
over all documents, and what a repeated run or window covers is removed, but for its first occurrence.
Sentences are cut and hashed in Arrow batches, counted and joined by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import back, durable, free_name, join_spread, rest_of, row_key

#: A sentence ends with its marks and the white space behind them, or with its line.
_PIECE = re.compile(rb"[^.!?\n]*(?:[.!?\n]+\s*|$)")
#: Words of a window, and of a row of windows one is kept: passages of 50 words are always found.
WINDOW, REACH = 36, 15


def sentences(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The sentences of a text in UTF-8, which concatenated give the text again, and their words in
    lower case (A-Z), single-spaced. A part without a word belongs to the sentence before it."""
    parts, words = [], []
    for part in _PIECE.findall(text):
        own = b" ".join(part.lower().split())
        if own.strip(b".!?") or not parts:
            parts.append(part)
            words.append(own)
        else:
            parts[-1] += part
    return parts, words


def run_hashes(words: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of the shortest run of consecutive sentences with at least min_words words
    from each sentence on, where there is one."""
    sizes = np.concatenate(([0], np.cumsum([w.count(b" ") + 1 if w else 0 for w in words]))).astype(np.int64)
    ends = np.searchsorted(sizes, sizes[:-1] + min_words)
    starts = np.nonzero(ends <= len(words))[0]
    ends = ends[starts]
    digests = [xxhash.xxh64_intdigest(b"\n".join(words[s:e])) for s, e in zip(starts.tolist(), ends.tolist())]
    return starts.astype(np.int32), (ends - starts).astype(np.int32), np.array(digests, dtype=np.uint64).view(np.int64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 7)
        return out


_HASHES = _WordHashes()


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best (np.minimum or np.maximum) of every `size` neighbours."""
    width = 1
    while 2 * width <= size:
        x, width = best(x[:-width], x[width:]), 2 * width
    return best(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def window_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of WINDOW words that winnowing keeps; A-Z in lower case."""
    words = text.lower().split()
    if len(words) < WINDOW:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    for step in (1, 2, 4, 8, 16, 4):  # windows of 2, 4, 8, 16, 32 and 36 words
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[step:] >> np.uint64(29)) ^ (h[step:] * np.uint64(0xD1342543DE82EF95))
    h ^= h >> np.uint64(32)
    low = _sliding(h, min(REACH, len(h)), np.minimum)
    pad = np.zeros(len(h) - len(low), np.uint64)  # kept: the least of one of the rows that hold it
    kept = np.nonzero(_sliding(np.concatenate((pad, low, pad)), len(pad) + 1, np.maximum) == h)[0]
    return kept.astype(np.int32), h[kept].view(np.int64)


def all_spans(text: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of a text's runs of sentences and, with length 0 and the first word's
    number as start, of its windows of words."""
    starts, lengths, hashes = run_hashes(sentences(text)[1], min_words)
    first, own = window_hashes(text)
    return np.concatenate((starts, first)), np.concatenate((lengths, np.zeros(len(first), np.int32))), np.concatenate((hashes, own))


def without_spans(text: bytes, starts: list[int], lengths: list[int]) -> tuple[bytes, int, int]:
    """The text without these runs and windows, its sentences, and how many of them lost something."""
    parts = sentences(text)[0]
    if not starts:
        return text, len(parts), 0
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    keep = np.ones(len(text), dtype=bool)
    for s, k in zip(starts, lengths):
        if k:
            keep[edges[s] : edges[min(s + k, len(parts))]] = False
    if 0 in lengths:
        data = np.frombuffer(text, dtype=np.uint8)
        black = (data != 32) & ((data < 9) | (data > 13))
        at = np.append(np.nonzero(black & ~np.append(False, black[:-1]))[0], len(text))
        for s, k in zip(starts, lengths):
            if not k:
                keep[at[s] : at[s + WINDOW]] = False
    lost = int(np.count_nonzero(np.add.reduceat(~keep, edges[:-1])))
    return np.frombuffer(text, dtype=np.uint8)[keep].tobytes(), len(parts), lost


def repeated_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """(key_id, key_text, spans: start and length): the repeated runs and windows that are not the
    first of their kind; first is by id, text hash and place, null ids before all. Windows that only
    their own document repeats are not among them."""
    from lemmaflow.llm.spans import all_spans as hashes

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 500):
                found = [hashes(t or b"", min_words) for t in texts[at : at + 500]]
                times = [len(s) for s, _, _ in found]
                columns = [np.repeat(ids[at : at + 500], times), np.repeat(keys[at : at + 500], times), *[np.concatenate([f[k] for f in found]) for k in range(3)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key_id", "key_text", "start", "length", "hash"])

    rows = docs.select(*row_key(), "text").where("text is not null")
    every = durable(rows.mapInArrow(spans, "key_id long, key_text long, start int, length int, hash long"))
    often = durable(every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    seen = durable(join_spread(every, often, "hash"))
    place = F.struct("key_id", "key_text", "start")
    first = durable(seen.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    elsewhere = (F.col("key_id") != F.col("first.key_id")) | (F.col("key_text") != F.col("first.key_text"))
    later = join_spread(seen, first, "hash").where((place != F.col("first")) & ((F.col("length") > 0) | elsewhere))
    return later.groupBy("key_id", "key_text").agg(F.collect_set(F.struct("start", "length")).alias("spans"))


def remove_repeated_spans(docs: DataFrame, min_words: int = 36) -> DataFrame:
    """docs with repeated passages taken out of the text, and n_sentences and n_removed (long): the
    text's sentences, and how many of them went, in whole or in part.

    A run of sentences counts as repeated wherever it comes again, in another document or in the same
    one, with the same words in the same order; case of A-Z and white space do not matter. Runs are the
    shortest of min_words words. Windows of WINDOW words count as repeated in another document, so a
    common passage of 50 words goes, but for less than REACH words at either end, whatever marks it has. Rows are never dropped; a text may become
    empty. Null text stays null, with no sentences. Rows with the same id and text get the same
    treatment; other columns stay as they are, whatever their names; where docs has an n_sentences or
    n_removed of its own, the new column has an underscore more.
    """
    from lemmaflow.llm.spans import without_spans as cut

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                rows.append((None, 0, 0) if text is None else cut(text, [x["start"] for x in spans or []], [x["length"] for x in spans or []]))
            texts, counts, gone = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_sentences", "n_removed"])

    spans = durable(repeated_spans(docs, min_words))
    rows = docs.select(rest_of(docs, "text"), "text", *row_key()).join(spans, ["key_id", "key_text"], "left").select("row", "text", "spans")
    done = rows.mapInArrow(apply, rows.select("row", "text").schema.add("n_sentences", "long").add("n_removed", "long"))
    return done.select(*back(docs, text=F.col("text")), *[F.col(c).alias(free_name(c, docs)) for c in ("n_sentences", "n_removed")])
