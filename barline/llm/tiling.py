"""Benchmark decontamination by greedy string tiling.

Texts are words: ASCII letters lower-cased, other ASCII characters but digits separate words, everything else belongs to them.
Seeds are the hashes of all runs of ``SEED_WORDS`` words, by one running Karp-Rabin hash over the bytes of a block of texts.
The seeds of the benchmark set bits of a filter of fixed size; documents that hit it are joined to the benchmark on the seed
itself. Pairs that share too few seed places to reach the threshold leave. Each other pair is tiled: the common runs of
unmarked words are found with Karp-Rabin hashes of word windows, marked longest first and without overlap, and the search goes on
with shorter windows down to ``SEED_WORDS``; the tiles are those of a plain greedy search. The share of the item's words under tiles is its coverage, whatever the
order of the passages in the document.

A null text is empty; texts and items of fewer than ``SEED_WORDS`` words match nothing; repeated rows are judged one by one;
ids may repeat or be null; empty tables give an empty result; a long text is one row, held whole with its words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import blocks, texts, tidy
from barline.session import written

SEED_WORDS, COVERAGE = 5, 0.5
PAIRS = 1 << 20  # places of equal hash looked at together
SLICE = 100_000  # words whose running sums are held at a time
FILTER_BITS = 24  # the filter is 2 MiB at any size of the benchmark
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Roller:
    """Hashes of slices of a byte or number sequence, each in constant time from running sums."""

    def __init__(self) -> None:
        self.up = self.down = powers(1, BASE)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(values):
            n = max(1 << 16, 2 * len(values))
            self.up, self.down = powers(n, BASE), powers(n, INVERSE)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        return h * MIX


def seed_hashes(cut: list[list[bytes]], roller: Roller, n: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word place of every run of n words of the texts."""
    sizes = np.array([len(c) for c in cut], dtype=np.int64)
    flat = [w for c in cut for w in c]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    text = np.repeat(np.arange(len(cut)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - first[text]
    full = np.flatnonzero(place + n <= sizes[text])
    found = np.empty(len(full), dtype=np.uint64)
    for begin in range(0, len(flat), SLICE):  # the sums of a slice of words, which reaches into the next
        a, b = np.searchsorted(full, (begin, begin + SLICE))
        if a < b:
            own, zero = full[a:b], starts[begin]
            sums = roller.sums(np.frombuffer(b" ".join(flat[begin : begin + SLICE + n]), dtype=np.uint8))
            found[a:b] = roller.slices(sums, starts[own] - zero, ends[own + n - 1] - 1 - zero)
    return found, text[full], place[full]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - FILTER_BITS)
    return (h >> shift).astype(np.int64), (h * np.uint64(BASE) >> shift).astype(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """``item_id, item_row, words, place, seed``: a row for each run of seed words of ``doc_id, row, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in blocks(batches):
            cut = [words_of(t) for t in batch.column("text").to_pylist()]
            h, text, place = seed_hashes(cut, roller)
            words = np.array([len(c) for c in cut], dtype=np.int64)[text]
            take = pa.array(text)
            yield pa.record_batch([batch.column("row").take(take), pa.array(words), pa.array(place), pa.array(h.view(np.int64))], names=["item_row", "words", "place", "seed"])

    return items.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_row long, words long, place long, seed long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bits of the seeds' slots, gathered as at most 2^18 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(batch.column("seed").to_numpy().view(np.uint64))))
            yield pa.record_batch([pa.array(slots)], names=["slot"])

    slots = seeds.select("seed").mapInArrow(run, "slot long")
    packed = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    rows = packed.toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def seeded(source: DataFrame, bits: np.ndarray) -> DataFrame:
    """``row, doc_id, text, seeds``: the documents that hit the filter, and the distinct seeds that do."""
    known = source.sparkSession.sparkContext.broadcast(np.packbits(bits))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, bits = Roller(), np.unpackbits(known.value)
        for batch in blocks(batches, limit=2 << 20):
            cut = [words_of(t) for t in batch.column("text").to_pylist()]
            h, text, _ = seed_hashes(cut, roller)
            one, two = _slots(h)
            hit = np.flatnonzero(bits[one])
            hit = hit[bits[two[hit]] == 1]
            found = np.unique(text[hit])
            if not len(found):
                continue
            per = [np.unique(h[hit[text[hit] == t]]).view(np.int64) for t in found]
            take = pa.array(found)
            yield pa.record_batch([batch.column("row").take(take), batch.column("doc_id").take(take), batch.column("text").take(take), pa.array(per, pa.list_(pa.int64()))], names=["row", "doc_id", "text", "seeds"])

    return source.select("row", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"row long, doc_id {kind}, text binary, seeds array<long>")


def _free_runs(free: np.ndarray) -> np.ndarray:
    """Free words from each place on until the next marked one."""
    n = len(free)
    ends = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


def _candidates(text: np.ndarray, item: np.ndarray, sums: tuple[np.ndarray, np.ndarray], runs: tuple[np.ndarray, np.ndarray], size: int, roller: Roller) -> np.ndarray:
    """Rows (words, text place, item place) of the free common runs of ``size`` words or more that cannot be extended, longest first, then from the left."""
    (sum_t, sum_i), (run_t, run_i) = sums, runs
    at_t, at_i = np.flatnonzero(run_t >= size), np.flatnonzero(run_i >= size)
    hash_t, hash_i = roller.slices(sum_t, at_t, at_t + size), roller.slices(sum_i, at_i, at_i + size)
    order = np.argsort(hash_i, kind="stable")
    hash_i, at_i = hash_i[order], at_i[order]
    first, last = np.searchsorted(hash_i, hash_t, side="left"), np.searchsorted(hash_i, hash_t, side="right")
    hits = np.flatnonzero(last > first)
    found = []
    ends = np.cumsum((last - first)[hits])
    begin = 0
    while begin < len(hits):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        part = hits[begin:stop]
        n = (last - first)[part]
        t = np.repeat(at_t[part], n)
        p = at_i[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        inside = (t > 0) & (p > 0) & (text[t - 1] == item[p - 1]) & (run_t[t - 1] > 0) & (run_i[p - 1] > 0)  # of a run that begins earlier
        t, p = t[~inside], p[~inside]
        low, high = np.full(len(t), size), np.minimum(run_t[t], run_i[p])
        while len(t) and (low < high).any():  # the length by bisection over the running hashes
            middle = (low + high + 1) // 2
            same = roller.slices(sum_t, t, t + middle) == roller.slices(sum_i, p, p + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        found.append(np.stack([low, t, p], axis=1))
        begin = stop
    every = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return every[np.lexsort((every[:, 2], every[:, 1], -every[:, 0]))]


def tile(text: np.ndarray, item: np.ndarray, roller: Roller, shortest: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (text place, item place, words) of two word-number sequences, longest first, then from the left.

    All free common runs as long as the window are known at once, so they are marked in order; what an earlier tile leaves of one
    goes back into the queue if it is still as long as the window, else a shorter window finds it.
    """
    open_t, open_i = np.ones(len(text), dtype=bool), np.ones(len(item), dtype=bool)
    sums = roller.sums(text), roller.sums(item)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(text), len(item))
    while size >= shortest:
        runs = _free_runs(open_t), _free_runs(open_i)
        longest = min(int(runs[0].max()), int(runs[1].max()))
        if longest < size:
            size = longest
            continue
        every = _candidates(text, item, sums, runs, size, roller)
        queue: list[tuple[int, int, int]] = []
        at, failed, patience = 0, 0, 64
        while at < len(every) or queue:
            ahead = (-int(every[at, 0]), int(every[at, 1]), int(every[at, 2])) if at < len(every) else None
            if ahead is not None and (not queue or ahead < queue[0]):
                n, t, p = ahead
                at += 1
            else:
                n, t, p = heapq.heappop(queue)
            free = open_t[t : t - n] & open_i[p : p - n]
            if free.any():
                free &= text[t : t - n] == item[p : p - n]  # else words of one hash
            if free.all():
                open_t[t : t - n] = open_i[p : p - n] = False
                tiles.append((t, p, -n))
                if not open_i.any():
                    return tiles
                continue
            failed += 1
            if failed == patience:  # of many places of one run most fall with the first: leave those without room for a window
                every, at, failed, patience = every[at:], 0, 0, 2 * patience
                room_t, room_i = (np.concatenate([[0], np.cumsum(o)]) for o in (open_t, open_i))
                lengths, in_t, in_i = every.T
                every = every[(room_t[in_t + lengths] - room_t[in_t] >= size) & (room_i[in_i + lengths] - room_i[in_i] >= size)]
            edge = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, t + a, p + a))
        size = size - 1 if size <= 2 * shortest else max(2 * shortest, size // 2)
    return tiles


def matches(source: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``row, doc_id, item_id, item_words, matched_words, coverage, tiles`` of the pairs at or over the threshold.

    ``source`` and ``items`` have ``row, doc_id, text``, with rows that are written, so that a row keeps its number.
    """
    seeds = written(item_seeds(items), "item_seeds")
    hits = written(seeded(source, seed_filter(seeds)), "seeded")
    shared = hits.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = shared.groupBy("row", "item_row").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words")).where(F.col("n") * SEED_WORDS >= F.col("words") * coverage)
    pairs = pairs.join(hits.select("row", "doc_id", "text"), "row").join(items.select(F.col("row").alias("item_row"), F.col("doc_id").alias("item_id"), F.col("text").cast("binary").alias("item")), "item_row")
    kinds = source.schema["doc_id"].dataType.simpleString(), items.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in blocks(batches):
            sizes, found = [], []
            for text, item in zip(batch.column("text").to_pylist(), batch.column("item").to_pylist(), strict=True):
                number: dict[bytes, int] = {}
                as_numbers = lambda t: np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int64)  # noqa: B023, E731
                i, t = as_numbers(item), as_numbers(text)
                sizes.append(len(i))
                found.append(sorted(tile(t, i, roller)))
            matched = [sum(n for _, _, n in x) for x in found]
            tiles = pa.array([[{"text_word": t, "item_word": p, "words": n} for t, p, n in x] for x in found], pa.list_(pa.struct([("text_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])))
            share = pa.array([m / n for m, n in zip(matched, sizes, strict=True)], pa.float64())
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), batch.column("item_id"), pa.array(sizes, pa.int64()), pa.array(matched, pa.int64()), share, tiles], names=["row", "doc_id", "item_id", "item_words", "matched_words", "coverage", "tiles"])

    tiled = pairs.select("row", "doc_id", "item_id", "text", "item").mapInArrow(
        run, f"row long, doc_id {kinds[0]}, item_id {kinds[1]}, item_words long, matched_words long, coverage double, tiles array<struct<text_word: long, item_word: long, words: long>>"
    )
    return tiled.where(F.col("coverage") >= coverage)


def numbered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())


def contaminated(df: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, item_words, matched_words, coverage, tiles`` of every document and item that match."""
    items = written(numbered(benchmark, item_id, item_text), "items")
    return matches(numbered(df, id_col, text_col), items, coverage).drop("row")
