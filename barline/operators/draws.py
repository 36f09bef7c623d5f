"""Resamples with replacement whose draws never become shuffled rows.

Values are gathered once into blocks of consecutive rows of their group. A resample of a group of one block is drawn where the
block is, in numpy, many repetitions at a time. A longer group is split: the draws of a mean are multinomial over its blocks,
so every block finds its own share by going down a binary tree of binomials, drawn from generators keyed by (seed, node) that
all blocks agree on without talking, then draws inside itself; only one sum per block and repetition is shuffled. Where the
order of draws matters in a longer group, its steps are joined to their values and folded by segments of ``SEGMENT`` steps:
(sum, lowest prefix) for ruin and (length, sum up to n) for blocks are merged along the segments, so a path of any length is
many tasks' work and the same draws as in one block.

A draw depends on (seed, repetition, step) only, so a lost task draws the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.session import spread, written

# 31-bit mask and multipliers of the counter-based generator.
MASK = 2**31 - 1
MIX = 73244475
STEP = 1103515245
BLOCK = 1 << 16  # values in one row: 512 kB
SEGMENT = 4096  # steps folded together where draws are joined
TOGETHER = 1 << 16  # draws made in one numpy step, small enough for a processor's cache
WORK = 1 << 20  # draws of a block that one row of work holds


def mixed(df: DataFrame, name: str) -> DataFrame:
    """Scramble a 31-bit column; every product stays within 62 bits.

    One projection per step: written as a single expression, its tree would double at every step.
    """
    c, mask = F.col(name), F.lit(MASK).cast("bigint")
    for _ in range(2):
        df = df.withColumn(name, c.bitwiseXOR(F.shiftright(c, 16)))
        df = df.withColumn(name, (c * F.lit(MIX).cast("bigint")).bitwiseAND(mask))
    return df.withColumn(name, c.bitwiseXOR(F.shiftright(c, 16)))


def scrambled(x: np.ndarray) -> np.ndarray:
    """The same on an array, in place."""
    for _ in range(2):
        x ^= x >> 16
        x *= MIX
        x &= MASK
    x ^= x >> 16
    return x


def places(seed: int, rep: np.ndarray, step: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The place drawn at each (rep, step), from 0 to size - 1."""
    start = scrambled((seed + rep.astype(np.int64) * STEP) & MASK)
    low = ((step & MASK) * STEP) & MASK
    low ^= ((step >> 31) * MIX) & MASK
    low = scrambled(low ^ start)
    high = scrambled(low ^ MIX)
    high <<= 31
    high += low
    high %= size
    return high


@lru_cache(maxsize=64)
def matrix(seed: int, first: int, last: int, begin: int, end: int, size: int) -> np.ndarray:
    """``places`` of repetitions first to last, steps begin to end; groups of one size share it.  At most 64 times ``TOGETHER`` are held."""
    found = places(seed, np.arange(first, last, dtype=np.int64)[:, None], np.arange(begin, end, dtype=np.int64)[None, :], size)
    found.flags.writeable = False
    return found


def _steps(groups: DataFrame, keys: Sequence[str], reps: int, seed: int, steps: str, size: str) -> DataFrame:
    """(keys, rep, step, rn): the row drawn at every step of every repetition, made in segments on the executors."""
    mask, stride, mixer = (F.lit(x).cast("bigint") for x in (MASK, STEP, MIX))
    d = groups.select(*keys, F.col(steps).cast("bigint").alias("_steps"), F.col(size).cast("bigint").alias("_size"))
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))
    d = mixed(d.withColumn("_start", (F.lit(seed).cast("bigint") + F.col("rep") * stride).bitwiseAND(mask)), "_start")
    d = d.withColumn("_segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_steps") - 1) / SEGMENT).cast("bigint"))))
    begin = F.col("_segment") * SEGMENT
    d = spread(d, *keys, "rep", "_segment").withColumn("step", F.explode(F.sequence(begin, F.least(begin + SEGMENT, F.col("_steps")) - 1)))
    s = F.col("step")
    counter = (s.bitwiseAND(mask) * stride).bitwiseAND(mask).bitwiseXOR((F.shiftright(s, 31) * mixer).bitwiseAND(mask))
    d = mixed(d.withColumn("_low", F.col("_start").bitwiseXOR(counter)), "_low")
    d = mixed(d.withColumn("_high", F.col("_low").bitwiseXOR(mixer)), "_high")
    return d.select(*keys, "rep", "_segment", "step", ((F.col("_high") * F.lit(2**31).cast("bigint") + F.col("_low")) % F.col("_size")).alias("rn"))


def _sizes(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "group_sizes")


def _blocks(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], value: Column, block: int) -> DataFrame:
    """(keys, n, _block, _values): values in the order of ``rn``, a row for each block of them."""
    d = rows.select(*keys, "rn", F.floor(F.col("rn") / block).cast("bigint").alias("_block"), value.cast("double").alias("_v"))
    d = d.groupBy(*keys, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "_v"))), lambda x: x["_v"]).alias("_values"))
    return d.join(sizes, list(keys))


def _in_tasks(blocks: DataFrame, keys: Sequence[str], reps: int, out: str, draw: Callable[[np.ndarray, int, int, int, int], np.ndarray]) -> DataFrame:
    """(keys, _block, rep, out): ``draw(values, n, block, first, last)`` for every block, its repetitions dealt out in rows of ``WORK`` draws."""
    keys = list(keys)
    at_once = F.greatest(F.lit(1), F.least(F.lit(reps), F.floor(F.lit(WORK) / F.size("_values")))).cast("int")
    d = blocks.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), at_once))).withColumn("_last", F.least(F.lit(reps), F.col("_first") + at_once))
    d = spread(d, *keys, "_block", "_first").select(*keys, "n", "_block", "_first", "_last", "_values")
    kinds = [f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = zip(*(batch.column(c).to_pylist() for c in ("n", "_block", "_first", "_last")), strict=True)
            for i, (n, block, first, last) in enumerate(work):
                found = draw(batch.column("_values").slice(i, 1).flatten().to_numpy(zero_copy_only=False), n, block, first, last)
                again = pa.array(np.full(last - first, i))
                held = [batch.column(k).take(again) for k in keys]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(last - first, block)), pa.array(np.arange(first, last)), pa.array(found)], names=[*keys, "_block", "rep", out])

    return d.mapInArrow(run, ", ".join([*kinds, "_block long", "rep long", f"{out} double"]))


def _together(first: int, last: int, steps: int) -> Iterator[tuple[int, int]]:
    """Ranges of repetitions with about ``TOGETHER`` draws, one at least."""
    size = max(1, TOGETHER // steps)
    for a in range(first, last, size):
        yield a, min(last, a + size)


def _share(seed: int, reps: int, n: int, block: int, width: int) -> np.ndarray:
    """How many of the n draws of each repetition fall into a block of the group: down the tree of binomials to its leaf."""
    count, low, high, node = np.full(reps, n, dtype=np.int64), 0, -(-n // width), 1
    while high - low > 1:
        middle = (low + high) // 2
        of = min(n, high * width) - low * width
        left = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), node])).binomial(count, (middle - low) * width / of)
        if block < middle:
            count, high, node = left, middle, 2 * node
        else:
            count, low, node = count - left, middle, 2 * node + 1
    return count


def _ragged(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of repetitions with about ``TOGETHER`` draws, one at least."""
    start, total = 0, 0
    for i, c in enumerate(counts.tolist()):
        if i > start and total + c > TOGETHER:
            yield start, i
            start, total = i, 0
        total += c
    if len(counts):
        yield start, len(counts)


def bootstrap_means(rows: DataFrame, keys: Sequence[str], value: str, reps: int = 2000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Mean of each of ``reps`` resamples with replacement; ``rows`` carry ``rn`` (0-based, per group).  Groups of one row have none."""
    keys = list(keys)
    values = _blocks(rows, _sizes(rows, keys, 2), keys, F.col(value), block)

    def draw(v: np.ndarray, n: int, at: int, first: int, last: int) -> np.ndarray:
        sums = np.zeros(last - first)
        if n == len(v):
            for a, b in _together(first, last, n):
                sums[a - first : b - first] = v[matrix(seed, a, b, 0, n, n)].sum(axis=1)
            return sums / n
        share = _share(seed, reps, n, at, block)[first:last]
        rep = np.arange(first, last, dtype=np.int64)
        for a, b in _ragged(share):
            counts = share[a:b]
            ends = np.cumsum(counts)
            step = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - counts, counts)
            drawn = v[places(seed + at * MIX, np.repeat(rep[a:b], counts), step, len(v))]
            held = np.flatnonzero(counts)
            if len(held):
                sums[a + held] = np.add.reduceat(drawn, (ends - counts)[held])
        return sums / n

    return _in_tasks(values, keys, reps, "mean", draw).groupBy(*keys, "rep").agg(F.sum("mean").alias("mean"))


def _long(sizes: DataFrame, block: int) -> DataFrame | None:
    """Groups of more rows than a block, if there are any."""
    long = sizes.filter(F.col("n") > block)
    return None if long.isEmpty() else long


def _both(short: DataFrame, long: DataFrame | None) -> DataFrame:
    return short if long is None else short.unionByName(long)


def block_bootstrap_means(rows: DataFrame, keys: Sequence[str], value: str, length: int = 5, reps: int = 2000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """As ``bootstrap_means`` with consecutive blocks of ``length`` (the last may be short), drawn until n values, then cut to n."""
    keys = list(keys)
    sizes = _sizes(rows, keys, 2)

    def draw(v: np.ndarray, n: int, _: int, first: int, last: int) -> np.ndarray:
        pieces = -(-n // length)
        padded = np.zeros(pieces * length)
        padded[:n] = v
        sums = np.hstack([np.zeros((pieces, 1)), np.cumsum(padded.reshape(pieces, length), axis=1)])
        lengths = np.full(pieces, length)
        lengths[-1] = n - (pieces - 1) * length
        out = np.zeros(last - first)
        for a, b in _together(first, last, pieces):
            taken, begin = np.zeros(b - a, dtype=np.int64), 0
            while taken.min() < n:  # another round of draws only where short blocks have left a gap
                drawn = matrix(seed, a, b, begin, begin + pieces, pieces)
                size = lengths[drawn]
                before = taken[:, None] + np.cumsum(size, axis=1) - size
                out[a - first : b - first] += sums[drawn, np.clip(n - before, 0, size)].sum(axis=1)
                taken, begin = taken + size.sum(axis=1), begin + pieces
        return out / n

    short = _in_tasks(_blocks(rows, sizes.filter(F.col("n") <= block), keys, F.col(value), block), keys, reps, "mean", draw).drop("_block")
    long = _long(sizes, block)
    return _both(short, None if long is None else _long_block_means(rows, long, keys, value, length, reps, seed))


def _long_block_means(rows: DataFrame, sizes: DataFrame, keys: list[str], value: str, length: int, reps: int, seed: int) -> DataFrame:
    d = rows.join(sizes.select(*keys), keys, "left_semi").withColumn("_piece", F.floor(F.col("rn") / length).cast("bigint"))
    d = d.groupBy(*keys, "_piece").agg(F.array_sort(F.collect_list(F.struct("rn", F.col(value).alias("v")))).alias("_m"))
    sums = F.transform(F.sequence(F.lit(0), F.size("_m")), lambda i: F.aggregate(F.slice("_m", F.lit(1), i), F.lit(0.0), lambda a, m: a + m["v"]))
    pieces = d.select(*keys, F.col("_piece").alias("rn"), F.size("_m").alias("_len"), sums.alias("_sums"))
    tail = F.when(F.col("n") % length == 0, length).otherwise(F.col("n") % length)
    sized = sizes.withColumn("_pieces", F.ceil(F.col("n") / length)).withColumn("_steps", F.when(F.col("n") % length == 0, F.col("_pieces")).otherwise(F.ceil(F.col("n") / tail)))
    drawn = _steps(sized, keys, reps, seed, "_steps", "_pieces").hint("merge").join(pieces, [*keys, "rn"])
    segments = drawn.groupBy(*keys, "rep", "_segment").agg(F.sum("_len").alias("_size"), F.array_sort(F.collect_list(F.struct("step", "_len", "_sums"))).alias("_drawn"))
    earlier = Window.partitionBy(*keys, "rep").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    # the offsets meet without the draws they belong to
    offsets = segments.select(*keys, "rep", "_segment", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    d = segments.join(offsets, [*keys, "rep", "_segment"]).join(sizes, keys).filter(F.col("_before") < F.col("n"))
    start = F.struct(F.col("_before").alias("before"), F.lit(0.0).alias("sum"))

    def take(state: Column, piece: Column) -> Column:
        taken = F.least(F.greatest(F.col("n") - state["before"], F.lit(0)), piece["_len"]).cast("int")
        return F.struct((state["before"] + piece["_len"]).alias("before"), (state["sum"] + F.element_at(piece["_sums"], taken + 1)).alias("sum"))

    d = d.withColumn("_sum", F.aggregate("_drawn", start, take)["sum"])
    return d.groupBy(*keys, "rep").agg((F.sum("_sum") / F.max("n")).alias("mean")).select(*keys, "rep", "mean")


def ruin_probability(rows: DataFrame, keys: Sequence[str], value: str, capital: float = 20.0, simulations: int = 5000, seed: int = 0, cost: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Share of resampled paths (n steps) whose capital reaches 0 at any step."""
    keys = list(keys)
    sizes = _sizes(rows, keys, 1)
    paid = F.col(value) - F.lit(cost)

    def draw(v: np.ndarray, n: int, _: int, first: int, last: int) -> np.ndarray:
        out = np.zeros(last - first)
        for a, b in _together(first, last, n):
            out[a - first : b - first] = capital + np.cumsum(v[matrix(seed, a, b, 0, n, n)], axis=1).min(axis=1)
        return out

    short = _in_tasks(_blocks(rows, sizes.filter(F.col("n") <= block), keys, paid, block), keys, simulations, "low", draw).drop("_block")
    long = _long(sizes, block)
    walks = _both(short, None if long is None else _long_walks(rows, long, keys, paid, capital, simulations, seed))
    return walks.groupBy(*keys).agg(F.avg((F.col("low") <= 0).cast("double")).alias("ruin_probability"))


def _long_walks(rows: DataFrame, sizes: DataFrame, keys: list[str], paid: Column, capital: float, simulations: int, seed: int) -> DataFrame:
    values = rows.join(sizes.select(*keys), keys, "left_semi").select(*keys, "rn", paid.cast("double").alias("_v"))
    drawn = _steps(sizes, keys, simulations, seed, "n", "n").hint("merge").join(values, [*keys, "rn"])
    segments = drawn.groupBy(*keys, "rep", "_segment").agg(F.array_sort(F.collect_list(F.struct("step", "_v"))).alias("_drawn"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("low"))

    def walk(state: Column, x: Column) -> Column:
        return F.struct((state["sum"] + x["_v"]).alias("sum"), F.least(state["low"], state["sum"] + x["_v"]).alias("low"))

    folded = segments.select(*keys, "rep", "_segment", F.aggregate("_drawn", start, walk).alias("_f"))
    earlier = Window.partitionBy(*keys, "rep").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    d = folded.withColumn("_at", F.coalesce(F.sum("_f.sum").over(earlier), F.lit(0.0)) + F.col("_f.low"))
    return d.groupBy(*keys, "rep").agg((F.lit(capital) + F.min("_at")).alias("low"))
