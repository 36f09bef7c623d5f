"""Near-duplicates by SimHash fingerprints, joined on keys of the binary Golay code.

A fingerprint has a bit for each of the 64 bits of its shingles' XXH64 values, set where over half of them have it. Two
fingerprints link at two or fewer differing bits. The 64 bits are cut into segments of 22, 21 and 21 bits. With two errors in
all, one segment has none, and the segment after it at most two. A segment is read as a 23-bit word; the perfect Golay code
decodes each such word to the index of the one codeword within three bits. A word and its one-bit neighbours decode to one
index (a word up to two bits from its codeword) or to six, and two words up to two bits apart share one of these, that of the
word half way. A key is thus a segment taken exactly with a Golay index of the next one; fingerprints of one key are joined
and verified.

A key shared by more than ``CROWD`` fingerprints is not joined to itself. Its fingerprints are keyed by all 65 values up to
one bit away instead: fingerprints that share such a value lie within two bits of each other, any two within two bits share
one, and a value has 65 at most. So no group yields all its pairs, and no link between components is lost.

Documents are reduced to distinct fingerprints first. Nulls, empty and blank texts have the fingerprint zero, linked like any
other; texts of one or two words are one shingle; repeated rows share their component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import blocks, texts
from barline.llm.components import components
from barline.session import written

SEED = 42
CROWD = 48  # fingerprints of a key up to which they are joined pair by pair
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of one text, over slices of shingles so that a long text needs no more memory than its words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - words_per_shingle + 1)
    ends = ends[min(words_per_shingle, len(words)) - 1 :]
    digest, votes = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=False)])
        votes += np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def simhash(values: np.ndarray) -> int:
    """SimHash of the XXH64 values of a text's shingles."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 16):
        raw = values[i : i + (1 << 16)].astype(">u8").view(np.uint8)
        votes += np.unpackbits(raw).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(values)).tobytes(), "big", signed=True)


def fingerprints(source: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a long) of ``doc_id, text``; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fp = [fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(maxsize=1)
def decoder() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and high part of a 23-bit word, and the error pattern of each syndrome, by the rule of the code."""

    def syndrome(x: int) -> int:
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        return x

    bit = [syndrome(1 << b) for b in range(23)]
    part = np.zeros((2, 1 << 12), dtype=np.int64)
    for half in range(2):
        for b in range(12 if half == 0 else 11):
            x = np.arange(1 << 12)
            part[half] ^= np.where(x >> b & 1, bit[12 * half + b], 0)
    error = np.zeros(1 << 11, dtype=np.int64)
    for i in range(23):
        error[bit[i]] = 1 << i
        for j in range(i):
            error[bit[i] ^ bit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[bit[i] ^ bit[j] ^ bit[k]] = 1 << i | 1 << j | 1 << k
    return part, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    part, error = decoder()
    return (words ^ error[part[0][words & 0xFFF] ^ part[1][words >> 12]]) >> 11


def fuzzy_keys(segment: np.ndarray, bits: int) -> np.ndarray:
    """A row of the distinct indices of each segment and its one-bit neighbours, filled up with -1."""
    near = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(bits)])[None, :]
    index = np.sort(codeword_index(near), axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    index = -np.sort(-index, axis=1)
    return index[:, :8]


def golay_keys(fps: DataFrame) -> DataFrame:
    """``key, fp``: up to eighteen keys of each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64)
            if not len(fp):
                continue
            segment = [fp >> shift & ((1 << bits) - 1) for shift, bits in SEGMENTS]
            for i in range(3):
                j = (i + 1) % 3
                index = fuzzy_keys(segment[j], SEGMENTS[j][1])
                row, column = np.nonzero(index >= 0)
                key = (i << 34 | segment[i] << 12)[row] | index[row, column]
                yield pa.record_batch([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that have the components of all links of two or fewer differing bits.

    Links of uncrowded keys are all there; a crowded key's are stars whose centre is within two bits of each point.
    """
    keyed = written(golay_keys(fps), "golay_keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key"), "golay_shared")
    few = shared.where(F.col("n") <= crowd).select("key", "fp")
    other = few.select("key", F.col("fp").alias("b"))
    joined = few.join(other, "key").where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2)).select(F.col("fp").alias("a"), "b")
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    one_off = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    near = crowded.select("fp", F.explode(F.transform(one_off, lambda e: F.col("fp").bitwiseXOR(e))).alias("value"))
    group = near.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 members at most
    star = group.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return joined.union(star).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, component_id`` of each row: the smallest document id reachable over links, the own class included."""
    marked = written(fingerprints(texts(df, id_col, text_col), words_per_shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint_classes")
    found = links(classes, crowd)
    # over class representatives, whose order is that of document ids
    ends = found.join(classes.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(classes.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    reached = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")))
    named = classes.join(reached.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):  # noqa: ANN201
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
