"""Near-duplicates by the similarity of texts' word shingles: those linked at a Jaccard similarity of 0.8 or more.

A text's shingles are its runs of five words (split at whitespace, lower case), each as an XXH64 value; a text of fewer words is one
shingle. Texts with equal sets of shingles are one class. Candidates come from two sides, and all are compared by their whole
sets, so every link is a true one. A class has the SimHash fingerprint of its set; fingerprints within two bits of each other are
found by their Golay keys (module ``golay``), classes of one fingerprint are compared with the first of them. A pair at 0.8 differs
in about ten of 64 bits, more than these keys reach, so a class also has ``BANDS`` keys of ``ROWS`` minimum hashes each, and classes
that share one are compared. A pair at 0.8 shares no such key with a probability of (1 - 0.8^5)^45 = 2e-8, and of less if it is
more alike: that is the only way to miss a link.

Classes of a key that few share are compared pair by pair, each pair once. The classes of a crowded key are dealt to blocks, and
each two blocks are compared in one task by an inverted index of their shingles, which yields a spanning forest of the links: no
group yields all its pairs. Sets are made again from the texts of classes that share a key; those of others are never stored.

Nulls, empty and blank texts have no shingles and are one class; repeated rows share their component; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import golay
from barline.llm.common import blocks, texts, tidy
from barline.llm.components import components
from barline.session import written

WORDS = 5
SEED = 42
BANDS, ROWS = 45, 5
CROWD = 8  # classes of a key up to which they are compared pair by pair
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 18  # of a crowded key, about


def shingles(text: str, words_per_shingle: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    words = text.lower().split()
    n = max(1, len(words) - words_per_shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    found = (digest(" ".join(words[i : i + words_per_shingle]).encode(), SEED) for i in range(n))
    return np.unique(np.fromiter(found, dtype=np.uint64, count=n))


def band_keys(found: np.ndarray) -> list[int]:
    """``BANDS`` keys of a set of shingles; none of an empty one."""
    if not len(found):
        return []
    rng = np.random.default_rng(SEED)
    mask, factor = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    factor |= np.uint32(1)
    short = (found ^ found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(short), 1 << 11):
        np.minimum(least, ((short[None, i : i + (1 << 11)] ^ mask) * factor).min(axis=1), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], b) - (1 << 63) for b in range(BANDS)]


def alike(common, total):  # noqa: ANN001, ANN201
    """Whether sets of ``total`` shingles in sum, ``common`` of them shared, have a similarity of 0.8: c / (t - c) >= 4 / 5."""
    return 9 * common >= 4 * total


def _decoded(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (shingles(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist())


def sketches(source: DataFrame) -> DataFrame:
    """``doc_id, digest, n, keys, fp`` of ``doc_id, text``: a digest of the set, its size, its keys and its fingerprint; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            digest, n, keys, fp = [], [], [], []
            for found in _decoded(batch):
                digest.append(xxhash.xxh128_digest(found.tobytes()))
                n.append(len(found))
                keys.append(band_keys(found))
                fp.append(golay.simhash(found))
            yield pa.record_batch([batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp, pa.int64())], names=["doc_id", "digest", "n", "keys", "fp"])

    return source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, digest binary, n long, keys array<long>, fp long")


def sets(source: DataFrame) -> DataFrame:
    """``doc_id, shingles``: the sorted values as bytes; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array([s.tobytes() for s in _decoded(batch)], pa.binary())], names=["doc_id", "shingles"])

    return source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, shingles binary")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b`` whose sets ``x, y`` are alike."""
    for batch in batches:
        found = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
            found.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))))
        yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(found, pa.bool_()))


def forest(found: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of pairs that are alike, as many as connect all that such pairs connect."""
    m, n = len(found), np.array([len(s) for s in found])
    owner = np.repeat(np.arange(m), n)
    _, value, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    order = np.argsort(value, kind="stable")
    held, first = owner[order], np.cumsum(count) - count
    top = list(range(m))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    links = []
    for i, (start, size) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
        mine = value[start : start + size]
        mine = mine[count[mine] > 1]
        many = count[mine]
        places = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(held[places], minlength=m)
        for j in (np.flatnonzero(alike(common[i + 1 :], size + n[i + 1 :])) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                top[b] = a
                links.append((i, j))
    return links


def _tile(table: pa.Table) -> pa.Table:
    ids = table.column("doc_id").to_numpy()
    links = forest([np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()])
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})


def golay_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes ``doc_id, fp``: the first ones of fingerprints that link, and of one fingerprint the first and each other."""
    first = written(classes.groupBy("fp").agg(F.min("doc_id").alias("first")), "shingle_fingerprints")
    side = lambda c, d: first.select(F.col("fp").alias(c), F.col("first").alias(d))
    near = golay.links(first).join(side("a", "u"), "a").join(side("b", "v"), "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    same = classes.select("fp", "doc_id").join(first, "fp").where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return near.union(same)


def links(source: DataFrame, classes: DataFrame, crowd: int = CROWD, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """Links ``a, b`` between classes ``doc_id, n, keys, fp`` that have the components of all links; ``source`` has their texts."""
    keyed = classes.select(F.explode("keys").alias("key"), "doc_id", "n")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    shared = written(keyed.join(sizes, "key"), "shingle_keys")
    few = shared.where(F.col("m") <= crowd).select("key", F.col("doc_id").alias("a"), "n")
    other = few.select("key", F.col("a").alias("b"), F.col("n").alias("n_b"))
    size = 5 * F.least("n", "n_b") >= 4 * F.greatest("n", "n_b")
    shared_keys = few.join(other, "key").where((F.col("a") < F.col("b")) & size).select("a", "b")
    pairs = written(golay_pairs(classes).union(shared_keys).distinct(), "shingle_pairs")
    crowded = shared.where(F.col("m") > crowd)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(crowded.select("doc_id")).distinct()
    held = written(sets(source.join(wanted, "doc_id", "left_semi")), "shingle_sets")
    side = lambda c, s: held.select(F.col("doc_id").alias(c), F.col("shingles").alias(s))
    verified = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(tidy(_compared), "a long, b long")
    k = F.ceil(F.greatest(F.col("m") / block_classes, F.col("total") / BLOCK_SHINGLES))
    dealt = crowded.select("key", "doc_id", k.alias("k"), F.pmod(F.xxhash64("doc_id"), k).alias("block"))
    copied = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    tiles = copied.select("key", F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high"), "doc_id").join(held, "doc_id")
    return verified.union(tiles.groupBy("key", "low", "high").applyInArrow(_tile, "a long, b long")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "row", text_col: str = "text", crowd: int = CROWD, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """``doc_id, component_id`` of each row of distinct long ids: the smallest id reachable over links, the own class included."""
    source = texts(df, id_col, text_col)
    marked = written(sketches(source), "shingle_sketches")
    classes = written(marked.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "keys", "fp")).alias("c")).select("digest", "c.*"), "shingle_classes")
    reached = components(links(source, classes.drop("digest"), crowd, block_classes))
    named = classes.select("digest", "doc_id").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    return marked.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")
