"""Log-likelihood of documents under a recurrent language model learned from the corpus.

Tokens are words (ASCII letters lower-cased) and an end for each text. All training tokens are counted; the commonest words are
outputs of the network (``recurrent``), any other word is an output class by its surface: final punctuation, characters beyond
ASCII, and a hash of its last letters. Within such a class a word has probability (c + 1) / (M + V + 1), with its count c, the
class's tokens M and distinct words V, and one place for all words that training has not met, as in the base score.

The network is trained over every window of every training document, in two passes over disjoint parts: each task runs through
its documents from the same start, and the tasks' weights are averaged by tokens where they are added up, on the executors. Then
every document is scored whole. Counts of the ``HEAD`` most frequent words are broadcast, a bound that holds at any size; other
words leave a document as (row, word, times) and are joined to the counts.

A null text is empty and scores its end alone; repeated rows count and are scored as often as they occur; a null id belongs to
the training part of the empty string; an empty table gives an empty result, one without training rows scores by the uniform
start. A very long text is scored in windows with its state carried on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import blocks, most_frequent, texts
from barline.llm.recurrent import Model, Shape, initial
from barline.session import written

HEAD = 300_000
FOLDS, HELD_OUT = 7, 2
WARM = 16  # one in so many documents is trained on first
BLOCK = 24 << 20
END = b"\n"
PUNCTUATION = b".,;:!?"


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def surface(word: bytes) -> int:
    """One of sixteen classes of words."""
    bare = word.rstrip(PUNCTUATION)
    return 8 * (len(bare) < len(word)) + 4 * (not word.isascii()) + zlib.crc32(bare[-2:]) % 4


def word_counts(training: DataFrame) -> DataFrame:
    """``word, surface, n`` of all training tokens, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            seen: Counter[bytes] = Counter()
            for t in batch.column("text").to_pylist():
                seen.update(t.lower().split())
            seen[END] += batch.num_rows
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array([surface(w) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "surface", "n"])

    return training.select("text").mapInArrow(run, "word binary, surface int, n long").groupBy("word", "surface").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Number of each frequent word; any other word's number follows from its surface.

    Numbers index ``code`` (the network's), ``base`` and ``inner`` (log10 probability under the base and within its class).
    """

    def __init__(self, shape: Shape, counts: list[tuple[bytes, int]], tokens: int, distinct: int, mass: np.ndarray, kinds: np.ndarray):
        ranked = sorted(counts, key=lambda x: (-x[1], x[0]))
        if END not in (common := [w for w, _ in ranked[: shape.common]]):  # the end is an output of the network in any case
            at = next((x for x in ranked if x[0] == END), (END, 0))
            ranked = [*ranked[: shape.common - 1], at, *[x for x in ranked[shape.common - 1 :] if x[0] != END]]
            common = [w for w, _ in ranked[: shape.common]]
        super().__init__({w: i for i, (w, _) in enumerate(ranked)})
        self.shape, self.size, self.tokens, self.distinct = shape, len(ranked), tokens, distinct
        n = np.array([n for _, n in ranked] + [0] * shape.others, dtype=np.float64)
        kind = np.array([surface(w) for w, _ in ranked] + list(range(shape.others)), dtype=np.int64)
        own, ones = np.zeros(shape.others), np.zeros(shape.others)
        np.add.at(own, kind[: len(common)], n[: len(common)])
        np.add.at(ones, kind[: len(common)], (n[: len(common)] > 0).astype(float))
        self.mass, self.kinds = mass - own, kinds - ones
        self.known = n > 0
        self.code = np.where(np.arange(len(n)) < len(common), np.arange(len(n)), shape.common + kind).astype(np.int32)
        self.base = np.log10((n + 1) / (tokens + distinct + 1))
        self.inner = np.where(np.arange(len(n)) < len(common), 0.0, np.log10((n + 1) / (self.mass + self.kinds + 1)[kind]))
        # joined to their counts elsewhere
        self.base[self.size :] = self.inner[self.size :] = 0.0
        self.start = np.zeros(shape.codes)
        self.start[: len(common)] = n[: len(common)]
        self.start[shape.common :] = self.mass

    def __missing__(self, word: bytes) -> int:
        return self.size + surface(word)

    def __reduce__(self) -> tuple:
        return _restored, (dict(self), self.__dict__)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of a text's words and its end."""
        out = np.empty(len(words) + 1, dtype=np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        out[-1] = dict.__getitem__(self, END)
        return out


def _restored(items: dict, state: dict) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    out.update(items)
    out.__dict__.update(state)
    return out


def vocabulary(counts: DataFrame, shape: Shape, head: int) -> Vocabulary:
    rows = counts.groupBy("surface").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()  # a row a surface
    mass, kinds = np.zeros(shape.others), np.zeros(shape.others)
    for r in rows:
        mass[r.surface], kinds[r.surface] = r.n, r.kinds
    frequent = most_frequent(counts, "word", "n", head).select("word", "n").toPandas()
    return Vocabulary(shape, [(bytes(w), int(n)) for w, n in zip(frequent["word"], frequent["n"], strict=True)], int(mass.sum()), int(kinds.sum()), mass, kinds)


def trained(training: DataFrame, vocab, shape: Shape, start: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """Weights after one pass over ``doc_id, text``: the mean over tasks, weighted by their tokens."""
    shared = training.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, seen = vocab.value, Model(shape, shared.value), 0
        for batch in blocks(batches, limit=BLOCK):
            seen += model.train([words.code[words.numbers(t.lower().split())] for t in batch.column("text").to_pylist()])
        if seen:
            n = len(model.flat)
            yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(model.flat.astype(np.float64) * seen), pa.array(np.full(n, float(seen)))], names=["i", "weighted", "seen"])

    parts = training.select("text").mapInArrow(run, "i int, weighted double, seen double").groupBy("i").agg((F.sum("weighted") / F.sum("seen")).alias("value"))
    rows = parts.toPandas()  # as many as the network has weights
    out = start.copy()
    out[rows["i"].to_numpy()] = rows["value"].to_numpy()
    return out


def scored(df: DataFrame, head: int = HEAD, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row (log10)."""
    spark = df.sparkSession
    source = texts(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    training = source.where(~held_out())
    counts = written(word_counts(training), "word_counts")
    words = vocabulary(counts, shape, head)
    tokens, distinct = words.tokens, words.distinct
    mass = (words.mass + words.kinds + 1).tolist()
    shared = spark.sparkContext.broadcast(words)
    warm = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(WARM)) == 0
    weights = initial(shape, words.start)
    if tokens:
        weights = trained(training.where(warm), shared, shape, weights)
        weights = trained(training.where(~warm), shared, shape, weights)
    network = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with all but its rare words, then a row for each rare word."""
        v, model = shared.value, Model(shape, network.value)
        for batch in blocks(batches, limit=BLOCK):
            codes, size, known, base, inner, rare = [], [], [], [], [], []
            for t in batch.column("text").to_pylist():
                cut = t.lower().split()
                numbers = v.numbers(cut)
                codes.append(v.code[numbers])
                size.append(len(numbers))
                known.append(int(v.known[numbers].sum()))
                base.append(float(v.base[numbers].sum()))
                inner.append(float(v.inner[numbers].sum()))
                rare.append(Counter([cut[i] for i in np.flatnonzero(numbers >= v.size)]))
            network_score = model.log_likelihoods(codes) / np.log(10) + np.array(inner)
            times = [1 + len(r) for r in rare]
            which = np.repeat(np.arange(len(rare)), times)
            first = np.zeros(len(which), dtype=bool)
            first[np.cumsum([0, *times[:-1]])[: len(times)]] = True
            take, blank = pa.array(which), ~first
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(take), batch.column("row").take(take),
                    pa.array(np.array(size, dtype=np.int64)[which], mask=blank), pa.array(np.array(known, dtype=np.int64)[which], mask=blank),
                    pa.array(np.array(base, dtype=np.float64)[which], mask=blank), pa.array(network_score[which], mask=blank),
                    pa.array([w for r in rare for w in [None, *r]], pa.binary()), pa.array([n for r in rare for n in [None, *r.values()]], pa.int64()),
                    pa.array([k for r in rare for k in [None, *map(surface, r)]], pa.int32()),
                ],
                names=["doc_id", "row", "n_tokens", "known", "base", "network", "word", "times", "surface"],
            )

    form = f"doc_id {kind}, row long, n_tokens long, known long, base double, network double, word binary, times long, surface int"
    parts = written(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, form), "score_parts")
    # n is null for a word that training has not met
    rare = parts.where("word IS NOT NULL").select("row", "word", "times", "surface").join(counts.select("word", "n"), "word", "left")
    c = F.coalesce("n", F.lit(0)) + 1
    within = F.element_at(F.array(*[F.lit(m) for m in mass]), F.col("surface") + 1)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(c / F.lit(float(tokens + distinct + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.log10(c / within)).alias("more_score"),
    )
    none = lambda name: F.coalesce(name, F.lit(0))
    return parts.where("word IS NULL").join(sums, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + none("more_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("more_base")).alias("base_score"), (F.col("network") + none("more_score")).alias("score"),
    )
