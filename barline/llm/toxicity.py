"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

A sentence is compared by its units: words in lower case without ASCII punctuation, single characters in a row joined to one
unit, long words in overlapping windows. The kernel of units (``kernel.Kernel``) tolerates gaps and inserted characters, in any
script and at any length. It is approximated on landmark units: some that training texts marked toxic hold more than others,
and the commonest of the others. Training is on labelled sentences, which count by their worst unit: the sentence of a toxic text
with the worst unit by margin, and those with units that tell of toxic texts, are positive; of another text the sentences with the
worst units are negative. The machine is fitted on these units' Nyström features, and the choice is repeated with its margins. A
text's margin is that of its worst unit, turned into a probability by a logistic curve; the curve and the machine's penalty
are chosen on every fourth training text, from which no unit was taken.

Fitting takes at most ``SAMPLE`` labelled texts of either label and of at most ``LONGEST`` bytes, those with the smallest hash
of their id. Scoring reads every whole text. A null, empty or blank text gets the score of a text without units; repeated rows
are scored alike; without labelled texts of both labels every score is the share of toxic ones (0 without any); labels that
are null are left out; an empty table gives an empty result. Of several labels of one id, the highest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barline.llm.common import blocks, give_back, texts, tidy
from barline.llm.kernel import Kernel

SAMPLE, LONGEST = 2500, 20_000
LANDMARKS, CANDIDATES, ROUNDS = 128, 400, 6
SUPPORT, SPREAD, TELLING, PENALTIES = 3, 0.8, 0.25, (1.0, 0.1, 10.0)
WINDOW, STEP = 16, 8
KEPT = 200_000  # units a worker remembers
FOLDS, HELD_OUT = 5, 0
SENTENCE = re.compile(r"[.!?\n]+")
DROPPED = {c: None for c in range(33, 127) if not chr(c).isalnum()}


def units(text: str) -> set[str]:
    """Units of a sentence or text."""
    words = text.translate(DROPPED).lower().split()
    out = set(words)
    single = bytes([len(w) == 1 for w in words])
    at = single.find(b"\1\1\1")
    while at >= 0:
        end = single.find(b"\0", at)
        end = end if end >= 0 else len(words)
        out.add("".join(words[at:end]))
        at = single.find(b"\1\1\1", end)
    for w in [w for w in out if len(w) > WINDOW]:
        out.remove(w)
        out.update(w[i : i + WINDOW] for i in range(0, len(w) - WINDOW + STEP, STEP))
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the rows inside the margin, halved until the loss falls."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0.0, 1 - y * (z @ w)) ** 2).sum() + (ridge * w * w).sum())

    now = loss(w)
    for _ in range(100):
        inside = y * (z @ w) < 1
        a = z[inside] * weight[inside, None]
        step = np.linalg.solve(a.T @ z[inside] + np.diag(ridge), a.T @ y[inside]) - w
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if now - then <= 1e-10 * max(1.0, now):
            break
        w, now = w + size * step, then
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x), with the targets drawn in a little."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


@dataclass
class Model:
    """Landmarks with their coefficients, and the curve from margin to probability."""

    landmarks: list[str] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None  # without a machine

    def __post_init__(self) -> None:
        self.kernel = Kernel(self.landmarks) if self.landmarks else None
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("kernel", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def margins(self, of: list[set[str]]) -> list[float]:
        """The worst unit's margin of each set of units; a set without units has that of a string that nothing matches."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*of).difference(self.known)) if of else []
        self.known.update(zip(new, self.kernel.combined(new, self.coefficients).tolist(), strict=True))
        worth = self.known.__getitem__
        return [max(map(worth, u), default=0.0) + self.bias for u in of]

    def scores(self, texts_: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts_)
        m = np.array(self.margins([units(t) for t in texts_]))
        return (1 / (1 + np.exp(-np.clip(self.slope * m + self.intercept, -30, 30)))).tolist()


def _landmarks(toxic: list[frozenset[str]], other: list[frozenset[str]], count: int) -> tuple[list[str], dict[str, float]]:
    """Units telling of toxic texts, spread out by kernel, then the commonest of other texts; and how telling each unit is."""
    a, b = Counter(u for d in toxic for u in d), Counter(u for d in other for u in d)
    na, nb = max(1, len(toxic)), max(1, len(other))

    def telling(u: str) -> float:
        p, q = (a[u] + 0.5) / (na + 1), (b[u] + 0.5) / (nb + 1)
        return p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q)) if p > q else 0.0

    least = max(SUPPORT, na // 200)  # a unit of a text or two tells of these texts only
    worth = {u: telling(u) for u, n in a.items() if n >= least}
    ranked = sorted((u for u in worth if worth[u] > 0), key=lambda u: (-worth[u], u))[:CANDIDATES]
    similar = Kernel(ranked).features(ranked) if ranked else np.zeros((0, 0))
    chosen: list[int] = []
    for i in range(len(ranked)):
        if len(chosen) < count // 2 and all(similar[i, j] < SPREAD for j in chosen):
            chosen.append(i)
    picked = [ranked[i] for i in chosen]
    common = [u for u, _ in sorted(b.items(), key=lambda x: (-x[1], x[0])) if u not in set(picked)]
    return picked + common[: count - len(picked)], worth


def _machine(toxic: list[frozenset[str]], other: list[frozenset[str]], landmarks: int, penalties: Sequence[float]) -> list[Model]:
    """A machine for each penalty, all on the units that the first one's margins choose: of a toxic text the worst unit of its
    worst sentence and those nearly as telling as the most telling one; of other texts the worst unit in turn, and all that were
    the worst before stay, until no new one comes inside the margin."""
    marks, worth = _landmarks(toxic, other, landmarks)
    if not marks:
        return []
    kernel = Kernel(marks)
    values, vectors = np.linalg.eigh(kernel.features(marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström features are kernel @ root
    every = sorted(set().union(*toxic, *other))
    place = {u: i for i, u in enumerate(every)}
    rows = [[np.array([place[u] for u in d], dtype=np.int32) for d in part] for part in (toxic, other)]
    positives, negatives = Counter(), Counter(place[u] for u in marks if not worth.get(u) and u in place)
    del place
    norms = kernel.all_norms(every)
    tell = np.array([worth.get(u, 0.0) for u in every])
    most = [i for r in rows[0] if len(r) and tell[r].max() > 0 for i in r[tell[r] >= TELLING * tell[r].max()].tolist()]
    known: dict[int, np.ndarray] = {}

    def fitted(penalty: float) -> Model:
        chosen = [*positives, *negatives]
        new = [i for i in chosen if i not in known]
        known.update(zip(new, kernel.features([every[i] for i in new]) @ root, strict=True))
        y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        weight = np.array([*positives.values(), *negatives.values()], dtype=float)
        weight[y > 0] *= weight[y < 0].sum() / max(1.0, weight[y > 0].sum())
        w, bias = _squared_hinge(np.array([known[i] for i in chosen]), y, weight, penalty)
        return Model(marks, root @ w, bias)

    positives.update(most)
    seen = [r[tell[r] > 0] for r in rows[0] if len(r) and tell[r].max() > 0]
    for _ in range(ROUNDS):
        model = fitted(penalties[0])
        margin = kernel.combined(every, model.coefficients, norms) + model.bias
        worst = Counter(int(r[np.argmax(margin[r])]) for r in rows[1] if len(r))
        new = {i: n for i, n in worst.items() if margin[i] > -1 and n > negatives[i]}
        if not new:
            break
        negatives.update({i: n - negatives[i] for i, n in new.items()})
        positives = Counter(most)
        positives.update(int(r[np.argmax(margin[r])]) for r in seen)
    return [fitted(p) for p in penalties]


def fit(labelled: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """A model from (text, label) rows: penalty and curve come from every fourth text, which the machine has not seen."""
    toxic = np.array([y == 1 for _, y in labelled], dtype=bool)
    if not toxic.any() or toxic.all():
        return Model(constant=float(toxic.mean()) if len(toxic) else 0.0)
    one: dict[str, str] = {}  # equal units share one string
    held = lambda s: frozenset(one.setdefault(u, u) for u in s)
    texts_ = [held(set().union(*map(units, SENTENCE.split(t)))) for t, _ in labelled]  # a text's units are those of its sentences
    inner = np.array([crc32(t.encode()) % 4 == 0 for t, _ in labelled])
    if min(toxic[inner].sum(), (~toxic[inner]).sum(), toxic[~inner].sum(), (~toxic[~inner]).sum()) == 0:
        inner[:] = False
    of = lambda choice: [s for s, c in zip(texts_, choice, strict=True) if c]
    models = _machine(of(toxic & ~inner), of(~toxic & ~inner), landmarks, PENALTIES)
    if not models:
        return Model(constant=float(toxic.mean()))
    judged = inner if inner.any() else ~inner
    y, best = toxic[judged].astype(float), None
    for model in models:
        margins = np.array(model.margins(of(judged)))
        model.slope, model.intercept = _logistic(margins, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(model.slope * margins + model.intercept, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        model.known.clear()
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` texts of either label outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("of IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(fold("of") != HELD_OUT).groupBy("of").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64(F.col("of").cast("string"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # of a label with many ids, only those with a hash below half as much again as the sample's share are looked up
    near = F.lit(False)
    for label, n in counts.items():
        near |= (F.col("toxic") == label) & (F.pmod(h, F.lit(1_000_003)) <= int(min(1.0, 1.5 * sample / n) * 1_000_003))
    few = F.broadcast(known.where(near).withColumn("h", h))  # 1.5 * sample rows of either label, give or take their spread
    source = texts(df, id_col, text_col).where(F.octet_length("text") <= LONGEST)
    joined = source.join(few, F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic", "h")
    rows = []
    for label in sorted(counts):
        rows += [(r.text, r.toxic) for r in joined.where(F.col("toxic") == label).orderBy("h", "doc_id", "text").limit(sample).collect()]
    return rows


def fitted(df: DataFrame, labels: DataFrame) -> Model:
    """``fit(training_rows(...))``, after which the driver gives back what the sample and the fit needed."""
    model = fit(training_rows(df, labels))
    give_back()
    return model


def flagged(df: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the column ``score``; narrow. ``text_col`` is a string; a null counts as empty and stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some hundred numbers and strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks(batches, column=text_col, limit=4 << 20):
            found = model.scores([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, score])

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, StructField(score, DoubleType())]))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    out = flagged(texts(df, id_col, text_col), model)
    return out.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scored(df, fit(training_rows(df, labels, id_col, text_col)), id_col, text_col)
