"""Scores of the language model: exact base columns, a proper distribution, and what training gains."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np

from barline.llm import language
from barline.llm.recurrent import Model, Shape, initial, views

SMALL = Shape(classes=4, width=4, others=16, hidden=6)


def corpus() -> list[tuple]:
    """Texts in two languages whose words alternate between two halves."""
    rng = random.Random(9)
    halves = [[[f"{k}{h}{i}" for i in range(20)] for h in "xy"] for k in "ab"]
    rows = []
    for i in range(300):
        k = i % 2
        rows.append((i, " ".join(rng.choice(halves[k][n % 2]) for n in range(rng.randint(5, 60))) + (f" rare{i}" if i % 5 == 0 else "")))
    return [*rows, (1000, None), (1001, ""), (1002, "A b\x0bC"), (1002, "A b\x0bC"), (None, "aX1"), (1003, "ax1 " * 5000)]


def test_base_columns_and_gain(spark):
    rows = corpus()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    cut = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for i, t in rows if not out(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, out(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t in rows)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, row int, word string")
    for head in (300_000, 10):
        got = language.scored(df, head=head, shape=SMALL).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_training_learns_language_and_order():
    rng = np.random.default_rng(3)
    # codes 0-3 and 4-7 are two languages, of which even and odd ones alternate
    texts = [(4 * (i % 2) + 2 * rng.integers(0, 2, 40) + np.arange(40) % 2).astype(np.int32) for i in range(400)]
    model = Model(SMALL, initial(SMALL, np.bincount(np.concatenate(texts), minlength=SMALL.codes).astype(float)))
    before = model.log_likelihoods(texts[:50]).sum() / 2000
    for _ in range(40):
        model.train(texts[50:])
    after = model.log_likelihoods(texts[:50]).sum() / 2000
    assert before < -2.0 and after > -0.85  # ln 8 without the state, ln 2 with it


def test_distribution_sums_to_one_and_state_is_carried():
    rng = np.random.default_rng(1)
    model = Model(SMALL, initial(SMALL, rng.integers(1, 50, SMALL.codes).astype(float)))
    model.flat += 0.3 * rng.standard_normal(len(model.flat)).astype(np.float32)
    model.p = views(SMALL, model.flat)
    head = rng.integers(0, SMALL.codes, 70).astype(np.int32)
    ends = [np.append(head, k).astype(np.int32) for k in range(SMALL.codes)]
    scores = model.log_likelihoods([head, *ends])
    assert abs(np.exp(scores[1:] - scores[0]).sum() - 1) < 1e-3
    alone = [model.log_likelihoods([t])[0] for t in ends[:5]]
    assert np.allclose(alone, scores[1:6], atol=1e-3)  # lanes and windows change nothing


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    shape = Shape(classes=2, width=2, others=2, hidden=3)
    texts = [rng.integers(0, shape.codes, n).astype(np.int32) for n in (9, 4, 6)]
    start = initial(shape, np.ones(shape.codes)) + 0.3 * rng.standard_normal(len(initial(shape, np.ones(shape.codes)))).astype(np.float32)
    seen = {}

    class Watched(Model):
        def _backward(self, x, s, into, g):  # noqa: ANN001
            super()._backward(x, s, into, g)
            seen["g"] = np.concatenate([g[k].ravel() for k in shape.sizes()]).copy()

    Watched(shape, start).train(texts)
    loss = lambda w: -Model(shape, w).log_likelihoods(texts).sum()
    for i in range(0, len(start), 5):
        up, down = start.copy(), start.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - seen["g"][i]) < 2e-2 * max(1, abs(seen["g"][i]))


def test_empty_table_and_no_training_rows(spark):
    assert language.scored(spark.createDataFrame([], "doc_id long, text string"), shape=SMALL).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = language.scored(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), shape=SMALL).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] and math.isfinite(got[0].score)
