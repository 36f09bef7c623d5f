"""The k-means tree against a scan of all vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barline.llm import tree

FORM = "vec_id long, embedding array<float>, key string, leaf int"


def plain(rows: list[tuple], queries: set[int], k: int) -> dict[int, list[tuple[float, int]]]:
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v)).all() and any(v)]
    out = {}
    for i, q in good:
        if i in queries:
            scored = [(-float((q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for j, v in good if j != i]
            out[i] = [(-s, j) for s, j in sorted(scored)[:k]]
    return out


def found(spark, rows: list[tuple], **options) -> dict[int, list[tuple[float, int]]]:
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], FORM)
    out: dict[int, list] = {}
    for r in sorted(tree.nearest(df, F.col("vec_id") % 10 == 0, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    want = plain(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    got = found(spark, rows, leaf_rows=40, sample=1500, trials=40)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, j): s for q, x in want.items() for s, j in x}
    assert all(abs(s - exact[q, j]) < 1e-12 for q, x in got.items() for s, j in x if (q, j) in exact)


def test_crowds_of_equal_vectors_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 400)]
    rows += [(400, None), (410, []), (420, [0.0] * 4), (430, [1.0, None, 1.0, 1.0]), (440, [float("nan")] * 4), (450, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (460, [2.0, 4.0, 6.0, 8.0])]
    want = plain(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    got = found(spark, rows, leaf_rows=20, recall=1.0, cell=16)
    assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in want.items()}


def test_few_and_no_rows(spark):
    assert found(spark, [(10, [1.0, 0.0]), (11, [1.0, 1.0])]) == {10: [(1 / np.sqrt(2), 11)]} or abs(found(spark, [(10, [1.0, 0.0]), (11, [1.0, 1.0])])[10][0][0] - 0.5**0.5) < 1e-12
    assert found(spark, [(10, [1.0, 0.0])]) == {}
    assert found(spark, []) == {}
