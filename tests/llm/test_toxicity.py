"""The subsequence kernel against its definition, and the machine's held-out accuracy."""

from __future__ import annotations

import os
import random
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from barline.llm import toxicity
from barline.llm.kernel import DECAY, Kernel

TABLES = "/root/testdata/sf0.1"


def plain(s: str, t: str) -> float:
    s, t = f"\x02{s}\x03", f"\x02{t}\x03"
    return sum(DECAY ** (a[2] - a[0] + b[2] - b[0] + 2) for a in combinations(range(len(s)), 3) for b in combinations(range(len(t)), 3) if all(s[x] == t[y] for x, y in zip(a, b, strict=True)))


def test_kernel_equals_its_definition():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["zzzz", "a", "ab", "日", "日本", ""]
    fixed = ["abcde", "ééab", "日本", "a"]
    kernel = Kernel(fixed)
    got = kernel.features(words)
    for i, w in enumerate(words):
        for j, f in enumerate(fixed):
            own = plain(w, w) if w else 0
            assert abs(got[i, j] - (plain(w, f) / (own * plain(f, f)) ** 0.5 if own else 0)) < 1e-12
    c = np.array([0.5, -1.0, 2.0, 0.1])
    assert np.allclose(kernel.combined(words, c), got @ c)


def corpus() -> tuple[list, list]:
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "bdgkl" for b in "aeiou" for c in "mnrst" for d in "aeo"]
    bad = ["zonkish", "frobber", "quimplet"]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            w = rng.choice(bad)
            if i % 8 == 0:
                w = rng.choice([w[:3] + "x" + w[3:], " ".join(w), "-".join([w[:3], w[3:]])])
            text.insert(rng.randrange(len(text)), w)
        docs.append((i, " ".join(text) + ".", 0.9, 0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_with_gaps_and_insertions(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out int")
    got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and 60 < len(held) < 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_edge_rows(spark):
    docs, labels = corpus()
    model = toxicity.fit([(t, dict(labels)[i]) for i, t, _, _ in docs[:200]])
    rows = [(None, "x"), (1, None), (2, ""), (3, " \n"), (4, "frobber"), (4, "frobber"), (5, "frobber " + "word " * 20000), (6, "q" * 50000)]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].score == by[2].score == by[3].score < 0.5 < by[4].score and by[5].predicted == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.score for r in toxicity.toxicity(df, none).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(df, spark.createDataFrame([(4, 1), (None, 1), (3, None)], "doc_id long, toxic int")).collect()} <= {0.0, 1.0}
    assert toxicity.toxicity(df.limit(0), none).collect() == []


def rates(model, rows):
    flagged = np.array(model.scores([t for t, _ in rows])) >= 0.5
    y = np.array([y == 1 for _, y in rows])
    return flagged[y].mean(), flagged[~y].mean()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_given_labels_are_decided_alike_from_any_sample():
    documents, labels = (pq.read_table(f"{TABLES}/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    text = {d["doc_id"]: d["text"] or "" for d in documents}
    known = [(i["doc_id"], i["toxic"]) for i in labels if i["toxic"] is not None and i["doc_id"] in text]
    held = [(text[d], y) for d, y in known if crc32(str(d).encode()) % 5 == 0]
    train = [(text[d], y) for d, y in known if crc32(str(d).encode()) % 5]
    found = [rates(toxicity.fit(random.Random(s).sample(train, n)), held) for s, n in ((0, len(train)), (1, len(train) * 2 // 3), (2, len(train) * 2 // 3))]
    assert min(r for r, _ in found) >= 0.8 and max(f for _, f in found) <= 0.1
    assert max(r for r, _ in found) - min(r for r, _ in found) <= 0.08


def test_short_units_and_other_scripts_are_told():
    rng = random.Random(3)
    words = ["мир", "дом", "лес", "во", "на", "я", "снег", "река", "поле", "да"]
    docs = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(20)]
        if i % 3 == 0:
            text.insert(rng.randrange(20), rng.choice(["фу", "ъ"]))
        docs.append((" ".join(text), int(i % 3 == 0)))
    model = toxicity.fit(docs)
    assert rates(model, docs) == (1.0, 0.0)


def test_a_fit_that_gives_memory_back_is_the_same(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3)
    here, there = toxicity.fit(toxicity.training_rows(df, known)), toxicity.fitted(df, known)
    texts = [t or "" for _, t, _, _ in docs]
    assert np.allclose(there.scores(texts), here.scores(texts), atol=1e-9)
    assert toxicity.fitted(df, known.limit(0)).scores(["x"]) == [0.0]
