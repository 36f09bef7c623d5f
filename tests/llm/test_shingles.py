"""Near-duplicates by shingles against all pairs, and the pipeline's stage on edited copies."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import golay, shingles

FORM = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows: list[tuple]) -> dict[int, int]:
    """The smallest id of each row's component, over all pairs."""
    held, name = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}
    linked = [(i, j) for i in held for j in held if i < j and (held[i] == held[j] or 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]))]
    for _ in rows:
        for i, j in linked:
            name[i] = name[j] = min(name[i], name[j])
    return name


def copies() -> list[tuple]:
    """Texts, copies with one to eight edited words or other ends, chains of copies of copies, and rows without words."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, n = [], 0
    for size in (3, 5, 6, 12, 40, 60, 90, 150, 400):
        for _ in range(3):
            base = say(size)
            rows.append((n := n + 1, " ".join(base)))
            for edits in (1, 2, 3, 5, 8):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(size)] = say(1)[0]
                rows.append((n := n + 1, " ".join(w)))
            rows.append((n := n + 1, " ".join(base + say(max(1, size // 8)))))
            chain = list(base)
            for _ in range(3):
                chain = chain[max(1, size // 10) :] + say(max(1, size // 10))
                rows.append((n := n + 1, " ".join(chain).upper()))
    return [*rows, (n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, rows[0][1].replace(" ", "\n"))]


def test_components_equal_all_pairs(spark):
    rows = copies()
    want = plain(rows)
    df = spark.createDataFrame(rows, "row long, text string")
    assert len(set(want.values())) < len(rows)
    for crowd, block in ((8, 1024), (2, 3), (1, 1024)):  # pair by pair, in tiles of few, and all in one tile
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df, crowd=crowd, block_classes=block).collect()} == want
    assert shingles.near_duplicates(df.limit(0)).collect() == []


def test_stage_drops_edited_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    edited = [*base[:50], "edited", *base[51:]]  # 91 of 101 shingles
    other = [w if i % 20 else "other" for i, w in enumerate(base)]  # under half
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in ((3, base), (1, edited), (2, other), (4, [*base, "end"]))]
    kept = corpus_pipeline.copies_out(spark, spark.createDataFrame(rows, FORM), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


def test_golay_keys_alone_give_candidates(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(50_000)}" for _ in range(8000)]
    texts = [base, [*base[:4000], "edited", *base[4001:]], [*base, "end"], [f"w{rng.randrange(50_000)}" for _ in range(8000)]]
    source = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    classes = shingles.sketches(source).withColumn("keys", F.array().cast("array<long>"))  # no minimum hashes
    fps = [r.fp for r in classes.orderBy("doc_id").collect()]
    near = {(i, j) for i in range(4) for j in range(i + 1, 4) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert (0, 2) in near and all(j < 3 for _, j in near)
    found = {(r.a, r.b) for r in shingles.links(source, classes).collect()}
    assert found == near
    assert fps[0] == golay.simhash(shingles.shingles(" ".join(base))) and golay.simhash(np.zeros(0, np.uint64)) == 0
