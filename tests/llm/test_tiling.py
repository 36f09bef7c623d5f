"""Greedy string tiling against a plain search."""

from __future__ import annotations

import random
import re
import time

import numpy as np

from barline.llm import tiling


def plain_coverage(text: str, item: str, least: int = 5) -> int:
    """Words of the item under greedy tiles."""
    a, b = ([w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", x.lower()) if w] for x in (text, item))
    return sum(n for _, _, n in plain_tiles(a, b, least))


def plain_tiles(a: list, b: list, least: int = 5) -> list[tuple[int, int, int]]:
    """Greedy tiles by comparing all places."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((i, j, n))
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


def corpus(rng: random.Random) -> tuple[list, list]:
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for k in range(12)]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            leak = rng.choice(items)[1].split()
            cut = rng.randrange(len(leak))
            parts = [leak[cut:], leak[:cut]] if rng.random() < 0.5 else [leak]
            for p in parts:
                if rng.random() < 0.3 and p:
                    p[rng.randrange(len(p))] = "changed"
                w += [*p, rng.choice(words)]
        docs.append((d, " ".join(x.upper() if rng.random() < 0.1 else x + rng.choice(["", "", ",", "."]) for x in w)))
    return docs, items


def test_matches_equal_plain_search(spark):
    docs, items = corpus(random.Random(4))
    long = " ".join(["filler"] * 5000 + [items[0][1]] + ["filler"] * 5000)
    docs += [(100, None), (101, ""), (102, long), (103, items[1][1]), (103, items[1][1]), (None, items[2][1])]
    items += [(50, None), (51, ""), (52, "too few words"), (None, items[3][1])]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, row int, seed int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None, r.item_id or 0, r.matched_words) for r in tiling.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for d, t in docs:
        for i, x in items:
            n = len(re.findall(r"[a-z0-9]+", (x or "").lower()))
            if n and d != 102 and (m := plain_coverage(t or "", x or "")) >= 0.5 * n:
                want.append((d is None, d or 0, i is None, i or 0, m))
    want.append((False, 102, False, 0, len(items[0][1].split())))
    assert got == sorted(want)


def test_tiles_of_few_words_are_those_of_a_plain_search(monkeypatch):
    rng, roller = random.Random(1), tiling.Roller()
    monkeypatch.setattr(tiling, "PAIRS", 7)  # many parts
    for _ in range(2000):
        letters = rng.choice([1, 2, 3, 4])
        text, item = ([rng.randrange(letters) for _ in range(rng.randint(0, n))] for n in (45, 40))
        least = rng.choice([2, 3, 5])
        assert tiling.tile(np.array(text, dtype=np.int64), np.array(item, dtype=np.int64), roller, least) == plain_tiles(text, item, least)


def test_tiles_of_repetitive_text_are_found_in_seconds():
    text, roller = np.zeros(1_000_000, dtype=np.int64), tiling.Roller()
    begun = time.process_time()
    assert tiling.tile(text, np.zeros(300, dtype=np.int64), roller) == [(0, 0, 300)]
    assert tiling.tile(text, np.array([0] * 150 + [1] + [0] * 149), roller) == [(0, 0, 150), (150, 151, 149)]
    assert time.process_time() - begun < 60


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert tiling.contaminated(none, items).collect() == []
    assert tiling.contaminated(some, items).collect() == []
