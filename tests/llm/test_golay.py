"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import itertools
import random

import xxhash

from barline.llm import golay
from barline.llm.components import components


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    fp = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values) > 0)
    return fp - (1 << 64) if fp >> 63 else fp


def plain_components(fps: dict[int, int]) -> dict[int, int]:
    root = {d: d for d in fps}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(fps), 2):
        if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(200, 400))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy), "x", i))
    return [*rows, (1, None, "x", 0), (2, "", "x", 0), (3, "  \n", "x", 0), (4, "One", "x", 0), (5, "one", "x", 0), (6, "two words", "x", 0), (7, rows[0][1], "x", 0), (8, "é " * 3000, "x", 0)]


def test_components_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")  # clashing names
    got = {r.doc_id: (r.fp, r.component_id) for r in golay.near_duplicates(df).collect()}
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_components(fps)
    assert got == {d: (fps[d], want[d]) for d in fps}
    crowded = {r.doc_id: r.component_id for r in golay.near_duplicates(df, crowd=1).collect()}
    assert crowded == want


def test_any_two_bits_are_found(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), x ^ 7 << rng.randrange(61)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in golay.links(df).collect()} == pairs


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert golay.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in golay.near_duplicates(twice).collect()] == [1, 1, 1]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
