"""Importance resampling against a plain count of features."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from barline.llm import resampling


def words_of(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features_of(text: str | None) -> list[int]:
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs: list[tuple], target: list[tuple]) -> list[tuple]:
    s, t = Counter(), Counter()
    for d in docs:
        s.update(features_of(d[1]))
    for d in target:
        t.update(features_of(d[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    rows = []
    for doc, text, *_ in docs:
        found = features_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in rows]


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["é", "ß", "日本", "İx", " ", "K"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n\n", "-", "\x7f", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 200])), "x") for i in range(500)]
    docs += [(3, docs[40][1], "x"), (3, docs[40][1], "x"), (None, docs[41][1], "x"), (900, None, None), (901, "", "y"), (902, " ,;\x7f", "y"), (903, "Aa aA " * 40_000, "y"), (904, "z" * 300_000, "y")]
    return docs, [(i, text(40), 0) for i in range(30)] + [(99, None, 0)]


def test_equals_plain_counts(spark):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, weight string").repartition(5)  # a clashing name
    got = resampling.resampled(df, spark.createDataFrame(target, "item_id long, text string, rank int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(docs, target))


def test_blocks_do_not_mix_documents():
    docs = ["a b", None, "c", "", "d e f a b", "Only CAPS"]
    found = resampling.Features(pa.array(docs))
    assert found.n_words.tolist() == [len(words_of(d)) for d in docs]
    n, sums = found.sums(np.arange(10000))
    assert n.tolist() == [len(features_of(d)) for d in docs]
    assert sums.tolist() == [sum(features_of(d)) for d in docs]
    assert found.counts().sum() == n.sum()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20), (2, "")], "doc_id long, text string")
    assert resampling.resampled(none, some).collect() == []
    assert sorted(r.doc_id for r in resampling.resampled(some, none).collect()) == [1, 2]


def test_all_are_drawn_at_full_share(spark):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, x string").repartition(7)
    got = resampling.resampled(df, spark.createDataFrame(target, "doc_id long, text string, x int"), percent=100, least_words=0)
    rows = sorted(got.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(docs) + 1))
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
