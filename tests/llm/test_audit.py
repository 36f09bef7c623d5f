"""The filter audit against a plain walk through all orders."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from barline.llm import audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs: list[tuple], labels: list[tuple]) -> Counter:
    first: dict[str, int] = {}
    for doc, text, *_ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good, toxic = ({d for d, *marks in labels if d is not None and marks[i] == 1} for i in (0, 1))
    seen = []
    for doc, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc is not None and doc > first[text] else set()
        seen.append((lang or "", fails, doc in good, doc in toxic))
    rows = Counter()
    for part in {p for p, *_ in seen}:
        shapley: Counter[str] = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = [x for x in seen if x[0] == part]
            gone: list = []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                shapley[f] += len(out)
                left = [x for x in left if f not in x[1]]
                alone = sum(x[0] == part and x[1] == {f} for x in seen)
                found.append((part, "".join(order), step, len(left), len(out), sum(f in x[1] for x in gone), alone, sum(x[2] for x in out), sum(x[3] for x in out), f))
                gone += out
        rows.update((*r[:-1], shapley[r[-1]]) for r in found)
    return rows


def check(spark, docs: list[tuple], labels: list[tuple]) -> None:
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask string, n long")  # clashing names
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(d, known)
    assert tuple(got.columns) == COLUMNS
    assert Counter(map(tuple, got.collect())) == plain(docs, labels)


def test_equals_a_plain_walk(spark):
    rng = random.Random(4)
    docs = []
    for i in range(300):
        n = rng.choice([0, 5, 99, 100, 101, 150])
        text = " ".join(rng.choice([f"w{rng.randrange(400)}", "the", "LOUD", "a|b", "é x"]) if rng.random() < 0.7 else f"v{j}" for j in range(n))
        docs.append((i, text, rng.choice(["en", "de", None, ""]), "m", i))
    docs += [(rng.randrange(600), d[1], rng.choice(["en", "de"]), None, 0) for d in rng.sample(docs, 120)]  # copies, some under repeated ids
    docs += [(None, docs[3][1], "en", None, 1), (None, None, None, None, None), (7, None, "en", None, 1), (7, None, "en", None, 1), (3, "", "en", None, 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 600, 2)] + [(4, 1, 1), (None, 1, 1)]
    check(spark, docs, labels)


def test_edges_of_thresholds(spark):
    hundred = [f"w{i}" for i in range(100)]
    cases = [
        " ".join(hundred), " ".join(hundred[:99]), " ".join(hundred[:80] + hundred[:20]), " ".join(hundred[:79] + hundred[:21]), "A" + "b" * 9, "AA" + "b" * 17, "AA" + "b" * 18, "x" * 50, "#", "a\x0bb\x0cc",
        "\x1cA\x85", "\t \r\n", " lead", "É" * 100,
    ]
    check(spark, [(i, t, "x", None, 0) for i, t in enumerate(cases)] + [(99, "w " * 200_000, "x", None, 0)], [])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, lang string")
    assert audit.audit(one, labels).count() == 600
