"""Line deduplication against a direct search of all runs."""

from __future__ import annotations

import random

from barline.llm import lines


def plain(rows: list[tuple], least: int) -> list[str]:
    """Texts kept, in the order of (id, row); every run of enough words that has come before goes."""
    docs = [[x.strip() for x in (t or "").split("\n")] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    gone = [set() for _ in docs]
    seen: set[tuple] = set()
    for i in order:
        for start in range(len(docs[i])):
            words = 0
            for end in range(start, len(docs[i])):
                words += len(docs[i][end].split())
                if words < least:
                    continue
                run = tuple(docs[i][start : end + 1])
                if run in seen:
                    gone[i] |= set(range(start, end + 1))
                seen.add(run)
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, (_, t) in enumerate(rows)]


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6]))) for _ in range(12)]
    rows = []
    for i in range(25):
        text = [rng.choice(pool) if rng.random() < 0.7 else f"own {i} {k}" for k in range(rng.randint(1, 14))]
        rows.append((i, "\n".join(text)))
    for i in range(25, 32):
        start = rng.randrange(3)
        rows.append((i, "\n".join([f"x{i}", *rows[rng.randrange(25)][1].split("\n")[start:], f"y{i}"])))
    return rows


def run(spark, rows: list[tuple], least: int) -> list[str]:
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return [r.text for r in sorted(lines.deduplicated(df, least).collect(), key=lambda r: r.row)]


def test_equals_direct_search(spark):
    for seed, least in ((1, 5), (2, 3)):
        rows = corpus(seed)
        assert run(spark, rows, least) == plain(rows, least)


def test_edge_rows(spark):
    long = "\n".join(["", "a b c", " a b c d e f ", ""] * 60)
    rows = [(4, "a b c d e"), (4, "a b c d e"), (None, "q r s t u\nv"), (1, "q r s t u"), (2, None), (3, ""), (5, "\n\n\n"), (6, "\n\n\n"), (7, long), (8, long)]
    assert run(spark, rows, 5) == plain(rows, 5)


def test_runs_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 0, 0), (1, "one two three\nfour five\nsix", 1, 1), (2, "new\none two three\nfour five\nsix", 1, 1)], "doc_id long, text string, row int, pos int").coalesce(1)
    got = {(r.doc_id, r.text): [tuple(d) for d in r.deleted] for r in lines.deduplicated(df).collect()}
    assert got == {(1, "x"): [], (1, "one two three\nfour five\nsix"): [], (2, "new"): [(1, 3)]}


def test_empty_table(spark):
    assert lines.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
