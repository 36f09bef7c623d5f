"""Resamples drawn in blocks against a step-by-step version, and long groups against short ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import draws


def plain_place(seed: int, rep: int, step: int, size: int) -> int:
    def scramble(x: int) -> int:
        for _ in range(2):
            x = ((x ^ x >> 16) * draws.MIX) & draws.MASK
        return x ^ x >> 16

    start = scramble((seed + rep * draws.STEP) & draws.MASK)
    low = scramble(start ^ ((step & draws.MASK) * draws.STEP & draws.MASK) ^ ((step >> 31) * draws.MIX & draws.MASK))
    return (scramble(low ^ draws.MIX) * 2**31 + low) % size


def test_places_are_the_counter_based_draws():
    rep, step = np.arange(20), np.array([0, 1, 5, 4096, 2**31 + 7])
    got = draws.places(12345, rep[:, None], step[None, :], 1009)
    assert got.tolist() == [[plain_place(12345, r, s, 1009) for s in step.tolist()] for r in rep.tolist()]
    assert step.tolist() == [0, 1, 5, 4096, 2**31 + 7]  # arguments stay


def groups() -> dict[str, list[float]]:
    rng = random.Random(1)
    return {"a": [float(rng.randint(-40, 43)) for _ in range(203)], "b": [float(rng.randint(-9, 10)) for _ in range(41)], "two": [1.0, 4.0], "one": [7.0]}


def table(spark):
    rows = [(g, i, v, "rep") for g, vs in groups().items() for i, v in enumerate(vs)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "g string, rn long, v double, mean string")  # a clashing name


def test_means_equal_single_draws(spark):
    got = {(r.g, r.rep): r["mean"] for r in draws.bootstrap_means(table(spark), ["g"], "v", 30, 5).collect()}
    want = {(g, r): sum(vs[plain_place(5, r, s, len(vs))] for s in range(len(vs))) / len(vs) for g, vs in groups().items() if len(vs) > 1 for r in range(30)}
    assert got == pytest.approx(want)


def plain_blocks(vs: list[float], rep: int, seed: int, length: int) -> float:
    blocks = [vs[i : i + length] for i in range(0, len(vs), length)]
    taken: list[float] = []
    step = 0
    while len(taken) < len(vs):
        taken += blocks[plain_place(seed, rep, step, len(blocks))]
        step += 1
    return sum(taken[: len(vs)]) / len(vs)


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_block_means_equal_single_draws(spark, block):
    got = {(r.g, r.rep): r["mean"] for r in draws.block_bootstrap_means(table(spark), ["g"], "v", 5, 20, 3, block=block).collect()}
    assert got == pytest.approx({(g, r): plain_blocks(vs, r, 3, 5) for g, vs in groups().items() if len(vs) > 1 for r in range(20)})


def test_one_short_block_is_drawn_again(spark):
    d = spark.createDataFrame([("x", i, float(i)) for i in range(6)], "g string, rn long, v double")
    got = {r.rep: r["mean"] for r in draws.block_bootstrap_means(d, ["g"], "v", 5, 200, 9).collect()}
    assert got == pytest.approx({r: plain_blocks([float(i) for i in range(6)], r, 9, 5) for r in range(200)})


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_ruin_equals_walking_every_path(spark, block, monkeypatch):
    monkeypatch.setattr(draws, "SEGMENT", 16)  # a long path is folded from many segments
    got = {r.g: r.ruin_probability for r in draws.ruin_probability(table(spark), ["g"], "v", 60.0, 64, 7, 0.5, block=block).collect()}
    for g, vs in groups().items():
        ruined = 0
        for r in range(64):
            capital = low = 60.0
            for s in range(len(vs)):
                capital += vs[plain_place(7, r, s, len(vs))] - 0.5
                low = min(low, capital)
            ruined += low <= 0
        assert got[g] == pytest.approx(ruined / 64)
    assert 0 < got["a"] < 1


def test_shares_of_blocks_add_up_and_are_binomial():
    n, width, reps = 1000, 64, 4000
    shares = [draws._share(11, reps, n, b, width) for b in range(-(-n // width))]
    assert (sum(shares) == n).all()
    for b, share in enumerate(shares):
        size = min(n, (b + 1) * width) - b * width
        sd = math.sqrt(size * (1 - size / n))
        assert abs(share.mean() - size) < 5 * sd / math.sqrt(reps) and 0.93 < share.std() / sd < 1.07
    assert abs(np.corrcoef(shares[0], shares[9])[0, 1] + 64 / (1000 - 64)) < 0.08


def test_split_groups_have_the_same_bounds(spark):
    rng = random.Random(4)
    vs = [rng.gauss(0.5, 2) for _ in range(900)]
    d = spark.createDataFrame([("x", i, v) for i, v in enumerate(vs)], "g string, rn long, v double")
    means = {block: sorted(r["mean"] for r in draws.bootstrap_means(d, ["g"], "v", 2000, 1, block=block).collect()) for block in (1 << 16, 100)}
    se = np.std(vs) / 30
    for place in (49, 500, 1000, 1500, 1950):
        assert abs(means[100][place] - means[1 << 16][place]) < 0.3 * se
    assert 0.94 < np.std(means[100]) / se < 1.06
    # a block far from the others gets its own number of draws, not more
    far = spark.createDataFrame([("x", i, 1000.0 if i < 100 else 0.0) for i in range(900)], "g string, rn long, v double")
    got = [r["mean"] for r in draws.bootstrap_means(far, ["g"], "v", 2000, 2, block=100).collect()]
    assert abs(np.mean(got) - 1000 / 9) < 1 and 0.93 < np.std(got) / (1000 * math.sqrt(8 / 81 / 900)) < 1.07


def test_no_draw_is_shuffled(spark):
    d = table(spark)
    plan = draws.bootstrap_means(d, ["g"], "v", 1000, 1, block=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "step" not in plan and plan.count("Join") == 1  # values and group sizes


def test_empty_rows(spark):
    none = table(spark).filter(F.lit(False))
    assert draws.bootstrap_means(none, ["g"], "v", 5).collect() == []
    assert draws.block_bootstrap_means(none, ["g"], "v", 5, 5).collect() == []
    assert draws.ruin_probability(none, ["g"], "v").collect() == []
