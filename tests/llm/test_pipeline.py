"""Each pipeline stage against what its operator decides, and all of them on a small folder."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import pieces
from barline.llm.catalog import PIECES
from barline.llm.common import tidy
from tests.llm.test_lines import plain
from tests.llm.test_shingles import plain as plain_near
from tests.llm.test_tiling import plain_coverage

FORM = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in "mnrst"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "\n".join(say(12) for _ in range(3))
    rows = [(i, "\n".join(say(rng.randint(3, 20)) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(60 + i, f"{say(30)}\n{shared}\n{say(9)}") for i in range(5)]
    rows += [(70 + i, f"{say(10)} zonkish {say(10)} frobber") for i in range(40)]
    rows += [(120, None), (121, ""), (122, rows[3][1]), (123, rows[4][1].replace(" ", "  "))]
    rows += [(130, f"{say(8)} {BENCHMARK[1]} {say(8)}"), (131, f"{' '.join(BENCHMARK[0].split()[8:])} x {' '.join(BENCHMARK[0].split()[:8])}")]
    base = say(100).split()
    edited = lambda *places: " ".join("edited" if i in places else w for i, w in enumerate(base))
    rows += [(140, " ".join(base)), (141, edited(50)), (142, edited(20, 40)), (143, edited(10, 30, 50, 70))]  # similarities of 0.90, 0.81 and 0.66
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


BENCHMARK = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", "red orange yellow green blue indigo violet black white grey"]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, FORM).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(70 <= r[0] < 110)) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCHMARK)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = {}
    for name in list(stages)[:-1]:
        stages[name](spark, docs, folder).coalesce(1).write.parquet(f"{folder}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '_')}")
        assert docs.schema == spark.read.parquet(f"{folder}/documents.parquet").schema
        step[name] = sorted(tuple(r) for r in docs.collect())
    clean = [r for r in rows if not 70 <= r[0] < 110]
    assert step["toxicity"] == sorted(clean)
    texts = plain([(r[0], r[1]) for r in clean], 5)
    without = [(r[0], None if r[1] is None else t, *r[2:4], len(t)) for r, t in zip(clean, texts, strict=True)]
    assert step["line dedup"] == sorted(without)
    named = plain_near([(r[0], r[1]) for r in without])
    single = [r for r in without if named[r[0]] == r[0]]
    assert {r[0] for r in single} & {140, 141, 142, 143} == {140, 143}
    assert step["near duplicates"] == sorted(single)
    leaked = [r[0] for r in single if any(plain_coverage(r[1] or "", b) * 2 >= len(b.split()) for b in BENCHMARK)]
    assert leaked == [130, 131]
    final = [r for r in single if r[0] not in leaked]
    assert step["decontamination"] == sorted(final)
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in final:
        ids = m.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(m.decode(ids))))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(want)


def test_stages_on_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], FORM + ", row int, rest string, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_send_bounded_batches(spark):
    held = {key: spark.conf.get(key) for key in corpus_pipeline.ARROW}

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    try:
        docs = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("word "), 200).alias("text"))
        got = corpus_pipeline._stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long, size long"))(spark, docs, "").collect()
        assert sum(r.n for r in got) == 9000 and max(r.n for r in got) <= 2000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        corpus_pipeline._stage(lambda spark, docs, sf_dir: docs)(spark, docs, "")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "50"
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def test_workers_forget_what_tasks_of_other_kinds_remember():
    pieces.vocabulary(PIECES)
    assert list(tidy(lambda batches: batches, keep=True)(iter([1]))) == [1] and pieces.vocabulary.cache_info().currsize == 1
    assert list(tidy(lambda batches: batches)(iter([1]))) == [1] and pieces.vocabulary.cache_info().currsize == 0
