"""Encoding and counting against the library."""

from __future__ import annotations

import hashlib
import random

import sentencepiece

from barline.llm import counts, pieces
from barline.llm.catalog import PIECES

ROWS = ["", " ", "   a", "a  b\nc \n d", "▁x ▁", "<s>hi</s> <0x0A>", "é\x00z", "日本😀 ﬁ Å", "\t\ta\r\n", "\n", "\n\n \n", "a\n ", " \na", "x" * 3000, "aaa" * 50 + "     " * 9, "a\x01b \x01", "word " * 3000, None]


def corpus() -> list[str | None]:
    rng = random.Random(2)
    letters = "abcdefghij  \n\té▁日"
    return ROWS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_encoder_equals_library():
    vocabulary = pieces.vocabulary(PIECES)
    for text in corpus():
        ids = [i for p in pieces.pretokens(text or "") for i in vocabulary.encode(p)]
        assert ids == vocabulary.library.encode(text or "")
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)
    cut = list({p for t in corpus() for p in pieces.pretokens(t or "")})
    assert vocabulary.encode_all(cut) == [vocabulary.encode(p) for p in cut]


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i % 300, t, 7, "x") for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, row string")
    ids = {t: library.encode(t or "") for _, t, *_ in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(library.decode(ids[t]))) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in pieces.digests(df, PIECES).collect()) == want
    whole = sorted((r.doc_id, r.n_tokens, sha(r.ids), sha(r.decoded)) for r in pieces.encoded(df, PIECES).collect())
    assert whole == want
    want = sorted((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 100) for i, t, *_ in rows)
    for head in (0, 20, 300_000):
        assert sorted(tuple(r) for r in counts.token_counts(df, PIECES, limit=100, head=head).collect()) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digests(none, PIECES).collect() == [] and counts.token_counts(none, PIECES).collect() == []
