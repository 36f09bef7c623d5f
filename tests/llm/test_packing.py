"""Packing against the library's ids and a plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text: str | None) -> list[int]:
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def held(rows: list, docs: list[tuple], window: int) -> int:
    """Checks pieces against the documents; returns the padding."""
    ids = {d[0]: ids_of(d[1]) for d in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found = ids[r.doc_id]
        assert r.doc_tokens == len(found) and 0 < r.length <= window
        assert r.ids_crc32 == zlib.crc32(np.array(found[r.start : r.start + r.length], dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    times = Counter(d[0] for d in docs)
    assert set(pieces) == set(times)
    for doc, found in pieces.items():
        taken = Counter(i for start, length in found for i in range(start, start + length))
        assert set(taken) == set(range(len(ids[doc]))) and set(taken.values()) == {times[doc]}
    padding = 0
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & end - 1 == 0 else window - end
    return padding


def corpus() -> list[tuple]:
    rng = random.Random(6)
    words = [f"Word{i}" for i in range(50)] + ["it's", "É", "é", "ΑΣ", "İ", "<|endoftext|>", "a<|startoftext|>b", "日本語", "x y", "\x1cz", "123", "#!?", "́"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n", " ", "\x0b", ", "]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 30, 100, 300, 900, 3000]))) for i in range(150)]
    return [*docs, (200, None), (201, ""), (202, " \n"), (5, docs[5][1]), (5, docs[5][1]), (203, "word " * 4095), (204, "word " * 8191), (205, "a" * 50_000)]


def test_ids_and_sequences(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, start long, offset string").repartition(3)  # clashing names
    got = packing.packed(df, PATH)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert held(got.collect(), docs, 4096) == 0
    assert held(packing.packed(df, PATH, window=256, pool=3000).collect(), docs, 256) == 0


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a b c")], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.length) for r in packing.packed(df, PATH).collect()] in ([(None, 4), (None, 2)], [(None, 4), (None, 1), (None, 1)])
    assert packing.packed(df.limit(0), PATH).collect() == []


def plain_best_fit(lengths: list[int], window: int) -> list[int]:
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        able = [r for r in room if r >= n]
        if able:
            room[room.index(min(able))] -= n
        else:
            room.append(window - n)
    return sorted(room)


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        window = rng.choice([8, 64, 4096])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
        windows = packing.best_fit([(i, 0, n) for i, n in enumerate(lengths)], window)
        assert sorted(window - sum(p[2] for p in w) for w in windows) == plain_best_fit(lengths, window)
        full, left = packing.filled(windows, window)
        assert all(sum(p[2] for p in w) == window for w in full) and sum(p[2] for p in left) == sum(lengths) % window
        cut = packing.powers(left)
        assert [sum(p[2] for p in w) for w in cut] == [1 << b for b in range(15, -1, -1) if sum(left_[2] for left_ in left) >> b & 1]
        got = Counter(x for w in [*full, *cut] for i, start, n in w for x in ((i, k) for k in range(start, start + n)))
        assert got == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))


def test_words_equal_the_library_in_any_mixture():
    rng = random.Random(12)
    letters = ["a", "B", "s", "'", "'s", "'ll", "'RE", "1", "23", "!", "#", "_", "<|", "<|endoftext|>", "<|startoftext|>", "|>", "é", "e\u0301", "\u0301", "İ", "Σ", "ς", "ﬁ", "½", "²", "٣", "日本", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", "\x00", "\x7f", " ", "\n", "\t", "\r", "😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    words = packing.Words(PATH)
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        assert words.encode(part) == [np.array(ids_of(t)[:-1], dtype="<u4").tobytes() for t in part]


def test_words_are_forgotten_and_learnt_again():
    words = packing.Words(PATH)
    first = words.encode(["one two", "three"])
    words.held = packing.KEPT + 1
    assert words.encode(["one two", "three"]) == first
    words.held = packing.KEPT + 1
    assert words.encode(["four"]) == [np.array(ids_of("four")[:-1], dtype="<u4").tobytes()]
    assert words.encode(["one two"]) == first[:1]


def test_variants_of_a_word_are_learnt_once():
    words, text = packing.Words(PATH), "Word word, WORD. wÖrd\nwörd,\tWÖRD. "
    assert words.encode([text]) == [np.array(ids_of(text)[:-1], dtype="<u4").tobytes()]
    assert set(words.known) == {"word", "wörd", ",", ".", ""}


def test_marks_beside_others_equal_the_library():
    rng = random.Random(13)
    letters = ["a", "B", "é", "ß", "Ÿ", "ÿ", "×", "µ", "s", "ll", "'", "'s", "1", ".", ",", "!", "***", " ", " ", "\n", "\r\n", "<", "|", "</w>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    assert packing.Words(PATH).encode(texts) == [np.array(ids_of(t)[:-1], dtype="<u4").tobytes() for t in texts]
