"""Best-fit decreasing packing of tokenized documents into fixed windows.

Each task packs the documents it reads, a pool of some million tokens at a time, so nothing is shuffled and no key can be hot.
A document is first cut into full windows. What remains of it goes, longest first, into the open window of the least sufficient
room, which a segment tree over remaining capacities finds; without one a window is opened. The windows that stay open at
the end of a pool are filled up: the fullest keep their place and take the contents of the emptiest, cut at the room they
have. One window at most is left, whose pieces open the next pool; the last one of a task is cut into sequences of powers of
two, which need no padding.

A sequence never leaves its task: a task that runs again after a lost executor gives the same documents whole sequences
again. Their ids hold the number of the partition above bit 33.

Ids are the library's: a text is cut at spaces, tabs and line ends, which no pre-token and no special string crosses, plain text
also around full stops and commas that stand by themselves, and each distinct word is remembered by the task. A null or empty text is the end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty result; a text of any length is taken whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barline.llm.common import blocks, texts

WINDOW = 4096
END = 2
POOL = 1 << 22  # tokens packed at a time: 16 MB of ids
KEPT = 96 << 20  # bytes of words and ids that either generation of remembered words may take
# How the vocabulary's pre-tokenizer cuts lower-case text, for printable ASCII and the letters of Latin-1; how the last id
# of a pre-token ends, and no other; the longest special string's beginning.
PLAIN = re.compile("[ -~\n\t\rÀ-ÖØ-öø-ÿ]*")
CUT = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \n\t\ra-zß-öø-ÿ0-9]+")
JOINED = re.compile(r"[^ \n\t\ra-zß-öø-ÿ0-9][.,]|[.,][^ \n\t\ra-zß-öø-ÿ0-9]")  # a mark that is not a pre-token by itself
LETTERS = re.compile("[a-zß-öø-ÿ]+")
SUFFIX = "</w>"
SPECIAL = "<|"
APART = "<|startoftext|>"


class Words:
    """Ids of texts as little-endian unsigned 32-bit integers, by their distinct words.

    Texts of printable ASCII and letters of Latin-1 are taken in lower case, with full stops and commas as words of their own, or
    else by pre-tokens where such a mark touches another. Words of these characters are made of pre-tokens, which are
    remembered in turn; other words go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.apart = self.library.token_to_id(APART)
        entries = self.library.get_vocab()
        self.last = np.zeros(max(entries.values()) + 1, dtype=bool)
        self.last[[i for entry, i in entries.items() if entry.endswith(SUFFIX)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Encode words not met yet; what has not been used since the last but one generation is forgotten."""
        known, older = self.known, self.older
        plain, other, parts = {}, [], set()
        for w in words:
            ids = older.get(w)
            if ids is not None:
                self._hold([w], [ids])
            elif LETTERS.fullmatch(w):
                parts.add(w)
            elif SPECIAL not in w and PLAIN.fullmatch(w):
                plain[w] = CUT.findall(w.lower())
            else:
                other.append(w)
        parts.update(p for cut in plain.values() for p in cut if p not in known)
        met = list(parts & older.keys())
        self._hold(met, [older[p] for p in met])
        self._encode_parts([p for p in parts if p not in known])
        self._encode(other)
        made = [w for w in plain if w not in known]
        self._hold(made, [b"".join([known[p] for p in plain[w]]) for w in made])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # without offsets

    def _encode_parts(self, parts: list[str]) -> None:
        """Pre-tokens by the library: many at once, kept apart by spaces; each ends with its one id that may be a pre-token's last."""
        for start in range(0, len(parts), 500):
            part = parts[start : start + 500]
            ids = self._ids(" ".join(part))
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                raise ValueError(f"the vocabulary does not end pre-tokens by {SUFFIX}")
            raw = ids.tobytes()
            self._hold(part, [raw[4 * begin : 4 * end] for begin, end in zip([0, *ends], ends, strict=False)])

    def _encode(self, words: list[str]) -> None:
        """By the library: many at once, kept apart by a special string, which no word holds; the others one by one."""
        whole = [w for w in words if SPECIAL not in w]
        for start in range(0, len(whole), 500):
            part = whole[start : start + 500]
            ids = self._ids(APART.join(part))
            ends = [*np.flatnonzero(ids == self.apart).tolist(), len(ids)] if self.apart is not None else []
            if len(ends) != len(part):
                raise ValueError(f"the vocabulary does not keep words apart by {APART}")
            raw = ids.tobytes()
            self._hold(part, [raw[4 * begin : 4 * end] for begin, end in zip([0, *(e + 1 for e in ends)], ends, strict=False)])
        alone = [w for w in words if SPECIAL in w]
        self._hold(alone, [self._ids(w).tobytes() for w in alone])

    def _hold(self, words: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.held += 2 * sum(map(len, words)) + sum(map(len, ids)) + 150 * len(words)

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Words of a text whose ids in a row are those of the text."""
        if SPECIAL not in text and PLAIN.fullmatch(text):
            text = text.lower()
            if JOINED.search(text):
                return CUT.findall(text)
            text = text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > KEPT:
            self.older, self.known, self.held = self.known, {}, 0
        get = self.known.get
        cut = [self._cut(t) for t in texts]
        found = [list(map(get, words)) for words in cut]
        new = [list(compress(count(), map(is_, ids, repeat(None)))) for ids in found]
        self.learn({words[i] for words, places in zip(cut, new, strict=True) for i in places})
        known = self.known
        for words, ids, places in zip(cut, found, new, strict=True):
            for i in places:
                ids[i] = known[words[i]]
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Words:
    return Words(path)


class Room:
    """Open windows by remaining capacity: a segment tree of how many windows each range of capacities holds."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, at: int, capacity: int) -> None:
        self.open[capacity].append(at)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        node, tree = capacity + self.size, self.tree
        while node:
            tree[node] += n
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes the window with the least capacity that suffices: its number and capacity."""
        node, tree = need + self.size, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


# A piece: the row of its document, the first id it takes, its ids.
Piece = tuple[int, int, int]  # document, start, length


def best_fit(pieces: list[Piece], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of the pieces, each no longer than a window, longest first."""
    windows: list[list[Piece]] = []
    room = Room(window)
    for piece in sorted(pieces, key=lambda p: -p[2]):
        found = room.tightest(piece[2])
        if found is None:
            at, capacity = len(windows), window
            windows.append([])
        else:
            at, capacity = found
        windows[at].append(piece)
        if capacity > piece[2]:
            room.put(at, capacity - piece[2])
    return windows


def filled(windows: list[list[Piece]], window: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows only, and the pieces of the one that is left: open windows take the contents of the emptiest."""
    full, open_ = [], []
    for w in windows:
        n = sum(p[2] for p in w)
        (full if n == window else open_).append(w if n == window else (n, w))
    open_.sort(key=lambda x: -x[0])
    total = sum(n for n, _ in open_)
    takers = total // window
    poured = [p for _, w in open_[takers:] for p in sorted(w, key=lambda p: p[2])]
    for n, w in open_[:takers]:
        while n < window:
            doc, start, length = poured.pop()
            taken = min(length, window - n)
            w.append((doc, start, taken))
            n += taken
            if taken < length:
                poured.append((doc, start + taken, length - taken))
        full.append(w)
    return full, poured[::-1]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences whose lengths are the powers of two of their total."""
    left = sum(p[2] for p in pieces)
    pieces, out = pieces[::-1], []
    while left:
        size = 1 << left.bit_length() - 1
        left -= size
        sequence = []
        while size:
            doc, start, length = pieces.pop()
            taken = min(length, size)
            sequence.append((doc, start, taken))
            size -= taken
            if taken < length:
                pieces.append((doc, start + taken, length - taken))
        out.append(sequence)
    return out


def packed(df: DataFrame, path: str, window: int = WINDOW, end: int = END, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row for each piece of each document."""
    if window & window - 1:
        raise ValueError("a window is a power of two")
    source = texts(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, sequence = vocabulary(path), TaskContext.get().partitionId() << 33
        docs: list[tuple[object, bytes]] = []  # of the pool: doc_id, ids
        rest: list[Piece] = []  # not packed yet
        size, id_type = 0, None

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in names]
            for pieces in sequences:
                offset = 0
                for doc, start, length in pieces:
                    name, ids = docs[doc]
                    for column, value in zip(columns, (name, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset), strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            return pa.record_batch([pa.array(c, id_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

        def flush() -> pa.RecordBatch:
            """Packs the pool; only documents of the window that is left stay."""
            nonlocal docs, rest, size
            full, rest = filled(best_fit(rest, window), window)
            out = rows(full)
            stay = sorted({p[0] for p in rest})
            place = {doc: i for i, doc in enumerate(stay)}
            docs, rest = [docs[d] for d in stay], [(place[d], start, length) for d, start, length in rest]
            size = sum(p[2] for p in rest)
            return out

        for batch in blocks(batches, limit=4 << 20):
            id_type = batch.schema.field("doc_id").type
            whole: list[list[Piece]] = []
            for name, ids in zip(batch.column("doc_id").to_pylist(), library.encode(batch.column("text").to_pylist()), strict=True):
                n, doc = len(ids) // 4 + 1, len(docs)
                docs.append((name, ids + last))
                whole += [[(doc, start, window)] for start in range(0, n - n % window, window)]
                if n % window:
                    rest.append((doc, n - n % window, n % window))
                size += n
            if whole:
                yield rows(whole)
            if size >= pool:
                yield flush()
        if docs:
            yield flush()
            if rest:
                yield rows(powers(rest))

    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
