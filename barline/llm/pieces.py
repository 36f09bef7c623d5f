"""Encoding and decoding with a merge-type piece vocabulary, by an agenda of symbol pairs.

A text is cut into pre-tokens at the places that no piece of the vocabulary spans: before a run of spaces and before a
newline. Merges never cross such a place, so each distinct pre-token is encoded once and the ids of a text are those of its
pre-tokens in order. Within a pre-token the agenda holds the adjacent symbol pairs whose concatenation is a piece, ordered by
score, then from the left; the best pair is merged and its new neighbours enter, until the agenda is empty. What is then no
piece is spelled in byte pieces. Long pre-tokens keep their agenda in a heap; short ones of one length share an array with a
row of pair scores for each, so that one step takes the best pair of thousands of agendas.

Nulls and empty texts have no ids and decode to the empty text; repeated rows are encoded as often as they occur; an empty
table gives an empty result. A text of any length is taken whole: only its pre-tokens' ids are held beside it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from barline.llm.common import blocks, remembered, texts, tidy

SPACE = "▁"
KEPT = 250_000  # distinct pre-tokens in either generation that a worker remembers
SHORT = 24  # symbols up to which agendas share an array
MARK = "\x01"
CUT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the space that the library puts before a text; a first piece marker counts as a space."""
    if not text:
        return []
    text = f" {text.replace(SPACE, ' ')}"
    if "  " in text or MARK in text:
        return CUT.findall(text)
    return text.replace(" ", MARK + " ").replace("\n", MARK + "\n").split(MARK)[1:]  # the same, faster


class Pieces:
    """A vocabulary of merge type and its encoder."""

    def __init__(self, path: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            self.text.append(piece)
            if m.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif m.is_control(i) or m.is_unknown(i):
                self.silent.add(i)
            else:
                self.id[piece], self.score[piece] = i, m.get_score(i)
        if len(self.byte) < 256 or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id) or m.encode(" a  ") != self._plain(" a  "):
            raise ValueError("not a merge-type vocabulary with byte pieces, leading spaces only and unchanged text")
        self.plain = ["" if i in self.silent else p.replace(SPACE, " ") for i, p in enumerate(self.text)]
        for i, b in self.byte_of.items():
            self.plain[i] = chr(b) if b < 128 else None
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # decoded texts other than the pre-token itself
        self._tables()

    def _tables(self) -> None:
        """Arrays over pieces: the symbol of each code point, and the merged piece of each pair of symbols."""
        size = len(self.text)
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int64)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        symbol = lambda p: self.id.get(p, -1) if len(p) > 1 else int(self.symbol[ord(p)])
        pairs = {}
        for piece, i in self.id.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left >= 0 and right >= 0:
                    pairs[left << 32 | right] = i
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int64)
        self.worth = np.full(size + 1, -np.inf)
        for piece, i in self.id.items():
            self.worth[i] = self.score[piece]

    def _plain(self, text: str) -> list[int]:
        return [i for p in pretokens(text) for i in self.encode(p)]

    def encode(self, pretoken: str) -> list[int]:
        """Ids of one pre-token."""
        part = list(pretoken.replace(" ", SPACE))
        n, score = len(part), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = part[i] + part[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not part[i] or after[i] != j or len(part[i]) + len(part[j]) != len(pair):
                continue  # a symbol of this pair was merged otherwise
            part[i], part[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = pair + part[k]
                if new in score:
                    heapq.heappush(agenda, (-score[new], i, k, new))
            h = before[i]
            if h >= 0:
                new = part[h] + pair
                if new in score:
                    heapq.heappush(agenda, (-score[new], h, i, new))
        out: list[int] = []
        for p in part:
            if p:
                i = self.id.get(p)
                out += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library gives it: the space before a text is dropped, ids without text are left out."""
        return self._spell(ids).removeprefix(" ")

    def _spell(self, ids: list[int]) -> str:
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # bytes of a longer character
            pass
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i >= 0 and i not in self.silent:
                out.append(self.text[i].replace(SPACE, " "))
        return "".join(out)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, or the place behind all pieces."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], len(self.text))

    def encode_all(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of many pre-tokens."""
        out: list[list[int]] = [[]] * len(pretokens)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pretokens):
            if 0 < len(p) <= SHORT:
                by_size.setdefault(len(p), []).append(i)
            else:
                out[i] = self.encode(p)
        for size, members in by_size.items():
            for start in range(0, len(members), 8192):
                self._encode_rows(size, [pretokens[i] for i in members[start : start + 8192]], members[start : start + 8192], out)
        return out

    def _encode_rows(self, size: int, words: list[str], places: list[int], out: list[list[int]]) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), size)
        symbols, place = self.symbol[codes], np.array(places)
        pairs = self._joined(symbols[:, :-1], symbols[:, 1:])
        pieces = len(self.text)
        while True:
            best = np.argmax(self.worth[pairs], axis=1) if pairs.shape[1] else np.zeros(len(pairs), dtype=np.int64)
            rows = np.arange(len(pairs))
            open_ = self.worth[pairs[rows, best]] > -np.inf if pairs.shape[1] else np.zeros(len(pairs), dtype=bool)
            for i, row in zip(place[~open_].tolist(), symbols[~open_].tolist(), strict=True):
                out[i] = row if max(row) < pieces else [y for x in row for y in ([x] if x < pieces else [self.byte[b] for b in chr(x - pieces).encode()])]
            if not open_.any():
                return
            symbols, pairs, best, place = symbols[open_], pairs[open_], best[open_], place[open_]
            rows = np.arange(len(symbols))
            new = pairs[rows, best]
            width = symbols.shape[1] - 1
            at = np.arange(width)
            symbols = np.take_along_axis(symbols, at + (at > best[:, None]), axis=1)
            symbols[rows, best] = new
            at = np.arange(width - 1)
            pairs = np.take_along_axis(pairs, at + (at >= best[:, None]), axis=1)
            for side in (best - 1, best):
                r = np.flatnonzero((side >= 0) & (side < width - 1))
                pairs[r, side[r]] = self._joined(symbols[r, side[r]], symbols[r, side[r] + 1])

    def renewed(self) -> dict[str, str]:
        """Ids by pre-token; what has not been used since the last but one generation is forgotten."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        return self.known

    def learn(self, wanted: set[str]) -> None:
        """Know the ids of the wanted pre-tokens; those met for the first time are held against the library."""
        known, older, new = self.known, self.older, []
        for p in wanted:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        newline, name = self.byte[10], [str(i) for i in range(len(self.text))]
        encoded = self.encode_all(new)
        for start in range(0, len(new), 1000):
            part, ids = new[start : start + 1000], encoded[start : start + 1000]
            ours = list(chain.from_iterable([(newline, *x) for x in ids]))
            joined = "\n" + "\n".join(part)
            if self.library.encode(joined)[1:] != ours:  # the first is the space that the library puts before a text
                wrong = next((a for a, b in zip(part, ids, strict=True) if self.library.encode("\n" + a)[2:] != b), part[0])
                raise ValueError(f"the library encodes {wrong!r} otherwise")
            for p, own in zip(part, ids, strict=True):
                known[p] = ",".join([name[i] for i in own])
            if self._spell(ours) != joined:
                self.odd |= {p: text for p, own in zip(part, ids, strict=True) if (text := self._spell(own)) != p}


@remembered
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: the ids of each whole text (decimal, comma-joined) and the text they decode to.

    Narrow: every Arrow batch is encoded where it is read; a worker keeps a bounded number of pre-tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, ids, decoded in _encoded(batches, path):
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    source = texts(df, id_col, text_col)
    return source.mapInArrow(tidy(run, keep=True), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encoded``, without sending the ids out of the worker."""
    sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, ids, decoded in _encoded(batches, path):
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), sha(ids), sha(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = texts(df, id_col, text_col)
    return source.mapInArrow(tidy(run, keep=True), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[str], list[str]]]:
    """Of each block of texts the numbers of tokens, the ids and the decoded texts."""
    pieces = vocabulary(path)
    for batch in blocks(batches, limit=4 << 20):
        cut = [pretokens(t) for t in batch.column("text").to_pylist()]
        of = pieces.renewed().get
        ids = [list(map(of, c)) for c in cut]
        open_ = [i for i, known in enumerate(ids) if None in known]
        pieces.learn({p for i in open_ for p, known in zip(cut[i], ids[i], strict=True) if known is None})
        for i in open_:
            ids[i] = list(map(of, cut[i]))
        ids = [",".join(x) for x in ids]
        odd = pieces.odd
        decoded = ["".join([odd.get(p, p) for p in c] if odd else c).removeprefix(" ") for c in cut]
        yield batch, [i.count(",") + 1 if i else 0 for i in ids], ids, decoded
