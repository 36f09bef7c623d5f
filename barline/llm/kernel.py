"""The gap-weighted subsequence kernel of three characters on short strings, in numpy.

Two strings are compared by all their subsequences of three characters, each weighed by ``DECAY`` to the power of the length it
spans, so that gaps and inserted characters weaken a match and don't undo it. Strings of one length are rows of an array; a
subsequence is a number, and its weight in any fixed combination of strings a table entry. Strings are compared between two
boundary marks, so that one of a single character has a subsequence too. The kernel is normalised to 1 for equal strings; an
empty string is 0.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

DECAY = 0.6
BEGIN, END = "\x02", "\x03"


class Kernel:
    """Kernel against fixed strings. Their characters are numbered from 1, whatever their script; all others share 0 and match nothing."""

    def __init__(self, fixed: list[str]):
        letters = sorted(set("".join(fixed)) | {BEGIN, END})
        self.base = len(letters) + 1
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.base)
        self.size = len(fixed)
        # the first two characters of a subsequence lead to a row of places for the third; place 0 is no weight
        self.pair = np.zeros(self.base * self.base, dtype=np.int32)
        third = [np.zeros(self.base, dtype=np.int32)]
        weights = [np.zeros(len(fixed))]
        for i, s in enumerate(fixed):
            own = self._subsequences([s])
            if own is None:
                continue
            first, last, w = own
            norm = self.norms([s])[0]
            for p, k, x in zip(first[0].tolist(), last[0].tolist(), w.tolist(), strict=True):
                if not self.pair[p]:
                    self.pair[p] = len(third)
                    third.append(np.zeros(self.base, dtype=np.int32))
                row = third[self.pair[p]]
                if not row[k]:
                    row[k] = len(weights)
                    weights.append(np.zeros(len(fixed)))
                weights[row[k]][i] += x / norm
        self.third, self.weights = np.concatenate(third), np.array(weights)

    def _codes(self, strings: list[str]) -> np.ndarray:
        text = "".join(f"{BEGIN}{s}{END}" for s in strings)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(strings), -1)

    def _subsequences(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """First two and third characters of the subsequences of strings of one length, and the weights of their places."""
        n = len(strings[0]) + 2
        if n < 3:
            return None
        code = self.code[self._codes(strings)]
        i, j, k = np.array(list(combinations(range(n), 3))).T
        return code[:, i] * self.base + code[:, j], code[:, k], DECAY ** (k - i + 1.0)

    def _places(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.third[self.pair[first] * self.base + last]

    def norms(self, strings: list[str]) -> np.ndarray:
        """Square root of the kernel of each string of one length with itself, by dynamic programming over all characters."""
        raw = self._codes(strings)
        rows, n = raw.shape
        letter = np.ascontiguousarray(raw.T)
        weight = DECAY * DECAY
        before = np.ones((n + 1, n + 1, rows))  # kernel of length 0, then 1, then 2, of the first a and b characters
        for _ in range(2):
            after = np.zeros((n + 1, n + 1, rows))
            for a in range(1, n + 1):
                run = np.zeros(rows)
                for b in range(1, n + 1):
                    run *= DECAY
                    run += weight * (letter[a - 1] == letter[b - 1]) * before[a - 1, b - 1]
                    np.multiply(after[a - 1, b], DECAY, out=after[a, b])
                    after[a, b] += run
            before = after
        total = np.zeros(rows)
        for a in range(n):
            for b in range(n):
                total += weight * (letter[a] == letter[b]) * before[a, b]
        return np.sqrt(np.maximum(total, 1e-300))

    def features(self, strings: list[str]) -> np.ndarray:
        """The normalised kernel of each string with each fixed one."""
        return self._summed(strings, self.weights, self.size)

    def combined(self, strings: list[str], coefficients: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """The same, multiplied with one coefficient for each fixed string; ``norms`` of the strings, where they are known."""
        return self._summed(strings, (self.weights @ coefficients)[:, None], 1, norms)[:, 0]

    def all_norms(self, strings: list[str]) -> np.ndarray:
        """``norms`` of strings of any length, 1 for an empty one."""
        out = np.ones(len(strings))
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_size.setdefault(len(s), []).append(i)
        for size, members in by_size.items():
            for start in range(0, len(members) if size else 0, 1024):
                at = members[start : start + 1024]
                out[at] = self.norms([strings[i] for i in at])
        return out

    def _summed(self, strings: list[str], weights: np.ndarray, width: int, known: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(strings), width))
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            if s:
                by_size.setdefault(len(s), []).append(i)
        for members in by_size.values():
            rows = 1024 if width == 1 else 64  # a row of features for each subsequence is held
            for start in range(0, len(members), rows):
                at = members[start : start + rows]
                part = [strings[i] for i in at]
                first, last, w = self._subsequences(part)
                found = self._places(first, last)
                norms = self.norms(part) if known is None else known[at]
                if width == 1:
                    out[at, 0] = (weights[found, 0] @ w) / norms
                else:
                    row, column = np.nonzero(found)
                    hit = weights[found[row, column]] * w[column, None]
                    edges = np.searchsorted(row, np.arange(len(part) + 1))
                    sums = np.concatenate([np.zeros((1, width)), np.cumsum(hit, axis=0)])
                    out[at] = (sums[edges[1:]] - sums[edges[:-1]]) / norms[:, None]
        return out
