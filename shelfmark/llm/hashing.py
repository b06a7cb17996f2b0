"""Words of many texts at once and 64-bit hashes of words and shingles, in numpy.

A word's hash is a polynomial in its bytes modulo 2**64, from differences of running sums; a shingle's is a sum of its
words' hashes times odd constants. Both are then mixed, so they serve as uniform hashes, the same in every process.
Bytes are taken in pieces of bounded size, so a text of any length needs little more than its words' places and hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 16  # of texts that are hashed at once: the running sums stay near the processor
BLOCK_WORDS = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_SEP = 32

#: Byte tables: what separates words becomes a blank, which no word has.
ALNUM_LOWER = bytes(_SEP if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c + 32 if 65 <= c <= 90 else c for c in range(256))
NOT_SPACE = bytes(_SEP if c == 32 or 9 <= c <= 13 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse's, for i up to n; n is of a piece of bytes, so the tables are bounded."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0], done, step = 1, 1, base
            while done < size:  # doubles what is there
                more = min(done, size - done)
                out[done : done + more] = out[:more] * np.uint64(step)
                done, step = done + more, step * step % (1 << 64)
            _POWERS[key] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def spans_hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the spans of a piece of bytes, with the running sums and inverse powers that they are from."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(up[:-1] * raw, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), sums, down


def _long_word(word: np.ndarray) -> int:
    """The polynomial of one word of any length, piece by piece."""
    total, up = 0, _powers(CHUNK_BYTES)[0]
    for a in range(0, len(word), CHUNK_BYTES):
        part = word[a : a + CHUNK_BYTES]
        total += int((up[: len(part)] * part).sum()) * pow(BASE, a, 1 << 64)
    return total % (1 << 64)


def runs_by_bytes(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of texts: hash, and of each text the range of its words; starts and ends are bytes in `joined`.

    beginnings: lengths; `heads` has for each of them the numbers of longer words, and hashes of their so many first bytes.
    """

    def __init__(self, texts: list[bytes], table: bytes, beginnings: tuple[int, ...] = ()) -> None:
        self.joined = b" ".join(texts) + b" "
        blank = self.joined.translate(table)
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        heads: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in beginnings}
        at, before = 0, 0
        while at < len(blank):
            until = min(at + PIECE_BYTES, len(blank))
            cut = blank.rfind(b" ", at, until)
            if cut < 0:  # a word longer than a piece; a blank ends the texts
                cut = blank.index(b" ", until)
                raw = np.frombuffer(blank, np.uint8, cut - at, at)
                found.append((np.array([at]), np.array([cut]), mix(np.array([(_long_word(raw) + len(raw)) % (1 << 64)], np.uint64))))
                raw, starts = raw[: max(beginnings, default=0) + 1], np.zeros(1, np.int64)
                ends = starts + len(raw)
                _, sums, down = spans_hashed(raw, starts, ends)
            else:
                raw = np.frombuffer(blank, np.uint8, cut + 1 - at, at)
                step = np.diff((raw != _SEP).view(np.int8), prepend=np.int8(0))
                starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                hashes, sums, down = spans_hashed(raw, starts, ends)
                found.append((starts + at, ends + at, hashes))
            for n in beginnings:
                far = np.flatnonzero(ends - starts > n)
                s = starts[far]
                heads[n].append((far + before, mix((sums[s + n] - sums[s]) * down[s] + np.uint64(1 << 40) + np.uint64(n))))
            before += len(starts)
            at = cut + 1
        self.starts, self.ends, self.hashes = (np.concatenate(c) for c in zip(*found))
        self.heads = {n: tuple(np.concatenate(c) for c in zip(*h)) if h else (np.empty(0, np.int64), np.empty(0, np.uint64)) for n, h in heads.items()}
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.bytes_from = np.cumsum(lengths) - lengths
        self.first = np.searchsorted(self.starts, self.bytes_from)
        self.last = np.r_[self.first[1:], len(self.starts)]

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are all of one text."""
        n, constants = len(self.hashes), odd_constants(k, seed)
        out = np.zeros(n, np.uint64)
        for a in range(0, n - k + 1, BLOCK_WORDS):
            b = min(a + BLOCK_WORDS, n - k + 1)
            total = np.zeros(b - a, np.uint64)
            for j, c in enumerate(constants):
                total += self.hashes[a + j : b + j] * c
            out[a:b] = mix(total)
        whole = np.ones(n, bool)
        for j in range(1, k):  # from the last k - 1 words of a text none goes on so far
            near = self.last - j
            whole[near[near >= self.first]] = False
        return out, whole

    def shingles(self, k: int) -> list[np.ndarray]:
        """Of each text the sorted distinct hashes of its k-word shingles; all words make one if they are fewer, none make none."""
        hashes, _ = self.windows(k)
        out = []
        for a, b in zip(self.first.tolist(), self.last.tolist()):
            if b - a >= k:
                out.append(np.unique(hashes[a : b - k + 1]))
            elif b > a:
                out.append(mix((self.hashes[a:b] * odd_constants(b - a, b - a)).sum(keepdims=True)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def shingle_sets(texts: list[bytes], k: int, table: bytes = ALNUM_LOWER) -> Iterator[np.ndarray]:
    for a, b in runs_by_bytes(texts):
        yield from Words(texts[a:b], table).shingles(k)
