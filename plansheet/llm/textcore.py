"""Vectorised byte-level text kernels shared by the training-data operators.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  All hashes are
64-bit polynomial hashes modulo 2**64 over randomised byte codes, finished with
a bit mixer; multipliers are odd and hence invertible, so the hash of any
slice comes from two prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BYTE_STEP = _U(0x9E3779B97F4A7C15)
_WORD_STEPS = (_U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F))
#: Bytes (or words) hashed at a time; a longer document is hashed alone.
BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def powers(step: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i for i < n, modulo 2**64."""
    have = _powers.get(int(step))
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK + 1024)
        inv = _U(pow(int(step), -1, 1 << 64))
        up, down = np.full(n, step), np.full(n, inv)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= BLOCK + 1024:  # some 4 MB a step; longer tables aren't kept
            _powers[int(step)] = have
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Words of a batch of texts: word w is data[start[w]:end[w]], document d has words off[d]:off[d+1]."""

    data: np.ndarray
    doc_off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    hash: np.ndarray | None = None

    @property
    def lens(self) -> np.ndarray:
        return np.diff(self.off)

    def left(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return np.repeat(self.off[1:], self.lens) - np.arange(len(self.start))


def raw(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and n+1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8, int(off[-1] - off[0]), int(off[0])) if off[-1] > off[0] else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK):
    """Runs (first, last) of documents of about size bytes."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


#: Bytes of letters: A-Z, a-z, and all of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def words(texts, lower: bool = False, hashed: bool = True, kind: np.ndarray | None = None, prefixes: tuple[int, ...] = ()) -> Words:
    """Split all texts into words, and hash each word.

    kind: the bytes that words consist of (else all but white space).  prefixes:
    hash the first so many bytes of each word too (column 1 on of a matrix).
    """
    member = ~_SPACE if kind is None else kind
    data, off = raw(texts, lower)
    starts, ends, hashes, counts = [], [], [], [np.zeros(1, np.int64)]
    for a, b in blocks(off):
        lo, hi = int(off[a]), int(off[b])
        part, cuts = data[lo:hi], off[a : b + 1] - lo
        inside = member[part]
        edge = np.empty(len(part) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[cuts] = True
        at = np.flatnonzero(edge)
        if len(part):
            keep = inside[at[:-1]]
            s, e = at[:-1][keep], at[1:][keep]
        else:
            s = e = np.zeros(0, np.int64)
        if hashed and len(part):
            up, down = powers(_BYTE_STEP, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_CODES[part] * up[: len(part)], out=sums[1:])
            cut = [mix((sums[z] - sums[s]) * down[s] + (z - s + salt).astype(np.uint64)) for z, salt in [(e, 0), *((np.minimum(s + k, e), 1000 + k) for k in prefixes)]]
            hashes.append(np.stack(cut, 1) if prefixes else cut[0])
        starts.append(s + lo)
        ends.append(e + lo)
        counts.append(np.diff(np.searchsorted(s, cuts)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros((0, 1 + len(prefixes)) if t is np.uint64 and prefixes else 0, t)
    return Words(data, off, cat(starts, np.int64), cat(ends, np.int64), np.cumsum(np.concatenate(counts)), cat(hashes, np.uint64) if hashed else None)


def window_hashes(h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of `length` consecutive values (runs that cross documents included)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step, out = _WORD_STEPS[which], np.empty(n, np.uint64)
    up, down = powers(step, min(len(h), BLOCK + length))
    sums = np.zeros(len(up) + 1, np.uint64)
    for lo in range(0, n, BLOCK):
        part = h[lo : lo + BLOCK + length - 1]
        k = len(part) - length + 1
        np.cumsum((part if not which else mix(part + step)) * up[: len(part)], out=sums[1 : len(part) + 1])
        out[lo : lo + k] = mix((sums[length : len(part) + 1] - sums[:k]) * down[:k] + _U(length))
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def joined(w: Words, keep: np.ndarray) -> list[bytes]:
    """Per document, its kept words joined by one space."""
    s, size = w.start[keep], (w.end - w.start)[keep]
    kept_off = np.concatenate([[0], np.cumsum(keep)])[w.off]
    out_at = np.concatenate([[0], np.cumsum(size + 1)])
    docs = []
    for a in range(0, len(w.off) - 1, 256):
        b = min(a + 256, len(w.off) - 1)
        lo, hi = kept_off[a], kept_off[b]
        take = np.arange(out_at[lo], out_at[hi]) + np.repeat(s[lo:hi] - out_at[lo:hi], size[lo:hi] + 1)
        buf = w.data[np.minimum(take, len(w.data) - 1)] if len(w.data) else np.zeros(0, np.uint8)
        base = out_at[lo]
        buf[out_at[lo + 1 : hi + 1] - 1 - base] = 32
        buf = buf.tobytes()
        at = out_at[kept_off[a : b + 1]] - base
        docs += [buf[x : max(x, y - 1)] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return docs
