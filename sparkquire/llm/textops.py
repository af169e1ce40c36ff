"""Vectorised byte-level text work in numpy: batches, words, hashes, shingles.

Texts arrive as Arrow columns. A batch becomes one byte array with document
offsets, cut so that working memory stays at a few times ``CHUNK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if len(_powers.get("up", ())) < n + 1:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n + 1, CHUNK + 1), base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def chunks(batch: pa.RecordBatch | pa.Table, column: str = "text", size: int = CHUNK, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of whole rows of about ``size`` bytes each."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not len(col):
        return
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if lower:
        col = pc.utf8_lower(col)
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``kind`` bytes that stay in one document, and each document's first run (n + 1 of them)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    turn = inside[1:] != inside[:-1]
    first, last = turn[:n] & inside[1:-1], turn[1:] & inside[1:-1]
    edges = offs[(offs > 0) & (offs < n)]
    first[edges] |= inside[1:-1][edges]
    last[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hasher(data: np.ndarray):
    """A function of (starts, ends) that gives a 64-bit hash of each span's bytes, by prefix sums of a polynomial."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.multiply(data, up[: len(data)], out=total[1:])
    total[1:] += up[: len(data)]
    np.cumsum(total[1:], out=total[1:])

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = total[ends]
        h -= total[starts]
        h *= down[starts]
        return mix(h)

    return of


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hasher(data)(starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of consecutive words, over document borders too."""
    if len(words) < n:
        return np.zeros(0, U)
    m, h = len(words) - n + 1, words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h *= U(BASE)
        h += words[k : k + m]
    return mix(h)


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word n-grams, and where each document's begin; 1 to n - 1 words give one shingle of them all."""
    counts = np.diff(first)
    grams = gram_hashes(words, n)
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(have)))
    out = np.zeros(begin[-1], U)
    full = np.repeat(counts >= n, have)
    doc = np.repeat(np.arange(len(counts)), have)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    out[full] = grams[at[full]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        h = U(0)
        with np.errstate(over="ignore"):
            for w in words[first[d] : first[d + 1]]:
                h = h * U(BASE) + w
        out[begin[d]] = mix(np.array([h ^ U(counts[d])]))[0]
    return out, begin


def unique_in(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and where each document's begin."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(len(begin)))
