"""Word and n-gram hashes of Arrow text columns, with numpy over the raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time, and that go into one slice of a batch.
PIECE, SLICE = 1 << 19, 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _separators(codes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


#: The separators of ``[^\x20\x09-\x0D]+``, and those of words of letters and digits (bytes above 127 count as letters).
WHITE = _separators([0x20, *range(0x09, 0x0E)])
SYMBOLS = _separators([c for c in range(128) if not chr(c).isalnum()])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
with np.errstate(over="ignore"):
    _VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most about ``size`` bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + n > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, separators: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> tuple:
    """``(hashes, bounds, starts, prefix hashes)`` of the words of all rows, A-Z folded.

    Words of row i are ``hashes[bounds[i]:bounds[i + 1]]``; ``starts`` are
    their byte places within the whole column.  For each number in
    ``prefixes`` there is an array with the hash of that many leading bytes (0
    for shorter words).  Any byte string has the same hash wherever it is.
    """
    data, offsets = raw(column)
    total = len(data)
    opens = np.zeros(total + 1, dtype=bool)
    opens[offsets] = True
    hashes, places, heads = [], [], [[] for _ in prefixes]
    at = 0
    while at < total:
        end = min(total, at + PIECE)
        if end < total:
            known = offsets[np.searchsorted(offsets, end, "right") - 1]
            if known > at:
                end = int(known)
            else:
                gaps = np.flatnonzero(separators[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # one word over a whole piece
                    while end < total and not separators[data[end]] and not opens[end]:
                        end += 1
        _piece(data[at:end], opens[at:end + 1], separators, at, hashes, places, prefixes, heads)
        at = end
    empty = np.zeros(0, dtype=np.uint64)
    starts = np.concatenate(places) if places else np.zeros(0, np.int64)
    bounds = np.searchsorted(starts, offsets)
    return (np.concatenate(hashes) if hashes else empty, bounds, starts, [np.concatenate(h) if h else empty for h in heads])


def _piece(data, opens, separators, base, hashes, places, prefixes, heads) -> None:
    gap = separators[data]
    new = np.empty(len(data), dtype=bool)
    new[0] = True
    new[1:] = gap[:-1] | opens[1:-1]
    starts = np.flatnonzero(new & ~gap)
    if not len(starts):
        return
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = new[1:] | gap[1:]
    ends = np.flatnonzero(last & ~gap) + 1
    power, inverse = (_POW, _INV) if len(data) <= PIECE else (_powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[_FOLD[data]] * power[: len(data)], out=sums[1:])
        low, back = sums[starts], inverse[starts]
        sizes = (ends - starts).astype(np.uint64)
        hashes.append(mix((sums[ends] - low) * back + sizes))
        for k, out in zip(prefixes, heads, strict=True):
            long_enough = ends - starts >= k
            stop = np.minimum(starts + k, len(data))
            h = mix((sums[stop] - low) * back + np.uint64(k + 1_000_003))
            out.append(np.where(long_enough, h, np.uint64(0)))
    places.append(starts + base)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` neighbouring words (rows are not told apart)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    return mix(out)


def row_shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Shingles of each row in their order: those of ``k`` words, or the whole of a shorter row, or none of an empty one."""
    whole = shingles(hashes, k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        yield whole[a:b - k + 1] if n >= k else shingles(hashes[a:b], int(n)) if n else hashes[a:a]
