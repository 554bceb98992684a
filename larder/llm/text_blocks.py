"""Whole columns of text as flat byte arrays: word bounds and 64-bit word hashes for a batch in a few numpy passes.

Texts are UTF-8.  All word rules here split on ASCII characters only, so bytes of longer characters are never torn.
A batch is cut into blocks of bounded size; a text larger than the bound is a block of its own and is never shortened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SPAN = 1 << 20  # bytes hashed with one table of powers
LONG_WORD = 4096  # longer words are hashed by digest, so that no hash depends on where a span begins

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _U(0xD6E8FEB86659FD93)

FOLD_ASCII = np.arange(256, dtype=np.uint8)
FOLD_ASCII[65:91] += 32

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(SPAN + LONG_WORD + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64) -> np.ndarray:
    if name not in _tables:
        _tables[name] = _powers(base)
    return _tables[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, and what one needed must not stay with it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A batch function that gives memory back when its rows have ended."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    if not len(column) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return flat, bounds - bounds[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each block of a string column."""
    flat, offsets = utf8(column)
    for start, stop in blocks(offsets, limit):
        yield start, stop, flat[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, and the n + 1 word offsets of the rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = inside[data]
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given byte ranges."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _table("power", _BASE), _table("inverse", _BASE_INVERSE)
    a = 0
    while a < len(starts):
        first = starts[a]
        b = a + 1
        if ends[a] - first <= LONG_WORD:
            b = max(b, int(np.searchsorted(ends, first + SPAN, "right")))
            span = data[first : ends[b - 1]]
            sums = np.empty(len(span) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_LETTER[span] * power[: len(span)], out=sums[1:])
            left, right = starts[a:b] - first, ends[a:b] - first
            out[a:b] = (sums[right] - sums[left]) * inverse[left] + _U(0x51ED27) * (right - left).astype(np.uint64)
        a = b
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        from hashlib import blake2b

        for k in long:
            digest = blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            out[k] = int.from_bytes(digest, "little")
    return mix(out)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, regardless of rows; ``len(words) - n + 1`` of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = words[:count].copy()
    for j in range(1, n):
        h *= _STEP
        h += words[j : j + count]
    return mix(h)


def gram_rows(word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that lie within one row, and the n + 1 offsets of the rows among them."""
    lengths = np.maximum(np.diff(word_offsets) - n + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    positions = np.arange(offsets[-1]) + np.repeat(word_offsets[:-1] - offsets[:-1], lengths)
    return positions, offsets


def hash_sequence(words: np.ndarray) -> np.uint64:
    """The hash that ``grams`` gives a whole sequence."""
    return grams(words, len(words))[0]


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
