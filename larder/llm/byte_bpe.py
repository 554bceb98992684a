"""Byte-level BPE: encoding by merge replay over distinct words, and decoding.

Texts are cut into words by the tokenizer's pattern.  The distinct words of a whole block of documents lie in one flat
array of byte symbols, and the merges are replayed over all of them at once, lowest rank first: an inverted index
leads from each merge to the places of its token pair, and a merge touches nothing but those places and their
neighbours, whose new pairs enter the index under their own ranks.  Documents are then written out word by word.

A merge can give birth to a pair of a lower rank than its own.  Where its neighbours make that possible, a word merges only
its leftmost place before the index is asked again; everywhere else all places go at once.

Each Python worker keeps the words it has seen, up to CACHE_WORDS, and starts anew beyond that, so memory is bounded
however many words the corpus has; no table of words is gathered, shuffled or broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text_blocks as tb
from larder.llm.shared import with_fields

CACHE_WORDS = 250_000
BLOCK_CHARS = 1 << 22
FEW = 24  # up to so many places of a merge, plain numbers are faster than arrays


class Vocabulary:
    """Token bytes by id, and the id that a pair of ids merges into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, hasty = [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
                    hasty.update(x for x in (left, right) if x > rank)
        pairs.sort()
        self.pairs = dict(pairs)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ids = np.array([r for _, r in pairs] or [-1], np.int64)
        # Tokens next to which a pair of a lower rank than the token's own can arise.
        self.hasty = hasty

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())})

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, -1 where the pair does not merge."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)


def replay(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, flat, and the n + 1 offsets of the words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = int(lengths.sum())
    token = np.empty(total + 1, np.int64)
    token[:total] = vocabulary.single[np.frombuffer(b"".join(words), np.uint8)]
    token[total] = -1
    word = np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, total + 2), np.arange(-1, total)
    after[total] = total
    ends = np.cumsum(lengths)
    after[ends[lengths > 0] - 1] = total  # the last place stands for "no neighbour"
    before[(ends - lengths)[lengths > 0]] = total

    # Places by rank: in arrays, and single ones.
    index: dict[int, tuple[list[np.ndarray], list[int]]] = {}
    waiting: list[int] = []
    pair_rank = vocabulary.pairs.get

    def enter(places: np.ndarray) -> None:
        places = places[(places < total) & (after[places] < total)]
        ranks = vocabulary.merged(token[places], token[after[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        if len(ranks) == 1:
            add(int(ranks[0]), places)
        elif len(ranks):
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                add(rank, own)

    def at(rank: int) -> tuple[list[np.ndarray], list[int]]:
        if rank not in index:
            index[rank] = [], []
            heapq.heappush(waiting, rank)
        return index[rank]

    def add(rank: int, places: np.ndarray) -> None:
        at(rank)[0].append(places)

    def merge_few(rank: int, places: list[int]) -> None:
        """The same as below for a few places, one by one from the left."""
        for k, place in enumerate(places):
            gone = int(after[place])
            if token[place] < 0 or pair_rank(int(token[place]) << 32 | int(token[gone])) != rank:
                continue
            beyond = int(after[gone])
            token[place], token[gone], after[place] = rank, -1, beyond
            if beyond < total:
                before[beyond] = place
            lower = False
            for left in (int(before[place]), place):
                if left < total and after[left] < total:
                    born = pair_rank(int(token[left]) << 32 | int(token[after[left]]))
                    if born is not None:
                        at(born)[1].append(left)
                        lower |= born < rank
            if lower and k + 1 < len(places):
                at(rank)[1].extend(places[k + 1 :])
                return

    def overtaken(rank: int, places: np.ndarray) -> np.ndarray:
        """Whether merging a place may make a pair of a lower rank, whatever happens to its neighbours."""
        new = np.full(len(places), rank, np.int64)
        made = [
            vocabulary.merged(token[before[places]], new),
            vocabulary.merged(new, token[after[after[places]]]),
            vocabulary.merged(new, new),
        ]
        return np.logical_or.reduce([(m >= 0) & (m < rank) for m in made])

    if total:
        enter(np.arange(total))
    while waiting:
        rank = heapq.heappop(waiting)
        arrays, single = index.pop(rank)
        if len(single) + sum(map(len, arrays)) <= FEW:
            merge_few(rank, sorted({*single, *(p for a in arrays for p in a.tolist())}))
            continue
        if single:
            arrays.append(np.array(single, np.int64))
        places = arrays[0] if len(arrays) == 1 else np.unique(np.concatenate(arrays))
        # A place may have changed since it was entered.
        places = places[token[places] >= 0]
        places = places[vocabulary.merged(token[places], token[after[places]]) == rank]
        if not len(places):
            continue
        if len(places) > 1:
            places = np.sort(places)
            if rank in vocabulary.hasty:
                own = word[places]
                first = np.concatenate(([True], own[1:] != own[:-1]))
                if not first.all():
                    later = np.isin(own, own[overtaken(rank, places)]) & ~first
                    if later.any():
                        add(rank, places[later])
                        places = places[~later]
            # Of places that overlap in a chain, every second one counted from the left.
            chained = np.concatenate(([False], after[places[:-1]] == places[1:]))
            if chained.any():
                number = np.arange(len(places))
                head = np.maximum.accumulate(np.where(chained, 0, number))
                places = places[(number - head) % 2 == 0]
        gone = after[places]
        beyond = after[gone]
        token[places] = rank
        token[gone] = -1
        after[places] = beyond
        before[beyond[beyond < total]] = places[beyond < total]
        enter(np.unique(np.concatenate((before[places], places))))
    kept = token[:total] >= 0
    counts = np.bincount(word[kept], minlength=len(words)) if total else np.zeros(len(words), np.int64)
    return token[:total][kept], np.concatenate(([0], np.cumsum(counts)))


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Encoder:
    """Encodes texts with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, cache_words: int = CACHE_WORDS):
        import regex

        self.vocabulary, self.cut, self.cache_words = vocabulary, regex.compile(pattern).findall, cache_words
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.known = 0
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and the n + 1 offsets of the texts."""
        if len(self.codes) > self.cache_words:
            self.forget()
        code, cut = self.codes.__getitem__, self.cut
        coded = []
        for text in texts:
            words = cut(text)
            coded.append(np.fromiter(map(code, words), np.int32, len(words)))
        if len(self.codes) > self.known:
            from itertools import islice

            fresh = [w.encode() for w in islice(self.codes, self.known, None)]
            ids, offsets = replay(self.vocabulary, fresh)
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
            self.known = len(self.codes)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        first, size = self.offsets[flat], self.offsets[flat + 1] - self.offsets[flat]
        stops = np.cumsum(size)
        total = int(stops[-1]) if len(stops) else 0
        out = self.ids[np.repeat(first - (stops - size), size) + np.arange(total)]
        words_before = np.cumsum([0, *map(len, coded)])
        return out, np.concatenate(([0], stops))[words_before]


class Decoder:
    """Joins token bytes: the lengths and bytes of all tokens lie in two flat arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all sequences, flat, and their n + 1 offsets."""
        size = self.sizes[ids]
        stops = np.cumsum(size)
        total = int(stops[-1]) if len(stops) else 0
        data = self.flat[np.repeat(self.first[ids] - (stops - size), size) + np.arange(total)]
        return data, np.concatenate(([0], stops))[offsets]


_held: dict[tuple, object] = {}


def _once(kind: str, key: tuple, make):
    """One encoder or decoder for each vocabulary in a worker, which serves many tasks."""
    if (kind, key) not in _held:
        _held[kind, key] = make()
    return _held[kind, key]


def _ship(df: DataFrame, ranks: str):
    """Broadcast the rank file as it is: its size is that of the vocabulary, not of the data."""
    with open(ranks, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _spans(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def encode(
    df: DataFrame, *, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """All columns of the input and ``ids`` array<int>, the token ids of the whole text without special tokens.

    With ``decoded``, a binary column of that name holds what the ids decode to, made in the same pass.

    ranks: path of a file of base64 tokens and ranks that the driver can read.  A null or empty text has no ids.
    Replaces a column already called like ``ids``.  Equal texts and repeated rows get equal ids; an empty table gives
    an empty result.
    """
    file = _ship(df, ranks)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    frame = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once("encode", (ranks, pattern), lambda: Encoder(Vocabulary.parse(file.value), pattern))
        decoder = _once("decode", (ranks,), lambda: Decoder(encoder.vocabulary)) if decoded else None
        for batch in batches:
            column = batch.column(at)
            lengths = column.fill_null("").cast(pa.large_string())
            sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8)) if len(lengths) else np.zeros(0, np.int64)
            for start, stop in _spans(sizes, BLOCK_CHARS):
                part = batch.slice(start, stop - start)
                out, bounds = encoder.encode([x or "" for x in part.column(at).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))
                more = [_binary(*decoder.decode(out, bounds))] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names=names)

    fields = [(ids, T.ArrayType(T.IntegerType())), *([(decoded, T.BinaryType())] if decoded else [])]
    names = [*kept, *(name for name, _ in fields)]
    return frame.mapInArrow(tb.tidy(run), with_fields(frame, *fields))


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(bounds.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


def decode(df: DataFrame, *, ranks: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """All columns of the input and ``data`` binary, the bytes of the token ids.

    Null ids decode to no bytes; an id outside of the vocabulary is an error.  Replaces a column already called like
    ``data``.
    """
    file = _ship(df, ranks)
    kept = [c for c in df.columns if c != data]
    frame = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once("decode", (ranks,), lambda: Decoder(Vocabulary.parse(file.value)))
        for batch in batches:
            column = batch.column(at).fill_null(pa.scalar([], pa.list_(pa.int32())))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            for start, stop in _spans(sizes, BLOCK_CHARS // 4):
                own = flat[edges[start] : edges[stop]]
                out, bounds = decoder.decode(own, edges[start : stop + 1] - edges[start])
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(out, bounds)], names=[*part.schema.names, data])

    return frame.mapInArrow(tb.tidy(run), with_fields(frame, (data, T.BinaryType())))
