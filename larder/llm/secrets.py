"""Secret scan: fixed shapes, and credential values rated by what it would cost to guess them.

The fixed shapes are assignments to a credential name, access key ids and long hexadecimal runs.  Beyond them, values
that follow credential words in looser wording are cut at minimum cost into dictionary words, dates, repeats, keyboard
walks and brute-force characters; a value that costs at least STRONG_BITS to guess is a secret too.  The dictionary is
made of the first guesses of COMMON and of the words and word parts of the byte-level vocabulary, so that ordinary prose
behind a credential word is cheap, also where a word is only made of known parts.  It is the same for every text: the spans
of a text follow from that text alone.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from datetime import date
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text_blocks as tb
from larder.llm.shared import with_fields

KINDS = ("assign", "access", "hex", "guess")
STRONG_BITS = 36.0

# The shapes of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among [0-9a-f]+
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Looser wording: "passphrase is ...", "pwd -> ...", "Authorization: Bearer ...", "password 'two words'".
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credentials?|bearer)"""
    r"""(?:["']?\s{0,8}(?::=|[:=]|->|=>|\bis\b)\s{0,8}|\s(?=["'`\w]*\d))["'`]?([^\s"'`,;<>]{6,})""",
    re.I | re.A,
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
CONTEXT_WORDS = (*ASSIGN_WORDS, b"api-key", b"passphrase", b"passcode", b"pwd", b"credential", b"bearer")

# Words that guessers try first, most frequent first.
COMMON = """password 123456 qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football
baseball superman batman trustno hello freedom whatever secret token test example sample demo default guest root user
changeme temp temporary system server database service account private public access key api love summer winter spring
autumn monday friday january december your my the this that is here value string none null true false placeholder
insert enter please company office home internet computer network security backup oracle mysql google apple windows
linux github docker cloud house horse battery staple correct black white blue green orange tiger lion flower coffee
money happy lucky magic star angel baby""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST_WORD = 24
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")

_PLACES = {key: (r, c) for r, row in enumerate(KEY_ROWS) for c, key in enumerate(row)}
_NEAR = {
    (a, b)
    for a, (r, c) in _PLACES.items()
    for b, (s, d) in _PLACES.items()
    if a != b and (abs(r - s), abs(c - d)) in ((0, 1), (1, 0)) or (s - r, d - c) in ((1, -1), (-1, 1))
}
_DATE = re.compile(r"(?:(\d{4})([-/.]?)(\d\d)\2(\d\d)|(\d\d)([-/.]?)(\d\d)\6(\d{4}))")
_YEARS = range(1900, 2051)
_BREAK_BITS = 1.0  # for every piece of a cut, that its kind must be guessed too


def _alphabet_bits(ch: str) -> float:
    if ch.isdigit():
        return math.log2(10)
    if ch.isascii() and ch.isalpha():
        return math.log2(26)
    return math.log2(33) if ch.isascii() else math.log2(100)


@cache
def base_ranks() -> dict[str, int]:
    """Rank of the words of COMMON and, behind them, of the words and word parts of three letters and more of the
    byte-level vocabulary, whose tokens stand in the order in which they were merged, so roughly by frequency."""
    import public_tokenizers

    ranks = dict(RANK)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    for _, token in tokens:
        word = token.removeprefix(b" ")
        if LONGEST_WORD >= len(word) > 2 and word.isalpha() and word.isascii():
            ranks.setdefault(word.decode().lower(), len(ranks) + 1)
    return ranks


def _word_bits(piece: str, ranks: dict[str, int]) -> float | None:
    """Rank of the word, of its plain spelling, and what capitals and digit-for-letter spellings add."""
    low = piece.lower()
    plain = low if low in ranks else low.translate(LEET)
    if plain not in ranks:
        return None
    swapped = sum(a != b for a, b in zip(low, plain, strict=True))
    upper = sum(c.isupper() for c in piece)
    case = 0.0 if not upper else 1.0 if upper == len(piece) or (upper == 1 and piece[0].isupper()) else float(len(piece))
    return math.log2(ranks[plain] + 1) + case + 1.5 * swapped


def _date_end(value: str, at: int) -> tuple[int, float] | None:
    """End and cost of a calendar date or a bare year that begins here."""
    m = _DATE.match(value, at)
    if m:
        y, mo, d = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
        try:
            if date(int(y), int(mo), int(d)).year in _YEARS:
                return m.end(), math.log2(365 * len(_YEARS)) + (2 if m[2] or m[6] else 0)
        except ValueError:
            pass
    if value[at : at + 4].isdigit() and len(value[at : at + 4]) == 4 and value[at : at + 4].isascii():
        if int(value[at : at + 4]) in _YEARS:
            return at + 4, math.log2(len(_YEARS))
    return None


def guess_bits(value: str, ranks: dict[str, int] | None = None) -> float:
    """log2 of the guesses that the cheapest cut of the value needs, with words by ``ranks`` (of ``base_ranks``).

    best[i] is the least cost of the first i characters.  Runs of equal characters and keyboard walks are tried at their
    full length and, because a later piece may begin inside, at every shorter length from three on while short; all
    other pieces have bounded length, so the cost of the scan is proportional to the value.
    """
    ranks = base_ranks() if ranks is None else ranks
    n = len(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    low = value.lower()
    run = [1] * n  # equal characters from here on
    walk = [1] * n  # neighbouring keys from here on
    for i in range(n - 2, -1, -1):
        if value[i] == value[i + 1]:
            run[i] = run[i + 1] + 1
        if (low[i], low[i + 1]) in _NEAR:
            walk[i] = walk[i + 1] + 1

    def offer(stop: int, cost: float) -> None:
        if cost < best[stop]:
            best[stop] = cost

    for i in range(n):
        base = best[i]
        # A brute-force character costs no break: a span of them is one piece in effect.
        offer(i + 1, base + _alphabet_bits(value[i]))
        base += _BREAK_BITS
        for stop in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            bits = _word_bits(value[i:stop], ranks)
            if bits is not None:
                offer(stop, base + bits)
        dated = _date_end(value, i)
        if dated:
            offer(dated[0], base + dated[1])
        for reach, bits in ((run[i], _alphabet_bits(value[i])), (walk[i], math.log2(len(_PLACES)))):
            for length in {*range(3, min(reach, 12) + 1), *([reach] if reach >= 3 else [])}:
                turns = 0.0 if bits == _alphabet_bits(value[i]) else 0.5 * length
                offer(i + length, base + bits + math.log2(length) + turns)
    return best[n]


def find(text: str, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) of all secrets, by start and then kind; bits where a value was rated by ``ranks``."""
    out: list[tuple[str, int, int, float | None]] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= ASSIGN_LEAST:
            out.append(("assign", m.start(), m.end(), guess_bits(m[2], ranks)))
    out += [("access", *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _ in out)
    starts = [a for a, _ in taken]
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        # Assignments do not overlap one another, and neither do the others of a kind: the few before are enough.
        k = int(np.searchsorted(starts, b)) if starts else 0
        if any(y > a for _, y in taken[max(0, k - 8) : k]):
            continue
        bits = guess_bits(m[1], ranks)
        if bits >= STRONG_BITS:
            out.append(("guess", a, b, bits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a secret: those with a credential word, an access prefix or a long hexadecimal run."""
    held = np.zeros(len(offsets) - 1, bool)
    plain, folded = data.tobytes(), tb.FOLD_ASCII[data].tobytes()

    def mark(haystack: bytes, needle: bytes) -> None:
        at = haystack.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            held[row] = True
            at = haystack.find(needle, max(at + 1, int(offsets[row + 1]) - len(needle) + 1))

    for word in CONTEXT_WORDS:
        mark(folded, word)
    mark(plain, b"AKIA")
    starts, ends, _ = tb.word_bounds(data, offsets, _HEX_BYTES)
    long = starts[ends - starts >= HEX_LEAST]
    held[np.searchsorted(offsets, long, "right") - 1] = True
    return held


_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[*range(48, 58), *range(97, 103)]] = True

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))


def scan(df: DataFrame, *, text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns of the input and ``spans``: array of (kind, start, end, bits), in code points, end exclusive.

    Null, empty and clean texts have no spans; texts are scanned whole.  Spans of different kinds may overlap, except
    that ``guess`` spans never touch another.  The spans of a row depend on its text only; repeated rows have the same.  A
    column already called like ``spans`` is replaced.
    """
    kept = [c for c in df.columns if c != spans]
    frame = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    ranks = df.sparkSession.sparkContext.broadcast(base_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column(at)):
                found: list[list] = [[] for _ in range(stop - start)]
                for row in np.flatnonzero(_candidates(data, offsets)).tolist():
                    own = find(data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8"), ranks.value)
                    found[row] = [dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(start, stop - start).columns, pa.array(found, _SPANS)], names=[*kept, spans]
                )

    span = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = with_fields(frame, (spans, T.ArrayType(span.add("bits", T.DoubleType()))))
    return frame.mapInArrow(tb.tidy(run), schema)


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by [SECRET]; null stays null."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(done: Column, s: Column) -> Column:
        fresh = F.when(
            s["start"] >= done["at"],
            F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("[SECRET]")),
        ).otherwise(done["out"])
        return F.struct(fresh.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, cut)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    )
