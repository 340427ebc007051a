"""Quality rules, line first: bad lines go, then documents that lost too much text go.

Each line is judged by itself.  It fails as
- punctuation: it does not end a sentence, has ``long_line`` words or more and hardly a full stop inside;
  or symbols stand in a large share of its words; or it shouts (capitals and exclamation marks);
- navigation: separators (``|``, ``>``, ``»``, ``/``, ``•``) stand between its words;
- boilerplate: it is short and has a fixed phrase of notices and menus.
What is left is the cleaned text.  A document is kept if it passes the base rules on its whole
text and its bad lines hold at most ``most_lost`` of its words.

Base rules: 20 words or more, and at most 30 % of the words in windows of eight words that the
text has twice or more.

Cases: a null text counts as empty: no words, base failed, not kept, cleaned text empty.
Repeated rows are judged alike; there is no state between documents, so the operator is one
narrow pass without a shuffle.  A very long text is worked off alone, its arrays a small multiple
of its bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakstone.llm import kernels as K

SYMBOL = K.table_of(b"#*$%&|<>")
SEPARATOR = [b"|", b">", b"/", b"\xc2\xbb", b"\xe2\x80\xa2", b"\xc2\xb7", b"::"]
FULL_STOP = K.table_of(b".!?;:,")
CLOSING = K.table_of(b".!?:;\"')]}")
WIDE_CLOSING = ["…".encode(), "”".encode(), "’".encode(), "»".encode()]
CAPITAL, SMALL = K.table_of(bytes(range(65, 91))), K.table_of(bytes(range(97, 123)))
HIGH = K.table_of(bytes(range(128, 256)))

# Phrases of notices, menus and licences.
PHRASES = (
    b"all rights reserved", b"cookie policy", b"accept cookies", b"uses cookies", b"privacy policy", b"terms of use",
    b"terms of service", b"terms and conditions", b"javascript is disabled", b"enable javascript",
    b"sign up for", b"subscribe to", b"log in to", b"click here", b"read more", b"share this",
    b"lorem ipsum", b"copyright (c)", b"licensed under", b"back to top", b"skip to content",
)

KIND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("lost_words", pa.int64()),
        ("kept", pa.bool_()),
        ("cleaned", pa.string()),
    ]
)
DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "lost_words long, kept boolean, cleaned string"
)


def phrase_pattern(phrases: tuple[bytes, ...]) -> re.Pattern:
    return re.compile(b"|".join(map(re.escape, phrases)))


def bad_lines(data: np.ndarray, starts, ends, n_words, words_at, phrases: re.Pattern, long_line: int) -> np.ndarray:
    """True for lines that fail a rule; ``words_at`` are the words' starts and ends."""
    letters = K.between(CAPITAL[data] | SMALL[data], starts, ends)
    capitals = K.between(CAPITAL[data], starts, ends)
    marks = K.between(data == 33, starts, ends)
    stops = K.between(FULL_STOP[data], starts, ends)
    begin, end = words_at
    marked = K.between(SYMBOL[data], begin, end) > 0
    separator = np.zeros(len(begin), bool)
    for sign in SEPARATOR:
        same = end - begin == len(sign)
        for j, byte in enumerate(sign):
            same[same] = data[begin[same] + j] == byte
        separator |= same
    of_line = np.searchsorted(starts, begin, "right") - 1
    n_marked = np.bincount(of_line[marked & ~separator], minlength=len(starts))
    n_separators = np.bincount(of_line[separator], minlength=len(starts))
    last = np.full(len(starts), -1)
    last[of_line] = end - 1  # the words are in order, so the last one stays
    closed = np.zeros(len(starts), bool)
    worded = np.flatnonzero(last >= 0)
    closed[worded] = CLOSING[data[last[worded]]]
    for sign in WIDE_CLOSING:
        fits = worded[last[worded] >= len(sign) - 1]
        for j, byte in enumerate(sign):
            fits = fits[data[last[fits] - len(sign) + 1 + j] == byte]
        closed[fits] = True
    loose = ~closed & (n_words >= long_line) & (20 * stops < n_words)
    symbols = (n_words > 0) & (3 * n_marked >= n_words)
    shouting = (n_words >= 3) & (10 * capitals >= 7 * letters) & (2 * marks >= n_words)
    navigation = (n_separators >= 2) & (6 * n_separators >= n_words)
    fixed = np.zeros(len(starts), bool)
    found = [m.start() for m in phrases.finditer(K.LOWER[data].tobytes())]
    if found:
        fixed[np.searchsorted(starts, np.array(found), "right") - 1] = True
    return loose | symbols | shouting | navigation | (fixed & (n_words <= 40))


def measure(data: np.ndarray, at: np.ndarray, phrases: re.Pattern, long_line: int, most_lost: float, clean: bool):
    n = len(at) - 1
    begin, end = K.words(data, at)
    of = K.owners(at, begin)
    hashes = K.span_hashes(data, begin, end)
    n_words = np.bincount(of, minlength=n)
    code_points = (data & 0xC0) != 0x80
    word_chars = K.per_text(code_points & ~K.BLANK[data], at)
    starts, ends, text = K.lines(data, at)
    line_words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    keys = K.keyed(text, K.span_hashes(data, starts, ends))
    worded = line_words > 0
    again = np.zeros(len(starts), bool)
    again[worded] = K.seen_before(keys[worded])
    covered = K.in_repeated_windows(of, hashes)
    n_repeat = np.bincount(of[covered], minlength=n)
    bad = bad_lines(data, starts, ends, line_words, (begin, end), phrases, long_line)
    lost = np.bincount(text[bad], weights=line_words[bad], minlength=n).astype(np.int64)
    failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    kept = ~failed & (lost <= most_lost * n_words)
    cleaned = []
    if clean:
        raw = data.tobytes()
        first = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            a, b = first[i], first[i + 1]
            if bad[a:b].any():
                piece = b"\n".join(raw[starts[k] : ends[k]] for k in range(a, b) if not bad[k])
            else:
                piece = raw[at[i] : at[i + 1]]
            cleaned.append(piece.decode("utf-8", "replace"))
    return (
        n_words, word_chars, K.per_text(SYMBOL[data], at), np.bincount(text[again], minlength=n), n_repeat,
        failed, lost, kept, cleaned or None,
    )


def judge_text(
    text: Column, long_line: int = 12, most_lost: float = 0.6, phrases: tuple[bytes, ...] = PHRASES, clean: bool = True
) -> Column:
    """Measures, verdict and (if ``clean``) cleaned text of a column of texts, as one struct."""
    pattern = phrase_pattern(phrases)

    @F.arrow_udf(DDL)
    def judged(column: pa.Array) -> pa.Array:
        data, at = K.buffers(column)
        parts = []
        for piece, offsets in K.slices(data, at):
            *numbers, cleaned = measure(piece, offsets, pattern, long_line, most_lost, clean)
            arrays = [pa.array(x, f.type) for x, f in zip(numbers, KIND, strict=False)]
            arrays.append(pa.array(cleaned, pa.string()) if clean else pa.nulls(len(offsets) - 1, pa.string()))
            parts.append(pa.StructArray.from_arrays(arrays, fields=list(KIND)))
        return pa.concat_arrays(parts) if parts else pa.array([], KIND)

    return judged(text)


def clean_documents(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, with their bad lines removed and the same columns."""
    judged = docs.withColumn("__judged", judge_text(F.col("text"), **rules)).filter("__judged.kept")
    return judged.select(*[F.col("__judged.cleaned").alias(c) if c == "text" else F.col(c) for c in docs.columns])
