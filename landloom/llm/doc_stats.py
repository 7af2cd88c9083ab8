"""Statistics of whole texts for the quality models: plain counts first, then the models' inputs.

A word is a run of other than ASCII white space. ``n_repeat_words`` counts the words that lie in a window of
eight words found twice or more in the text. Null and empty texts have zeros throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from landloom.llm.arrow import batch_of, slices, utf8

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the models, in order; shares are of words or of characters in words.
INPUTS = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "top_share", "twin_share", "upper_share", "digit_share", "stop_share", "comma_share", "bang_share", "bar_share", "other_ascii_share", "wide_share", "words_per_line", "short_line_share", "longest_word", "capital_share", "symbol_word_share")

_UPPER, _DIGIT, _CONT = bytes(range(65, 91)), b"0123456789", bytes(range(0x80, 0xC0))
_OTHER = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>.,!?")
_HIGH = bytes(range(0xC0, 0x100))


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows that are found at two places or more; windows are told apart exactly, by pairs of pairs."""
    n = len(ids)
    if n <= window or distinct == n:
        return 0
    codes, width, kinds = ids, 1, max(distinct, 1)
    while width < window:
        # windows of 2 * width words: a pair of two that stand width apart (the last step overlaps for other sizes)
        step = min(width, window - width)
        pairs = codes[:-step] * kinds + codes[step:]
        _, codes = np.unique(pairs, return_inverse=True)
        kinds, width = int(codes.max(initial=0)) + 1, width + step
        if kinds == len(codes):
            return 0
    twice = np.bincount(codes, minlength=kinds)[codes] > 1
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Counts and model inputs of one UTF-8 text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(INPUTS)
    joined = b"".join(words)
    less = lambda chars: len(joined) - len(joined.translate(None, chars))
    chars = len(joined) - less(_CONT)
    symbols = less(SYMBOLS)
    seen, dup_lines, lines, short = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\x0b\x0c\r"):
            lines += 1
            short += len(line) < 40
            dup_lines += line in seen
            seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated_words(ids, len(known))
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    per_id = np.bincount(ids, minlength=len(known))
    capital = np.fromiter((65 <= w[0] <= 90 for w in known), bool, len(known))
    marked = np.fromiter((w[-1] in SYMBOLS for w in known), bool, len(known))
    inputs = [
        np.log1p(n), chars / n, symbols / chars, dup_lines / lines, repeats / n, len(known) / n, per_id.max() / n,
        float((ids[1:] == ids[:-1]).sum()) / n, less(_UPPER) / chars, less(_DIGIT) / chars, less(b".?") / n, less(b",") / n,
        less(b"!") / n, less(b"|") / n, less(_OTHER) / chars, less(_HIGH) / chars, n / lines, short / lines,
        float(sizes.max()), float(per_id[capital].sum()) / n, float(per_id[marked].sum()) / n,
    ]
    return [n, chars, symbols, dup_lines, repeats], [float(x) for x in inputs]


def doc_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the plain counts and ``inputs`` (array of doubles) of every row (columns doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("inputs", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [statistics(t) for t in utf8(b)]
            counts = list(zip(*(c for c, _ in found), strict=True)) or [[]] * len(COUNTS)
            yield batch_of(schema, b.column("doc_id"), *(list(c) for c in counts), [x for _, x in found])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, inputs array<double>")
