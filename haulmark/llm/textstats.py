"""Counts per text that rules and classifiers are built on."""

from __future__ import annotations

import numpy as np

from haulmark.llm.tokens import SHINGLE, TextSlice, keys_by_doc, repeated

SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
    "n_bare_symbols",
    "n_distinct_words",
)


def counts(part: TextSlice) -> dict[str, np.ndarray]:
    """Exact counts of every text of a slice, one array per name in ``COUNTS``."""
    data = part.data
    character = (data & 0xC0) != 0x80
    line_start, line_end, line_doc = part.lines()
    line_keys = keys_by_doc(part.span_hash(line_start, line_end), line_doc)
    _, first = np.unique(line_keys, return_index=True)
    n_lines = np.bincount(line_doc, minlength=part.n_docs)
    words = part.words()
    _, first_word = np.unique(keys_by_doc(words, part.word_doc), return_index=True)
    shingle, at = part.shingles()
    twice = at[repeated(keys_by_doc(shingle, part.word_doc[at]))]
    cover = np.zeros(len(part.starts) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + SHINGLE, -1)
    covered = np.cumsum(cover)[:-1] > 0
    symbol = _SYMBOL[data]
    one_symbol = symbol[part.starts] & (part.ends - part.starts == 1)
    return {
        "n_words": part.n_words,
        "word_chars": part.per_doc(part.is_word & character),
        "n_symbols": part.per_doc(symbol),
        "n_dup_lines": n_lines - np.bincount(line_doc[first], minlength=part.n_docs),
        "n_repeat_words": part.per_doc(covered, part.word_ptr),
        "n_lines": n_lines,
        "n_upper": part.per_doc(_UPPER[data]),
        "n_marks": part.per_doc(data == ord("!")),
        "n_bare_symbols": part.per_doc(one_symbol, part.word_ptr),
        "n_distinct_words": np.bincount(part.word_doc[first_word], minlength=part.n_docs),
    }


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free statistics, one row per text: all lie between 0 and about 1."""
    words = np.maximum(c["n_words"], 1).astype(np.float64)
    chars = np.maximum(c["word_chars"], 1).astype(np.float64)
    lines = np.maximum(c["n_lines"], 1).astype(np.float64)
    return np.column_stack(
        [
            np.minimum(c["n_symbols"] / words, 4.0) / 4.0,
            c["n_upper"] / chars,
            np.minimum(c["n_marks"] / words, 4.0) / 4.0,
            c["n_bare_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            np.minimum(chars / words, 20.0) / 20.0,
            # Distinct words fall with length in any text; the root of the length is its scale.
            np.minimum(c["n_distinct_words"] / np.sqrt(words) / 40.0, 1.0),
        ]
    )
