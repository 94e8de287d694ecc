"""Statistics of whole texts, used by the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np

from .words import SPACE, Texts, distinct_per_text, hashes_of, lines_of, per_text, repeated, salted, shingles_of, words_of

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".,;:!?")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "mean_word", "long_words", "symbols", "upper", "digits", "stops", "shouts", "bars", "breaks", "foreign", "spaces",
    "dup_lines", "repeat_words", "same_next", "distinct", "alone",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measure(texts: Texts) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The five base counts and the ratios of each text. Texts without words give zeros.

    word_chars: code points in words. n_symbols: characters of `#*$%&|<>`. n_dup_lines: lines with a word that equal an
    earlier line of the text. n_repeat_words: words inside 5-word windows that the text has twice or more.
    """
    data, offsets, count = texts.data, texts.offsets, texts.count
    words = words_of(data, offsets)
    n_words = np.bincount(words.docs, minlength=count)
    leads = (data & 0xC0) != 0x80
    inside = ~SPACE[data]
    word_chars = per_text(leads & inside, offsets)
    symbols = per_text(SYMBOLS[data], offsets)
    lines = lines_of(data, offsets)
    n_lines = np.bincount(lines.docs, minlength=count)
    dup_lines = n_lines - distinct_per_text(hashes_of(data, lines), lines.docs, count)
    hashes = hashes_of(data, words)
    windows, at = shingles_of(hashes, words.docs)
    twice = at[repeated(salted(windows, words.docs[at]))]
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    edges[: len(hashes)] += np.bincount(twice, minlength=len(hashes))[: len(hashes)] if len(hashes) else 0
    closing = np.bincount(twice + 5, minlength=len(edges))
    covered = np.cumsum(edges - closing[: len(edges)])[:-1] > 0
    repeat_words = np.bincount(words.docs[covered], minlength=count)
    base = dict(zip(BASE, (n_words, word_chars, symbols, dup_lines, repeat_words), strict=True))

    length = words.ends - words.starts
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.docs[1:] == words.docs[:-1])
    single = length == 1
    bars = single & (data[words.starts] == 124) if len(length) else single
    upper = per_text((data >= 65) & (data <= 90), offsets)
    letters = upper + per_text(((data >= 97) & (data <= 122)) | (data >= 0xC0), offsets)
    ratios = dict(zip(RATIOS, (
        np.log1p(n_words), _share(word_chars, n_words), _share(np.bincount(words.docs[length > 20], minlength=count), n_words),
        _share(symbols, word_chars), _share(upper, letters), _share(per_text((data >= 48) & (data <= 57), offsets), word_chars),
        _share(per_text(STOPS[data], offsets), word_chars), _share(per_text(data == 33, offsets), n_words),
        _share(np.bincount(words.docs[bars], minlength=count), n_words), _share(per_text(data == 10, offsets), n_words),
        _share(per_text(data >= 0xC0, offsets), word_chars), _share(np.diff(offsets), n_words + word_chars),
        _share(dup_lines, n_lines), _share(repeat_words, n_words), _share(np.bincount(words.docs[same], minlength=count), n_words),
        _share(distinct_per_text(hashes, words.docs, count), n_words),
        _share(np.bincount(words.docs[single], minlength=count), n_words),
    ), strict=True))
    return base, ratios
