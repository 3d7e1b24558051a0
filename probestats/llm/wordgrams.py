"""Words of a batch and the character n-grams of its distinct words, as arrays."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    """The letters of a word, in lower case."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
    word = word.casefold()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def coded_words(texts: pa.Array, plain=letters) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words after ``plain``, their numbers in text order, each text's end); words that end up empty are left out."""
    split = pc.utf8_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    known: dict[str, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) if (w := plain(x)) else -1 for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else number
    there = codes >= 0
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return list(known), codes[there], np.r_[0, np.cumsum(there)][ends]


def char_ngrams(words: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``low`` to ``high`` characters of each word, and the words' positions.

    A word is set between two marks first, so n-grams at its ends are affixes. A word shorter than ``low`` has its
    whole self as only n-gram. Hashes have 64 well-mixed bits.
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(chars))  # characters of the word from here on
    hashes, owners = [], []
    rolling = np.zeros(len(chars), np.uint64)
    for n in range(1, high + 1):
        rolling = rolling[: len(chars) - n + 1] * _FACTOR + chars[n - 1 :] + np.uint64(n)
        if n < low:
            short = np.flatnonzero((left[: len(rolling)] == n) & (sizes[word[: len(rolling)]] == n))
            hashes.append(rolling[short])
            owners.append(word[short])
            continue
        fits = left[: len(rolling)] >= n
        hashes.append(rolling[fits])
        owners.append(word[: len(rolling)][fits])
    found, owner = np.concatenate(hashes), np.concatenate(owners)
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    order = np.argsort(owner, kind="stable")
    return found[order], owner[order]
