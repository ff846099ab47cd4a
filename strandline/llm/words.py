"""Words and lines of a batch of texts, as arrays over the whole batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts in one array of their own, with nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: compute functions misread the offsets of slices
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts, and the index of each word's text."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    return (flat, owner) if full.all() else (flat.filter(pa.array(full)), owner[full])


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines of all texts cut at \\n, and the index of each line's text."""
    parts = pc.split_pattern(texts, "\n")
    return parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))


def codes(strings: pa.Array) -> tuple[np.ndarray, int]:
    """Equal strings get equal numbers from 0 on; how many numbers there are."""
    found = strings.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of the weights (or the count) of each text's items."""
    return np.bincount(owner, weights=weights, minlength=n).astype(np.int64)


def bytes_in(texts: pa.Array, members: bytes) -> np.ndarray:
    """How many bytes of each text are among ``members`` (one-byte characters)."""
    table = np.zeros(256, np.int64)
    table[list(members)] = 1
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(table[data[offsets[0] : offsets[-1]]], dtype=np.int64)])
    return np.diff(ends[offsets - offsets[0]])


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def kinds(word: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table of the kind of each byte: 1 belongs to a word, 2 breaks a piece, 0 only separates words."""
    found = np.zeros(256, np.uint8)
    found[list(word)], found[list(breaks)] = 1, 2
    return found


def count_words(texts: pa.Array, kind: np.ndarray) -> np.ndarray:
    """How many runs of word bytes each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside, opens = kind[data] == 1, np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    starts = np.flatnonzero(inside & (opens[:-1] | ~np.r_[False, inside[:-1]]))
    return np.diff(np.searchsorted(starts, offsets))


def cut_words(texts: pa.Array, kind: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes with A-Z lowered; the index of each one's text; whether it begins a piece of the text.

    Pieces end at bytes that break and at the end of a text. Bytes of longer characters are of one kind.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    now = kind[data]
    inside, opens = now == 1, np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    starts = np.flatnonzero(inside & (opens[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (opens[1:] | ~np.r_[inside[1:], False])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.flatnonzero(now == 2)
    piece = np.searchsorted(breaks, starts)
    first = np.r_[True, (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])][: len(starts)]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(LOWERED[data[inside]])])
    return words, owner, first


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of each string (large strings, none empty); equal strings have equal hashes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    lengths = np.diff(offsets)
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    within = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    mixed = np.add.reduceat(data * powers[within], offsets[:-1] - offsets[0])
    return (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
