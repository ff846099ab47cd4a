"""Whole texts to token ids with the tokenizers library, one encoding for each distinct word of a batch.

White space always separates the pre-tokens of the word-level vocabulary, so a text's ids are the ids of its words, one
after another. A word of a batch is encoded once however often it occurs; plain words are joined into long lines for the
library, and cut apart again where a token ends a word.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.llm.shared import spans

#: Strings whose ids a Python worker remembers from one batch to the next, and strings that the library encodes at once.
REMEMBERED, AT_ONCE = 700_000, 40_000

#: Composed Latin letters whose lower case is one letter again, and closing marks that never start a contraction: one or
#: two pre-tokens, which the library's normaliser would only put in lower case.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
CLOSED = "^([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)$"


class Memory:
    """Ids of strings met before, as Arrow and numpy columns; ``learn`` gives (ids, starts, lengths) of new strings."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.strings = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)

    def fade(self) -> None:
        """Keep the strings that were asked for twice or more since the last time, unless they are too many."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > REMEMBERED // 2:
            self.forget()
            return
        self.strings = self.strings.take(pa.array(kept))
        self.ids, self.lengths = self.spelled(kept), self.lengths[kept]
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.met = np.zeros(len(kept), np.int32)

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """The row of each string: its ids are ids[starts[k] : starts[k] + lengths[k]]."""
        at = pc.index_in(distinct, value_set=self.strings)
        if at.null_count:
            new = distinct.filter(pc.is_null(at))
            if len(self.strings) + len(new) > REMEMBERED:
                self.fade()
                new = distinct.filter(pc.is_null(pc.index_in(distinct, value_set=self.strings)))
            for first in range(0, len(new), AT_ONCE):
                ids, starts, lengths = self.learn(new.slice(first, AT_ONCE))
                self.starts = np.concatenate([self.starts, len(self.ids) + starts])
                self.ids = np.concatenate([self.ids, ids])
                self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.strings = pa.concat_arrays([self.strings, new])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
            at = pc.index_in(distinct, value_set=self.strings)
        rows = at.to_numpy(zero_copy_only=False)
        self.met[rows] += 1
        return rows

    def spelled(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the strings of these rows, one after another."""
        return self.ids[spans(self.starts[rows], self.lengths[rows])]


class WordEncoder:
    """Token ids of texts by the vocabulary file at ``path``; the same ids as the library gives for whole texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: The same model for words in normal form that white space cuts into pre-tokens.
        self.direct = Tokenizer(self.library.model)
        self.direct.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)]
        )
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(size, dtype=bool)
        for token, number in self.library.get_vocab(with_added_tokens=True).items():
            self.ends_word[number] = token.endswith("</w>")
        self.memory = Memory(self._learn)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    def _in_lines(self, words: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain and closed words (with a space before the marks) of one or two pre-tokens each."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lines = [" ".join(words[i : i + 4000]).lower() for i in range(0, len(words), 4000)]
        found = self.direct.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, dtype=np.uint32) for x in found])
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        last = np.cumsum(pieces)
        if len(cuts) != last[-1] or cuts[-1] != len(ids):
            raise ValueError("a vocabulary without word ends")
        return ids, np.diff(cuts[last - 1], prepend=0)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        closed = pc.match_substring_regex(words, CLOSED).to_numpy(zero_copy_only=False)
        simple = np.flatnonzero(plain | closed)
        other = np.flatnonzero(~(plain | closed))
        spaced = pc.replace_substring_regex(words.take(pa.array(simple)), CLOSED, r"\1 \2").to_pylist()
        ids_a, lengths_a = self._in_lines(spaced, 1 + closed[simple].astype(np.int64))
        ids_b, lengths_b = self._one_by_one(words.take(pa.array(other)).to_pylist())
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[simple], lengths[other] = lengths_a, lengths_b
        starts[simple] = np.cumsum(lengths_a) - lengths_a
        starts[other] = len(ids_a) + np.cumsum(lengths_b) - lengths_b
        return np.concatenate([ids_a, ids_b]), starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and the number of ids of each text."""
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")  # a copy: no slice
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else capitals may tell text from special tokens
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        counts = np.diff(words.offsets.to_numpy())
        distinct = words.flatten().dictionary_encode()
        rows = self.memory.rows(distinct.dictionary)[distinct.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.memory.lengths[rows], dtype=np.int64)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.memory.spelled(rows), np.diff(ends[edges])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker."""
    return WordEncoder(path)
