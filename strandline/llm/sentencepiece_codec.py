"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as plain protobuf wire data; normaliser, metaspace marker, unigram scores or BPE merges, and byte
fallback are rebuilt on ``tokenizers.Tokenizer``, whose threads encode the texts of a batch side by side. Control, unused and
byte pieces never match text; user-defined pieces always do. Decoding joins the bytes of the pieces.

If no piece of the vocabulary joins a space to the character before it, a text's ids are those of its units (a word with
the space before it), and each distinct unit of a batch is encoded once. ``checked`` compares every unit, and every text that
isn't cut into units, with the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import words as W
from strandline.llm.packing import gathered
from strandline.llm.shared import added_to, small_batches, spans
from strandline.llm.tokenise import Memory

MARK = "▁"

#: Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Threads of the tokenizers library in a Python worker, unless RAYON_NUM_THREADS says otherwise.
THREADS = 2

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; fixed-size numbers stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def read(cls, data: bytes) -> ModelFile:
        own = cls([])
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                own.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                own.model_type, own.byte_fallback, own.suffix = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
            elif number == 3:
                rules = dict(_fields(value))
                own.charsmap = rules.get(2, b"")
                own.dummy_prefix, own.trim, own.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        return own

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first; at equal scores the longest left part, so runs grow from the left."""
        known = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        found = [(-score, -k, piece[:k], piece[k:]) for piece, score in known.items() for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
        return [(left, right) for *_, left, right in sorted(found)]


class SentenceCodec:
    """Texts to ids and back by a SentencePiece model file; with ``verify`` the sentencepiece library is asked as well."""

    def __init__(self, path: str, verify: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import AddedToken, Tokenizer, models, normalizers

        with open(path, "rb") as file:
            self.file = file_ = ModelFile.read(file.read())
        if file_.model_type not in (UNIGRAM, BPE) or file_.suffix:
            raise ValueError("only unigram and BPE models with the space before a word are supported")
        self.unknown = next((k for k, p in enumerate(file_.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(file_.pieces) if kind == BYTE}
        if file_.model_type == BPE:
            model = models.BPE({p: k for k, (p, _, _) in enumerate(file_.pieces)}, file_.merges(), unk_token=file_.pieces[self.unknown][0], byte_fallback=file_.byte_fallback, fuse_unk=True)
        else:  # a piece that text must not match gets a name of characters that are none
            lowest = min((s for _, s, kind in file_.pieces if kind == NORMAL), default=0.0)
            model = models.Unigram([(p, s) if kind in (NORMAL, USER_DEFINED) else (f"\ufffe{k}\uffff", lowest) for k, (p, s, kind) in enumerate(file_.pieces)], self.unknown, False)
        self.library = Tokenizer(model)
        self.defined = sorted((p for p, _, kind in file_.pieces if kind == USER_DEFINED), key=len, reverse=True)
        if self.defined:
            self.library.add_tokens([AddedToken(p, normalized=False) for p in self.defined])
        self.split = re.compile("(" + "|".join(map(re.escape, self.defined)) + ")") if self.defined else None
        self.charsmap = normalizers.Precompiled(file_.charsmap) if file_.charsmap else None
        normal = [p for p, _, kind in file_.pieces if kind in (NORMAL, USER_DEFINED)]
        plain = not (file_.charsmap or file_.trim or self.defined)
        self.by_units = plain and file_.dummy_prefix and file_.escape and file_.model_type == BPE and not any(MARK in p.lstrip(MARK) or "\n" in p for p in normal)
        raw = [b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in file_.pieces]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.memory = Memory(self._learn)
        #: Ids of units and texts that the sentencepiece library gives otherwise.
        self.other = None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.wrong_units: set[str] = set()

    def normal(self, text: str) -> str:
        """The text after the model's own rules: characters, spaces, the marker before it and in place of spaces."""
        if self.charsmap is not None:
            parts = self.split.split(text) if self.split else [text]
            text = "".join(x if k % 2 else self.charsmap.normalize_str(x) for k, x in enumerate(parts))
        if self.file.trim:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if text and self.file.dummy_prefix:
            text = " " + text
        text = text.replace(" ", MARK) if self.file.escape else text
        return text.rstrip(MARK) if self.file.trim and self.file.escape else text

    def _encoded(self, normal: list[str]) -> list[list[int]]:
        """Ids of texts in normal form, encoded side by side."""
        found = [x.ids for x in self.library.encode_batch_fast(normal, add_special_tokens=False)]
        if self.file.model_type == UNIGRAM and self.file.byte_fallback:
            again = [k for k, ids in enumerate(found) if self.unknown in ids]
            for k, x in zip(again, self.library.encode_batch([normal[k] for k in again], add_special_tokens=False), strict=True):
                found[k] = [i for own, token in zip(x.ids, x.tokens, strict=True) for i in ([self.bytes[b] for b in token.encode()] if own == self.unknown else [own])]
        return found

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self._encoded([self.normal(x) for x in texts])

    def _learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = units.to_pylist()
        found = self._encoded(names)
        if self.other is not None:
            if not len(self.memory.ids):
                self.wrong_units.clear()
            line = self.other.encode("\n")
            for lead, before in ((MARK, []), ("", line)):  # units after a space, and those at the start of a line
                own = [k for k, x in enumerate(names) if (x[0] == MARK and len(x) > 1 if lead else x[0] not in (MARK, "\n"))]
                given = self.other.encode([names[k][1:] if lead else "\n" + names[k] for k in own])
                self.wrong_units.update(names[k] for k, ids in zip(own, given, strict=True) if ids != before + found[k])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), np.cumsum(lengths) - lengths, lengths

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", " " + MARK), "\n", " \n ")
        size = pa.large_string()
        marked = pc.binary_join_element_wise(pa.scalar(MARK, size), marked, pa.scalar("", size))
        parts = pc.split_pattern(marked, " ")
        flat, owner = parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        units = flat.filter(pa.array(full)).dictionary_encode()
        rows = self.memory.rows(units.dictionary)[units.indices.to_numpy()]
        each = self.memory.lengths[rows]
        return self.memory.spelled(rows), np.bincount(owner[full], weights=each, minlength=len(texts)).astype(np.int64)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """The texts that are not cut into units."""
        if not self.by_units:
            return np.ones(len(texts), bool)
        odd = pc.starts_with(texts, " ").to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        for pattern in ("  ", MARK):
            odd |= pc.match_substring(texts, pattern).to_numpy(zero_copy_only=False)
        return odd

    def differs(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The texts of an ``encode`` just made whose ids the sentencepiece library gives otherwise: those with a unit that it
        encodes otherwise, and those not cut into units that it does."""
        texts = W.whole(texts)
        odd = self._odd(texts)
        out = np.zeros(len(texts), bool)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.other.encode(texts[k].as_py()) != ids[edges[k] : edges[k + 1]].tolist()
        if self.wrong_units:
            for k in np.flatnonzero(~odd).tolist():
                words = (" " + texts[k].as_py()).replace(" ", " " + MARK).replace("\n", " \n ").split(" ")
                out[k] = not self.wrong_units.isdisjoint(words)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and the number of ids of each text."""
        texts = W.whole(texts)
        n = len(texts)
        odd = self._odd(texts)
        plain = np.flatnonzero(~odd)
        ids, counts = self._by_units(texts.take(pa.array(plain))) if len(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not odd.any():
            return ids, counts
        rest = np.flatnonzero(odd)
        found = self._whole(texts.take(pa.array(rest)).to_pylist())
        lengths = np.zeros(n, np.int64)
        lengths[plain], lengths[rest] = counts, list(map(len, found))
        pool = np.concatenate([ids, np.fromiter((i for x in found for i in x), np.uint32, int(lengths[rest].sum()))])
        starts = np.zeros(n, np.int64)
        starts[plain] = np.cumsum(counts) - counts
        starts[rest] = len(ids) + np.cumsum(lengths[rest]) - lengths[rest]
        return pool[spans(starts, lengths)], lengths

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.piece_size[ids]
        raw = self.piece_bytes[spans(self.piece_start[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [x[1:] if x.startswith(" ") else x for x in texts] if self.file.dummy_prefix else texts

    def check_parity(self, path: str, texts: list[str]) -> list[str]:
        """The texts that the sentencepiece library encodes or decodes otherwise (none, if all is well)."""
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, counts = self.encode(pa.array(texts, pa.string()))
        edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
        back = self.decode(ids, counts)
        return [t for t, a, b, x in zip(texts, edges[:-1], edges[1:], back, strict=True) if other.encode(t) != ids[a:b].tolist() or other.decode(ids[a:b].tolist()) != x]


@lru_cache(maxsize=2)
def codec(path: str, verify: bool = False) -> SentenceCodec:
    """One codec for each model file and Python worker."""
    return SentenceCodec(path, verify)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``docs`` with ids (little-endian 32-bit numbers as bytes) and n_tokens.

    A null or empty text has no ids. Columns of those names are replaced. A very long text is encoded whole, by one task. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens").withColumn("text", F.col("text").cast("string"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            ids, counts = codec(model_path).encode(table.column("text"))
            raw, edges = ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)]).tolist()
            column = pa.array([raw[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield from table.append_column("ids", column).append_column("n_tokens", pa.array(counts)).combine_chunks().to_batches()

    return docs.mapInArrow(encode, added_to(docs.schema).add("ids", "binary").add("n_tokens", "long"))


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``rows`` with decoded, the text of column ids; null ids give a null text."""
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            own = [np.frombuffer(x or b"", "<u4") for x in raw]
            texts = codec(model_path).decode(np.concatenate(own).astype(np.int64), np.array(list(map(len, own)))) if own else []
            column = pa.array([None if x is None else t for x, t in zip(raw, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(decode, added_to(rows.schema).add("decoded", "string"))


def checked(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_crc32, round_trip and parity.

    ``round_trip``: decoding the ids gives the whole text again; ``parity``: the sentencepiece library gives the same ids.
    A null text counts as empty; a null doc_id stays null. Repeated rows give repeated rows, an empty table none.
    """
    small_batches(docs.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, True)
        for table in gathered(batches):
            texts = table.column("text")
            ids, counts = own.encode(texts)
            back = own.decode(ids, counts)
            raw, edges = ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)]).tolist()
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            same = [(x or "") == y for x, y in zip(texts.to_pylist(), back, strict=True)]
            columns = [table.column("doc_id").combine_chunks(), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same), pa.array(~own.differs(texts, ids, counts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(check, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")
