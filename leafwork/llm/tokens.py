"""Token ids of a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is serialised straight from the vocabulary's rank file: each byte is written as one
character of U+0100..U+01FF, each piece is scored by its negative rank and nothing is normalised, so the model's
merges are the vocabulary's merges and its piece numbers are the vocabulary's ids. Texts are first cut by the
vocabulary's public pattern into pre-tokens, which never merge with each other; each distinct pre-token is encoded
once per worker and looked up after that.

Defined cases: an empty text and a null text both have the empty list of ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens a worker remembers; beyond it the memory is emptied and filled again (results don't change).
MEMORY = 200_000
_BASE = 0x100


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files: the installed package's own, or LEAFWORK_TOKENIZERS."""
    if own := os.environ.get("LEAFWORK_TOKENIZERS"):
        return own
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"


def read_ranks(path: str | Path) -> list[bytes]:
    """Byte strings of a rank file in order of rank; ranks must be 0..n-1."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines()) if token)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not consecutive")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & 0xFFFFFFFFFFFFFFFF)


_TO_CHAR = {b: chr(_BASE + b) for b in range(256)}


def as_chars(data: bytes) -> str:
    """Bytes as characters of U+0100..U+01FF, one each."""
    return data.decode("latin-1").translate(_TO_CHAR)


def as_bytes(chars: str) -> bytes:
    """Inverse of as_chars."""
    return bytes(ord(c) - _BASE for c in chars)


def serialise_model(ranks: list[bytes]) -> bytes:
    """Serialised sentencepiece model whose piece numbers are the ranks; one unknown piece follows them."""
    pieces = []
    for rank, token in enumerate(ranks):
        pieces.append(_message(1, _message(1, as_chars(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    pieces.append(_message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", -float(len(ranks))) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


class Encoder:
    """Encodes and decodes with one vocabulary; made once per Python worker."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(serialise_model(ranks))
        self.ranks = ranks
        self.cut = regex.compile(PRE_TOKEN).findall
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def learn(self, tokens: Iterable[str]) -> None:
        known = self.known
        new = list({t for t in tokens if t not in known})
        if len(known) + len(new) > MEMORY:
            known.clear()
            self.sizes.clear()
            new = list(set(tokens))
        if new:
            ids = self.processor.EncodeAsIds([as_chars(t.encode("utf-8", "surrogatepass")) for t in new])
            known.update(zip(new, ids))
            self.sizes.update(zip(new, map(len, ids)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        tokens = self.cut(text)
        known = self.known
        try:
            return [i for t in tokens for i in known[t]]
        except KeyError:
            self.learn(tokens)
            known = self.known
            return [i for t in tokens for i in known[t]]

    def count(self, text: str | None) -> int:
        """Number of ids; no list of them is made."""
        if not text:
            return 0
        tokens = self.cut(text)
        try:
            return sum(map(self.sizes.__getitem__, tokens))
        except KeyError:
            self.learn(tokens)
            return sum(map(self.sizes.__getitem__, tokens))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.ranks[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def rank_file(name: str, folder: str | None = None) -> str:
    return str(Path(folder or tokenizer_dir()) / f"{name}.tiktoken")


def _ids_batches(path: str, key: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id and ids of every row of ``documents`` (columns doc_id, text; others are ignored). No shuffle."""
    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_ids_batches(rank_file(tokenizer, folder), pa.int64()), "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the xxhash64 of the text (copies share it) of every row; texts don't travel further."""
    path = rank_file(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = pa.array([enc.count(t) for t in batch.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("cluster"), n], ["doc_id", "source", "cluster", "n_tokens"])

    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("cluster"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, source string, cluster bigint, n_tokens int")
