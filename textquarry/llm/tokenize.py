"""Encoding of a corpus with a byte-level BPE vocabulary (problem 5).

The vocabulary file of a public tokenizer (base64 token and rank on each line) is
serialised directly as a sentencepiece BPE model: every token is written with
its bytes mapped one to one to printable characters, its score is the negative
rank, and the normaliser is the identity. Sentencepiece then merges, within one
pre-token, the adjacent pair whose union has the lowest rank, which is the
merge order of the byte-level BPE, and a piece's index is its rank. Pre-tokens
are cut by the vocabulary's published pattern; decoding maps pieces back to bytes.

Defined cases: null and empty texts have no ids; strings that look like special
tokens are plain text; ids depend on the text alone.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.storage import spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# --- Fixed values: how byte-level BPE cuts text before merging --------------------
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept in a worker's memory of encoded pre-tokens before it starts afresh.
MEMORY_ENTRIES = 200_000
#: Longer pre-tokens are encoded each time.
MEMORY_CHARS = 64


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


LETTERS = byte_letters()
#: For ``str.translate`` of a Latin-1 reading of the bytes.
TO_LETTERS = dict(enumerate(LETTERS))
TO_BYTES = {ord(c): b for b, c in enumerate(LETTERS)}


def spell(data: bytes) -> str:
    """Bytes as mapped characters."""
    return data.decode("latin-1").translate(TO_LETTERS)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    """A protobuf field: a length-delimited message or string, or a varint."""
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a ranked byte vocabulary; the unknown piece follows the last rank.

    Ranks must be dense from 0 and hold every single byte, so that nothing is ever unknown.
    """
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks are not dense")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no token")
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(by_rank):
        out += _field(1, _field(1, spell(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    # no dummy prefix, no removal of blanks, no escaping of blanks, identity map
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    out += _field(2, trainer) + _field(3, normaliser)
    return bytes(out)


@lru_cache(maxsize=4)
def model_bytes(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> bytes:
    return serialise_model(read_ranks(f"{directory}/{vocabulary}"))


class Encoder:
    """Encodes and decodes with a serialised model; remembers pre-tokens it has met."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PRETOKEN).findall
        self.memory: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = {p for pieces in cut for p in pieces if p not in self.memory}
        if len(self.memory) + len(fresh) > MEMORY_ENTRIES:
            self.memory.clear()
            fresh = {p for pieces in cut for p in pieces}
        order = list(fresh)
        ids = self.processor.encode([spell(p.encode("utf-8", "surrogatepass")) for p in order], num_threads=1) if order else []
        new = dict(zip(order, ids, strict=True))
        self.memory.update((p, x) for p, x in new.items() if len(p) <= MEMORY_CHARS)
        known = self.memory
        return [[i for p in pieces for i in (known.get(p) or new[p])] for pieces in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The inverse mapping: pieces to bytes to text."""
        letters = "".join(self.processor.id_to_piece(int(i)) for i in ids)
        return bytes(TO_BYTES[ord(c)] for c in letters).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """One encoder per worker process and model."""
    return Encoder(model)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (list of int) of each row; null and empty texts give an empty list.

    A narrow stage without shuffle. The model travels as a broadcast of fixed
    size (one vocabulary); only ``key`` and ``text`` are read.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model_bytes(directory, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        for batch in batches:
            ids = enc.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(key, text)).mapInArrow(run, schema)


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of each row and ``n_tokens``, the length of its ids."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model_bytes(directory, vocabulary))

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(shipped.value)
        for batch in texts:
            yield pd.Series([len(x) for x in enc.encode_batch(batch.astype(object).where(batch.notna(), None).tolist())], dtype="int64")

    return spread(docs.select(*keep, text)).select(*keep, count(F.col(text)).alias("n_tokens"))


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` decoded from ids; empty and null lists give the empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model_bytes(directory, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([encoded.schema[key], T.StructField("text", T.StringType())])
    return encoded.select(key, ids).mapInArrow(run, schema)
