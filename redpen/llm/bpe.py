"""Byte-level BPE encoding and decoding through a sentencepiece model built from ranks.

The rank file is turned into a serialised sentencepiece BPE model: every
token's bytes become code points, its score is its negative rank, and
normalisation is the identity. Merging the best-scored neighbouring pair is
then the same as merging the lowest rank. Text is cut into pre-tokens first,
each is encoded by itself, and ids decode by the inverse mapping.

Defined cases: null text is empty text; empty text has no ids and decodes to
no bytes; repeated rows repeat; other columns are not read; texts and
pre-tokens may have any length.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.tables import map_slices

#: Code points of the 256 byte values: letters only, no white space or control characters.
BYTE_BASE = 0x100
#: Pre-tokens remembered per task; the table starts afresh when it is full.
REMEMBERED = 100_000
#: Characters of text encoded together, and put into one output batch.
SLICE_CHARACTERS = 500_000

_TO_CHARACTERS = {b: chr(BYTE_BASE + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def characters(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHARACTERS)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece ids are the ranks, the unknown piece comes last.

    Ranks must run from 0 without gaps and include all single bytes.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    pieces = [
        _field(1, _field(1, characters(token).encode()) + _field(2, float(-rank)))
        for token, rank in sorted(ranks.items(), key=lambda item: item[1])
    ]
    unknown = _field(1, _field(1, b"<unk>") + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(ranks))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Ids of texts; remembers the ids of short pre-tokens.

    The model's call has a fixed cost, so the unknown pre-tokens of many texts
    go into one call. Known ids lie end to end in one array.
    """

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of ids of each text."""
        found = [self.find(text) for text in texts]
        # Dictionary encoding hashes each pre-token once; Python meets only the distinct ones.
        coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        missing = [word for word in words if word not in self.known]
        if missing:
            self._learn(missing)
        known = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = known[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.ends[at + 1] - self.ends[at]
        after = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.ends[at] - after[:-1], lengths) + np.arange(after[-1])]
        stops = np.cumsum([0, *map(len, found)])
        return ids, np.diff(after[stops])

    def _learn(self, words: list[str]) -> None:
        lists = self._encode(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])

    def _encode(self, words: list[str]) -> list[list[int]]:
        """A pre-token that is a token keeps its id, as the rank rule has it; the others are merged."""
        raw = [word.encode() for word in words]
        whole = [self.ranks.get(token) for token in raw]
        rest = [characters(token) for token, rank in zip(raw, whole) if rank is None]
        merged = iter(self.pieces.encode(rest, out_type=int, num_threads=1) if rest else ())
        return [next(merged) if rank is None else [rank] for rank in whole]


def _share_encoder(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> Callable[[], Encoder]:
    """Gives the encoder inside a task."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((ranks, sentencepiece_model(ranks), {}))  # fixed size: the vocabulary

    def encoder() -> Encoder:
        # A reused worker keeps its copy of the broadcast, and with it what its encoder has learned.
        ranks, model, own = shared.value
        if pattern not in own:
            own[pattern] = Encoder(ranks, model, pattern)
        return own[pattern]

    return encoder


def _encoded(encoder: Encoder, keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Keys and ids, by slices of at least ``SLICE_CHARACTERS`` characters."""
    start, held, size = 0, [], 0
    for row, value in enumerate(texts, 1):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= SLICE_CHARACTERS or row == len(texts):
            ids, counts = encoder.ids(held)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield keys.slice(start, row - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            start, held, size = row, [], 0


def _decoded(table: list[bytes], lists: pa.ListArray) -> list[bytes]:
    piece = table.__getitem__
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), [0]
    for one in pc.list_value_length(lists).fill_null(0).to_pylist():
        offsets.append(offsets[-1] + one)
    return [b"".join(map(piece, flat[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]


def _by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    return [token for token, _ in sorted(ranks.items(), key=lambda item: item[1])]


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids array<int>`` of every row's whole text. Narrow: no shuffle."""
    shared = _share_encoder(docs, read_ranks(ranks_path), pattern)

    def make():
        encoder = shared()
        return lambda keys, texts: ({key: k, "ids": ids} for k, ids in _encoded(encoder, keys, texts))

    kind = docs.schema[key].dataType.simpleString()
    return map_slices(docs, [key, text], make, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, the ids and ``decoded binary``: the ids' bytes, joined. Null ids decode to no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(_by_rank(read_ranks(ranks_path)))

    def make():
        return lambda keys, lists: [{key: keys, "ids": lists, "decoded": _decoded(shared.value, lists)}]

    kind = tokens.schema[key].dataType.simpleString()
    renamed = tokens.withColumnRenamed(ids, "ids")
    return map_slices(renamed, [key, "ids"], make, f"`{key}` {kind}, ids array<int>, decoded binary", rows=128)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass: a task holds one Python process, and ids do not travel between two."""
    ranks = read_ranks(ranks_path)
    shared = _share_encoder(docs, ranks, pattern)
    table = docs.sparkSession.sparkContext.broadcast(_by_rank(ranks))

    def make():
        encoder = shared()

        def run(keys, texts):
            for k, ids in _encoded(encoder, keys, texts):
                yield {key: k, "ids": ids, "decoded": _decoded(table.value, ids)}

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_slices(docs, [key, text], make, f"`{key}` {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, hash of the ids in decimal, hash of the decoded bytes."""
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
