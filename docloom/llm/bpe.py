"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte is mapped to one printable character; a piece is the mapped string of its bytes and
scores minus its rank; normalisation is the identity. Texts are cut by the tokenizer's pattern,
each match is encoded alone (a match that is a piece itself is that piece) and ids decode by the
inverse mapping.

Cases: null and empty texts have no ids and the digests of nothing; repeated rows are kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct matches that one worker remembers before it starts anew.
REMEMBERED = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """One printable character a byte: printable Latin-1 bytes stand for themselves, the others
    follow from U+0100 on."""
    keeps = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in keeps}
    for b in range(256):
        out.setdefault(b, chr(256 + b - sum(k < b for k in keeps)))
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """A protocol-buffer field: int as varint, float as 32 bits, bytes and str with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece i has rank i, the unknown piece comes last."""
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.get)
    assert [ranks[t] for t in by_rank] == list(range(len(by_rank))), "ranks must be 0..n-1"
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t)) + _field(2, float(-r))) for r, t in enumerate(by_rank)]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, 2**32 - 1) + _field(42, 2**32 - 1) + _field(43, 2**32 - 1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.pieces = ["".join(self.map[b] for b in t) for t in sorted(self.ranks, key=self.ranks.get)]
        self.inverse = {ord(c): chr(b) for b, c in self.map.items()}
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> None:
        new = [m for m in dict.fromkeys(matches) if m not in self.known]
        raw = [m.encode() for m in new]
        hard = [i for i, r in enumerate(raw) if r not in self.ranks]
        found = self.sp.encode([raw[i].decode("latin-1").translate(self.map) for i in hard], out_type=int, num_threads=1) if hard else []
        ids = {i: x for i, x in zip(hard, found, strict=True)}
        for i, m in enumerate(new):
            self.known[m] = struct.pack(f"<{len(ids[i])}I", *ids[i]) if i in ids else struct.pack("<I", self.ranks[raw[i]])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        matches = self.find(text)
        try:
            return b"".join(map(self.known.__getitem__, matches))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._learn(matches)
            return b"".join(map(self.known.__getitem__, matches))

    def counts(self, matches: list[str]) -> list[int]:
        """Tokens of each match."""
        try:
            return [len(x) >> 2 for x in map(self.known.__getitem__, matches)]
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._learn(matches)
            return [len(self.known[m]) >> 2 for m in matches]

    def decode(self, ids: bytes) -> bytes:
        """The pieces of ``ids``, each character mapped back to its byte."""
        pieces = "".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return pieces.translate(self.inverse).encode("latin-1")


_loaded: dict[str, ByteBPE] = {}


def coder(path: str) -> ByteBPE:
    """One coder a worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    path = path or vocabulary_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = [own.encode(t) for t in part.column(1).to_pylist()]
                cols = [
                    part.column(0),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(own.decode(c)).hexdigest() for c in coded]),
                ]
                if ids:
                    at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
