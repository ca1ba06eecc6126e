"""Token ids of documents in binary shards, with a minimal perfect hash from keys to their places.

``write`` encodes whole texts, appends an end id to each and writes the ids of all documents, in
ascending order of their keys, as raw little-endian integers (two bytes an id where the vocabulary
allows, else four) into shards of a bounded size. A shard ends with the number of ids of each of its
documents. ``index`` writes one perfect hash for each bucket of keys, whose slots hold a 32-bit
fingerprint of the key and where its documents start; ``read`` takes a DataFrame of keys and
looks each up with one probe a level and one read. The manifest holds, for each shard, how
many documents and ids lie before it.

Cases: null and empty texts have the end id alone; a null key is a key like others and comes first;
documents that share a key are all written, in an order fixed by their texts, and are all read back;
a very long text fills a longer shard; keys that were not written give no rows (an absent key
passes its fingerprint once in 2^32); an empty table has no shard, no bucket and gives no rows;
other columns are ignored. Two keys whose 128 bits of hash agree would be one (about n^2 / 2^129).
A task that runs again writes the same files under the same names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import slices
from .files import Writing, place, read_file, write_file
from .perfect_hash import PerfectHash
from .scratch import _folder, shared_dir, stored

VOCABULARY = "word_bpe_49k.json"
END = 1
#: A shard is closed once it holds so many bytes of ids or so many documents.
SHARD_BYTES, SHARD_DOCUMENTS = 64 << 20, 1 << 20
#: Runs of keys in one bucket of the index, on average.
BUCKET_KEYS = 1 << 18
#: Distinct pre-tokens that a worker remembers, and the longest one in characters.
REMEMBERED, LONGEST = 1_000_000, 64
#: Texts of characters that normalisation keeps and that lower-case one by one, so that pre-tokens can be cut here.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e\\xa0\\xa1\\xab\\xbb\\xbf-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u20ac]*").fullmatch
# The pre-tokens of the vocabulary's own pattern, for such texts.
_PRETOKENS = re.compile(r"[a-zß-öø-ſ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ſ]+").findall
#: Words between ASCII white space, past which the tokenizer never looks.
_WORDS = re.compile(r"[^ \t-\r]+").findall
_MAGIC = b"DLTOKEN1"
_SLOT = np.dtype([("mark", "<u4"), ("more", "<u4"), ("docs", "<u8"), ("shard", "<u8"), ("first", "<u8"), ("offset", "<u8"), ("tokens", "<u8")])
_U = np.uint64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and encodes each pre-token alone, with a mark on
    the last piece of each. Pre-tokens, and words with characters whose form depends on others, are encoded
    once each, many in one call, and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, bounds = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                self.known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *bounds], bounds, strict=False))
            else:
                self.known.update((w, self._alone(w)) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as integers of ``kind``."""
        cut = [_PRETOKENS(t.lower()) if _PLAIN(t) and "<|" not in t else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*(c for c in cut if c is not None)).difference(self.known)
        self._learn(list(new))
        ids = self.known.__getitem__
        out = [b"".join(map(ids, c)) if c is not None else self._by_words(t) for t, c in zip(texts, cut, strict=True)]
        for long in [w for w in new if len(w) > LONGEST]:
            del self.known[long]
        return out

    def _by_words(self, text: str) -> bytes:
        if len(self.words) > REMEMBERED // 4:
            self.words.clear()
        out = []
        for w in _WORDS(text):
            if w not in self.words:
                self.words[w] = self._alone(w)
            out.append(self.words[w])
        return b"".join(out)


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


class _Shard:
    """One shard as it grows, and the runs of equal keys in it."""

    def __init__(self, folder: str, number: int, width: int):
        self.out, self.number, self.width = Writing(f"{folder}/shards/{number}.ids"), number, width
        self.lengths: list[int] = []
        self.size, self.runs = 0, []

    def add(self, key, ids: bytes) -> None:
        if self.runs and self.runs[-1][0] == key:
            last = self.runs[-1]
            last[2], last[4] = last[2] + 1, last[4] + len(ids) // self.width
        else:
            self.runs.append([key, len(self.lengths), 1, self.size, len(ids) // self.width])
        self.out.write(ids)
        self.lengths.append(len(ids) // self.width)
        self.size += len(ids)

    def close(self) -> list[list]:
        self.out.write(np.asarray(self.lengths, "<u8").tobytes() + np.asarray([len(self.lengths), self.size, self.width], "<u8").tobytes() + _MAGIC)
        self.out.close()
        return self.runs


def _hashes(key: str) -> list[Column]:
    """Two 64-bit hashes of a key; null is a key of its own."""
    return [F.xxhash64(F.lit(n), F.isnull(key), F.col(key)).alias(f"h{n}") for n in (1, 2)]


class TokenFiles:
    """A written folder; ``read`` gives ids by key."""

    def __init__(self, folder: str):
        self.folder = folder
        self.manifest = json.loads(read_file(f"{folder}/manifest.json"))

    def _found(self, keys: DataFrame, key: str) -> DataFrame:
        """Where the documents of each key lie: a row for each shard that holds some."""
        folder, buckets = self.folder, self.manifest["buckets"]
        kind = keys.schema[key].dataType.simpleString()
        named = keys.select(F.col(key).alias("key")).distinct().select("key", *_hashes("key"))
        dealt = named.withColumn("bucket", F.pmod("h1", F.lit(max(buckets, 1)))).repartition("bucket").sortWithinPartitions("bucket")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, index = None, None
            for batch in batches if buckets else ():
                own, h1, h2 = batch.column(3).to_numpy(), _unsigned(batch.column(1)), _unsigned(batch.column(2))
                for bucket in np.unique(own):
                    if bucket != at:
                        at, index = bucket, Bucket.load(folder, int(bucket))
                    rows = np.flatnonzero(own == bucket)
                    piece = 0
                    while len(rows):
                        slot, good = index.find(h1[rows], h2[rows], piece)
                        rows, slot = rows[good], slot[good]
                        if len(rows):
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(slot[n].astype(np.int64)) for n in ("shard", "first", "docs", "offset", "tokens"))], ["key", "shard", "first", "docs", "offset", "tokens"])
                        rows, piece = rows[slot["more"] > 0], piece + 1

        return dealt.mapInArrow(look, f"key {kind}, shard long, first long, docs long, offset long, tokens long")

    def read(self, keys: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
        """A row for each document whose key is in ``keys``: the key, ``start`` (ids of all documents before it),
        ``n_tokens``, ``ids_crc32`` (of the ids as 32-bit integers) and, if asked for, the ids."""
        folder, width, starts = self.folder, self.manifest["width"], {s["shard"]: s["start"] for s in self.manifest["shards"]}
        kind = keys.schema[key].dataType.simpleString()
        dealt = self._found(keys, key).repartition("shard").sortWithinPartitions("shard", "offset")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, file, keep = None, None, starts
            for batch in batches:
                took, rows, held = [], [], 0
                cols = [c.to_pylist() for c in batch.columns[1:]]
                for n, (shard, first, docs, offset, tokens) in enumerate(zip(*cols, strict=True)):
                    if shard != at:
                        at, file = shard, ShardFile(folder, shard)
                    lengths = [tokens] if docs == 1 else file.lengths(first, docs)
                    start = keep[shard] + offset // width
                    for length in lengths:
                        raw = file.ids(offset, length)
                        took.append(n)
                        rows.append((start, length, zlib.crc32(raw.astype("<u4").tobytes()), raw))
                        offset, start, held = offset + length * width, start + length, held + length
                        if held > 1 << 20 or len(rows) > 4096:
                            yield _rows(batch, took, rows, key, ids)
                            took, rows, held = [], [], 0
                if rows:
                    yield _rows(batch, took, rows, key, ids)

        return dealt.mapInArrow(fetch, f"{key} {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def _rows(batch: pa.RecordBatch, took: list[int], rows: list[tuple], key: str, ids: bool) -> pa.RecordBatch:
    cols = [batch.column(0).take(pa.array(took, pa.int64())), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))]
    if ids:
        at = np.concatenate([[0], np.cumsum([r[1] for r in rows])]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32))))
    return pa.RecordBatch.from_arrays(cols, [key, "start", "n_tokens", "ids_crc32", *["ids"] * ids])


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(_U)


class ShardFile:
    """Random reads of one shard."""

    def __init__(self, folder: str, shard: int):
        system, path = place(f"{folder}/shards/{shard}.ids")
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - 32)
        end = self.file.read(32)
        if end[24:] != _MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        self.docs, self.size, self.width = (int(x) for x in np.frombuffer(end[:24], "<u8"))

    def lengths(self, first: int, docs: int) -> list[int]:
        self.file.seek(self.size + 8 * first)
        return np.frombuffer(self.file.read(8 * docs), "<u8").astype(int).tolist()

    def ids(self, offset: int, tokens: int) -> np.ndarray:
        self.file.seek(offset)
        return np.frombuffer(self.file.read(tokens * self.width), f"<u{self.width}")


class Bucket:
    """One bucket of the index: a perfect hash and the slots that it leads to."""

    def __init__(self, table: PerfectHash, slots: np.ndarray):
        self.table, self.slots = table, slots

    @staticmethod
    def mark(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The stored fingerprint: bits of the second hash that no level uses alone."""
        return ((h2 >> _U(32)) ^ (h1 & _U(0xFFFFFFFF))).astype(np.uint32)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, runs: dict[str, np.ndarray]) -> Bucket:
        """Rows must be sorted by (h1, h2, shard); the pieces of one key in several shards are keys of their own."""
        n = len(h1)
        fresh = np.ones(n, bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        piece = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        own = h2 + piece.astype(_U)
        table = PerfectHash.build(h1, own)
        slots = np.zeros(n, _SLOT)
        at = table.slots(h1, own)
        slots["mark"][at] = cls.mark(h1, own)
        slots["more"][at] = np.append(~fresh[1:], False)
        for name, values in runs.items():
            slots[name][at] = values
        return cls(table, slots)

    def find(self, h1: np.ndarray, h2: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """The slots of keys and whether their fingerprints agree."""
        own = h2 + _U(piece)
        at = self.table.slots(h1, own)
        slot = self.slots[np.maximum(at, 0)] if len(self.slots) else np.zeros(len(h1), _SLOT)
        return slot, (at >= 0) & (slot["mark"] == self.mark(h1, own))

    def save(self, folder: str, number: int) -> None:
        head = np.asarray([len(self.table.sizes), len(self.slots), *self.table.sizes], "<u8")
        write_file(f"{folder}/index/{number}.mph", _MAGIC + head.tobytes() + self.table.words.tobytes() + self.slots.tobytes())

    @classmethod
    def load(cls, folder: str, number: int) -> Bucket:
        system, path = place(f"{folder}/index/{number}.mph")
        if system.get_file_info(path).type.name == "NotFound":
            return cls(PerfectHash([], np.zeros(0, "<u8")), np.zeros(0, _SLOT))
        raw = read_file(f"{folder}/index/{number}.mph")
        levels, n = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
        sizes = np.frombuffer(raw, "<u8", levels, 24).astype(int).tolist()
        at = 24 + 8 * levels
        return cls(PerfectHash(sizes, np.frombuffer(raw, "<u8", sum(sizes), at)), np.frombuffer(raw, _SLOT, n, at + 8 * sum(sizes)))


def write(docs: DataFrame, folder: str, key: str = "doc_id", path: str | None = None, end: int = END, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> TokenFiles:
    """Encode ``docs`` (``key``, text) and write shards, index and manifest into ``folder``.

    Rows are dealt by ranges of the key, so that the order of tasks is the order of keys; a key of very many
    documents is spread by their texts and rows."""
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()
    order = [F.col(key).asc_nulls_first(), F.col("_text").asc(), F.col("_row").asc()]
    dealt = docs.select(key, "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(*order).sortWithinPartitions(*order).select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path)
        last, base, shard = np.asarray([end], own.kind).tobytes(), TaskContext.get().partitionId() << 20, None
        count = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for k, ids in zip(part.column(0).to_pylist(), own.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    if shard is None:
                        shard, count = _Shard(folder, base + count, own.kind.itemsize), count + 1
                    shard.add(k, ids + last)
                    if shard.size >= shard_bytes or len(shard.lengths) >= SHARD_DOCUMENTS:
                        yield table(shard, shard.close())
                        shard = None
        if shard is not None:
            yield table(shard, shard.close())

    def table(shard: _Shard, runs: list[list]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = list(zip(*runs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(key_type)), pa.array([shard.number] * len(runs), pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array([shard.width] * len(runs), pa.int64())], ["key", "shard", "first", "docs", "offset", "tokens", "width"])

    key_type = docs.schema[key].dataType
    runs = stored(dealt.mapInArrow(run, f"key {kind}, shard long, first long, docs long, offset long, tokens long, width long"), "runs")
    shards, tokens, texts, keys, width = [], 0, 0, 0, 2
    # one row a shard, of which each holds shard_bytes of ids
    for s in sorted(runs.groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.count("*").alias("runs"), F.max("width").alias("width")).collect()):
        shards.append({"shard": s["shard"], "docs": s["docs"], "tokens": s["tokens"], "start": tokens, "first": texts})
        tokens, texts, keys, width = tokens + s["tokens"], texts + s["docs"], keys + s["runs"], s["width"]
    buckets = -(-keys // bucket_keys)
    index(runs, folder, buckets)
    write_file(f"{folder}/manifest.json", json.dumps({"width": width, "end": end, "buckets": buckets, "documents": texts, "tokens": tokens, "shards": shards}).encode())
    return TokenFiles(folder)


def index(runs: DataFrame, folder: str, buckets: int) -> None:
    """Write one perfect hash for each bucket of keys."""
    if not buckets:
        return
    dealt = runs.select(*_hashes("key"), "shard", "first", "docs", "offset", "tokens").withColumn("bucket", F.pmod("h1", F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "h1", "h2", "shard", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(7).to_numpy()
            for bucket in np.unique(own):
                at = np.flatnonzero(own == bucket)
                if held and held[0].column(7)[0].as_py() != bucket:
                    yield close(held)
                    held = []
                held.append(batch.slice(at[0], len(at)))
        if held:
            yield close(held)

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        bucket = whole.column(7)[0].as_py()
        runs_ = {n: whole.column(n).to_numpy().astype(np.uint64) for n in ("shard", "first", "docs", "offset", "tokens")}
        Bucket.build(_unsigned(whole.column(0)), _unsigned(whole.column(1)), runs_).save(folder, bucket)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([whole.num_rows], pa.int64())], ["bucket", "keys"])

    dealt.mapInArrow(run, "bucket long, keys long").write.format("noop").mode("overwrite").save()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, removed when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/docloom-ids-{uuid.uuid4().hex}"
    where, system = _folder(spark, folder)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return folder
