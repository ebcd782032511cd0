"""Token ids as binary shards: every document is one zstandard frame under a dictionary that all shards share.

A shard is one file, written by one task for one range of ids:

    magic ``SLTK1``, sha256 of the dictionary (32 bytes), documents (u64), ids (u64)
    the frames, one after another
    the index: frame offsets (u64, one more than documents), document ids (i64), null flags (u8), ids per document (u64)
    length of the index (u64), magic ``SLTK1``

so a document is read by its index entry and one small frame. A frame holds the ids little-endian, 2 bytes each, or 4
behind a leading 0 byte when one is over 65,535. The dictionary lies beside the shards and is checked by its hash.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.store import kept, new_dir
from sparkloom.llm.words import chunks

MAGIC = b"SLTK1"
END_ID = 1
LEVEL = 3
#: The dictionary is trained on so many documents at most, the first by a hash of the id; of a longer one a window of so
#: many characters at a place drawn by the hash is taken. Their id arrays are cut into samples of so many ids.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_IDS, DICT_BYTES = 1000, 32_768, 1024, 112_640
#: zstandard trains on so many samples at least; where the table gives fewer, their ids themselves are the dictionary.
TRAIN_SAMPLES = 20
#: A shard holds about so many ids, or fewer where that gives less than spark.sql.shuffle.partitions shards.
SHARD_IDS = 1 << 26
#: Chunks whose ids a Python worker remembers.
MEMO = 1_500_000
#: Ends a chunk in a joined text; a chunk that has it is encoded alone.
_MARK = "\x01"
#: Fixed value: the split pattern of tokenizer files whose texts may be cut.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters up to blank or a closing mark, closing marks up to blank, or anything up to blank: the tokenizer never joins across these.
_CHUNK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \t\n\r.,;:!?]|\Z)|[.,;:!?]+(?=[ \t\n\r]|\Z)|[^ \t\n\r]+")


def cuttable(path: str) -> bool:
    """Whether the tokenizer file splits texts as _CHUNK takes for granted: white space goes, and letters, digits and marks never join across it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in normal.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    split = parts[0] if parts else {}
    return (
        kinds == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and (parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == (False, False)
        and not spec["model"].get("dropout")
    )


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer's file allows it, each different chunk of a text is encoded once and remembered; else texts go whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cuttable = Tokenizer.from_file(path), cuttable(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids, 2 bytes each (4 if the vocabulary is larger)."""
        cut = [None if not self.cuttable or any(s in t for s in self.special) else _CHUNK.findall(t) for t in texts]
        new = set().union(*(c for c in cut if c)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*(c for c in cut if c))
        self._learn(sorted(new))
        kind, memo = ("<u2" if self.small else "<u4"), self.memo
        whole = iter(self.tokenizer.encode_batch_fast([t for t, c in zip(texts, cut, strict=True) if c is None], add_special_tokens=False))
        return [np.array(next(whole).ids, kind).tobytes() if c is None else b"".join([memo[x] for x in c]) for c in cut]

    def _learn(self, new: list[str]) -> None:
        kind, size = ("<u2", 2) if self.small else ("<u4", 4)
        alone = new if self.mark is None else [x for x in new if _MARK in x]
        for x, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.memo[x] = np.array(e.ids, kind).tobytes()
        if self.mark is None:
            return
        new = [x for x in new if _MARK not in x]
        blocks = [new[k : k + 512] for k in range(0, len(new), 512)]
        joined = [f" {_MARK} ".join(b) + f" {_MARK}" for b in blocks]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, kind)
            ends = np.flatnonzero(ids == self.mark)
            data, at = ids.tobytes(), 0
            for x, end in zip(block, ends.tolist(), strict=True):
                self.memo[x] = data[at * size : end * size]
                at = end + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: bytes, small: bool, end_id: int) -> tuple[int, bytes]:
    """Number of ids with the end id, and their serialized form."""
    if small and end_id < 1 << 16:
        data = ids + struct.pack("<H", end_id)
        return len(data) // 2, data
    wide = np.append(np.frombuffer(ids, "<u2" if small else "<u4").astype("<u4"), np.uint32(end_id))
    return len(wide), (wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\0" + wide.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2").astype("<u4") if len(data) % 2 == 0 else np.frombuffer(data, "<u4", offset=1)


def train(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """The shared dictionary; never empty, but for an empty table.

    Trained on samples of serialized ids. Of few or tiny samples nothing can be trained: then the samples, one after another,
    are a dictionary of raw content.
    """
    h, spare = F.xxhash64(id_col), F.greatest(F.length(text_col) - TRAIN_CHARS, F.lit(0))
    at = (F.pmod(F.xxhash64(F.lit("window"), id_col), spare + 1) + 1).cast("int")
    rows = docs.select(h.alias("h"), F.col(text_col).substr(F.coalesce(at, F.lit(1)), F.lit(TRAIN_CHARS)).alias("t")).orderBy("h", "t").limit(TRAIN_ROWS)
    enc = encoder(tokenizer_path)
    whole = [pack(x, enc.small, end_id)[1] for x in enc.encode([r.t or "" for r in rows.toLocalIterator()])]
    samples = [x[k : k + 2 * TRAIN_IDS] for x in whole for k in range(0, len(x), 2 * TRAIN_IDS)]
    useful = [x for x in samples if len(x) > 16]
    size = min(DICT_BYTES, sum(map(len, useful)) // 20)
    if len(useful) < TRAIN_SAMPLES or size < 1024:
        return b"".join(samples)[-DICT_BYTES:]
    return zstandard.train_dictionary(size, useful, level=LEVEL, threads=0).as_bytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None  # raw content if it doesn't begin with the dictionary magic


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
          partitions: int | None = None) -> DataFrame:
    """Encodes every whole text and writes shards below ``path`` in ascending id order; returns one row per shard, in order.

    Null texts count as empty (one id, the end). Ids are integers; null ids come first, repeated ids stand side by side by
    length and a hash of their ids, and may span shards. An empty table writes no shard. Other columns aren't read. A shard
    appears under its final name only when whole, so a task that is run again does no harm. ``partitions`` shards are
    written, by default as many as the number of ids asks for.
    """
    spark = docs.sparkSession
    dictionary = train(docs, tokenizer_path, end_id, id_col, text_col)
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base)
    with fs.open_output_stream(f"{base}/dictionary") as f:
        f.write(dictionary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), None
        for batch in chunks(batches):
            packer = packer or zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=False)
            packed = [pack(x, enc.small, end_id) for x in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
            frames = pa.array([packer.compress(x) for _, x in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in packed], pa.int64()), frames], ["id", "n", "frame"])

    frames = kept(rows.mapInArrow(encode, "id long, n long, frame binary"), "frames")  # the range sort reads them twice
    n = partitions
    if not n:
        ids = frames.agg(F.sum("n")).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids // SHARD_IDS))
    # a hash after the id splits a hot id, null among them, over ranges
    ordered = frames.withColumn("h", F.xxhash64("frame")).repartitionByRange(n, "id", "n", "h").sortWithinPartitions("id", "n", "h", "frame")
    digest = hashlib.sha256(dictionary).digest()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = temp = out = tie = None
        ids, counts, sizes = [], [], []
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                first, tie = batch.column("id")[0].as_py(), batch.column("h")[0].as_py()
                name = f"{base}/shard-{'null' if first is None else f'{first + (1 << 63):020d}'}-{uuid.uuid4().hex}"
                temp, out = name + ".part", fs.open_output_stream(name + ".part")
                out.write(MAGIC + digest + struct.pack("<QQ", 0, 0))
            for frame in batch.column("frame"):
                data = frame.as_buffer()
                out.write(data)
                sizes.append(data.size)
            ids.append(batch.column("id"))
            counts.append(batch.column("n").to_numpy())
        if out is None:
            return
        key, count = pa.chunked_array(ids), np.concatenate(counts).astype("<u8")
        nulls = key.is_null().to_numpy().astype(np.uint8)
        index = np.cumsum([0, *sizes]).astype("<u8").tobytes() + key.fill_null(0).to_numpy().astype("<i8").tobytes() + nulls.tobytes() + count.tobytes()
        out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        out.close()
        fs.move(temp, name + ".sltk")
        low, high = key[0].as_py(), key[-1].as_py()
        yield pa.RecordBatch.from_pydict(
            {"path": [name + ".sltk"], "low": [low], "high": [high], "docs": [len(count)], "ids": [int(count.sum())], "n": [int(count[0])], "h": [tie]},
            schema=pa.schema([("path", pa.string()), *((x, pa.int64()) for x in ("low", "high", "docs", "ids", "n", "h"))]),
        )

    shards = ordered.mapInArrow(shard, "path string, low long, high long, docs long, ids long, n long, h long")
    found = sorted(shards.collect(), key=lambda r: (r.low is not None, r.low or 0, r.n, r.h))  # one row per shard
    starts = accumulate((r.ids for r in found), initial=0)
    schema = T.StructType([T.StructField(x, T.StringType() if x == "path" else T.LongType()) for x in ("path", "low", "high", "docs", "ids", "start")])
    return spark.createDataFrame([(r.path, r.low, r.high, r.docs, r.ids, s) for r, s in zip(found, starts, strict=False)], schema)


class Shard:
    """A shard opened for reading: ``shard[k]`` reads one document's ids, by its index entry alone."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if bytes(self.file.read_at(37, 0)) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a shard of this dictionary")
        tail = bytes(self.file.read_at(13, size - 13))
        if tail[8:] != MAGIC:
            raise ValueError(f"{path}: cut short")
        length = struct.unpack("<Q", tail[:8])[0]
        index, n = bytes(self.file.read_at(length, size - 13 - length)), (length - 8) // 25
        self.at = np.frombuffer(index, "<u8", n + 1).astype(np.int64) + 53
        self.ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
        self.nulls = np.frombuffer(index, np.uint8, n, 16 * n + 8)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n + 8).astype(np.int64)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return unpack(self.unpacker.decompress(bytes(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))))


def read(shards: DataFrame, path: str, *, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """The documents of the shards that ``write`` returned: id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if asked."""
    fields = [(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int64()))] if with_ids else fields)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base}/dictionary") as f:
                    shard = Shard(fs, row["path"], f.read())
                starts = row["start"] + np.cumsum(shard.counts) - shard.counts
                for at in range(0, len(shard), 1000):
                    span = range(at, min(at + 1000, len(shard)))
                    ids = [shard[k] for k in span]
                    if any(len(x) != shard.counts[k] for x, k in zip(ids, span, strict=True)):
                        raise ValueError(f"{row['path']}: a document has another length than its index says")
                    columns = [pa.array(shard.ids[at : span.stop], pa.int64(), mask=shard.nulls[at : span.stop].astype(bool)), pa.array(starts[at : span.stop]),
                               pa.array(shard.counts[at : span.stop]), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), schema=schema)

    out = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = shards.count()
    return (shards.repartition(max(1, n)) if n else shards).mapInArrow(load, out)


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the shards of docs into a new shared folder and reads them back."""
    path = new_dir(docs.sparkSession, "tokens")
    return read(write(docs, path, tokenizer_path, **options), path, id_col=options.get("id_col", "doc_id"))
