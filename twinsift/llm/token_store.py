"""Token ids on disk: one compressed frame per document, a shared dictionary and an offset index.

Format of a store, three Parquet tables below one folder, written by Spark alone so that any file
system will do:

``blocks``     ``shard``, ``block``, ``shard_start`` (tokens of the shard before it), ``first_doc``, ``last_doc``, ``dictionary_hash``, and for the
               documents of the block ``doc_ids``, ``n_tokens``, ``offsets`` (of each frame in
               ``payload``, one more than documents) and ``payload``, the frames one after the other.
``shards``     ``shard``, ``tokens_before``: tokens of all shards before it.
``dictionary`` one row: ``hash`` (sha256), ``content``, ``id_bytes``.

A frame is a zstandard frame over the little-endian ids of one document, compressed with the
dictionary, so one document is read by slicing one block. Shards follow the order of ``doc_id``, and
so do the documents inside; ``tokens_before`` plus the counts before a document give its start.

Null texts are empty ones, an empty text holds just the end id, rows with the same ``doc_id`` are kept
all and follow each other by text, null ids come first, and an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.encode import encoder, share_tokenizer
from twinsift.llm.session import give_back, hash_share, string

# A block is closed at this many tokens or documents.
BLOCK_TOKENS = 1 << 18
BLOCK_DOCS = 4_096
# The dictionary is trained on at most so many documents of at most so many characters.
SAMPLE_DOCS = 1_000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

_BLOCKS = (
    "shard int, block int, shard_start bigint, first_doc bigint, last_doc bigint, dictionary_hash string, "
    "doc_ids array<bigint>, n_tokens array<int>, offsets array<bigint>, payload binary"
)
_RECORDS = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


@dataclass(frozen=True)
class Dictionary:
    content: bytes
    id_bytes: int

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.content).hexdigest()

    @property
    def dtype(self) -> str:
        return f"<u{self.id_bytes}"

    def _zstd(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.content) if self.content else None

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._zstd())

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._zstd())


def train_dictionary(docs: DataFrame, tokenizer: Broadcast, end_id: int) -> Dictionary:
    """Train on the serialized ids of a bounded sample, picked by hash. Too little data gives an empty dictionary."""
    picked = docs.where(hash_share(F.col("doc_id"), SAMPLE_DOCS, docs.count()))
    sample = (
        picked.select(string("text").alias("text"))
        .where(F.length("text").between(1, SAMPLE_CHARS))
        .orderBy(F.xxhash64("text"), "text")
        .limit(SAMPLE_DOCS)
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        samples = []
        for batch in batches:
            for _, _, ids, bounds in encode.encode(batch.column(0), end_id):
                samples += [ids[a:b].astype(f"<u{width}").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        try:
            content = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            content = b""
        yield pa.RecordBatch.from_pydict({"content": [content], "id_bytes": pa.array([width], pa.int32())})

    row = sample.coalesce(1).mapInArrow(train, "content binary, id_bytes int").first()
    return Dictionary(bytes(row.content), row.id_bytes)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode ``docs(doc_id, text)`` in ascending order of ``doc_id`` and write a store to ``path``."""
    spark = docs.sparkSession
    tokenizer = share_tokenizer(spark, tokenizer_path)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), string("text").alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id)
    spark.createDataFrame(
        [(dictionary.hash, dictionary.content, dictionary.id_bytes)], "hash string, content binary, id_bytes int"
    ).write.parquet(f"{path}/dictionary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        compressor = dictionary.compressor()
        shard = TaskContext.get().partitionId()
        block = _Block(shard, dictionary.hash)
        for batch in batches:
            ids_of = batch.column(0)
            for first, last, ids, bounds in encode.encode(batch.column(1), end_id):
                ids = ids.astype(dictionary.dtype)
                for k in range(last - first):
                    part = ids[bounds[k] : bounds[k + 1]]
                    block.add(ids_of[first + k].as_py(), len(part), compressor.compress(part.tobytes()))
                    if block.full():
                        yield block.close()
        if block.doc_ids:
            yield block.close()
        give_back()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, _BLOCKS).write.parquet(f"{path}/blocks")

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    tokens = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda total, n: total + n)
    per_shard = blocks.groupBy("shard").agg(F.sum(tokens).alias("tokens"))
    # One row per shard: as many as the shuffle is wide, however large the data.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before")).write.parquet(
        f"{path}/shards"
    )


class _Block:
    def __init__(self, shard: int, dictionary_hash: str):
        self.shard, self.dictionary_hash, self.number, self.before = shard, dictionary_hash, 0, 0
        self._start()

    def _start(self) -> None:
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[bytes] = []
        self.tokens = 0

    def add(self, doc_id: int | None, count: int, frame: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(count)
        self.frames.append(frame)
        self.tokens += count

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.doc_ids) >= BLOCK_DOCS

    def close(self) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in self.frames])]).astype(np.int64)
        known = [d for d in self.doc_ids if d is not None]
        columns = [
            pa.array([self.shard], pa.int32()),
            pa.array([self.number], pa.int32()),
            pa.array([self.before], pa.int64()),
            pa.array([min(known, default=None)], pa.int64()),
            pa.array([max(known, default=None)], pa.int64()),
            pa.array([self.dictionary_hash], pa.string()),
            pa.array([self.doc_ids], pa.list_(pa.int64())),
            pa.array([self.counts], pa.list_(pa.int32())),
            pa.array([offsets.tolist()], pa.list_(pa.int64())),
            pa.array([b"".join(self.frames)], pa.binary()),
        ]
        self.number += 1
        self.before += self.tokens
        self._start()
        names = [part.split()[0] for part in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names=names)


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = Dictionary(bytes(row.content), row.id_bytes)
    if dictionary.hash != row.hash:
        raise ValueError(f"the dictionary below {path} does not have the hash it was written with")
    return dictionary


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids`` as 32-bit integers.

    ``doc_ids`` (a few) picks single documents: the blocks' bounds prune the scan and only the frames
    of those documents are decompressed.
    """
    dictionary = read_dictionary(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is not None:
        within = [F.lit(d).between(F.col("first_doc"), F.col("last_doc")) for d in doc_ids]
        condition = F.lit(False)
        for one in within:
            condition = condition | one
        blocks = blocks.where(condition)
    wanted = None if doc_ids is None else set(doc_ids)
    names = [part.split()[0] for part in _RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = dictionary.decompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                get = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                if get["dictionary_hash"].as_py() != dictionary.hash:
                    raise ValueError("a block was written with another dictionary")
                docs, offsets = get["doc_ids"].as_py(), get["offsets"].as_py()
                starts = get["shard_start"].as_py() + np.cumsum([0, *get["n_tokens"].as_py()])
                payload = memoryview(get["payload"].as_buffer())
                out: list[tuple] = []
                for k, doc_id in enumerate(docs):
                    if wanted is None or doc_id in wanted:
                        raw = decompressor.decompress(payload[offsets[k] : offsets[k + 1]])
                        ids = np.frombuffer(raw, dictionary.dtype).astype("<u4").tobytes()
                        kept = ids if with_ids else None
                        out.append((doc_id, get["shard"].as_py(), int(starts[k]), len(ids) // 4, zlib.crc32(ids), kept))
                columns = zip(*out) if out else ((),) * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    records = blocks.mapInArrow(read, _RECORDS)
    shards = spark.read.parquet(f"{path}/shards")
    start = F.col("tokens_before") + F.col("shard_start")
    kept = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return records.join(shards, "shard").select("doc_id", start.alias("start"), *kept)
