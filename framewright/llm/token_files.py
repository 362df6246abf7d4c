"""Token ids in fixed-width bit-packed files.

The files are Parquet rows, so that any store Spark writes to holds them and a lost task leaves nothing behind. A row is a
block: its shard, its number, the ids before it in the shard (`start`), the bits an id takes, the documents it holds with
their lengths, and the packed ids, most significant bit first. Documents are never split, so a block is read by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from framewright.llm.common import slices, small_batches, starts_of, tidied
from framewright.llm.tokens import SLICE_BYTES, WordEncoder, crc32s, default_path

END = 1
#: A block is closed at the first document that brings it to this many ids.
BLOCK_IDS = 1 << 16
BLOCKS = "shard int, block int, start long, n_ids long, bits int, doc_ids array<long>, lengths array<long>, ids binary"


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each, most significant bit first, the last byte filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes()


def unpack_ids(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """n ids from number first on, without reading those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    low = first * bits // 8
    flags = np.unpackbits(np.frombuffer(data, np.uint8)[low : -(-(first + n) * bits // 8)])[first * bits - 8 * low :][: n * bits]
    return flags.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def write(documents: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in the order of key, to folder.

    Shards hold ascending ranges of key; null keys come first, equal keys are ordered by a hash of their text;
    rows that repeat altogether can be in several shards.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        bits = max(1, (max(encode.vocabulary, end + 1) - 1).bit_length())
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def closed(keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            row = {"shard": [shard], "block": [block], "start": [start], "n_ids": [len(ids)], "bits": [bits], "doc_ids": [keys.to_pylist()], "lengths": [lengths.tolist()], "ids": [pack_ids(ids, bits)]}
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

        def joined() -> tuple[pa.Array, np.ndarray, np.ndarray]:
            return pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

        for batch in batches:
            for first, texts in slices(batch.column("text"), SLICE_BYTES):
                ids, counts = encode.encode_ended(texts, end)
                held.append((batch.column("key").slice(first, len(texts)), counts, ids))
                keys, lengths, ids = joined()
                ends = np.cumsum(lengths)
                done = at = 0
                while ends[-1] - at >= block_ids:
                    last = int(np.searchsorted(ends, at + block_ids)) + 1
                    yield closed(keys[done:last], lengths[done:last], ids[at : ends[last - 1]])
                    block, start, done, at = block + 1, start + int(ends[last - 1] - at), last, int(ends[last - 1])
                    if done == len(lengths):
                        break
                held = [(keys[done:], lengths[done:], ids[at:].copy())] if done < len(lengths) else []
        if held:
            yield closed(*joined())

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows.repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "text").mapInArrow(tidied(blocks), BLOCKS).write.parquet(folder)


def read_digests(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, start being the ids of all documents before it."""
    files = spark.read.schema(BLOCKS).parquet(folder)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard: bounded by the number of partitions that were written
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                lengths = row["lengths"].values.to_numpy()
                ids = unpack_ids(row["ids"].as_py(), row["bits"].as_py(), 0, row["n_ids"].as_py())
                at = starts_of(lengths)
                yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"].values, "start": pa.array(row["start"].as_py() + at), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc32s(ids, at, lengths))})

    placed = files.join(F.broadcast(before), "shard").select((F.col("start") + F.col("before")).alias("start"), "n_ids", "bits", "doc_ids", "lengths", "ids")
    return placed.mapInArrow(tidied(digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark, folder: str, first: int, n: int) -> np.ndarray:
    """n ids from number first on, counted over all documents in the files' order: the shards' sizes tell where they are, only the
    blocks that hold them are read, and only their bytes in these are unpacked. What comes to the driver are these ids alone."""
    files = spark.read.schema(BLOCKS).parquet(folder)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).sort("shard").collect()  # a row for each partition written
    parts, before = [], 0
    for shard in sizes:
        low, high = max(0, first - before), min(shard.n, first + n - before)
        if low < high:
            held = files.where((F.col("shard") == shard.shard) & (F.col("start") < high) & (F.col("start") + F.col("n_ids") > low)).select("start", "n_ids", "bits", "ids").sort("start")
            for r in held.toLocalIterator():
                at, end = max(0, low - r.start), min(r.n_ids, high - r.start)
                parts.append(unpack_ids(bytes(r.ids), r.bits, at, end - at))
        before += shard.n
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_document(spark, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document of that id, the end id included, from the blocks that hold it."""
    held = spark.read.schema(BLOCKS).parquet(folder).where(F.array_contains("doc_ids", doc_id)).select("bits", "doc_ids", "lengths", "ids")
    found = []
    for r in held.toLocalIterator():
        lengths = np.array(r.lengths, np.int64)
        found += [unpack_ids(bytes(r.ids), r.bits, int(lengths[:i].sum()), int(lengths[i])) for i, d in enumerate(r.doc_ids) if d == doc_id]
    return found


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone; repeated rows are written each time; an empty table gives no rows."""
    import uuid

    from framewright.llm.common import shared_folder

    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_digests(spark, folder)
