"""First-fit decreasing packing of token ids by a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from framewright.llm.common import mix, runs_sum, slices, small_batches, starts_of, tidied
from framewright.llm.tokens import SLICE_BYTES, WordEncoder, crc32s, default_path

CAPACITY = 4096
END = 2
#: Documents, and bytes of text, that one group has about: a group is packed by one task.
GROUP_DOCUMENTS, GROUP_BYTES = 8_000, 32 << 20
#: Rooms of at most this share of a sequence stay empty rather than take a scrap of another document.
TOLERATED = 1 / 256
#: `ids` are little-endian unsigned integers of `id_bytes` bytes; `padded` is the length that the sequence takes in training.
SEQUENCES = "sequence_id long, length int, padded int, id_bytes int, ids binary, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>"
_PARTS = "doc_id long, doc_tokens long, start long, length long, id_bytes int, ids binary, deal long"


class FirstFit:
    """Bins in the order they were opened, with a tournament tree over their rooms: each node holds the larger room below it.

    Bins that aren't open yet take part with a whole sequence of room, so that the first bin that fits is always there.
    """

    def __init__(self, most_bins: int, capacity: int):
        self.base = 1 << max(1, (most_bins - 1).bit_length())
        self.room = [capacity] * (2 * self.base)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room for length, which is taken from it."""
        room, node = self.room, 1
        while node < self.base:
            node *= 2
            if room[node] < length:
                node += 1
        bin_, had = node - self.base, room[node]
        room[node] = had - length
        while node > 1:
            node >>= 1
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return bin_, had


def first_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken from the longest to the shortest, ties in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = FirstFit(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], had = tree.put(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def _unpadded(length: int, capacity: int) -> bool:
    return length == capacity or length & (length - 1) == 0


def laid_out(lengths: np.ndarray, capacity: int = CAPACITY, tolerated: float = TOLERATED) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, ids of it before, length).

    Items are packed by first-fit decreasing. Of the sequences that would be padded by more than the tolerated share, the least
    full ones are poured into the rooms of the fullest, cutting an item where a room ends; what is left in the last one is laid
    out in sequences whose lengths are powers of two, which take no padding.
    """
    bins, offsets = first_fit(lengths, capacity)
    order = np.lexsort((offsets, bins))
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(int(bins.max()) + 1 if len(bins) else 0)]
    for i in order.tolist():
        sequences[bins[i]].append((i, 0, int(lengths[i])))
    filled = np.bincount(bins, weights=lengths).astype(np.int64).tolist()
    wanting = [b for b, n in enumerate(filled) if not _unpadded(n, capacity) and capacity - n > tolerated * capacity]
    done = [s for b, s in enumerate(sequences) if b not in set(wanting)]
    wanting.sort(key=lambda b: (-filled[b], b))
    first, last = 0, len(wanting) - 1
    while first < last:
        into, source = sequences[wanting[first]], sequences[wanting[last]]
        room = capacity - filled[wanting[first]]
        while room and source:
            item, at, length = source.pop()
            taken = min(room, length)
            into.append((item, at, taken))
            if taken < length:
                source.append((item, at + taken, length - taken))
            room -= taken
            filled[wanting[last]] -= taken
        filled[wanting[first]] = capacity - room
        first += not room
        last -= not source
    if first == last:  # one is neither full nor empty
        rest, left = sequences[wanting[first]], filled[wanting[first]]
        while left:
            size = 1 << (left.bit_length() - 1) if left < capacity else capacity
            left, laid = left - size, []
            while size:
                item, at, length = rest.pop(0)
                taken = min(size, length)
                laid.append((item, at, taken))
                if taken < length:
                    rest.insert(0, (item, at + taken, length - taken))
                size -= taken
            done.append(laid)
        wanting.pop(first)
    return done + [sequences[b] for b in wanting if sequences[b]]


def packed_sequences(documents: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The sequences (SEQUENCES) that hold the ids of all documents, each with the id end after it.

    Documents are dealt to groups by chance (a hash of their place), and each group is packed by itself. A document of more than
    capacity ids gives whole sequences of its own, dealt to any group; what remains of it is packed with the rest. `padded` is capacity,
    or the length itself where that is a power of two. Null and empty text: the end id alone. Null ids and repeated rows are packed like
    others, an empty table gives none, other columns are not read. Sequence ids are unique, not consecutive.
    """
    path = path or default_path()
    small_batches(documents.sparkSession)
    size = documents.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    groups = max(1, math.ceil(size.n / GROUP_DOCUMENTS), math.ceil((size.bytes or 0) / GROUP_BYTES))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        kind = "<u2" if max(encode.vocabulary, end + 1) <= 1 << 16 else "<u4"
        rows = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, texts in slices(batch.column("text"), SLICE_BYTES):
                ids, counts = encode.encode_ended(texts, end)
                n = -(-counts // capacity)
                document = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(n.sum()) - np.repeat(starts_of(n), n)) * capacity
                length = np.minimum(counts[document] - start, capacity)
                data = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(starts_of(length), length.sum()) * int(kind[2])), pa.py_buffer(ids.astype(kind))])
                deal = mix((rows + np.arange(len(start))).astype(np.uint64)) >> np.uint64(1)
                rows += len(start)
                keys = batch.column("doc_id").slice(first, len(texts)).take(pa.array(document))
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, (counts[document], start, length)), pa.array(np.full(len(start), int(kind[2]), np.int32)), data.cast(pa.binary()), pa.array(deal.astype(np.int64))], _PARTS.replace(",", "").split()[::2])

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")]).combine_chunks()
        number, width = table.column("_g")[0].as_py(), table.column("id_bytes")[0].as_py()
        lengths = table.column("length").to_numpy()
        flat = np.frombuffer(b"".join(table.column("ids").to_pylist()), f"<u{width}")
        at, short = starts_of(lengths), np.flatnonzero(lengths < capacity)
        laid = [[(i, 0, capacity)] for i in np.flatnonzero(lengths == capacity).tolist()]
        laid += [[(int(short[i]), a, n) for i, a, n in s] for s in laid_out(lengths[short], capacity)]
        item, before, length = np.array([p for s in laid for p in s], np.int64).reshape(-1, 3).T
        held = np.array([len(s) for s in laid])
        sizes = runs_sum(length, held)
        ids = flat[np.repeat(at[item] + before - starts_of(length), length) + np.arange(length.sum())]
        whole = (sizes & (sizes - 1)) == 0
        ends = pa.array(np.append(0, np.cumsum(held)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, v) for v in (table.column("doc_id").combine_chunks().take(pa.array(item)), pa.array(table.column("start").to_numpy()[item] + before), pa.array(length), pa.array(table.column("doc_tokens").to_numpy()[item]))]
        data = pa.Array.from_buffers(pa.binary(), len(laid), [None, pa.py_buffer((np.append(0, np.cumsum(sizes)) * width).astype(np.int32)), pa.py_buffer(ids)])
        columns = [pa.array((number << 32) + np.arange(len(laid))), pa.array(sizes.astype(np.int32)), pa.array(np.where(whole, sizes, capacity).astype(np.int32)), pa.array(np.full(len(laid), width, np.int32)), data, *lists]
        return pa.Table.from_arrays(columns, ["sequence_id", "length", "padded", "id_bytes", "ids", "doc_ids", "starts", "lengths", "doc_tokens"])

    parts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(tokenized), _PARTS)
    return parts.withColumn("_g", F.pmod("deal", F.lit(groups))).groupBy("_g").applyInArrow(group, SEQUENCES)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece that lies in the sequences."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.compute.list_value_length(batch.column("lengths")).to_numpy(zero_copy_only=False)
            lengths = batch.column("lengths").flatten().to_numpy()
            flat = np.concatenate([np.frombuffer(b, f"<u{w}").astype("<u4") for b, w in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist(), strict=True)])
            at = starts_of(lengths)
            offset = at - np.repeat(at[starts_of(held)], held)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_ids").flatten(), "start": batch.column("starts").flatten(), "length": pa.array(lengths), "ids_crc32": pa.array(crc32s(flat, at, lengths)),
                "doc_tokens": batch.column("doc_tokens").flatten(), "sequence_id": pa.array(np.repeat(batch.column("sequence_id").to_numpy(), held)), "offset": pa.array(offset),
            })

    return sequences.mapInArrow(tidied(digests), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op12_first_fit_packing(spark, sf_dir: str) -> DataFrame:
    """packed_sequences() of all documents, a row for each piece; its docstring tells what odd rows give."""
    return pieces_of(packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")))
