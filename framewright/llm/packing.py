"""Best-fit decreasing packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.llm.common import cut, slices, small_batches, starts_of, tidied
from framewright.llm.tokens import SLICE_BYTES, WordEncoder, crc32s, default_path

CAPACITY = 2048
END = 0
#: Pieces that one task packs, about.
GROUP_PIECES = 16_000
#: Sequences less full than this are opened again and packed with those of other groups.
FULL = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity: a segment tree whose leaf c tells whether a bin has room for just c more."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(self.base)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = room + self.base
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room that holds length; it is no longer open."""
        node, any_ = length + self.base, self.any
        while not any_[node]:
            while node & 1:  # a right child: the next subtree hangs higher
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node *= 2
            if not any_[node]:
                node += 1
        room = node - self.base
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            while node and (node >= self.base or not (any_[2 * node] or any_[2 * node + 1])):
                any_[node] = 0
                node >>= 1
        return room, bin_


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken from the longest to the shortest, ties in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, tree = 0, OpenBins(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room, bin_ = tree.take_tightest(length) or (capacity, opened)
        opened += bin_ == opened
        bins[i], offsets[i] = bin_, capacity - room
        if room > length:
            tree.put(room - length, bin_)
    return bins, offsets


def pieces(documents: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row of PIECES for each stretch of at most capacity ids of each document, the id end included."""
    path = path or default_path()
    small_batches(documents.sparkSession)

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        for batch in batches:
            for first, texts in slices(batch.column("text"), SLICE_BYTES):
                ids, counts = encode.encode_ended(texts, end)
                n = -(-counts // capacity)
                document = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(n.sum()) - np.repeat(starts_of(n), n)
                start = piece * capacity
                length = np.minimum(counts[document] - start, capacity)
                crc = crc32s(ids, starts_of(counts)[document] + start, length)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)).take(pa.array(document)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc)})

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(tokenized), PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """found, with sequence_id and offset of each piece.

    The pieces are dealt to groups by a hash that also differs for repeated rows, each packed by itself; the sequences of a group that stay less full than FULL
    are opened and packed once more in groups of their pieces. Sequence ids are unique, not consecutive.
    """

    def packed(turn: int):
        def group(table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = table.column("length").to_numpy()
            bins, offsets = best_fit(lengths, capacity)
            filled = np.bincount(bins, weights=lengths)
            number = (table.column("_g").to_numpy() << 32) * 2 + (turn << 32) + bins
            return table.drop_columns(["_g"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("_full", pa.array(filled[bins] >= FULL * capacity))

        return group

    def dealt(df: DataFrame) -> DataFrame:
        groups = max(1, round(df.count() / group_pieces))
        return df.withColumn("_g", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, monotonically_increasing_id()), {groups}L)")).groupBy("_g")

    columns = f"{PIECES}, sequence_id long, offset long, _full boolean"
    first = cut(dealt(found).applyInArrow(packed(0), columns), "packed")
    again = first.where("not _full").select(*found.columns)
    second = dealt(again).applyInArrow(packed(1), columns)
    return first.where("_full").unionByName(second).drop("_full")


def packed_documents(documents: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Null and empty text: one piece of one id. Only documents of more than capacity ids are cut. Null ids and repeated rows
    are packed like others. An empty table gives none. Other columns are not read.
    """
    return pack(cut(pieces(documents, text, key, path, capacity), "pieces"), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """packed_documents() of all documents; its docstring tells what odd rows give."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
