"""What the text operators share: the shared scratch folder, word splitting in numpy, and 64-bit mixing."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text bytes that a Python task works on at a time; a longer single document is one slice of its own.
SLICE_BYTES = 3_000_000
#: Bytes of the batches that Spark hands to Python.
BATCH_BYTES = 6 << 20


_GAP = re.compile(rb"[\x20\x09-\x0D]")


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where that is unset, a folder of this process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of BATCH_BYTES at most, unless the session asks for smaller ones.

    By default a batch has 10,000 rows or 64 MB, whichever comes first, and a worker and its executor hold several copies of it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lost executors never recompute what came before.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from cut() that nothing will read again."""
    for df in tables:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def tidied(work: Callable) -> Callable:
    """A function over batches that gives the memory of its task back at the end: Spark keeps Python workers for the next task,
    and what they have freed but still hold counts against the executor all the while."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return run


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table to be broadcast if it has so many rows at most, counted now; larger ones are joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts with nulls as empty strings) in runs of about limit bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def parts_of(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each part, parts) in runs of about limit bytes, in order: whole texts, and longer ones cut at ASCII white space."""
    for first, part in slices(texts, limit):
        if len(part) > 1 or part.nbytes <= 2 * limit:
            yield np.arange(first, first + len(part)), part
            continue
        text, at = part.cast(pa.large_binary())[0].as_buffer(), 0
        data = memoryview(text)
        while at < len(data):
            end = min(at + limit, len(data))
            while end < len(data):  # up to the next white space, looked for a little at a time
                near = bytes(data[end : end + 4096])
                if gap := _GAP.search(near):
                    end += gap.end()
                    break
                end += len(near)
            yield np.array([first]), pa.array([bytes(data[at:end])], pa.large_binary()).cast(pa.large_string())
            at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    blank = pc.equal(pc.binary_length(words), 0)
    if pc.any(blank).as_py():  # a text without words gives one empty word
        gone = blank.to_numpy(zero_copy_only=False)
        counts -= np.bincount(np.repeat(np.arange(len(counts)), counts)[gone], minlength=len(counts))
        words = words.filter(pc.invert(blank))
    return words, counts


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words by code."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def strings(values: pa.Array) -> list[str]:
    """The values as Python strings, many times faster than to_pylist()."""
    return values.to_numpy(zero_copy_only=False).tolist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word's UTF-8 bytes, the same in every task."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, strings(distinct.cast(pa.large_binary()))), np.uint64, len(distinct))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each run of counts begins."""
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def runs_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of values; runs may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
