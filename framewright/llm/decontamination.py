"""Benchmark decontamination by spaced-seed hashing.

A seed hashes some of the words of a window and ignores the others, by a fixed mask. Words are compared in lower case,
letters and digits only. Training and test seeds are joined by hash; each shared seed sets an alignment of a document and
an item, and the words around it are compared. An item is found in a document where, along one alignment, WINDOW words of
the item stand in the document with NEEDED of them equal (items shorter than WINDOW: all but a fifth of their words, those
under SHORTEST words: all of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from framewright.llm.common import coded, cut, few, mix, slices, small_batches, split_words, starts_of, strings, tidied, word_hashes

#: Together they hit every window of 13 words with at most three of them replaced.
MASKS = ("110100011", "1101011", "111001001")
WINDOW, NEEDED = 13, 10
#: Items under this many words fit no mask well; a mask of their own length without holes finds them.
SHORTEST = 10
#: Bits of the filter of test seeds that every executor gets: 8 MB, whatever the size of the benchmark.
FILTER_BITS = 1 << 26
SEGMENT_GAP = 2 * WINDOW
#: A seed that more stretches hold is dealt to parts of about so many, each of which meets the seed's items by itself.
PART_HITS = 20_000
#: Tables of seeds that are dealt out of so many rows at most are broadcast.
BROADCAST_SEEDS = 1_000_000

_NOISE = re.compile(r"[\W_]+")


def _normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words in lower case without anything but letters and digits, and how many each text has."""
    words, counts = split_words(texts)
    codes, distinct = coded(words)
    low = strings(distinct)
    odd = np.flatnonzero(pc.invert(pc.match_substring_regex(distinct, "^[a-z0-9]+$")).to_numpy(zero_copy_only=False))
    for i in odd.tolist():
        low[i] = _NOISE.sub("", low[i].lower())
    hashes = word_hashes(pa.array(low, pa.large_string()))
    real = np.fromiter(map(bool, low), bool, len(low))[codes] if len(codes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    return hashes[codes][real] if len(codes) else np.zeros(0, np.uint64), np.bincount(owner[real], minlength=len(counts))


def _seeds(hashes: np.ndarray, counts: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask its number, the seeds of all windows inside one text, and where they begin."""
    room = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
    for number, mask in enumerate(masks):
        at = np.flatnonzero(room >= len(mask))
        seed = np.full(len(at), len(mask) * 1_000_003 + int(mask, 2), np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                seed = (seed ^ hashes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
                seed ^= seed >> np.uint64(32)
        yield number, mix(seed), at


def _bits(seeds: np.ndarray) -> list[np.ndarray]:
    return [(seeds >> np.uint64(shift)).astype(np.int64) & (FILTER_BITS - 1) for shift in (0, 20, 38)]


def test_words(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, words): the hashed words of every item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                hashes, counts = _normal_words(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id").slice(first, len(texts)), "words": lists})

    return benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(tidied(run), "item_id long, words array<long>").where("size(words) > 0")


def test_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(seed, item, item_at)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("words").value_lengths().to_numpy().astype(np.int64)
            hashes, ids = batch.column("words").flatten().to_numpy().view(np.uint64), batch.column("item")
            owner = np.repeat(np.arange(len(counts)), counts)
            for number, seed, at in _seeds(hashes, counts, masks):
                own = (counts[owner[at]] >= SHORTEST) if number < len(MASKS) else (counts[owner[at]] == len(masks[number]))
                seed, at = seed[own], at[own]
                yield pa.RecordBatch.from_pydict({"seed": pa.array(seed.view(np.int64)), "item": ids.take(pa.array(owner[at])), "item_at": pa.array((at - starts_of(counts)[owner[at]]).astype(np.int32))})

    return items.mapInArrow(tidied(run), "seed long, item long, item_at int")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds; at most FILTER_BITS / 64 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits in _bits(batch.column("seed").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_pydict({"word": pa.array(bits >> 6), "flag": pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))})

    words = seeds.select("seed").mapInArrow(tidied(run), "word long, flag long").groupBy("word").agg(F.bit_or("flag").alias("flag")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("flag").to_numpy().view(np.uint64)
    return table


SEGMENTS = "doc_id long, start long, words array<long>, at array<int>, seeds array<long>"


def segments(documents: DataFrame, table: np.ndarray, masks: tuple[str, ...], text: str, key: str) -> DataFrame:
    """The stretches of documents round seeds that the filter knows: hashed words, and the seeds with their places in them."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def known(seeds: np.ndarray) -> np.ndarray:
        found = np.arange(len(seeds))
        for k in range(3):
            bits = _bits(seeds[found])[k]
            found = found[(shared.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                hashes, counts = _normal_words(texts)
                hits, places = [], []
                for _, seed, at in _seeds(hashes, counts, masks):
                    found = known(seed)
                    hits.append(seed[found])
                    places.append(at[found])
                seed, at = np.concatenate(hits), np.concatenate(places)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                seed, at = seed[order], at[order]
                owner = np.repeat(np.arange(len(counts)), counts)
                new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > SEGMENT_GAP) | (owner[at[1:]] != owner[at[:-1]]))))
                ends = np.append(new[1:], len(at))
                document = owner[at[new]]
                begin = starts_of(counts)[document]
                low = np.maximum(begin, at[new] - 2 * WINDOW)
                high = np.minimum(begin + counts[document], at[ends - 1] + 3 * WINDOW)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, len(texts)).take(pa.array(document)),
                        "start": pa.array(low - begin),
                        "words": pa.array([hashes[a:b].view(np.int64) for a, b in zip(low, high, strict=True)], pa.list_(pa.int64())),
                        "at": pa.array([(at[a:b] - w).astype(np.int32) for a, b, w in zip(new, ends, low, strict=True)], pa.list_(pa.int32())),
                        "seeds": pa.array([seed[a:b].view(np.int64) for a, b in zip(new, ends, strict=True)], pa.list_(pa.int64())),
                    }
                )

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), SEGMENTS)


def _best_window(same: np.ndarray, item_words: int) -> tuple[int, int, int]:
    """(words compared, words equal, place in the overlap) of the best window, or zeros where no window is good enough."""
    window = min(WINDOW, item_words)
    needed = NEEDED if item_words >= WINDOW else (item_words if item_words < SHORTEST else -(-4 * item_words // 5))
    if len(same) < window:
        return 0, 0, 0
    total = np.concatenate(([0], np.cumsum(same)))
    sums = total[window:] - total[:-window]
    best = int(sums.argmax())
    return (window, int(sums[best]), best) if sums[best] >= needed else (0, 0, 0)


def _met(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """hits (segment, at, seed) joined with seeds (seed, item, item_at). A seed's hits, a third of all perhaps, are dealt to parts,
    and its items, which are few, go to each part."""
    parts = hits.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / PART_HITS).cast("int").alias("parts")).where("parts > 1")
    parts = few(cut(parts, "hot-seeds"), BROADCAST_SEEDS)
    dealt = hits.join(parts, "seed", "left").select("seed", "segment", "at", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("segment", "at"), F.col("parts")).cast("int")).alias("part"))
    copied = seeds.join(parts, "seed", "left").select("seed", "item", "item_at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(copied, ["seed", "part"])


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, item_id, doc_at, window and equal: each item found in each document, with the first word and size of the best
    window in the document and how many of its words are equal.

    Null and empty texts, and items without a letter or digit, are found nowhere. Repeated rows and items give the pair once,
    as does a tie (the first place). Empty tables give no rows. Documents with null ids give rows with null ids.
    """
    small_batches(documents.sparkSession)
    items = cut(test_words(benchmark, item_text, item).withColumn("item", F.xxhash64("words")), "test-items")
    distinct = cut(items.groupBy("words").agg(F.first("item").alias("item")), "distinct-items")  # items of the same words are looked for once
    lengths = [r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < SHORTEST).distinct().collect()]  # nine at most
    masks = MASKS + tuple("1" * n for n in sorted(lengths))
    seeds = cut(test_seeds(distinct, masks), "test-seeds")
    stretch = cut(segments(documents, _filter(seeds), masks, text, key).withColumn("segment", F.monotonically_increasing_id()), "segments")
    hits = stretch.select("segment", F.explode(F.arrays_zip("at", "seeds")).alias("h")).select("segment", F.col("h.at").alias("at"), F.col("h.seeds").alias("seed"))
    pairs = _met(hits, seeds).select("segment", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    aligned = pairs.join(stretch.select("segment", "doc_id", "start", "words"), "segment").join(distinct.select("item", F.col("words").alias("wanted")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, wanted = batch.column("words"), batch.column("wanted")
            out: list[tuple[int, int, int]] = []
            for i, shift in enumerate(batch.column("shift").to_numpy()):
                d, q = docs[i].values.to_numpy(), wanted[i].values.to_numpy()
                low, high = max(0, -shift), min(len(q), len(d) - shift)
                window, equal, place = _best_window(q[low:high] == d[low + shift : high + shift], len(q)) if high > low else (0, 0, 0)
                out.append((window, equal, place + low + shift))
            window, equal, place = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "item": batch.column("item"), "doc_at": pa.array(batch.column("start").to_numpy() + place), "window": pa.array(window), "equal": pa.array(equal)})

    found = aligned.select("doc_id", "item", "start", "words", "shift", "wanted").mapInArrow(tidied(run), "doc_id long, item long, doc_at long, window long, equal long").where("window > 0")
    best = found.groupBy("doc_id", "item").agg(F.max(F.struct("equal", (-F.col("doc_at")).alias("back"), "window")).alias("b"))
    named = best.join(items.select("item", "item_id").distinct(), "item")
    return named.select("doc_id", "item_id", (-F.col("b.back")).alias("doc_at"), "b.window", "b.equal")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated() of all documents and items; its docstring tells what odd rows give."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
