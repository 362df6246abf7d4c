"""Ranked lexical search by hashed max-sketches.

A document's sketch has WIDTH places; each holds the largest impact among the terms that hash to it. An impact grows with a
term's occurrences alone within one document, so a sketch keeps the largest count (255 for any from 255 on), and the impact is
had from it when the corpus' length is known. Places that hold something are stored, three bytes each. For a query, the sum of its weights times the impacts at its terms' places bounds a
document's score from above. The documents with the highest bounds are rescored exactly; the k-th best score is the threshold, and
all others whose bound reaches it are rescored in turn. Sketches and terms are columns of one table, so bounds read sketches only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from framewright.llm.common import coded, cut, discard, few, parts_of, runs_sum, small_batches, split_words, starts_of, tidied, word_hashes

K = 50
#: Places of a sketch, a power of two up to 2 ** 16: with fewer, more terms meet in one place, and bounds are looser.
WIDTH = 1 << 16
#: Documents that are rescored for each query before its threshold is known.
FIRST = 100
#: Terms of all queries of a block, about: a block's terms and weights are sent to every task.
BLOCK_TERMS = 1 << 17
#: Documents whose bounds are taken together, fewer where a block has many terms: cells of the tables laid out for them.
SLICE_DOCUMENTS, CELLS = 1_000, 1 << 22
#: Candidate documents at most whose list is broadcast.
BROADCAST_CANDIDATES = 500_000
#: Fixed values of the score.
SCALE, TF_SCALE, M_SCALE, FLAT, SLOPE, WEIGHT_SCALE = 1_000_000_000, 1_000, 20, 50, 50, 1_000

INDEX = "row long, doc_id long, n long, bag binary, places binary, peaks binary, terms binary, counts binary"
#: Every byte as itself if it belongs to a term, capital letters small, else a space.
_SIGNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def _terms(part: pa.Array) -> pa.Array:
    """The texts with a space for every sign outside terms, and A-Z in lower case: their words are the terms."""
    part = part.cast(pa.large_string())
    _, offsets, data = part.buffers()
    return pa.Array.from_buffers(pa.large_string(), len(part), [None, offsets, pa.py_buffer(data.to_pybytes().translate(_SIGNS) if data else b"")], offset=part.offset)


def _counted(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each text's distinct terms, by text and hash, and the number of terms of each text."""
    n, found = np.zeros(len(texts), np.int64), []
    for owner, part in parts_of(texts):
        words, held = split_words(_terms(part))
        codes, distinct = coded(words)
        pair, count = np.unique(np.repeat(owner, held) * max(1, len(distinct)) + codes, return_counts=True)
        found.append((pair // max(1, len(distinct)), word_hashes(distinct)[pair % max(1, len(distinct))], count))
        np.add.at(n, owner, held)
    owner, term, count = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.lexsort((term, owner))
    owner, term, count = owner[order], term[order], count[order]
    first = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (term[1:] != term[:-1]))[: len(owner)])  # parts of one long text meet here
    return owner[first], term[first], np.add.reduceat(count, first) if len(first) else count, n


def _places(terms: np.ndarray, width: int) -> np.ndarray:
    return (terms >> np.uint64(64 - (width - 1).bit_length())).astype(np.int64)


def _blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The runs of values as bytes."""
    ends = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def index(documents: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """A row of INDEX for each document with a term: its place, key, number of terms, a digest of its terms and their counts, its
    sketch (the places that hold something, ascending, and what they hold), and the 64-bit hashes of its distinct terms with their counts."""
    small_batches(documents.sparkSession)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            owner, term, count, n = _counted(batch.column("text"))
            held = np.bincount(owner, minlength=len(n))
            full = np.flatnonzero(n)
            terms, counts = _blobs(term, held[full]), _blobs(count.astype("<u4"), held[full])
            bags = [xxhash.xxh3_128_digest(t + c) for t, c in zip(terms.to_pylist(), counts.to_pylist(), strict=True)]
            place = owner * width + _places(term, width)  # ascending, as terms are
            first = np.flatnonzero(np.diff(place, prepend=-1))
            peak = np.minimum(np.maximum.reduceat(count, first), 255) if len(first) else count
            filled = np.bincount(owner[first], minlength=len(n))[full]
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(row + full), "doc_id": batch.column("doc_id").take(pa.array(full)), "n": pa.array(n[full]), "bag": pa.array(bags, pa.binary()),
                "places": _blobs((place[first] % width).astype("<u2"), filled), "peaks": _blobs(peak.astype(np.uint8), filled), "terms": terms, "counts": counts,
            })
            row += len(n)

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(indexed), INDEX)


def _queries(items: DataFrame, text: str, key: str) -> DataFrame:
    """(q, item_id, term) for each distinct term of each item; q tells items apart whose ids are equal."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = TaskContext.get().partitionId() << 36
        for batch in batches:
            owner, term, _, n = _counted(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"q": pa.array(q + owner), "item_id": batch.column("item_id").take(pa.array(owner)), "term": pa.array(term.view(np.int64))})
            q += len(n)

    return items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(tidied(terms), "q long, item_id long, term long")


@dataclass
class Block:
    """Some queries: their vocabulary, ascending, with weights, and for each query (by number) where its terms lie in `of`."""

    vocabulary: np.ndarray
    weights: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    held: np.ndarray
    documents: int
    terms: int

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of counts in documents of n terms, in 64-bit integers."""
        m = 100 - FLAT + (SLOPE * n * self.documents) // self.terms
        return (SCALE * counts) // (TF_SCALE * counts + M_SCALE * m)

    def bounds(self, owner: np.ndarray, place: np.ndarray, peak: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
        """Upper bounds by query and document, from the filled places of all documents' sketches."""
        used, column = np.unique(_places(self.vocabulary[self.of], width), return_inverse=True)
        at = np.full(width, -1)
        at[used] = np.arange(len(used))
        at = at[place]
        owner, peak, at = owner[at >= 0], peak[at >= 0], at[at >= 0]
        table = np.zeros((len(used), len(n)), np.int64)
        table[at, owner] = np.where(peak == 255, SCALE // TF_SCALE, self.impacts(peak, n[owner]))
        found = np.zeros((len(self.held), len(n)), np.int64)
        for q, (start, held) in enumerate(zip(self.starts.tolist(), self.held.tolist(), strict=True)):
            terms = slice(start, start + held)
            found[q] = self.weights[self.of[terms]] @ table[column[terms]]
        return found

    def scores(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, n: np.ndarray, document: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of (document, query) pairs, from the documents' terms and counts."""
        at = np.minimum(np.searchsorted(self.vocabulary, term), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == term
        owner, at = owner[known], at[known]
        impact = self.impacts(count[known], n[owner]) * self.weights[at]
        size, found = len(self.vocabulary), np.zeros(len(document), np.int64)
        step = max(1, CELLS // max(1, size))  # documents whose impacts on the whole vocabulary are laid out together
        order = np.argsort(document, kind="stable")
        for first in range(0, len(n), step):
            lo, hi = np.searchsorted(owner, (first, first + step))
            table = np.zeros((min(step, len(n) - first), size), np.int64)
            table[owner[lo:hi] - first, at[lo:hi]] = impact[lo:hi]
            a, b = np.searchsorted(document[order], (first, first + step))
            for low in range(a, b, 50_000):
                pairs = order[low : min(b, low + 50_000)]
                q, d = query[pairs], document[pairs] - first
                held = self.held[q]
                terms = self.of[np.repeat(self.starts[q] - starts_of(held), held) + np.arange(held.sum())]
                found[pairs] = runs_sum(table[np.repeat(d, held), terms], held)
        return found


def _frequencies(indexed: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.uint64)
            at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            df += np.bincount(at[vocabulary[at] == term], minlength=len(vocabulary))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"v": pa.array(met), "df": pa.array(df[met])})

    found = indexed.select("terms").mapInArrow(tidied(counted), "v long, df long").groupBy("v").agg(F.sum("df").alias("df")).toPandas()  # a row for each term of the block
    df = np.zeros(len(vocabulary), np.int64)
    df[found["v"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return df


def _block(pairs: pd.DataFrame, indexed: DataFrame, documents: int, terms: int) -> Block:
    """The queries numbered 0.. in pairs (number, term). Terms of no document add nothing to any score and go."""
    vocabulary, of = np.unique(pairs["term"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    df = _frequencies(indexed, vocabulary)
    weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    number = pairs["number"].to_numpy()
    kept, queries = df[of] > 0, int(number.max()) + 1
    held = np.bincount(number[kept], minlength=queries)
    return Block(vocabulary, weights, of[kept], starts_of(held), held, documents, terms)


def _bounded(indexed: DataFrame, block: Block, least: np.ndarray | None, k: int, width: int) -> DataFrame:
    """(row, number, bound): documents whose bound reaches least, or, if that is None, each task's FIRST highest bounds of each query.

    Of documents in a slice that have the same terms and counts, only the k smallest keys are given: the others score the same and rank behind.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def given(rows: np.ndarray, number: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"row": pa.array(rows), "number": pa.array(number), "bound": pa.array(bound)})

        def highest() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rows, number, bound = (np.concatenate(c) for c in zip(*best, strict=True))
            order = np.lexsort((rows, -bound, number))
            rows, number, bound = rows[order], number[order], bound[order]
            top = np.arange(len(number)) - np.searchsorted(number, number) < FIRST
            return [(rows[top], number[top], bound[top])]

        step = max(1, min(SLICE_DOCUMENTS, CELLS // max(1, len(block.vocabulary), len(block.held))))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                rows, n = part.column("row").to_numpy(), part.column("n").to_numpy()
                _, bag = np.unique(np.array(part.column("bag").to_pylist(), object), return_inverse=True)
                keys = part.column("doc_id")
                order = np.lexsort((rows, keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), bag))
                ahead = np.arange(len(order)) - np.searchsorted(bag[order], bag[order])
                some = np.sort(order[ahead < k])
                part, rows, n = part.take(pa.array(some)), rows[some], n[some]
                filled = pa.compute.binary_length(part.column("peaks")).to_numpy(zero_copy_only=False)
                place, peak = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).astype(np.int64) for c, kind in (("places", "<u2"), ("peaks", np.uint8)))
                bounds = block.bounds(np.repeat(np.arange(len(n)), filled), place, peak, n, width)
                if least is not None:
                    q, d = np.nonzero(bounds >= least[:, None])
                    yield given(rows[d], q, bounds[q, d])
                    continue
                top = np.argpartition(-bounds, FIRST, axis=1)[:, :FIRST] if len(rows) > FIRST else np.tile(np.arange(len(rows)), (len(bounds), 1))
                q, d = np.repeat(np.arange(len(bounds)), top.shape[1]), top.ravel()
                real = bounds[q, d] > 0
                best.append((rows[d[real]], q[real], bounds[q[real], d[real]]))
                best = highest()
        if best:
            yield given(*best[0])

    return indexed.select("row", "doc_id", "n", "bag", "places", "peaks").mapInArrow(tidied(bounded), "row long, number long, bound long")


def _rescored(indexed: DataFrame, candidates: DataFrame, block: Block) -> DataFrame:
    """(number, row, doc_id, bag, score) of the candidates (row, number), from the terms of their documents."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            asked = pa.compute.list_value_length(batch.column("numbers")).to_numpy(zero_copy_only=False)
            held = pa.compute.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 8
            term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.uint64)
            count = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4").astype(np.int64)
            document, query = np.repeat(np.arange(len(n)), asked), batch.column("numbers").flatten().to_numpy()
            score = block.scores(np.repeat(np.arange(len(n)), held), term, count, n, document, query)
            real = np.flatnonzero(score > 0)
            at = pa.array(document[real])
            yield pa.RecordBatch.from_pydict({"number": pa.array(query[real]), "row": batch.column("row").take(at), "doc_id": batch.column("doc_id").take(at), "bag": batch.column("bag").take(at), "score": pa.array(score[real])})

    by_row = cut(candidates.groupBy("row").agg(F.collect_list("number").alias("numbers")), "candidates")  # at most a block's queries in a list
    terms = indexed.select("row", "doc_id", "n", "bag", "terms", "counts")
    return terms.join(few(by_row, BROADCAST_CANDIDATES), "row").mapInArrow(tidied(scored), "number long, row long, doc_id long, bag binary, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, equal ones by ascending key, null keys last; `rank` from 1."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = K, text: str = "text", key: str = "doc_id", item: str = "item_id", width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents that score highest for each item, if they score above 0.

    Equal scores rank by ascending key, null keys last. Null and empty texts have no terms and are in no result; nor are items without a
    term that a document holds. Repeated rows are documents each, repeated items are ranked each. Empty tables give none.
    Terms are told apart by 64-bit hashes. Items are worked on in blocks of about BLOCK_TERMS terms, against all documents each.
    """
    spark = documents.sparkSession
    indexed = cut(index(documents, text, key, width), "sketches")
    queries = cut(_queries(items, text, item), "queries")
    size = indexed.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    found = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    blocks = -(-queries.count() // BLOCK_TERMS) if size.documents else 0
    for b in range(blocks):
        pairs = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()  # bounded by the block
        if pairs.empty:
            continue
        pairs = pairs.sort_values(["q", "term"], kind="stable").reset_index(drop=True)
        pairs["number"] = pd.factorize(pairs["q"])[0]
        ids = spark.createDataFrame([(int(i), None if pd.isna(v) else int(v)) for i, v in pairs.drop_duplicates("number")[["number", "item_id"]].itertuples(index=False)], "number long, item_id long")
        block = _block(pairs, indexed, size.documents, size.terms)
        order = Window.partitionBy("number").orderBy(F.desc("bound"), "row")
        first = _bounded(indexed, block, None, k, width).withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST)
        tried = _best(_rescored(indexed, first.select("row", "number"), block), k).groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).toPandas()
        least = np.ones(len(block.held), np.int64)
        enough = tried[tried["n"] == k]
        least[enough["number"].to_numpy(np.int64)] = enough["score"].to_numpy(np.int64)
        candidates = _bounded(indexed, block, least, k, width).select("row", "number")
        best = cut(_best(_rescored(indexed, candidates, block), k).join(F.broadcast(ids), "number").select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "found")
        found.append(best)
    discard(queries, indexed)
    result = found[0]
    for best in found[1:]:
        result = result.unionByName(best)
    return result


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """search() of all documents for each item of the benchmark; its docstring tells what odd rows give."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = {
    "op13_lexical_search": r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), counts AS (
        SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
    ), lengths AS (
        SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
    ), totals AS (
        SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths
    ), items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM items) GROUP BY term), totals
    ), scores AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
        FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
    ), ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """
}
