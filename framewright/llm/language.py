"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.common import parts_of, small_batches, starts_of, strings, tidied

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Labelled rows that the model is fitted on, about; all are used where there are fewer.
SAMPLE_ROWS = 8_000
UNDETERMINED = "und"
#: Text bytes that a task looks at together; each character takes some 100 bytes on the way. Longer texts are cut at white space.
SLICE_BYTES = 500_000
#: A text is foreign to its language if its likelihood a letter is so many deviations under that of labelled rows.
FOREIGN_AT = 8
#: Likelihoods of so many texts and languages are held together.
CELLS = 1 << 22


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """The lower-case code point of every letter, a space for every other code point."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each text; and sparse counts: how many (text, n-gram) there are by text, and the n-gram and count of each.

    Texts stand between spaces, and a run of anything but letters is one space. An n-gram is one of each order that ends at a letter.
    """
    rows = strings(texts)
    points = np.frombuffer(" ".join(["", *rows, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    folded = _folded()[points]
    owner = np.concatenate((np.zeros(1, np.int64), np.repeat(np.arange(len(lengths)), lengths + 1)))  # a text and the space after it
    keep = (folded != 32) | np.concatenate(([True], folded[:-1] != 32))
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    own = folded != 32
    text = owner[own].astype(np.uint64) * np.uint64(len(ORDERS) * BUCKETS)
    letters = np.bincount(owner[own], minlength=len(lengths))
    keys = []
    for k, n in enumerate(ORDERS):
        h = np.full(len(folded), n, np.uint64)
        for back in range(n):
            part = np.full(len(folded), 32, np.uint64)
            part[back:] = folded[: len(folded) - back]
            h = (h + part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys.append(text + np.uint64(k * BUCKETS) + ((h[own] >> np.uint64(40)) & np.uint64(BUCKETS - 1)))
    key = np.sort(np.concatenate(keys))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(key)))
    found = key[at].astype(np.int64)
    return letters, np.bincount(found // (len(ORDERS) * BUCKETS), minlength=len(lengths)), found % (len(ORDERS) * BUCKETS), counts


class Model(NamedTuple):
    """Log probabilities as a sparse matrix: of each n-gram (ORDERS * BUCKETS) the languages that the sample has it in, and how far
    each is above that of an n-gram which the language hasn't; base: that one's log probability, summed over the orders. The
    matrix has an entry for each n-gram and language that the sample has, so its size is bounded by the sample, not by languages.
    usual: of each language the mean likelihood a letter of labelled rows, its variance from row to row, and that from letter to letter."""

    languages: list[str]
    starts: np.ndarray  # where each n-gram's entries begin, and the end
    of: np.ndarray  # language of each entry
    above: np.ndarray  # float32 of each entry
    base: np.ndarray
    usual: np.ndarray


def _likelihoods(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text, and float64[texts, languages]: its log likelihood, the mean of the orders, which see the same letters."""
    letters, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)))
    for owner, part in parts_of(texts, SLICE_BYTES):
        n, width, grams, counts = _features(part)
        np.add.at(letters, owner, n)
        if not sums.size:
            continue
        first, last = model.starts[grams], model.starts[grams + 1]
        held = last - first
        at = np.repeat(first - starts_of(held), held) + np.arange(held.sum())
        cell = np.repeat(np.repeat(owner, width), held) * len(model.languages) + model.of[at]
        low = int(cell.min()) if len(cell) else 0  # a slice's texts stand together
        found = np.bincount(cell - low, np.repeat(counts, held) * model.above[at])
        sums.reshape(-1)[low : low + len(found)] += found
    return letters, (sums + letters[:, None] * model.base) / len(ORDERS)


def _chunks(texts: pa.Array, model: Model) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts) in runs whose likelihoods are CELLS numbers at most."""
    step = max(1, CELLS // max(1, len(model.languages)))
    for first in range(0, len(texts), step):
        yield first, texts.slice(first, step)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows: of those with the lowest hashes of key and text, about sample_rows, seven eighths give the
    matrix and one eighth what is usual. Rows with a null lang or text teach nothing; rows without a key teach by their text, and
    where there are more rows than sample_rows, rows that repeat altogether teach once. No labelled rows: no languages.
    """
    small_batches(labelled.sparkSession)
    own = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(key)))
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), own.alias("h"), F.xxhash64(key, text).alias("s")).where("text is not null and lang is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s", 0.02).alias("distinct"), F.min("s").alias("least")).first()
    if size.n > sample_rows:
        limit = min(2**63 - 1, int((sample_rows / size.distinct - 0.5) * 2.0**64)) if size.distinct > sample_rows else 2**63 - 1
        rows = rows.where(F.col("s") <= F.lit(max(limit, size.least))).groupBy("s", "lang").agg(F.first("text").alias("text"), F.first("h").alias("h"))
    rows = rows.withColumn("usual", F.pmod(F.xxhash64("h"), F.lit(8)) == 0)
    lone = rows.groupBy("lang").agg(F.bool_and("usual").alias("lone")).where("lone").select("lang")  # all of whose rows would be kept from the matrix
    rows = rows.join(F.broadcast(lone.withColumn("lone", F.lit(True))), "lang", "left").withColumn("usual", F.col("usual") & F.col("lone").isNull())
    usual = F.col("usual")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for owner, texts in parts_of(batch.column("text"), SLICE_BYTES):
                _, width, grams, counts = _features(texts)
                of = np.repeat(langs[owner], width)
                for name in set(langs[owner]):
                    into = sums.setdefault(name, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    np.add.at(into, grams[of == name], counts[of == name])
        for name, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(into[at])})

    counts = rows.where(~usual).select("text", "lang").mapInArrow(tidied(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # bounded by the sample's n-grams
    languages = sorted(set(table.column("lang").to_pylist()))
    of = np.searchsorted(np.array(languages, object), np.array(table.column("lang").to_pylist(), object)) if languages else np.zeros(0, np.int64)
    bucket, n = table.column("bucket").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
    total = np.full((len(languages), len(ORDERS)), 0.1 * BUCKETS)
    np.add.at(total, (of, bucket // BUCKETS), n)
    order = np.lexsort((of, bucket))
    starts = np.searchsorted(bucket[order], np.arange(len(ORDERS) * BUCKETS + 1))
    model = Model(languages, starts, of[order].astype(np.int32), np.log((n[order] + 0.1) / 0.1).astype(np.float32), np.log(0.1 / total).sum(axis=1), np.zeros((0, 3)))
    return model._replace(usual=_usual(rows.where(usual), model))


def _usual(rows: DataFrame, model: Model) -> np.ndarray:
    """float64[languages, 3] of Model; a language without rows has infinite variances, so that nothing is foreign to it."""
    languages = model.languages
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        places = {name: i for i, name in enumerate(held.languages)}
        for batch in batches:
            for first, texts in _chunks(batch.column("text"), held):
                letters, sums = _likelihoods(texts, held)
                langs = batch.column("lang").slice(first, len(texts))
                at = np.array([places.get(x, -1) for x in langs.to_pylist()], np.int64)
                ok = np.flatnonzero((letters > 0) & (at >= 0))
                yield pa.RecordBatch.from_pydict({"lang": langs.take(pa.array(ok)), "n": pa.array(letters[ok]), "m": pa.array(sums[ok, at[ok]] / letters[ok])})

    of = rows.select("text", "lang").mapInArrow(tidied(likely), "lang string, n long, m double").groupBy("lang")
    # rows of n letters have a mean whose variance is between + within / n: the slope over 1 / n and what is left
    found = of.agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var"), F.avg(1 / F.col("n")).alias("inverse")).collect()
    usual = np.tile([0.0, np.inf, np.inf], (len(languages), 1))
    for r in found:
        spread = max(r["var"], 0.01)
        usual[languages.index(r["lang"])] = r["mean"], spread, max(4.0, spread / max(r["inverse"], 1e-9))
    return usual


def predictor(df: DataFrame, model: Model) -> Callable[[str], Column]:
    """A function from a text column to struct(lang_pred, score, foreign), with the sparse matrix sent once to each executor.

    foreign: the text has letters, but is far less likely than usual in every language that has been learnt.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("lang_pred string, score double, foreign boolean")
    @tidied
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for series in batches:
            texts = pa.array(series, pa.large_string(), from_pandas=True)
            pred, score, foreign = np.full(len(series), UNDETERMINED, object), np.zeros(len(series)), np.zeros(len(series), bool)
            for first, part in _chunks(texts, model):
                letters, sums = _likelihoods(part, model)
                full = np.flatnonzero(letters)
                if model.languages and len(full):
                    n = letters[full, None]
                    foreign[first + full] = (sums[full] / n < model.usual[:, 0] - FOREIGN_AT * np.sqrt(model.usual[:, 1] + model.usual[:, 2] / n)).all(axis=1)
                    p = np.exp(sums[full] - sums[full].max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    pred[first + full], score[first + full] = np.array(model.languages, object)[p.argmax(axis=1)], p.max(axis=1)
            yield pd.DataFrame({"lang_pred": pred, "score": score, "foreign": foreign})

    return lambda text: predict(F.col(text))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows that teach nothing: crc32 of the key as text leaves the remainder part."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def identify(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the rows that aren't held out.

    Null text, empty text and text without a letter: `und`, score 0. Ties go to the first language in order.
    Repeated rows are predicted alike. Without labelled rows everything is `und`. Other columns are not read.
    """
    model = fit(documents.where(~held_out(key)), text, lang, key)
    predict = predictor(documents, model)
    found = documents.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), predict(text).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """identify() of all documents; its docstring tells what odd rows give."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
