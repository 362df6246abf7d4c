"""Compression classifier: documents that a dictionary of good text compresses better than one of bad text are good."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.common import cut, small_batches, tidied
from framewright.llm.language import held_out

#: Labelled documents of each class that the model is fitted on, about, and the bytes of whole documents that they have at most.
SAMPLE_ROWS = 1_200
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 112_640
#: Dictionaries are trained on pieces of so many bytes, which cover every document.
PIECE_BYTES = 4_096
LEVEL = 3
PREDICT_AT = 0.3


def _compressors(dictionaries: tuple[bytes, bytes]) -> list:
    import zstandard

    found = []
    for content in dictionaries:
        # a trained one is loaded with its entropy tables: as content alone, 84 % instead of 91 % of the bad texts of sf0.1 are found
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
        dictionary.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
    return found


def _features(text: str | None, compressors: list) -> tuple[float, float]:
    """The difference of the two compressed sizes over their sum, and how much of the text is left after compression."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0, 1.0
    good, bad = (len(c.compress(data)) for c in compressors)
    return (bad - good) / (bad + good), min(good, bad) / len(data)


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on all passages of the texts; the texts themselves where they are too few for zstandard to train one."""
    import zstandard

    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    pieces = [d[i : i + PIECE_BYTES] for d in data for i in range(0, len(d), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(data) or b" "


def _fitting(sizes: list) -> list[tuple]:
    """(y, h, _k, th) in the order of the keys' hashes h: of each class y as many whole documents as have SAMPLE_BYTES together; one that doesn't fit is passed over."""
    total, found = {0: 0, 1: 0}, []
    for r in sorted(sizes, key=lambda r: r.h):
        if total[r.y] + r.bytes <= SAMPLE_BYTES:
            total[r.y] += r.bytes
            found.append((r.y, r.h, r._k, r.th))
    return found


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[tuple[bytes, bytes], np.ndarray]:
    """Dictionaries for good (label 1) and bad (0) text, and the weights of the calibration.

    Of each class, about sample_rows labels with the lowest hashes of key are used, with the whole texts of their
    documents: that many keys are sent to the documents, and one text for each comes back. Even ones fill the dictionaries, odd
    ones calibrate. Without rows of both classes, every text scores the share of good labels.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key)).alias("h"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    keyed = rows.distinct()  # a key that is labelled many times is one
    keys_of = {r.y: r.n for r in keyed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    low = F.create_map(*[x for y in (0, 1) for x in (F.lit(y), F.lit(int((min(1, sample_rows / max(1, keys_of.get(y, 0))) - 0.5) * (2.0**64 - 2**12))))])
    keys = cut(keyed.where(F.col("h") <= low[F.col("y")]), "label-keys")  # about sample_rows of each class
    texts = documents.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    # of a key with several documents the one whose text has the smallest hash: one text for each key, however often it stands
    first = texts.select("_k", "th", F.octet_length("t").alias("b")).join(F.broadcast(keys), "_k").groupBy("y", "h", "_k").agg(F.min(F.struct("th", "b")).alias("m"))
    sizes = first.select("y", "h", "_k", "m.th", F.col("m.b").alias("bytes")).collect()
    fitting = F.broadcast(documents.sparkSession.createDataFrame(_fitting(sizes), keys.select("y", "h", "_k").withColumn("th", F.lit(0).cast("long")).schema))
    sample = texts.join(fitting, ["_k", "th"]).groupBy("y", "h", "_k").agg(F.min("t").alias("t")).toPandas().sort_values(["h", "t"])
    halves = {y: sample.loc[sample.y == y, "t"].tolist() for y in (0, 1)}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    dictionaries = (_dictionary(halves[1][0::2]), _dictionary(halves[0][0::2]))
    if not all(len(h) > 1 for h in halves.values()):
        return dictionaries, np.array([0.0, 0.0, 0.0, np.log((prior + 1e-3) / (1 - prior + 1e-3))])
    compressors = _compressors(dictionaries)
    x = np.array([_features(t, compressors) for y in (1, 0) for t in halves[y][1::2]])
    y = np.repeat([1.0, 0.0], [len(halves[1][1::2]), len(halves[0][1::2])])
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return dictionaries, _logistic(_expanded(x), y, weight)


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x[:, 0] * 10, x[:, 0] * 10 * x[:, 1], x[:, 1], np.ones(len(x))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.05 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w += step / max(1.0, np.abs(step).max() / 5)
    return w


def scorer(df: DataFrame, model: tuple[tuple[bytes, bytes], np.ndarray]) -> Callable[[str], Column]:
    """A function from a text column to its score; the two dictionaries go to each executor once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dictionaries, w = shared.value
        compressors = _compressors(dictionaries)
        for series in batches:
            x = np.array([_features(t, compressors) for t in series]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_expanded(x) @ w, -30, 30))))

    udf = F.pandas_udf(tidied(scores), "double")
    return lambda text: udf(F.col(text))


def scored(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents.

    Labels that are null or neither 0 nor 1, and labels of held-out or missing documents, teach nothing; a key with several
    labels teaches each. Null and empty texts get the score of an even text. Repeated rows score alike. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    out = held_out(key, 5, 0)
    score = scorer(documents, fit(documents, labels.where(~out), text, label, key))
    found = documents.select(F.col(key).alias("doc_id"), out.alias("held_out"), score(text).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """scored() of all documents; its docstring tells what odd rows give."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
