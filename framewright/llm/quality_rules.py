"""Quality rules with thresholds from mergeable quantile sketches per language and source.

A sketch counts, for one measure, the values in buckets that keep the ten leading bits of an integer: quantiles are at most 1/512
too low, sketches merge by adding counts, and a group has a few thousand buckets at most, however many documents it has. A group
of fewer than LEAST_ROWS documents takes the merged sketches of its language, a language of fewer those of all documents; so
does a group without a document above the median. Where no document of all is above it, there is no limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.common import coded, cut, few, runs_sum, slices, small_batches, split_words, tidied

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [column.split()[0] for column in BASE.split(", ")]
SYMBOLS = "[#*$%&|<>]"

#: measure: (so many thousandths a word; the upper quantile in hundredths; how often its distance from the median goes on top).
#: Counts that most documents have none of are taken one higher: that is the rate a document of its length can't rule out, so
#: that a group's lengths give the measure a spread of its own where its counts give none.
RULES = {
    "symbols": ("1000 * (n_symbols + 1) div n_words", 75, 12),
    "dup_lines": ("1000 * (n_dup_lines + 1) div n_words", 90, 8),
    "repeats": ("1000 * (n_repeat_words + 1) div n_words", 90, 20),
    "word_length": ("1000 * word_chars div n_words", 75, 12),
}
#: Quantiles that stand in, in this order, where the upper quantile is the median, as in a group that is mostly copies of one text.
FURTHER = (95, 99, 100)
#: Documents that pass the base rules which a group needs for limits of its own.
LEAST_ROWS = 100
#: Tables of limits of so many rows at most, under 100 bytes each, are broadcast.
BROADCAST_ROWS = 100_000


def _repeated(codes: np.ndarray, distinct: int, counts: np.ndarray) -> np.ndarray:
    """How many words of each text lie in a 3-word window that the text has twice or more."""
    n = len(codes)
    if n < 3:
        return np.zeros(len(counts), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    first, second, third = codes[at], codes[at + 1], codes[at + 2]
    pair = first * distinct + second
    if distinct >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
        key = pair * distinct + third if len(at) < (1 << 62) // distinct else np.unique(np.stack([pair, third], 1), axis=0, return_inverse=True)[1]
    else:
        key = pair * distinct + third
    order = np.argsort(key, kind="stable")  # stable: the windows of one text stay together
    k, o = key[order], owner[at][order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for back in range(3):
        covered[at[twice] + back] = True
    return runs_sum(covered, counts)


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, lines = coded(lists.flatten())
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    own = worded[codes]
    total = np.bincount(owner[own], minlength=len(counts))
    distinct = np.unique(owner[own] * max(1, len(lines)) + codes[own])
    return total - np.bincount(distinct // max(1, len(lines)), minlength=len(counts))


def _base(texts: pa.Array) -> dict[str, np.ndarray]:
    words, counts = split_words(texts)
    codes, distinct = coded(words)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": counts,
        "word_chars": runs_sum(chars, counts),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": _dup_lines(texts),
        "n_repeat_words": _repeated(codes, len(distinct), counts),
    }


def base_statistics(text: Column) -> Column:
    """struct of BASE for a text column."""

    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            parts = [_base(texts) for _, texts in slices(pa.array(series, pa.large_string(), from_pandas=True))]
            yield pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in NAMES})

    return F.pandas_udf(tidied(statistics), BASE)(text)


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, limit_<measure>) of each group with documents that pass the base rules; null where there is none."""
    value = F.explode(F.create_map(*[x for name, rule in RULES.items() for x in (F.lit(name), F.expr(rule[0]))]))
    v = stats.where("not base_failed").select("lang", "source", value.alias("measure", "value"))
    shift = F.expr("greatest(length(bin(value)) - 10, 0)")
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("value"), shift), shift)
    sketch = v.withColumn("bucket", bucket).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))

    groups = "explode(array(named_struct('level', 0, 'lang', lang, 'source', source), named_struct('level', 1, 'lang', lang, 'source', cast(null as string)), named_struct('level', 2, 'lang', cast(null as string), 'source', cast(null as string))))"
    merged = sketch.select(F.expr(groups).alias("g"), "measure", "bucket", "n").groupBy("g", "measure", "bucket").agg(F.sum("n").alias("n"))
    upper = F.create_map(*[x for name, rule in RULES.items() for x in (F.lit(name), F.lit(rule[1]))])
    quantile = "aggregate(array_sort(collect_list(struct(bucket, n))), named_struct('seen', 0L, 'q', cast(null as bigint)), (a, x) -> named_struct('seen', a.seen + x.n, 'q', if(a.q is null and 100 * (a.seen + x.n) >= {p} * sum(n), x.bucket, a.q)), a -> a.q)"
    asked_of = {"mid": 50, "p_upper": "max(upper)"} | {f"p_{p}": p for p in FURTHER}
    q = merged.withColumn("upper", upper[F.col("measure")]).groupBy("g", "measure").agg(F.sum("n").alias("rows"), *[F.expr(quantile.format(p=p)).alias(name) for name, p in asked_of.items()])
    high = F.coalesce(*[F.when(F.col(name) > F.col("mid"), F.col(name)) for name in list(asked_of)[1:]])
    q = cut(q.select("g.*", "measure", "rows", "mid", high.alias("high")), "quantiles")

    asked = q.where("level = 0").select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "measure", F.expr(groups).alias("g")).select("of_lang", "of_source", "measure", "g.*")
    usable = q.where(((F.col("rows") >= LEAST_ROWS) & F.col("high").isNotNull()) | (F.col("level") == 2)).withColumnsRenamed({c: f"_{c}" for c in ("level", "lang", "source", "measure")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("level", "lang", "source", "measure")]
    first = asked.join(usable, same[0] & same[1] & same[2] & same[3]).groupBy("of_lang", "of_source", "measure").agg(F.min(F.struct("level", "mid", "high")).alias("q"))

    def limit(name: str) -> Column:
        return F.max(F.when(F.col("measure") == name, F.col("q.high") + RULES[name][2] * (F.col("q.high") - F.col("q.mid"))))

    return first.groupBy(F.col("of_lang").alias("lang"), F.col("of_source").alias("source")).agg(*[limit(m).alias(f"limit_{m}") for m in RULES])


def _judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with kept, by the limits of its language and source."""
    limits = few(cut(limits, "limits"), BROADCAST_ROWS).withColumnsRenamed({"lang": "_l", "source": "_s"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    fits = " and ".join(f"coalesce({rule[0]} <= limit_{m}, true)" for m, rule in RULES.items())
    return joined.withColumn("kept", F.expr(f"if(base_failed, false, {fits})")).drop("_l", "_s")


def _statistics(documents: DataFrame, text: str, lang: str, source: str, **more: Column) -> DataFrame:
    small_batches(documents.sparkSession)
    rows = documents.select(*[c.alias(name) for name, c in more.items()], F.col(lang).alias("lang"), F.col(source).alias("source"), base_statistics(F.col(text)).alias("b")).select(*more, "lang", "source", "b.*")
    return rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def judged(documents: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, lang and source of every row.

    Null and empty text: no words, base_failed. Null lang or source is a group of its own. Repeated rows count each
    time and are judged alike. Values at a limit are kept. An empty table gives none. Other columns are not read.
    """
    stats = cut(_statistics(documents, text, lang, source, doc_id=F.col(key)), "quality-base")
    return _judged(stats, thresholds(stats))


def passing(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that judged() keeps, with all their columns.

    The verdict needs a row's own text, language and source alone, so the statistics are taken twice and no row is looked up by
    its id: null and repeated ids are judged by their own text.
    """
    limits = thresholds(cut(_statistics(documents, text, lang, source), "quality-base"))
    whole = F.struct(*documents.columns)
    return _judged(_statistics(documents, text, lang, source, row=whole), limits).where("kept").select("row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """judged() of all documents; its docstring tells what odd rows give."""
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIMITS = ", ".join(f"max(case when measure = '{m}' then high + {times} * (high - mid) end) as limit_{m}" for m, (_, _, times) in RULES.items())
_HIGH = "coalesce(" + ", ".join(f"case when p_{p} > mid then p_{p} end" for p in ("upper", *FURTHER)) + ")"
_QUANTILES = ", ".join(f"min(case when 100 * up >= {p} * total then bucket end) as p_{p}" for p in ("upper", *FURTHER))
_VALUES = " union all ".join(f"select lang, source, '{m}' as measure, {upper} as upper, {rule.replace(' div ', ' // ')} as value from stats where not base_failed" for m, (rule, upper, _) in RULES.items())
ORACLE_SQL = {
    "op6_quality_rules": rf"""
with words as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from windows) where c > 1),
repeats as (select doc_id, count(distinct i + b) as n from twice, (values (0), (1), (2)) as t(b) group by doc_id),
lines as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from words) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
stats as (select doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words,
  len(w) < 50 or 100 * coalesce(repeats.n, 0) > 50 * len(w) as base_failed
  from words left join lines using (doc_id) left join repeats using (doc_id)),
measured as ({_VALUES}),
sketch as (select lang, source, measure, upper, (value >> s) << s as bucket, count(*) as n from (select *, greatest(length(bin(value)) - 10, 0)::bigint as s from measured) group by all),
merged as (select 0 as level, * from sketch union all select 1, lang, null, measure, upper, bucket, sum(n) from sketch group by all union all select 2, null, null, measure, upper, bucket, sum(n) from sketch group by all),
seen as (select *, sum(n) over (partition by level, lang, source, measure order by bucket) as up, sum(n) over (partition by level, lang, source, measure) as total from merged),
quantiles as (select *, {_HIGH} as high from (select level, lang, source, measure, total, min(case when 2 * up >= total then bucket end) as mid, {_QUANTILES} from seen group by all)),
usable as (select * from quantiles where total >= {LEAST_ROWS} and high is not null or level = 2),
ranked as (select g.lang, g.source, g.measure, u.mid, u.high, row_number() over (partition by g.lang, g.source, g.measure order by u.level) as r from quantiles as g join usable as u
  on g.level = 0 and g.measure = u.measure and (u.level = 2 or u.lang is not distinct from g.lang) and (u.level > 0 or u.source is not distinct from g.source)),
limits as (select lang, source, {_LIMITS} from ranked where r = 1 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else {" and ".join(f"coalesce({rule.replace(' div ', ' // ')} <= limit_{m}, true)" for m, (rule, _, _) in RULES.items())} end as kept
from stats left join limits on stats.lang is not distinct from limits.lang and stats.source is not distinct from limits.source"""
}
