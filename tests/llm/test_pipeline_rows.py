"""The pipeline's stages on rows with clashing columns, null and repeated ids and long texts; language ID without ids."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import decontamination, language, quality_rules
from test_text_operators import LONG, docs

TEXTS = [" ".join(f"{'abcdefgh'[(i * k) % 8]}{k}x" for k in range(80)) for i in range(1, 6)]


def clashing(spark, rows):
    """Columns of odd names and types; maps can't be compared."""
    df = docs(spark, rows, clash=False)
    return df.withColumns({"_h": F.lit("x"), "_n": F.lit(1), "row": F.lit(2.0), "hash": F.lit("h"), "digest": F.lit(None).cast("string"), "tags": F.create_map(F.lit("k"), F.col("text"))})


def stages(spark, tmp_path, df):
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = stage(spark, df, str(tmp_path))
    return df


def test_stages_keep_whole_rows(spark, tmp_path):
    rows = [(i % 3 or None, t, "en", "a") for i, t in enumerate(TEXTS * 2)] + [(None, LONG, "en", "a"), (9, TEXTS[0] + " " + " ".join(f"item{i}" for i in range(20)), "en", "b"), (8, None, "en", "a")]
    df = clashing(spark, rows)
    got = stages(spark, tmp_path, df)
    assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
    found = got.collect()
    assert sorted(r.text for r in found) == sorted([*TEXTS, LONG])
    assert all(r._h == "x" and r._n == 1 and r.row == 2.0 and r.hash == "h" and r.digest is None and r.tags == {"k": r.text} for r in found)
    assert {r.text: r.doc_id for r in found}[TEXTS[1]] == 1  # of rows 1 and null the smallest id


def test_stages_with_null_ids_alone(spark, tmp_path):
    got = stages(spark, tmp_path, clashing(spark, [(None, t, "en", "a") for t in TEXTS * 3])).collect()
    assert sorted(r.text for r in got) == sorted(TEXTS)


def test_language_is_learnt_from_rows_without_ids(spark):
    rng = random.Random(1)
    words = {"en": ["the", "house", "with", "garden"], "de": ["der", "haus", "mit", "über"]}
    rows = [(None, " ".join(rng.choices(words[lang], k=12)) + f" {'xyz'[i % 3]}", lang, "a") for i in range(1_500) for lang in words]
    df = docs(spark, rows, clash=False)
    model = language.fit(df, sample_rows=200)
    assert model.languages == ["de", "en"]
    kept = df.select("lang", language.predictor(df, model)("text").alias("p"))
    assert kept.where("p.lang_pred != lang").count() == 0
    same = docs(spark, [(None, "the house with the garden", "en", "a")] * 900, clash=False)
    assert language.fit(same, sample_rows=10).languages == ["en"]
    assert corpus_pipeline.language_id(spark, same, "").count() == 900


def test_seeds_of_many_items_and_documents(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_HITS", 7)
    phrase = [f"common{i}" for i in range(16)]
    items = [(i, " ".join(phrase)) for i in range(5)] + [(10 + i, " ".join(phrase + [f"own{i}"])) for i in range(20)]
    rows = [(i, f"word{i} " + " ".join(phrase) + f" tail{i}", "en", "a") for i in range(60)] + [(99, "nothing of it", "en", "a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(docs(spark, rows), benchmark).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d in range(60) for i, _ in items)


def test_limits_of_groups_without_spread(spark):
    plain = " ".join(f"word{k}x" for k in range(80))
    other = lambda i: " ".join(f"{'abcd'[k % 4]}{i}y{k}" for k in range(60 + i))
    copies = [(i, plain, "en", "copies") for i in range(300)] + [(400 + i, other(i), "en", "copies") for i in range(9)] + [(500, "# $ " * 60 + plain, "en", "copies")]
    mixed = [(1000 + i, other(i % 90), "en", "mixed") for i in range(200)] + [(1900, "# $ " * 60 + plain, "en", "mixed")]
    limits = {r.source: r for r in quality_rules.thresholds(quality_rules._statistics(docs(spark, copies + mixed), "text", "lang", "source")).collect()}
    assert limits["copies"].limit_word_length is None  # no document is above the median
    assert limits["copies"].limit_symbols != limits["mixed"].limit_symbols  # each has its own, from its documents
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs(spark, copies + mixed)).collect()}
    assert not kept[1900] and all(k for i, k in kept.items() if i not in (500, 1900))
    even = quality_rules.thresholds(quality_rules._statistics(docs(spark, copies[:200]), "text", "lang", "source")).first()
    assert even.limit_symbols is None and all(r.kept for r in quality_rules.judged(docs(spark, copies[:200])).collect())
