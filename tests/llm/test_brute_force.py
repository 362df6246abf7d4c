"""Text operators against plain Python: naive Bayes, spaced seeds, compression, random access, thresholds, and odd tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from framewright.llm import chat, common, decontamination, language, licenses, packing, quality_model, quality_rules, token_files, tokens
from test_text_operators import LONG, ODD, docs, reference_ids


def test_language_by_a_plain_naive_bayes(spark):
    rng = np.random.default_rng(2)
    vocabulary = {"en": ["the", "house", "with", "Garden", "over"], "de": ["der", "Haus", "mit", "Gärten", "über"], "fr": ["le", "maison", "avec", "jardin", "où"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 8)) + ("!? 7" if i % 5 else ""), lang, "a") for i, lang in enumerate(["en", "de", "fr"] * 40)]
    df = docs(spark, rows)
    model = language.fit(df)

    def grams(text):
        """Hashed n-grams, one of each order ending at each letter, a run of anything but letters being one space."""
        folded = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
        folded = re.sub(" +", " ", folded)
        out = []
        for k, n in enumerate(language.ORDERS):
            for i, c in enumerate(folded):
                if c != " ":
                    h = n
                    for back in range(n):
                        h = (h + ord(folded[i - back] if i >= back else " ")) * 0x9E3779B97F4A7C15 % 2**64
                        h ^= h >> 29
                    out.append(k * language.BUCKETS + (h >> 40) % language.BUCKETS)
        return out

    counts = defaultdict(Counter)
    hashes = {r.doc_id: r.u for r in df.select("doc_id", F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(8)).alias("u")).collect()}
    for i, text, lang, _ in rows:
        if hashes[i]:
            counts[lang].update(grams(text))
    got = {r.doc_id: r for r in df.select("doc_id", language.predictor(df, model)("text").alias("p")).select("doc_id", "p.*").collect()}
    for i, text, _, _ in rows[:60]:
        like = {}
        for lang, c in counts.items():
            totals = [sum(v for b, v in c.items() if b // language.BUCKETS == k) + 0.1 * language.BUCKETS for k in range(len(language.ORDERS))]
            like[lang] = sum(math.log((c[b] + 0.1) / totals[b // language.BUCKETS]) for b in grams(text)) / len(language.ORDERS)
        best = max(like, key=like.get)
        assert got[i].lang_pred == best and not got[i].foreign
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - like[best]) for v in like.values()), abs=1e-3)


def test_foreign_texts_and_many_languages(spark):
    rows = [(i, f"{chr(97 + i % 20)}a{chr(98 + i % 20)}o " * 30, f"l{i % 20:02}", "a") for i in range(2_000)]
    df = docs(spark, rows)
    model = language.fit(df)
    odd = spark.createDataFrame([("это русский текст о погоде и природе",), ("baco baco baco",), ("z",), ("77",), (None,)], "text string")
    got = [r.p.foreign for r in odd.select(language.predictor(df, model)("text").alias("p")).collect()]
    assert len(model.languages) == 20 and got == [True, False, False, False, False]


def test_parts_of_long_texts_are_whole_words():
    text = "".join(f"word{i} \n" for i in range(3_000)) + "x" * 9_000
    for limit in (100, 5_000):
        found = list(common.parts_of(pa.array(["a b", text, None, "c"], pa.string()), limit))
        by = defaultdict(str)
        for owner, part in found:
            for o, p in zip(owner.tolist(), part.to_pylist(), strict=True):
                by[o] += p
        assert [by[i] for i in range(4)] == ["a b", text, "", "c"]
        assert all(p[-1:] in " \n" or text.endswith(p) for o, part in found for i, p in zip(o.tolist(), part.to_pylist(), strict=True) if i == 1)


def test_tokens_of_odd_words_and_forgotten_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    signs = list("aAzZ09'\"<|>.,!#_- \n\téÉßÆŁİıſǅɏȺ×÷²½ªº日Σςµ́sTreLVEdD")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(2_000)] + [LONG[:30_000]]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 3_000)
    ids, counts = tokens.WordEncoder(tokens.default_path()).encode(pa.array(texts, pa.large_string()))
    want = reference_ids(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_limits_follow_the_group(spark):
    rng = np.random.default_rng(4)
    words = lambda n, size: " ".join("".join(rng.choice(list("abcdefgh"), size + int(rng.integers(0, 3)))) for _ in range(n))
    rows = [(i, words(80, 4 if i % 2 else 9), "en", f"s{i % 2}") for i in range(400)] + [(1000, words(80, 9), "en", "s1"), (1001, words(80, 9), "en", "s0"), (1002, words(80, 4), "fr", "s9")]
    df = docs(spark, rows)
    stats = quality_rules._statistics(df, "text", "lang", "source", doc_id=F.col("doc_id")).cache()
    limits = {(r.lang, r.source): r for r in quality_rules.thresholds(stats).collect()}
    assert limits["en", "s0"].limit_word_length > 9_000 > 7_000 > limits["en", "s1"].limit_word_length
    values = sorted(r.word_chars * 1000 // r.n_words for r in stats.collect())
    mid, high = values[-(-len(values) // 2) - 1], values[-(-3 * len(values) // 4) - 1]
    assert limits["fr", "s9"].limit_word_length == pytest.approx(high + 12 * (high - mid), rel=0.03)  # too few rows: those of all documents
    kept = {r.doc_id: r.kept for r in quality_rules.judged(df).collect()}
    assert not kept[1000] and kept[1001] and kept[1002]
    assert {r.doc_id for r in quality_rules.passing(df).collect()} == {d for d, k in kept.items() if k}


def test_repeated_ids_are_judged_by_their_own_text(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "a"), (1, "short", "en", "a"), (None, good, "en", "a"), (2, good, None, None)]
    assert Counter((r.doc_id, r.text == good) for r in quality_rules.passing(docs(spark, rows)).collect()) == Counter([(1, True), (None, True), (2, True)])


def test_decontamination_by_all_alignments(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [list(rng.choice(vocabulary, 30)) for _ in range(12)]
    rows = []
    for i in range(60):
        d = list(rng.choice(vocabulary, int(rng.integers(5, 70))))
        item = items[i % 12][: int(rng.integers(8, 31))]
        for _ in range(i % 5):
            item[int(rng.integers(0, len(item)))] = "other"
        at = int(rng.integers(0, len(d) + 1))
        rows.append((i, " ".join(d[:at] + item + d[at:]), "en", "a"))
    rows.append((500, LONG + " " + " ".join(items[3]) + " " + LONG, "en", "a"))
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")

    def found(d, q):
        for shift in range(-len(q), len(d)):
            same = [q[j] == d[j + shift] for j in range(max(0, -shift), min(len(q), len(d) - shift))]
            if any(sum(same[k : k + 13]) >= 10 for k in range(len(same) - 12)):
                return True
        return False

    want = {(i, k) for i, t, _, _ in rows[:-1] for k, q in enumerate(items) if found(t.split(), q)} | {(500, 3)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs(spark, rows + [rows[0]]), benchmark).collect()}
    assert got == want


def test_scores_by_zstandard(spark):
    rng = np.random.default_rng(6)
    good, bad = [f"word{i}" for i in range(200)], ["BUY!!", "###", "$$$", "win!!"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 60)), "en", "a") for i in range(90)] + [(5, "another text of five", "en", "a")] * 3
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(7, 1)] * 50, "doc_id long, quality int")
    df = docs(spark, rows)
    (dictionaries, w) = quality_model.fit(df, labels)
    makers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_checksum=False, write_content_size=False, write_dict_id=False) for d in dictionaries]
    got = df.select("text", quality_model.scorer(df, (dictionaries, w))("text").alias("s")).collect()
    for r in got:
        a, b = (len(m.compress(r.text.encode())) for m in makers)
        x, left = 10 * (b - a) / (a + b), min(a, b) / len(r.text.encode())
        assert r.s == pytest.approx(1 / (1 + math.exp(-(w[0] * x + w[1] * x * left + w[2] * left + w[3]))), abs=1e-9)
    assert quality_model.scored(df.limit(0), labels).collect() == []


def test_token_files_of_null_ids_and_repeated_rows_and_random_access(spark, tmp_path):
    rows = [*ODD, *[(9, f"some {i} text " * (i % 7), "en", "a") for i in range(20)], *[(30, "twin twin", "en", "a")] * 9]
    folder = str(tmp_path / "ids")
    token_files.write(docs(spark, rows).repartition(3), folder, block_ids=64)
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, folder).collect())
    want = Counter()
    for (d, *_), ids in zip(rows, reference_ids([r[1] for r in rows]), strict=True):
        ids = np.append(ids, np.uint32(1)).astype("<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert got == want
    whole = token_files.read_ids(spark, folder, 0, 10**9)
    assert len(whole) == sum(n * c for (_, n, _), c in want.items())
    for first, n in ((0, 5), (17, 300), (len(whole) - 3, 50), (len(whole), 4)):
        assert token_files.read_ids(spark, folder, first, n).tolist() == whole[first : first + n].tolist()
    assert [len(x) for x in token_files.read_document(spark, folder, 30)] == [len(reference_ids(["twin twin"])[0]) + 1] * 9
    assert token_files.read_document(spark, folder, 12345) == []


def test_repeated_rows_are_dealt_to_several_groups(spark):
    found = spark.range(4_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    got = packing.pack(found, 2048, 500).groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("o")).collect()
    assert sum(r.n for r in got) == 4_000 and max(r.n for r in got) == 6 and len(got) <= 4_000 / 6 + 9 and len({r.sequence_id >> 33 for r in got}) > 2


def test_chat_of_a_long_conversation_and_an_empty_table(spark, tmp_path):
    spark.range(3_000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id").alias("text")).write.parquet(str(tmp_path / "long" / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op4_chat_formatting(spark, str(tmp_path / "long")).collect()}
    assert got[5].n_turns == 3_000 and got[5].loss_chars == sum(len(f"turn {i}") for i in range(1, 3_000, 2))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r.conv_id for r in chat.op4_chat_formatting(spark, str(tmp_path / "none")).collect()] == [-1]


def test_branches_by_all_paths(spark):
    rng = np.random.default_rng(3)
    nodes = [(t, i, int(rng.integers(0, i)) if i and rng.random() < 0.9 else None, "user", f"{t}-{i}", float(rng.integers(0, 5))) for t in range(6) for i in range(25)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    parent, score = {(t, i): p for t, i, p, *_ in nodes}, {(t, i): s for t, i, _, _, _, s in nodes}
    want = set()
    for t in range(6):
        paths = []
        for i in set(range(25)) - {parent[t, j] for j in range(25)}:
            path = [i]
            while parent[t, path[0]] is not None:
                path.insert(0, parent[t, path[0]])
            paths.append((-sum(score[t, n] for n in path), i, tuple(path)))
        want |= {(t, leaf, path) for _, leaf, path in sorted(paths)[:3]}
    got = defaultdict(list)
    for r in chat.paths(df, 3).collect():
        got[r.tree, r.leaf].append((r["at"], r.node))
    assert {(t, leaf, tuple(n for _, n in sorted(p))) for (t, leaf), p in got.items()} == want
    assert all([a for a, _ in sorted(p)] == list(range(1, len(p) + 1)) for p in got.values())


def test_licences_by_family_and_in_odd_tables(spark):
    rng = np.random.default_rng(12)
    filler = lambda n: " ".join(rng.choice([f"term{i}" for i in range(400)], n))
    rows = [(i, "\n".join(filler(n) for n in (12, 60)), "en", "a") for i in range(80)]
    notices = [(f, t) for f, texts in sorted(licenses.TEMPLATES.items()) for t in texts]
    rows += [(200 + i, f"{filler(12)}\n{t}\n{filler(12)}", "en", "a") for i, (_, t) in enumerate(notices)]
    rows += [(900 + i, f"{filler(20)}\n{t}", "en", "a") for i, t in enumerate(licenses.UNLICENSED[10:])] + [rows[85], (None, notices[0][1], "en", "a")]
    got = {(r.doc_id, r.paragraph): r for r in licenses.scanned(docs(spark, rows + ODD)).collect()}
    assert {k: r.family for k, r in got.items() if k[0] is None or k[0] < 900} == {(200 + i, 1): f for i, (f, _) in enumerate(notices)} | {(None, 0): notices[0][0]}
    assert not [k for k in got if k[0] is not None and k[0] >= 900]
    assert licenses.scanned(docs(spark, rows).limit(0)).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    vocabulary = [f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(600)]
    filler = lambda n: " ".join(rng.choice(vocabulary, n))
    item, twin = filler(30), filler(80)
    clean = [(i, filler(80), "en", "s0") for i in range(25)]
    rows = clean + [(None, twin, "en", "s0"), (7, twin, "en", "s0"), (3, filler(70), "en", None), (3, "too short", "en", None), (None, filler(30) + " " + item + " " + filler(30), "en", "s0"), (8, None, None, None)]
    docs(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter([*range(25), 3, 7])
    (tmp_path / "empty").mkdir()
    docs(spark, rows, clash=False).limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
