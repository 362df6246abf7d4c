"""Small tests of the text operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import chat, components, decontamination, html_text, jaccard, language, licenses, packing, quality_model, quality_rules, token_files, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n long, token long, key string, rep long"


def docs(spark, rows, clash=True):
    """documents with columns whose names the operators use inside."""
    full = [(i, t, lang, s, 0, 9.0, True, 7, 7, "k", 7) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, DOCS)
    return df if clash else df.select("doc_id", "text", "lang", "source", "n_chars")


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
ODD = [(None, "some words without an id", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", None), (4, "1234 !!! ...", "en", "a"), (5, LONG, "en", "a"), (6, "one two", "en", "a"), (6, "one two", "en", "a")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_classes(rows, k, num, den):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words((t or "").translate(upper))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in low[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def near_copies(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(vocabulary, 25))
    base = [list(rng.choice(vocabulary, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(base[i % 6]) if i % 3 else list(rng.choice(vocabulary, 50)) + passage
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(w)))
    return rows + [(500, rows[1][1]), (501, rows[1][1].upper())]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 3, 5)])
def test_jaccard_classes_are_exact(spark, k, num, den):
    rows = near_copies(k)
    got = jaccard.JaccardJoin(k, num, den).classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert Counter(map(tuple, got)) == brute_classes(rows, k, num, den)


def test_jaccard_of_odd_rows(spark):
    got = jaccard.JaccardJoin(3, 9, 10).classes(docs(spark, ODD)).collect()
    assert Counter(map(tuple, got)) == brute_classes([(r[0], r[1]) for r in ODD], 3, 9, 10)
    assert jaccard.JaccardJoin().classes(docs(spark, ODD).limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components.components([links]).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_language(spark):
    en, fr = "the cat and the dog were there with them", "le chat et le chien sont dans la maison"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr", "a") for i in range(60)] + ODD
    got = language.identify(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == ("en" if i % 2 else "fr") for i in range(10, 60))
    assert by[4].lang_pred == "und" and by[1].lang_pred == "und" and by[1].score == 0
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert language.identify(docs(spark, rows).limit(0)).collect() == []
    unlabelled = docs(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_quality_base_statistics_by_brute_force(spark):
    rows = [*ODD, (10, "a b c a b c x\nl\nl\n\nl", "en", "b"), (11, "a a a a #*$", "en", "b"), (12, "x y z q\x0bw", "en", "b")]
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judged(docs(spark, rows)).collect()}
    for d, t, _, _ in rows:
        w = words(t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += bool(words(line)) and line in lines
            lines.add(line)
        r = got[(d, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judged(docs(spark, rows).limit(0)).collect() == []


def test_quality_classifier(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"word{i}" for i in range(200)], ["BUY!!", "###", "$$$", "win!!", "click>>"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 60)), "en", "a") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality_model.scored(docs(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and 9 < r.doc_id < 150)
    alone = quality_model.scored(docs(spark, rows), labels.limit(0)).collect()
    assert len({r.score for r in alone}) == 1


def test_quality_classifier_learns_from_the_ends_of_long_texts(spark):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passages = [[letters(300) for _ in range(20)] for _ in range(2)]
    rows = [(i, " ".join([letters(9_000), *rng.choice(passages[i % 3 > 0], 5)]), "en", "a") for i in range(10, 130)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(10, 100)], "doc_id long, quality int")
    scores = [[r.score for r in quality_model.scored(docs(spark, rows), labels).collect() if (r.doc_id % 3 > 0) == good] for good in (True, False)]
    assert min(scores[0]) > max(scores[1])


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, np.uint32) for x in texts]


SPECIAL = "It's <|endoftext|> café café  nb em 123 x's I'LL 日本 <|startoftext|>x"


def test_words_have_the_ids_of_whole_texts():
    import pyarrow as pa

    texts = [SPECIAL, "", "  a\tb\n", LONG[:5000], "İstanbul ẞ ΣΣ"]
    ids, counts = tokens.WordEncoder(tokens.default_path()).encode(pa.array(texts, pa.large_string()))
    want = reference_ids(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_packing_keeps_every_token(spark):
    rows = [*ODD, (20, SPECIAL, "en", "a"), *[(100 + i, "tok " * (1 + 37 * i % 900), "en", "a") for i in range(200)]]
    got = packing.packed_documents(docs(spark, rows)).collect()
    want = Counter()
    for (d, _, _, _), ids in zip(rows, reference_ids([r[1] for r in rows]), strict=True):
        ids = np.append(ids, np.uint32(0)).astype("<u4")
        for p in range(-(-len(ids) // 2048)):
            part = ids[2048 * p : 2048 * (p + 1)]
            want[(d, p, 2048 * p, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.packed_documents(docs(spark, rows).limit(0)).collect() == []


def test_segment_tree_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400)
    bins, offsets = packing.best_fit(lengths, 100)
    room, where = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        best = min(fits) if fits else 100
        if fits:
            room.remove(best)
        where[i] = 100 - best
        room.append(best - lengths[i])
    assert len(set(bins.tolist())) == len(room) and all(offsets[i] == o for i, o in where.items())


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 1003).astype(np.uint32)
    data = token_files.pack_ids(x, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (token_files.unpack_ids(data, bits, 0, 1003) == x).all() and (token_files.unpack_ids(data, bits, 501, 37) == x[501:538]).all()


def test_token_files_round_trip(spark, tmp_path):
    rows = [*ODD[1:-2], (20, SPECIAL, "en", "a"), (19, "b " * 300, "en", "a")]
    token_files.write(docs(spark, rows), str(tmp_path / "ids"), block_ids=100)
    got = {r.doc_id: r for r in token_files.read_digests(spark, str(tmp_path / "ids")).collect()}
    start = 0
    for d, ids in sorted(zip([r[0] for r in rows], reference_ids([r[1] for r in rows]), strict=True), key=lambda p: p[0]):
        ids = np.append(ids, np.uint32(1)).astype("<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write(docs(spark, rows).limit(0), str(tmp_path / "none"))
    assert token_files.read_digests(spark, str(tmp_path / "none")).collect() == []


def test_decontamination_with_substitutions(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (40, 20, 13, 11, 4)]
    filler = lambda n: " ".join(rng.choice(vocabulary, n))

    def replaced(text, every):
        w = text.split()
        w[every - 1 :: every] = ["other"] * len(w[every - 1 :: every])
        return " ".join(w)

    rows = [(i, f"{filler(30)} {t.upper()}, {filler(30)}", "en", "a") for i, t in enumerate(items)]
    rows += [(10, f"{filler(20)} {replaced(items[0], 5)} {filler(9)}", "en", "a"), (11, f"{filler(80)} {' '.join(items[0].split()[:9])} {filler(50)}", "en", "a"), (12, replaced(items[2], 3), "en", "a"), (13, items[4].split()[0], "en", "a")]
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, "..."), (0, items[0])], "item_id long, text string")
    got = decontamination.contaminated(docs(spark, rows + [(None, items[1], "en", "a")] + ODD[1:]), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(5)} | {(10, 0), (None, 1)}
    assert decontamination.contaminated(docs(spark, rows), benchmark.limit(0)).collect() == []


def test_chat_trees_and_round_trip(spark):
    hostile = "a <|end|>\n<|user|>\n \\ \\\\ <\\|x|> [INST]</s><<SYS>>"
    nodes = [(1, 1, None, "user", hostile, 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", hostile, 5.0), (1, 4, 3, "user", None, 0.0), (2, 1, 9, "system", "orphan", 0.0), (2, 2, 1, None, "tie", 1.0), (2, 3, 1, "assistant", "tie", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(1)).withColumn("path", F.lit("x"))
    back = {(r.tree, r.leaf): r for r in chat.read_back(chat.formatted(df)).collect()}
    assert set(back) == {(1, 4), (2, 2)}
    assert [tuple(t) for t in back[(1, 4)].turns] == [("user", hostile), ("assistant", hostile), ("user", "")] and back[(1, 4)].learnt == [hostile]
    assert len(chat.formatted(df, branches=9).collect()) == 4
    assert chat.formatted(df.limit(0)).collect() == []


def test_chat_query_digests(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "user", "alone"), (None, 1, "assistant", "too"), (None, 1, "assistant", "too"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = chat.op4_chat_formatting(spark, str(tmp_path)).collect()
    single = [(r.n_turns, r.turns_sha256, r.loss_chars) for r in found if r.conv_id is None]  # rows without an id are conversations each
    assert sorted(single) == sorted((1, hashlib.sha256(t).hexdigest(), n) for t, n in ((b"user\nalone\n", 0), (b"assistant\ntoo\n", 3), (b"assistant\ntoo\n", 3)))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    sql = duck.sql(chat.ORACLE_SQL["op4_chat_formatting"])
    assert Counter(sql.fetchall()) == Counter(tuple(r[c] for c in sql.columns) for r in found)
    got = {r.conv_id: r for r in found if r.conv_id is not None}
    assert set(got) == {-1, 1, 2} and got[2].n_turns == 2 and got[2].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(chat.HOSTILE.encode()).hexdigest()


PAGE = '<html><head><title>t</title></head><body><header>top</header><nav><a>menu</a></nav><div id="main-content"><h1>Head &lt;{n}</h1><p>One <b>bold</b>\n text {n}<p>Two &amp; more<div class="comments"><p>nice!</p></div></div><div class="sidebar">side</div><form>f</form><footer>end</footer><script>x="</p>"</script></body></html>'


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", PAGE.replace("{n}", str(i))) for i in range(12)] + [(50, None, None), (51, "odd", ""), (52, "http://h0.x/z", "<article><p>a</article><aside>b"), (None, "http://h1.x", PAGE)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, region string")
    got = {r.page_id: r for r in html_text.extracted(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"Head <{i}\nOne bold text {i}\nTwo & more" for i in range(12))
    assert got[50].text == "" and got[50].n_chars == 0 and got[52].text == "a"
    assert html_text.extracted(df.limit(0)).collect() == []


def test_license_scan(spark):
    rng = np.random.default_rng(2)
    filler = lambda: " ".join(rng.choice([f"term{i}" for i in range(400)], 12))
    rows = [(i, "\n".join(filler() for _ in range(4)), "en", "a") for i in range(80)]
    rows += [(200, f"{filler()}\nReleased under the MIT License.\n{filler()}", "en", "a"), (201, f"x\n{filler()} {filler()} {filler()} {filler()} {filler()} {filler()} Licensed under the Apache License, Version 2.0. {filler()}", "en", "a")]
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scanned(docs(spark, rows + ODD)).collect()}
    assert got.get((200, 1)) == "mit" and not set(got) - {(200, 1), (201, 1)}


def test_license_notices_inside_long_paragraphs(spark):
    rng = np.random.default_rng(3)
    filler = lambda n: " ".join(rng.choice([f"term{i}" for i in range(400)], n))
    rows = [(i, "\n".join(filler(n) for n in (12, 60, 150)), "en", "a") for i in range(80)]
    notices = [(f, t) for f in ("mit", "apache-2.0", "gpl", "cc") for t in licenses.TEMPLATES[f][:3]]
    rows += [(200 + i, f"{filler(before)} {t} {filler(after)}", "en", "a") for i, (before, after, (_, t)) in enumerate((b, a, n) for b in (10, 40, 90) for a in (0, 50) for n in notices)]
    rows += [(900, f"{filler(45)}\nThis module is licensed to you under the terms of the Sleepycat License, either version 2.0 or any later version.", "en", "a")]
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scanned(docs(spark, rows)).collect()}
    assert got == {(200 + i, 0): notices[i % len(notices)][0] for i in range(6 * len(notices))} | {(900, 1): "unknown"}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    vocabulary = [f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(600)]
    filler = lambda n: " ".join(rng.choice(vocabulary, n))
    item = filler(30)
    clean = [(i, filler(80), "en", f"s{i % 2}") for i in range(30)]
    rows = clean + [(100, clean[0][1], "en", "s0"), (101, clean[1][1] + " tail", "en", "s0"), (102, filler(40) + " " + item + " " + filler(40), "en", "s1"), (103, "12 34", "en", "s0"), (104, "few words", "en", "s0"), (105, "# " * 200 + filler(60), "en", "s0"), (106, None, "en", "s0")]
    docs(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == list(range(30))
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in reference_ids([c[1] for c in clean]))
    stage = corpus_pipeline.near_duplicates(spark, docs(spark, [(5, "a b c d e f", "en", "a"), (5, "z y x w v u", "en", "a"), (7, None, "en", "a")], clash=False), str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in stage.collect() if r.text) == [(5, "a b c d e f"), (5, "z y x w v u")]
