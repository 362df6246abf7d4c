"""Merkle manifest, first-fit packing and ranked search against plain Python, on odd tables too."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import first_fit, lexical, merkle
from test_text_operators import LONG, ODD, docs, reference_ids


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout=3):
    """The root, and for each node the siblings of each level."""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % fanout : i - i % fanout + fanout]
            siblings[k] += [(run[: i % fanout], run[i % fanout + 1 :])]
        at = [i // fanout for i in at]
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], siblings


def plain_manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, siblings) for rows (doc_id, text, lang, source)."""
    groups = {}
    for i, text, lang, source in rows:
        groups.setdefault(source, []).append((i is not None, i or 0, plain_leaf(i, source, lang, 0, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf in sorted(groups[s])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    found = Counter()
    for s, upper in zip(names, above, strict=True):
        for (known, i, leaf), lower in zip(sorted(groups[s]), trees[s][1], strict=True):
            found[i if known else None, leaf, trees[s][0], root, "".join("".join(a + b) for a, b in lower + upper)] += 1
    return found


@pytest.mark.parametrize("block_levels", [1, 2, 7])
def test_manifest_equals_a_plain_tree(spark, block_levels):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 10, "é": 28, None: 82, "": 5, "z": 27}
    rows = [(1000 * k + 7 * i, f"text {i}", "en", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = merkle.manifest(docs(spark, rows).withColumn("grp", F.lit(1)).withColumn("leaf", F.lit("x")).repartition(5), block_levels=block_levels)
    found = got.withColumn("seen", F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof")))
    found = found.collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.seen) for r in found) == plain_manifest(rows)
    assert all(r.back == r.root for r in found)


def test_manifest_of_odd_rows(spark):
    got = [(r.doc_id, r.leaf, r.subroot, r.root) for r in merkle.manifest(docs(spark, ODD)).collect()]
    assert Counter(got) == Counter(k[:4] for k, n in plain_manifest(ODD).items() for _ in range(n))
    assert merkle.manifest(docs(spark, ODD).limit(0)).collect() == []
    one = merkle.manifest(docs(spark, ODD[:1])).first()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_changed_rows_are_found(spark):
    rows = [(i, f"line {i}\nnext" if i % 3 else "no line end", "en", "ab"[i % 2]) for i in range(60)]
    cropped = merkle.leaf_digest({c: F.col(c) for c in merkle.COLUMNS} | {"text": F.regexp_replace("text", "\n", "")})
    got = merkle.manifest(docs(spark, rows), claimed=cropped, block_levels=1).select("doc_id", (merkle.folded(F.col("claimed"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in got if not r.ok} == {i for i in range(60) if i % 3}


def plain_first_fit(lengths, capacity):
    rooms, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_ = next((b for b, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if bin_ == len(rooms):
            rooms.append(capacity)
        where[i] = (bin_, capacity - rooms[bin_])
        rooms[bin_] -= lengths[i]
    return [where[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_and_layout(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [65, 20, 64, 40][seed], [300, 1, 77, 500][seed])
    bins, offsets = first_fit.first_fit(lengths, 64)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_first_fit(lengths.tolist(), 64)
    laid = first_fit.laid_out(lengths, 64, tolerated=0)
    sizes = [sum(n for *_, n in s) for s in laid]
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes)  # nothing is padded
    held = sorted((i, a, n) for s in laid for i, a, n in s)
    for i, n in enumerate(lengths.tolist()):
        at = 0
        for _, a, k in (h for h in held if h[0] == i):
            assert a == at and k > 0
            at += k
        assert at == n
    assert first_fit.laid_out(np.zeros(0, np.int64)) == []


def test_sequences_hold_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(first_fit, "GROUP_DOCUMENTS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 90, int(rng.integers(0, 60)))), "en", "a") for i in range(300)] + ODD
    sequences = first_fit.packed_sequences(docs(spark, rows), capacity=128)
    found = sequences.collect()
    assert len({r.sequence_id for r in found}) == len(found) and sum(r.padded - r.length for r in found) < 0.02 * sum(r.length for r in found)
    texts, want = Counter(), Counter()
    pieces = sorted(((d is not None, d or 0, n, s), list(np.frombuffer(r.ids, f"<u{r.id_bytes}")[at : at + k])) for r in found for d, s, k, n, at in zip(r.doc_ids, r.starts, r.lengths, r.doc_tokens, np.cumsum([0, *r.lengths]), strict=False))
    for r in found:
        assert r.length == sum(r.lengths) == len(r.ids) // r.id_bytes <= 128 and r.padded == (r.length if r.length & (r.length - 1) == 0 else 128)
    for (_, d, _, _), ids in pieces:
        texts[d] += len(ids)
    for (d, *_), ids in zip(rows, reference_ids([r[1] or "" for r in rows]), strict=True):
        want[d or 0] += len(ids) + 1
    assert texts == want
    digests = first_fit.pieces_of(sequences).collect()
    assert sum(r.length for r in digests) == sum(want.values())
    assert first_fit.packed_sequences(docs(spark, ODD).limit(0)).collect() == []


def test_pieces_are_their_documents_ids(spark):
    rows = [(i, LONG[: 40 * i], "en", "a") for i in range(150)]
    ids = dict(zip([r[0] for r in rows], reference_ids([r[1] for r in rows]), strict=True))
    for r in first_fit.pieces_of(first_fit.packed_sequences(docs(spark, rows), capacity=512)).collect():
        whole = [*ids[r.doc_id], 2]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())


def plain_search(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [Counter(terms(t)) for t in rows.values()]
    held = [c for c in counts if c]
    big_n, big_l, df = len(held), sum(sum(c.values()) for c in held), Counter(t for c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for d, c in zip(rows, counts, strict=True):
            m = 50 + 50 * sum(c.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)))
            scored += [(-score, d, item)] if score > 0 else []
        found += [(i, rank, d, -s) for rank, (s, d, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize(("width", "block"), [(1 << 16, 1 << 17), (16, 20), (256, 60)])
def test_search_equals_scoring_everything(spark, monkeypatch, width, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "FIRST", 6)
    rng = np.random.default_rng(width)
    words = [f"W{i}" for i in range(60)] + ["é", "Ⅷa", "x_y", "a-b", "日本", "tab\tbed"]
    p = 1 / np.arange(1, len(words) + 1)
    make = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    rows = {i: make(int(rng.integers(1, 40))) for i in range(200)} | {300: None, 301: "", 302: "-- !!", 303: LONG, 304: " ".join(["w3"] * 400), 305: LONG.upper()}
    rows |= {400 + i: rows[5] for i in range(40)}  # equal scores
    items = [(i, make(int(rng.integers(1, 12)))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere else"), (93, rows[5]), (94, "word3 and4 W3")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, [(i, t, "en", "a") for i, t in rows.items()]).repartition(3)
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(df, benchmark, k=5, width=width).collect())
    assert got == plain_search(rows, items, 5)


def test_search_of_odd_tables(spark):
    benchmark = spark.createDataFrame([(1, "one words"), (1, "one words"), (None, "id")], "item_id long, text string")
    got = sorted(((r.item_id or 0, r["rank"], r.doc_id) for r in lexical.search(docs(spark, [*ODD, (None, "one two", "en", "a")]), benchmark).collect()), key=str)
    # repeated items and rows are ranked each; null keys come last among equal scores; the first row holds the rarer word
    assert Counter(got) == Counter({(0, 1, None): 1, (1, 1, None): 2, (1, 2, 6): 2, (1, 3, 6): 2, (1, 4, None): 2})
    assert lexical.search(docs(spark, ODD).limit(0), benchmark).collect() == []
    assert lexical.search(docs(spark, ODD), benchmark.limit(0)).collect() == []
