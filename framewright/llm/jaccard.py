"""N-gram Jaccard join over a token-group matrix.

Documents are sets of hashed word shingles; equal sets are one class. Classes with the same min-hashes form groups of
bounded size, and a group keeps the union of its members' tokens. A class is a query: the groups it can link with share one
of its group's rarest tokens (all but t * n of a set's n tokens can be missing from a linked set, so one of any (1 - t) * n + 1
is shared), and only those whose token union could overlap enough are opened and compared member by member.

What is wanted are components, so pairs already connected need no comparison. Each class is first compared with the first
member of its group and with one class that shares most of its rare tokens, twice; what is opened after that are groups
with members outside the query's component. A family of many near copies thus takes a few comparisons a document, and no
link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from framewright.llm.common import coded, cut, discard, mix, slices, small_batches, split_words, starts_of, tidied, word_hashes
from framewright.llm.components import extended

#: Text bytes whose shingles are taken together: each takes some 60 bytes on the way.
SLICE_BYTES = 1_000_000
GROUP_MEMBERS = 32
#: Groups of one token that a task takes at a time.
TOKEN_GROUPS = 256
#: One in so many pairs of groups that are apart is opened before the others.
OPENED_FIRST = 16
#: Slots of the table that tells how often a token occurs, by the leading bits of its hash: 4 MB, whatever the input.
SLOTS = 1 << 22
#: Bits of the filters that tell which tokens occur twice and which documents have candidates: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 63-bit hashes, and how many each has; A-Z are lower-cased.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    flat, counts = split_words(texts)
    codes, distinct = coded(flat)
    hashes = word_hashes(pc.ascii_lower(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    first = starts_of(counts)
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    at = np.repeat(first - starts_of(n), n) + np.arange(n.sum())
    span = np.minimum(counts, words)
    size = np.repeat(span, n)
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(words):
        part = hashes[np.minimum(at + i, max(0, len(hashes) - 1))] if len(hashes) else hashes
        h = np.where(i < size, (h ^ part) * np.uint64(0x9E3779B97F4A7C15), h)
        h ^= h >> np.uint64(32)
    h = mix(h) >> np.uint64(1)
    owner = np.repeat(np.arange(len(counts)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new].astype(np.int64), np.bincount(owner[new], minlength=len(counts))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))


def _digests(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two digests of each set and a key that similar sets are likely to share, by two min-hashes."""
    u, full, out = h.astype(np.uint64), n > 0, []
    for salt, fold in ((0x1234567, np.add), (0x89ABCDEF01, np.add), (0x5555AAAA77, np.minimum), (0x3C3C3C3C11, np.minimum)):
        values = np.zeros(len(n), np.uint64)
        if full.any():
            values[full] = fold.reduceat(mix(u ^ np.uint64(salt)), starts_of(n)[full])
        out.append(values)
    return [out[0].view(np.int64), out[1].view(np.int64), mix(out[2] * np.uint64(31) + out[3]).view(np.int64)]


class JaccardJoin:
    """The join of documents with themselves at a Jaccard similarity of num / den or more over shingles of so many words."""

    def __init__(self, words: int = 5, num: int = 4, den: int = 5):
        self.words, self.num, self.den = words, num, den
        #: Tokens with a hash under this are counted, and ordered before all others: twice as many as a prefix takes.
        self.tier = int(min(1.0, 2.2 * (1 - num / den)) * (2**63 - 1))

    def _prefix(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n - -(-self.num * n // self.den) + 1, 0)

    def sets(self, documents: DataFrame, text: str, key: str) -> DataFrame:
        """A row for each document: n, the digests, and the tokens that a prefix can hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in slices(batch.column("text"), SLICE_BYTES):
                    h, n = shingles(texts, self.words)
                    owner = np.repeat(np.arange(len(n)), n)
                    rank = np.arange(len(h)) - starts_of(n)[owner]
                    pooled = (h < self.tier) | (rank < self._prefix(n)[owner])
                    d1, d2, group = _digests(h, n)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), "n": pa.array(n), "d1": pa.array(d1), "d2": pa.array(d2), "alike": pa.array(group), "pool": _lists(h[pooled], np.bincount(owner[pooled], minlength=len(n)))})

        rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        return rows.mapInArrow(tidied(run), "doc_id long, n long, d1 long, d2 long, alike long, pool array<long>")

    def _levels(self, sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the counted tokens that occur more than once, and by slot the logarithm of how often its most frequent
        token occurs. An eighth of the bits or slots at most are used; with more such tokens the least frequent are left out.
        """
        counted = sets.select(F.explode("pool").alias("t")).where(F.col("t") < self.tier).groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
        counted = cut(counted.select("t", F.floor(F.log2("c")).cast("int").alias("level")), "frequent")
        sizes = {r.level: r.n for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()}

        def least(room: int) -> int:
            return next((level for level in sorted(sizes) if sum(n for k, n in sizes.items() if k >= level) <= room // 8), max(sizes, default=0))

        word, bit = F.shiftright("t", 63 - FILTER_BITS.bit_length() + 1 + 6), F.expr(f"cast(shiftright(t, {63 - FILTER_BITS.bit_length() + 1}) & 63 as int)")
        words = counted.where(F.col("level") >= least(FILTER_BITS)).groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("flag")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[words.column("word").to_numpy()] = words.column("flag").to_numpy().view(np.uint64)
        slots = counted.where(F.col("level") >= max(2, least(SLOTS))).groupBy(F.shiftright("t", 63 - SLOTS.bit_length() + 1).alias("slot")).agg(F.max("level").alias("level")).toArrow()
        table = np.zeros(SLOTS, np.uint8)
        table[slots.column("slot").to_numpy()] = slots.column("level").to_numpy()
        return bits, table

    def _rank(self, h: np.ndarray, bits: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The order of tokens, the same for all sets: rare ones first, uncounted ones last; ties go by hash."""
        place = h >> (63 - FILTER_BITS.bit_length() + 1)
        often = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return np.where(h >= self.tier, 64, np.where(often, np.maximum(1, table[h >> (63 - SLOTS.bit_length() + 1)]), 0))

    def _shared_prefixes(self, full: DataFrame, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """(token, rep, n, c, rest): the rarest of a set's c shared tokens, as many as not all can be missing from a linked set,
        and how many there are from each token on."""
        shared = full.sparkSession.sparkContext.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy()
                counts = batch.column("tokens").value_lengths().to_numpy().astype(np.int64)
                h = batch.column("tokens").flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), counts)
                order = np.lexsort((h, self._rank(h, *shared.value), owner))
                rank = np.arange(len(h)) - starts_of(counts)[owner]
                chosen = order[rank <= (counts + (-self.num * n // self.den))[owner]]
                at = owner[chosen]
                yield pa.RecordBatch.from_pydict({"token": pa.array(h[chosen]), "rep": batch.column("rep").take(pa.array(at)), "n": pa.array(n[at]), "c": pa.array(counts[at]), "rest": pa.array(counts[at] - rank[rank <= (counts + (-self.num * n // self.den))[owner]])})

        return full.mapInArrow(tidied(run), "token long, rep long, n long, c long, rest long")

    def _rare_tokens(self, sets: DataFrame, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """(token, uid): the rarest tokens of every set, without tokens that only one set has among its rarest."""
        shared = sets.sparkSession.sparkContext.broadcast(levels)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy()
                counts = batch.column("pool").value_lengths().to_numpy().astype(np.int64)
                h = batch.column("pool").flatten().to_numpy()
                owner = np.repeat(np.arange(len(n)), counts)
                order = np.lexsort((h, self._rank(h, *shared.value), owner))
                rank = np.arange(len(h)) - starts_of(counts)[owner]
                chosen = order[rank < self._prefix(n)[owner]]
                yield pa.RecordBatch.from_pydict({"token": pa.array(h[chosen]), "uid": batch.column("uid").take(pa.array(owner[chosen]))})

        def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # the last row so far, and whether it was given out
            for batch in batches:
                if not batch.num_rows:
                    continue
                token = batch.column("token").to_numpy()
                same = token[1:] == token[:-1]
                follows = held is not None and held[0].column("token")[0].as_py() == token[0]
                if follows and not held[1]:
                    yield held[0]
                kept = np.concatenate(([follows], same)) | np.concatenate((same, [False]))
                yield batch.filter(pa.array(kept))
                held = batch.slice(batch.num_rows - 1), bool(kept[-1])

        rows = sets.where("n > 0").select("uid", "n", "pool").mapInArrow(tidied(prefixes), "token long, uid long")
        return rows.repartition("token").sortWithinPartitions("token").mapInArrow(tidied(twice), "token long, uid long")

    def _full_sets(self, documents: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
        """(rep, tokens) of the classes in wanted (rep, doc_id, n, d1, d2), read again from their texts."""

        def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = self._bits(batch.column("doc_id"))
                yield pa.RecordBatch.from_pydict({"word": pa.array(bits >> 6), "flag": pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))})

        words = wanted.select("doc_id").mapInArrow(tidied(flags), "word long, flag long").groupBy("word").agg(F.bit_or("flag").alias("flag")).toArrow()
        table = np.zeros(FILTER_BITS // 64, np.uint64)
        table[words.column("word").to_numpy()] = words.column("flag").to_numpy().view(np.uint64)
        shared = documents.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = self._bits(batch.column("doc_id"))
                batch = batch.filter(pa.array((shared.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1))
                for first, texts in slices(batch.column("text"), SLICE_BYTES):
                    h, n = shingles(texts, self.words)
                    d1, d2, _ = _digests(h, n)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), "n": pa.array(n), "d1": pa.array(d1), "d2": pa.array(d2), "tokens": _lists(h, n)})

        rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), "doc_id long, n long, d1 long, d2 long, tokens array<long>")
        w = wanted.withColumnsRenamed({"doc_id": "_id"})
        return rows.join(w, ["n", "d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("rep").agg(F.first("tokens").alias("tokens"))

    @staticmethod
    def _bits(ids: pa.Array) -> np.ndarray:
        return (mix(ids.fill_null(-1).to_numpy().view(np.uint64)) >> np.uint64(20)).astype(np.int64) & (FILTER_BITS - 1)

    def _shared_tokens(self, full: DataFrame) -> DataFrame:
        """(rep, n, tokens): the tokens that another set may have too; a set with too few of them to be linked goes.

        Tokens of one set only can't be in an overlap. Which tokens occur twice is told by bits, so a few others may stay.
        """
        place = 63 - FILTER_BITS.bit_length() + 1
        twice = full.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
        flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr(f"cast(shiftright(t, {place}) & 63 as int)"))
        words = twice.groupBy(F.shiftright("t", place + 6).alias("word")).agg(F.bit_or(flag).alias("flag")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[words.column("word").to_numpy()] = words.column("flag").to_numpy().view(np.uint64)
        shared = full.sparkSession.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = batch.column("tokens").value_lengths().to_numpy().astype(np.int64)
                h = batch.column("tokens").flatten().to_numpy()
                at = h >> place
                kept = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                owner = np.repeat(np.arange(len(counts)), counts)
                n = np.bincount(owner[kept], minlength=len(counts))
                lists = _lists(h[kept], n)
                out = pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "n": batch.column("n"), "tokens": lists})
                yield out.filter(pa.array(self.den * n >= self.num * batch.column("n").to_numpy()))

        return full.mapInArrow(tidied(run), "rep long, n long, tokens array<long>")

    def _enough(self, both: Column, x: Column, y: Column) -> Column:
        return (self.num + self.den) * both >= self.num * (x + y)

    def _linked(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sets are similar enough."""
        a = full.select(F.col("rep").alias("a"), F.col("n").alias("_m"), F.col("tokens").alias("_x"))
        b = full.select(F.col("rep").alias("b"), F.col("n").alias("_n"), F.col("tokens").alias("_y"))
        both = F.size(F.array_intersect("_x", "_y"))
        return cut(pairs.join(a, "a").join(b, "b").where(self._enough(both, F.col("_m"), F.col("_n"))).select("a", "b"), "links")

    def _star(self, rare: DataFrame, comp: DataFrame, seed: int) -> DataFrame:
        """For each class one pair (a, b): with the class that is first, by seed, in most of its rare tokens and outside its component."""
        rows = rare.join(comp, "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
        first = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(seed)).alias("h"), F.col("rep").alias("b"), F.col("comp").alias("_c"), F.col("n").alias("_n"), F.col("c").alias("_s"))).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        met = rows.join(first.where("lo < hi").select("token", "f.b", "f._c", "f._n", "f._s"), "token").where((F.col("comp") != F.col("_c")) & self._enough(F.least("c", "_s"), F.col("n"), F.col("_n")))
        votes = met.groupBy("rep", "b").agg(F.count("*").alias("v")).groupBy("rep").agg(F.max(F.struct("v", "b")).alias("m"))
        return votes.select(F.least("rep", "m.b").alias("a"), F.greatest("rep", "m.b").alias("b")).distinct()

    @staticmethod
    def _met(rare: DataFrame) -> DataFrame:
        """The rows of tokens that more than one class has."""
        several = rare.groupBy("token").agg(F.count("*").alias("_c")).where("_c > 1").select("token")
        return rare.join(several, "token", "left_semi")

    def _near(self, matrix: DataFrame) -> DataFrame:
        """(g, o): pairs of groups that may hold a link, from matrix (token, g, lo, hi, rest): of the sets with the token in a
        group, the least and largest size, and the most tokens from it on.

        Of the tokens that two linked sets share, the first in order has at least their overlap from it on in both, so that the
        pair is found at that token; tokens that stand behind too many others, such as those of a common passage, find nothing.
        The groups of a frequent token are dealt to parts of TOKEN_GROUPS, each met by all groups of the token, so that no task
        has more than one part.
        """
        sizes = matrix.groupBy("token").agg(F.ceil(F.count("*") / TOKEN_GROUPS).cast("int").alias("parts"))
        dealt = cut(matrix.join(sizes, "token"), "dealt")
        left = dealt.withColumn("part", F.expr("cast(pmod(xxhash64(g), parts) as int)"))
        right = dealt.select("token", F.col("g").alias("o"), *[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "rest")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
        sized = (self.den * F.col("hi") >= self.num * F.col("_lo")) & (self.den * F.col("_hi") >= self.num * F.col("lo"))
        pair = (left["token"] == right["token"]) & (F.col("part") == F.col("_part")) & (F.col("g") <= F.col("o")) & sized & self._enough(F.least("rest", "_rest"), F.col("lo"), F.col("_lo"))
        return left.join(right, pair).select("g", "o").distinct()

    def _overlapping(self, near: DataFrame, member: DataFrame, full: DataFrame) -> DataFrame:
        """Those of near (g, o) whose token unions have enough in common for sets of the groups' least sizes."""
        asked = near.select("g").union(near.select("o")).distinct()
        union = F.array_distinct(F.flatten(F.collect_list("tokens")))
        held = member.join(asked, "g", "left_semi").select("g", "rep", "n").join(full.select("rep", "tokens"), "rep")
        unions = cut(held.groupBy("g").agg(union.alias("union"), F.min("n").alias("n_lo")), "unions")
        other = unions.select(F.col("g").alias("o"), F.col("union").alias("_union"), F.col("n_lo").alias("_n_lo"))
        pairs = near.join(unions, "g").join(other, "o").where(self._enough(F.size(F.array_intersect("union", "_union")), F.col("n_lo"), F.col("_n_lo")))
        return cut(pairs.select("g", "o"), "overlapping")

    @staticmethod
    def _about(member: DataFrame) -> DataFrame:
        """Of each group the sizes and components that its members have."""
        return member.groupBy("g").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("c").alias("c_hi"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))

    @staticmethod
    def _members(groups: DataFrame, labels: DataFrame) -> DataFrame:
        reached = groups.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        return cut(reached.withColumn("comp", F.coalesce("label", "rep")).drop("label"), "members")

    def _opened(self, rare: DataFrame, labels: DataFrame, groups: DataFrame, full: DataFrame) -> DataFrame:
        """labels (node, label) of all links, from those of some: the rest is found in the groups that queries open.

        rare: (token, rep, rest); groups: (rep, n, c, g), c being the size of the shared tokens. Of each pair of groups that may
        hold a link single members are compared first; then some of the pairs that are still apart are opened, which connects most
        of a large cluster with few links, and then all that are apart after that.
        """
        member = self._members(groups, labels)
        rows = rare.select("token", "rep", "rest").join(member, "rep")
        open_ = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        rows = cut(rows.join(open_, "token", "left_semi"), "queries")
        matrix = cut(rows.groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest")), "matrix")
        near = self._overlapping(cut(self._near(matrix), "near"), member, full)
        for seed in (4, 5):
            one = member.groupBy("g").agg(F.min(F.struct(F.xxhash64("rep", F.lit(seed)).alias("h"), "rep", "comp")).alias("m")).select("g", F.col("m.rep").alias("a"), F.col("m.comp").alias("ca"))
            pairs = near.join(one, "g").join(one.toDF("o", "b", "cb"), "o").where("ca != cb")
            labels = extended(labels, self._linked(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), full))
            member = self._members(groups, labels)
            near = self._apart(near, member)
        some = F.pmod(F.xxhash64("g", "o"), F.lit(OPENED_FIRST)) == 0
        labels = extended(labels, self._between(near.where(some), member, full))
        member = self._members(groups, labels)
        return extended(labels, self._between(self._apart(near.where(~some), member), member, full))

    def _apart(self, near: DataFrame, member: DataFrame) -> DataFrame:
        """Those of near (g, o) that aren't of one component together."""
        comps = self._about(member).select("g", "c1", "c2")
        apart = (F.col("c1") != F.col("_c1")) | (F.col("c2") != F.col("_c2")) | (F.col("c1") != F.col("c2"))
        return cut(near.join(comps, "g").join(comps.toDF("o", "_c1", "_c2"), "o").where(apart).select("g", "o"), "apart")

    def _between(self, near: DataFrame, member: DataFrame, full: DataFrame) -> DataFrame:
        """(a, b): the links between members of different components of each pair of groups in near."""
        opened = near.join(self._about(member).withColumnRenamed("g", "o"), "o").withColumnRenamed("g", "_g")
        fits = (self.den * F.col("n_hi") >= self.num * F.col("n")) & self._enough(F.least("c", "c_hi"), F.col("n"), F.col("n_lo"))
        other = (F.col("c1") != F.col("comp")) | (F.col("c2") != F.col("comp"))
        candidates = cut(member.join(opened, (F.col("g") == F.col("_g")) & fits & other).select("rep", "n", "c", "comp", "o", "n_lo"), "candidates")
        tokens = full.select("rep", "tokens")
        wanted = candidates.select(F.col("o").alias("g")).distinct()
        held = member.join(wanted, "g", "left_semi").join(tokens, "rep").groupBy(F.col("g").alias("o")).agg(F.collect_list(F.struct("rep", "n", "c", "comp", "tokens")).alias("members"))
        held = held.withColumn("union", F.array_distinct(F.flatten("members.tokens")))
        least = F.greatest(self.num * F.col("n") / self.den, self.num * (F.col("n") + F.col("n_lo")) / (self.num + self.den))
        asked = candidates.join(tokens, "rep").join(held, "o").where(F.size(F.array_intersect("tokens", "union")) >= least)
        linked = F.filter("members", lambda m: (m.comp != F.col("comp")) & self._enough(F.least(m.c, F.col("c")), m.n, F.col("n")) & self._enough(F.size(F.array_intersect(m.tokens, F.col("tokens"))), m.n, F.col("n")))
        found = asked.select("rep", F.explode(F.transform(linked, lambda m: m.rep)).alias("_rep"))
        return cut(found.select(F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b")).distinct(), "links")

    def classes(self, documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id, n_shingles and component_id of every row: the smallest doc_id that links reach from it, its own included.

        Null and empty texts and texts without words have no shingles and no links. Rows with the same set are linked, so
        repeated rows are. Null ids take part; a component of null ids alone has a null id. An empty table gives none.
        Other columns are not read.
        """
        small_batches(documents.sparkSession)
        sets = cut(self.sets(documents, text, key).withColumn("uid", F.monotonically_increasing_id()), "sets")
        slim = cut(sets.select("uid", "doc_id", "n", "d1", "d2", "alike"), "slim")
        digest = ["n", "d1", "d2"]
        classes = cut(slim.where("n > 0").groupBy(*digest).agg(F.min(F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "uid", "alike")).alias("m")).select(*digest, F.col("m.uid").alias("rep"), "m.doc_id", "m.alike"), "classes")
        levels = self._levels(sets)
        first = cut(self._rare_tokens(sets, levels), "rare")
        reps = slim.select("uid", *digest).join(classes.drop("doc_id", "alike"), digest).select("uid", "rep")
        rare = cut(first.join(reps, "uid").select("token", "rep").distinct(), "rare")
        discard(sets, first)
        wanted = cut(classes.join(self._met(rare).select("rep").distinct(), "rep", "left_semi"), "wanted")
        full = cut(self._full_sets(documents, wanted.select("rep", "doc_id", *digest), text, key).join(wanted.select("rep", "n"), "rep"), "full")
        for _ in range(2):
            before, full = full, cut(self._shared_tokens(full), "full")
            discard(before)
        facts = cut(full.select("rep", "n", F.size("tokens").cast("long").alias("c")).join(wanted.select("rep", "alike"), "rep"), "facts")
        rare = cut(self._met(self._shared_prefixes(full, levels)), "rare")

        alike = facts.groupBy("alike").agg(F.count("*").alias("k"), F.min("rep").alias("pivot"))
        grouped = facts.join(alike, "alike")
        groups = cut(grouped.select("rep", "n", "c", "pivot", F.xxhash64("alike", F.expr(f"pmod(xxhash64(rep), ceil(k / {GROUP_MEMBERS}))")).alias("g")), "groups")

        nothing = rare.select(F.col("rep"), F.col("rep").alias("label")).where("false")
        inside = groups.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        labels = extended(None, self._linked(inside.union(self._star(rare, nothing, 1)).distinct(), full))
        for seed in (2, 3):
            labels = extended(labels, self._linked(self._star(rare, labels.withColumnRenamed("node", "rep"), seed), full))
        labels = self._opened(rare, labels, groups.drop("pivot"), full)

        own = classes.select("rep", *digest, "doc_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        smallest = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        found = own.join(smallest, "label").select(*digest, "component_id")
        rows = slim.select("doc_id", *digest).join(found, digest, "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """JaccardJoin.classes() of all documents, three words and 0.9; its docstring tells what odd rows give."""
    return JaccardJoin(3, 9, 10).classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
