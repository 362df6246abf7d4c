"""A Merkle manifest of a dataset: a digest for each row, a root for each group and for all, and each row's proof.

Rows are ordered within their group and cut into aligned blocks of FANOUT ** BLOCK_LEVELS leaves; a task hashes the tree of a
block. Above the blocks, the trees are hashed by a butterfly exchange: in each round every block fetches the roots of the other
aligned runs of its group's next level, each from one block there, and hashes its own ancestor. All blocks of a run hash the same
ancestors, and so each ends with its upper proof and the root; nothing is handed down again. Nothing but digests is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.llm.common import cut, few

FANOUT = 3
BLOCK_LEVELS = 7
#: Rows of the table of positions (one for each group and range of rows) that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000
#: Columns of a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left: string, right: string>"


def leaf_digest(columns: dict[str, Column] | tuple[str, ...] = COLUMNS) -> Column:
    """Hex sha256 of the columns' values, each as UTF-8 byte count, `:` and value, or `-` if null."""
    values = [columns[c] if isinstance(columns, dict) else F.col(c) for c in columns]
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(leaves: list[str], height: int) -> list[list[str]]:
    """The nodes of each level from the leaves up, height levels above them; a shorter last run is hashed as it is."""
    found = [leaves]
    for _ in range(height):
        below = found[-1]
        found.append([_hash(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return found


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def _positioned(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """leaves (grp, leaf and others) with their number i within grp by order, and the size n of grp.

    Rows are range-partitioned and written once; a row's number is its place in its file, and the rows of its group in the files before.
    """
    ordered = leaves.repartitionByRange("grp", *order, "leaf").sortWithinPartitions("grp", *order, "leaf")
    written = cut(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.expr("monotonically_increasing_id() & ((1L << 33) - 1)")), name)
    runs = written.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    by_group = Window.partitionBy("grp")
    # rows in a group's window: one for each file that holds the group
    runs = runs.select("grp", "part", (F.sum("rows").over(by_group.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(by_group).alias("n"))
    return written.join(few(cut(runs, f"{name}-runs"), BROADCAST_ROWS), ["grp", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _block_roots(leaves: DataFrame, block_levels: int) -> DataFrame:
    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        digests = table.column("leaf").to_pylist()
        top = _levels(digests, min(block_levels, _height(table.column("n")[0].as_py())))[-1]
        return pa.table({"grp": table.column("grp").slice(0, 1), "block": table.column("block").slice(0, 1), "n": table.column("n").slice(0, 1), "digest": top})

    return leaves.select("grp", "block", "i", "n", "leaf").groupBy("grp", "block").applyInArrow(root, "grp string, block long, n long, digest string")


def _exchanged(roots: DataFrame, block_levels: int, name: str) -> DataFrame:
    """roots (grp, block, n, digest) with the group's root as digest and the upper proof of each block.

    In round r a block asks, for each aligned run of FANOUT ** r blocks beside its own, the block at its own place there, or the
    group's last block where the run is shorter; so each block is asked by about as many as it asks.
    """
    leaves = FANOUT**block_levels
    state = cut(roots.withColumn("blocks", F.expr(f"(n + {leaves - 1}) div {leaves}")).withColumn("upper", F.expr(f"cast(array() as array<{_STEP}>)")), name)
    most = state.agg(F.max("blocks")).first()[0] or 0
    size = 1  # blocks of a run that share an ancestor
    while size < most:
        place = f"(block div {size}) % {FANOUT}"
        asks = state.where(f"blocks > {size}").select(
            "grp", "block", F.expr(place).alias("mine"), "digest", "upper",
            F.expr(f"transform(filter(sequence(0, {FANOUT - 1}), j -> j != {place} and (block div {size * FANOUT}) * {size * FANOUT} + j * {size} < blocks), "
                   f"j -> struct(j, least((block div {size * FANOUT}) * {size * FANOUT} + j * {size} + block % {size}, blocks - 1) as asked))").alias("others"),
        )
        sent = asks.select("grp", "block", "mine", "digest", "upper", F.explode_outer("others").alias("other"))
        held = state.select("grp", F.col("block").alias("asked"), F.col("digest").alias("answer"))
        heard = sent.select("*", F.col("other.asked").alias("asked"), F.col("other.j").alias("j")).join(held, ["grp", "asked"], "left")
        runs = heard.groupBy("grp", "block").agg(F.first("mine").alias("mine"), F.first("digest").alias("digest"), F.first("upper").alias("upper"), F.sort_array(F.collect_list(F.struct("j", "answer"))).alias("run"))
        side = lambda sign: F.expr(f"array_join(transform(filter(run, x -> x.j {sign} mine), x -> x.answer), '')")
        hashed = runs.select("grp", "block", side("<").alias("left"), "digest", side(">").alias("right"), "upper")
        risen = hashed.select("grp", "block", F.sha2(F.concat("left", "digest", "right"), 256).alias("risen"), F.concat("upper", F.array(F.struct("left", "right"))).alias("longer"))
        state = state.join(risen, ["grp", "block"], "left").select("grp", "block", "n", "blocks", F.coalesce("risen", "digest").alias("digest"), F.coalesce("longer", "upper").alias("upper"))
        state, size = cut(state, name), size * FANOUT
    return state.select("grp", "block", "digest", "upper")


def _proofs(leaves: DataFrame, states: DataFrame, kept: str, block_levels: int) -> DataFrame:
    """The kept columns of each leaf with its proof (the steps within its block, then those of states) and the block's states."""
    names = kept.split(", ")

    def proven(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by("i").combine_chunks()
        height = min(block_levels, _height(table.column("n")[0].as_py()))
        levels = _levels(table.column("leaf").to_pylist(), height)
        left, right, at, steps = [], [], np.arange(table.num_rows), []
        for nodes in levels[:-1]:
            steps.append(at + len(left))
            for k in range(len(nodes)):
                run = k - k % FANOUT
                left.append("".join(nodes[run:k]))
                right.append("".join(nodes[k + 1 : run + FANOUT]))
            at = at // FANOUT
        upper = state.column("upper")[0].as_py()
        steps += [np.full(table.num_rows, len(left) + k) for k in range(len(upper))]
        known = pa.StructArray.from_arrays([pa.array(left + [s["left"] for s in upper], pa.string()), pa.array(right + [s["right"] for s in upper], pa.string())], ["left", "right"])
        flat = np.stack(steps, 1).ravel() if steps else np.zeros(0, np.int64)
        proof = pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1) * len(steps), pa.int32()), known.take(pa.array(flat)))
        ends = [pa.array([state.column(c)[0].as_py()] * table.num_rows, pa.string()) for c in ("subroot", "root")]
        return pa.Table.from_arrays([*[table.column(c.split(" ")[0]) for c in names], *ends, proof], [c.split(" ")[0] for c in names] + ["subroot", "root", "proof"])

    return leaves.groupBy("grp", "block").cogroup(states.groupBy("grp", "block")).applyInArrow(proven, f"{kept}, subroot string, root string, proof array<{_STEP}>")


def manifest(documents: DataFrame, leaf: Column | None = None, key: str = "doc_id", group: str = "source", claimed: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root and proof of each row, and `claimed`, a digest to be verified (default: the leaf itself).

    A group's leaves ascend by key, null keys first, equal keys by digest; rows that repeat altogether are leaves of their own.
    The null group comes first, then groups by their UTF-8 bytes. proof has a step for each level, from the leaf up: the digests to
    the left and to the right of the node in its run. One leaf alone has an empty proof and is the root. An empty table gives none.
    Columns are read by name; others make no difference.
    """
    digest = leaf_digest() if leaf is None else leaf
    grp = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = documents.select(grp.alias("grp"), F.col(key).cast("long").alias("doc_id"), digest.alias("leaf"), (digest if claimed is None else claimed).alias("claimed"))
    leaves = _positioned(leaves, ["doc_id"], "leaves").withColumn("block", F.expr(f"i div {FANOUT**block_levels}"))
    states = _exchanged(_block_roots(leaves, block_levels), block_levels, "blocks")
    groups = states.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("leaf"))
    groups = _positioned(groups, ["name"], "groups").withColumn("block", F.expr(f"i div {FANOUT**block_levels}"))
    tops = _exchanged(_block_roots(groups, block_levels), block_levels, "tops").withColumn("root", F.col("digest")).withColumn("subroot", F.col("digest"))
    above = cut(_proofs(groups, tops, "name string", block_levels).select(F.col("name").alias("grp"), "root", F.col("proof").alias("above")), "above")
    states = states.join(few(above, BROADCAST_ROWS), "grp").select("grp", "block", F.col("digest").alias("subroot"), "root", F.concat("upper", "above").alias("upper"))
    found = _proofs(leaves, states, "grp string, doc_id long, leaf string, claimed string", block_levels)
    return found.select("doc_id", F.expr("substring(nullif(grp, ''), 2)").alias("source"), "leaf", "claimed", "subroot", "root", "proof")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to under a proof."""
    return F.aggregate(proof, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hex sha256 of all siblings of a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """manifest() of all documents, verified against copies whose texts lost their line ends where 2 divides the id's crc32 (null ids: never)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cropped = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    claimed = leaf_digest({c: F.col(c) for c in COLUMNS} | {"text": cropped})
    found = manifest(documents, claimed=claimed).withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL = {
    "op11_merkle_manifest": """
    WITH RECURSIVE rows_ AS (
        SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END
            || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
            || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END
            || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END AS head, text
        FROM documents
    ), digests AS (
        SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
            sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '') END) AS cropped
        FROM rows_
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM digests
    ), nodes AS (
        SELECT source, 0 AS level, i, n, leaf AS digest FROM leaves
        UNION ALL
        SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY nodes.i)) FROM nodes WHERE n > 1 GROUP BY source, level, nodes.i // 3, n
    ), subroots AS (
        SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, i, n, subroot AS digest FROM subroots
        UNION ALL
        SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY tops.i)) FROM tops WHERE n > 1 GROUP BY level, tops.i // 3, n
    ), steps AS (
        SELECT a.source, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
        FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.source, a.level, a.i
    ), top_steps AS (
        SELECT a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
        FROM tops a JOIN tops b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i
    ), climbed AS (
        SELECT source, i AS leaf_i, 0 AS level, i, '' AS seen, CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                lambda k: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), CAST(4294967295 AS BIGINT)) % 2 = 0 THEN cropped ELSE leaf END AS digest FROM leaves
        UNION ALL
        SELECT c.source, c.leaf_i, c.level + 1, c.i // 3, c.seen || s.l || s.r, sha256(s.l || c.digest || s.r)
        FROM climbed c JOIN steps s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.i = s.i
    ), at_top AS (
        SELECT c.source, leaf_i, 0 AS level, s.i, seen, digest FROM (SELECT *, max(level) OVER (PARTITION BY source) AS high FROM climbed) c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source WHERE c.level = high
        UNION ALL
        SELECT c.source, c.leaf_i, c.level + 1, c.i // 3, c.seen || s.l || s.r, sha256(s.l || c.digest || s.r) FROM at_top c JOIN top_steps s ON c.level = s.level AND c.i = s.i
    ), ends AS (
        SELECT * FROM at_top WHERE level = (SELECT max(level) FROM tops)
    )
    SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(seen) AS proof_sha256, e.digest AS folded_root, e.digest = (SELECT digest FROM tops WHERE n = 1) AS verified
    FROM leaves v JOIN subroots s ON v.source IS NOT DISTINCT FROM s.source JOIN ends e ON v.source IS NOT DISTINCT FROM e.source AND v.i = e.leaf_i
    """
}
