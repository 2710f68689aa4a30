"""A Merkle manifest of a table: a hash for each row, a tree for each language, and a tree over the languages.

A tree's nodes are cut into aligned blocks of 1024. A block keeps each of its levels as one hex string: the parents of a level
are hashes of fixed-width substrings of it, and a node's siblings on the way up are the substrings that flank its ancestors.
The roots of the blocks are the nodes of the next, smaller tree, until one is left. Nothing but blocks of bounded size is
gathered, whatever the size of a language.

Rows with equal ids are ordered by their hash. Null ids come first, null languages are a language of their own, and a null
value is hashed as ``-``. Repeated rows are leaves of their own. An empty table gives an empty result. Texts are hashed
whole. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import discard, let, numbered, written

#: Levels that a block spans, the leaves it has at most, and the width of a hash in hex.
SPAN = 10
BLOCK = 1 << SPAN
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """The hash of a row's values: each as its length in UTF-8 bytes, a colon and itself, or ``-`` if it is null."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (array of left and right flanks, level by level) lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_hash(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _segment(level: Column, at: Column) -> Column:
    """The hash at place ``at`` of a level, empty outside of it."""
    return F.when(at >= 0, F.substring(level, (at * HEX + 1).cast("int"), F.lit(HEX)).cast("string")).otherwise("")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (2 * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (2 * HEX) + 1, F.lit(2 * HEX)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, tree: list[str], payload: list[str]) -> DataFrame:
    """The blocks of trees given by their nodes (tree..., pos, size, node, payload...), as a table: tree..., block, height,
    members, levels, the path from the block's top to the tree's root, and the root."""
    members = F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("members")
    packed = nodes.groupBy(*tree, F.shiftright("pos", SPAN).alias("block"), "size").agg(members)
    # A lone node is hashed as well while its tree has others, so every block of a larger tree spans all levels.
    height = F.when(F.col("size") > BLOCK, SPAN).when(F.col("size") == 1, 0).otherwise(F.length(F.bin(F.col("size") - 1))).cast("int")
    ground = F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary")
    steps = F.when(F.col("height") > 0, F.sequence(F.lit(1), F.col("height"))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(ground), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    built = packed.withColumn("height", height).withColumn("levels", levels)
    blocks = written(built.withColumn("top", F.element_at("levels", -1).cast("string")), "blocks")
    largest = blocks.agg(F.max("size")).first()[0] or 0
    if largest <= BLOCK:
        return blocks.select(*tree, "block", "height", "members", "levels", F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("top").alias("root"))
    roots = blocks.select(*tree, F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("node"))
    upper = paths(_blocks(roots, tree, []), tree, []).select(*[F.col(t).alias(f"__of_{t}") for t in tree], F.col("pos").alias("__pos"), F.col("proof").alias("above"), "root")
    same = F.col("block") == F.col("__pos")
    for t in tree:
        same = same & F.col(t).eqNullSafe(F.col(f"__of_{t}"))
    return blocks.join(upper, same).select(*tree, "block", "height", "members", "levels", "above", "root")


def paths(blocks: DataFrame, tree: list[str], payload: list[str]) -> DataFrame:
    """A row for each node: tree..., pos, node, payload..., its proof up to the root, and the root."""

    def proof(pos: Column, levels: Column) -> Column:
        def flanks(k: Column) -> Column:
            at = F.call_function("shiftright", pos, k)
            odd = at % 2 == 1
            level = F.get(levels, k)
            return F.struct(F.when(odd, _segment(level, at - 1)).otherwise("").alias("left"), F.when(odd, F.lit("")).otherwise(_segment(level, at + 1)).alias("right"))

        up = F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(up, flanks)

    inside = (F.col("block") * BLOCK).cast("long")
    opened = let(F.col("levels"), lambda levels: F.transform("members", lambda m: F.struct(*[m[x].alias(x) for x in ("pos", "node", *payload)], proof((m["pos"] - inside).cast("int"), levels).alias("proof"))))
    rows = blocks.select(*tree, "above", "root", F.explode(opened).alias("m"))
    return rows.select(*tree, *[F.col(f"m.{x}").alias(x) for x in ("pos", "node", *payload)], F.concat("m.proof", "above").alias("proof"), "root")


def manifest(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, and the columns of ``also``) for each row of ``docs``.

    ``proof`` holds what flanks the row's node on each level, up to the root of its language and on to the root of all.
    """
    also = also or {}
    rows = docs.select("doc_id", "lang", leaf_hash(*[F.col(c) for c in FIELDS]).alias("node"), F.monotonically_increasing_id().alias("__row"), *[c.alias(k) for k, c in also.items()])
    leaves = written(rows, "leaves")
    places = numbered(leaves, ["lang"], ["doc_id", "node", "__row"])
    payload = ["doc_id", *also]
    blocks = _blocks(places, ["lang"], payload)
    discard(leaves)
    langs = blocks.filter("block = 0").select(F.lit(0).alias("all"), "lang", F.col("root").alias("node"))
    order = numbered(langs, ["all"], ["lang"])
    above = paths(_blocks(order, ["all"], ["lang"]), ["all"], ["lang"]).select(F.col("lang").alias("__lang"), F.col("node").alias("subroot"), F.col("proof").alias("__over"), F.col("root").alias("__root"))
    joined = blocks.join(above, F.col("lang").eqNullSafe(F.col("__lang")))
    whole = joined.withColumns({"above": F.concat("above", "__over"), "root": F.col("__root")})
    return paths(whole, ["subroot"], payload).select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof", *also)


def tampered_leaf() -> Column:
    """The leaf of a row whose n_chars has grown by one, if 7 divides the crc32 of its id; else null."""
    grown = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf_hash(*[grown if c == "n_chars" else F.col(c) for c in FIELDS]))
