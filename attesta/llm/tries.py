"""A prefix trie of conversations, whose nodes are the distinct sequences of first turns.

A turn is a row of two hashes and a length; a prefix is the exclusive or of the hashes of its turns, each mixed with its place,
so prefixes come from running aggregates. A count-min sketch of all prefixes then proves most of them single: from the first
single prefix on, a conversation's nodes are its own alone and are told from its rows as they are. Only what may be shared is
shuffled and grouped exactly.

A node is named by its depth and smallest member. The sums over subtrees need no walk: each value of a node is credited to
its smallest member, and a node adds up what its members are credited with, less what its own smallest member has above it.

Turns are ordered by turn (null first), then role, the text's first characters and hash, so repeated rows are turns
of their own. Null roles and texts are empty. Rows without a conv_id are one conversation, which borrows no turns and has no
number: a node's conv_id is null where it is the only member, and lists of ids leave it out. An empty table has no nodes.
Texts are hashed whole. Prefixes are told apart by 128 bits. A conversation may hold any part of the rows: it is numbered and
added up in pieces. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.screening import MOST_CELLS, with_single
from attesta.llm.shared import discard, numbered, written

#: Turns of a piece of a conversation, and ids of a piece of a list.
PIECE_BITS = 12
KEY = ("depth", "p1", "p2")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, size, h1, h2, bytes) of each turn of ``conversations`` (conv_id, turn, role, text), numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long"), "turn", F.substring(role, 1, 32).alias("role"), F.substring(text, 1, 32).alias("head"), F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    stored = written(rows, "turns")
    return numbered(stored, ["conv_id"], ["turn", "role", "head", "h1", "h2", "row"]).select("conv_id", "pos", "size", "h1", "h2", "bytes")


def same(left: DataFrame, right: DataFrame, *names: str, how: str = "left") -> DataFrame:
    """A join in which nulls equal each other; the columns of the right side other than ``names`` are added."""
    own = right.select(*[F.col(n).alias(f"__{n}") for n in names], *[c for c in right.columns if c not in names])
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(own, on, how).drop(*[f"__{n}" for n in names])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n) and their turns (conv_id, depth from 1, h1, h2, bytes) after each has taken its first h
    turns from the conversation that begins its run of five ids; h is the crc32 of its id modulo 9."""
    convs = turns.filter("pos = 0").select("conv_id", "size")
    lead = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, F.lit(0))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    plan = convs.withColumns({"lead": lead, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(bases, "base", "left")
    plan = written(plan.select("conv_id", "base", "size", "lead", F.least("lead", F.coalesce("base_size", F.lit(0))).alias("taken")), "plan")
    own = same(turns.filter(F.col("pos") >= lead), plan.select("conv_id", "taken"), "conv_id", how="inner")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - lead + 1).alias("depth"), "h1", "h2", "bytes")
    first = turns.filter("pos < 8").select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "bytes")
    borrowed = first.join(plan.filter("taken > 0").select("conv_id", "base", "taken"), "base").filter("pos < taken")
    rows = own.unionByName(borrowed.select("conv_id", (F.col("pos") + 1).alias("depth"), "h1", "h2", "bytes"))
    return plan.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("lead"), F.lit(0))).alias("n")), rows


def running(rows: DataFrame, key: str, at: str, values: dict[str, str], total: Callable, add: Callable) -> DataFrame:
    """``rows`` with running aggregates of ``values`` (new name: column) by ``at`` within ``key``.

    A key is added up in pieces of 4096 places, so a long one meets many tasks; only keys of more than one piece need the sums
    of earlier pieces.
    """
    piece = F.shiftright(at, PIECE_BITS)
    rows = rows.withColumn("__piece", piece)
    inside = W.partitionBy(key, "__piece").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumns({name: total(value).over(inside) for name, value in values.items()})
    sums = rows.groupBy(key, "__piece").agg(*[total(value).alias(f"__{name}") for name, value in values.items()])
    later = W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(key, "__piece", *[total(f"__{name}").over(later).alias(f"__{name}") for name in values]).filter(F.col(f"__{next(iter(values))}").isNotNull())
    out = same(placed, before, key, "__piece")
    return out.withColumns({name: add(F.col(name), F.coalesce(F.col(f"__{name}"), F.lit(0))) for name in values}).drop("__piece", *[f"__{name}" for name in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """The rebuilt turns with g1, g2 of the turn in its place, and p1, p2 of the prefix that it ends."""
    g1, g2 = F.xxhash64("depth", "h1", F.lit(1), "h2"), F.xxhash64(F.lit(2), "h2", "depth", "h1")
    rows = turns.select("conv_id", "depth", "bytes", g1.alias("g1"), g2.alias("g2"))
    return running(rows, "conv_id", "depth", {"p1": "g1", "p2": "g2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) for rows (depth, p1, p2, conv_id): the digest of the ids in ascending order, comma-joined.

    Ids are joined in pieces by their upper bits; the pieces of a node then stream, in order, through one digest, which has to
    meet them one after the other.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, said = None, None, False
        for batch in batches:
            out = []
            for depth, p1, p2, ids in zip(batch["depth"], batch["p1"], batch["p2"], batch["ids"], strict=True):
                if (depth, p1, p2) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state, said = (depth, p1, p2), hashlib.sha256(), False
                if ids:
                    state.update(("," * said + ids).encode())
                    said = True
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    in_order = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return in_order.mapInPandas(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has a row (conv_id, n) for each conversation, ``turns`` (conv_id, depth from 1, h1, h2, bytes) their turns.
    """
    paths = written(prefixes(turns), "paths")
    single = with_single(paths.select("conv_id", "depth", "p1", "p2"), "p1", "p2", most_cells).filter("single").groupBy("conv_id").agg(F.min("depth").alias("tail"))
    convs = written(same(convs, single, "conv_id"), "convs")
    known = same(paths, convs, "conv_id", how="inner")
    # The parent's prefix is the node's own without its last turn.
    known = known.select("conv_id", "depth", "n", "tail", "bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("g2")).alias("q2"))
    known = written(known, "known")
    discard(paths)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("bytes"), *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2")], *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")])
    shared = known.filter("tail is null or depth < tail").drop("tail").unionByName(roots)

    groups = shared.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    groups = written(groups, "groups")
    heads = known.filter("depth = tail").select("conv_id", "depth", "q1", "q2")
    above = lambda rows: rows.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = above(groups).unionByName(above(heads)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = groups.join(children, list(KEY), "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = written(nodes, "nodes")

    # What each conversation is credited with: of the nodes whose smallest member it is, the savings and the leaf.
    credit = nodes.groupBy("conv_id").agg(F.sum("saved").alias("credit"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    member = same(convs, credit, "conv_id").select("conv_id", F.coalesce("credit", F.lit(0)).alias("credit"), F.when(F.col("tail").isNotNull(), 1).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf"))
    sums = same(shared.select("conv_id", *KEY), member, "conv_id", how="inner").groupBy(*KEY).agg(F.sum("credit").alias("all_credit"), F.sum("leaf").cast("long").alias("n_leaves"))
    so_far = running(nodes.select("conv_id", "depth", "saved", "p1", "p2"), "conv_id", "depth", {"upto": "saved"}, F.sum, lambda a, b: a + b).select(*KEY, (F.col("upto") - F.col("saved")).alias("before"))
    ends = ends_digest(shared.filter("depth = n").select(*KEY, "conv_id"))
    parents = groups.select(F.col("depth").alias("of_depth"), F.col("p1").alias("of_p1"), F.col("p2").alias("of_p2"), F.col("conv_id").alias("parent_conv_id"))
    below = (F.col("depth") - 1 == F.col("of_depth")) & (F.col("q1") == F.col("of_p1")) & (F.col("q2") == F.col("of_p2"))

    inner = nodes.join(sums, list(KEY)).join(so_far, list(KEY)).join(ends, list(KEY), "left").join(parents, below, "left")
    inner = inner.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_credit") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    # Tails: their nodes have one member, one leaf and nothing saved.
    own = known.filter("depth >= tail").withColumn("last", F.col("depth") == F.col("n"))
    one = [F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")]
    digest = F.sha2(F.when(F.col("last"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).otherwise(""), 256).alias("ends_sha256")
    deep = own.filter("depth > tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *one, digest)
    top = own.filter("depth = tail").join(parents, below).select("conv_id", "depth", "parent_conv_id", *one, digest)
    return inner.unionByName(deep).unionByName(top)


def conversation_trie(conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns = turn_rows(conversations)
    return trie(*rebuilt(written(turns, "numbered")), most_cells)
