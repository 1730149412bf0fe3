"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is a row of ``WIDTH`` turn ids per block of its positions. One ``GROUP BY key, ROLLUP (t1, ..., tW)``
aggregates all prefixes of a block together, and grouping_id tells their depths. Conversations that go on, and share the
block's last node with another one, continue in the next block's columns, keyed by that node; what follows after a node
with one member has one member as well and is written down without any grouping. A second ROLLUP per block, from the
deepest block up, sums leaves and saved bytes over subtrees, with the totals of a block handed to the node it hangs from.

A node is named by its smallest member and its depth. Turns are told apart by 128 bits of SHA-256 over role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import with_row_index
from tablegauge.llm.common import col, join_groups, store, with_workers

WIDTH = 8
ROOT = -1  # key of the first block; the keys of later blocks are members


def turn_rows(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, place, id): the turns without their texts, numbered over the whole table in order.

    Turns are ordered by ``turn`` (null first); rows that tie there are ordered by their id. The rows of one conversation
    are numbered by a range shuffle, so a long one is spread over several tasks.
    """
    name, body = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text))
    # The length of the role keeps (role, text) pairs apart; 16 bytes of the digest, then the size of the text.
    digest = F.sha2(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name, body), 256)
    size = F.lpad(F.hex(F.octet_length(body).cast("bigint")), 16, "0")
    thin = df.filter(col(conversation).isNotNull()).select(
        col(conversation).cast("bigint").alias("conv"), col(turn).alias("turn"),
        F.unhex(F.concat(F.substring(digest, 1, 32), size)).alias("id"))
    return with_row_index(thin, ["conv", F.col("turn").asc_nulls_first(), "id"], "place").select("conv", "place", "id")


def bytes_of(turn: Column) -> Column:
    """The size of a turn's text, kept in the last eight bytes of its id."""
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("bigint")


def rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (conv, nth, id) of the rebuilt conversations, and (conv, n) of all of them, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % group and goes on with its own turns after its
    first h, where h = crc32(c as decimal text) % heads.
    """
    sizes = store(turns.groupBy("conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("own")), "conversations")
    plan = sizes.select("conv", "first", "own", (F.col("conv") - F.col("conv") % group).alias("base"),
                        (F.crc32(F.col("conv").cast("string")) % heads).alias("h"))
    plan = plan.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left").withColumn(
        "k", F.least("h", F.coalesce("base_own", F.lit(0))))
    plan = store(plan.select("conv", "base", "first", "own", "h", "k", (F.col("k") + F.greatest(
        F.col("own") - F.col("h"), F.lit(0))).alias("n")), "rebuilding")
    numbered = store(join_groups(turns, plan.select("conv", "first", "own", "h", "k"), "conv", "own", turns.count()).select(
        "conv", (F.col("place") - F.col("first")).alias("nth"), "id", "h", "k"), "numbered-turns")
    # A base gives fewer than ``heads`` turns to each of at most ``group`` conversations.
    first = numbered.filter(F.col("nth") < heads - 1).select(F.col("conv").alias("base"), "nth", "id").join(
        plan.filter("k > 0").select("conv", "base", "k"), "base").filter("nth < k").select("conv", "nth", "id")
    rest = numbered.filter("nth >= h").select("conv", (F.col("nth") - F.col("h") + F.col("k")).alias("nth"), "id")
    return store(first.unionByName(rest), "rebuilt-turns"), plan.select("conv", "n")


def names(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def positional(turns: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Stored rows (conv, block, n, t1 ... tW): the ids of a block's turns in columns; block 0 has every conversation."""
    # A group is a block of a conversation, at most ``width`` rows.
    blocks = turns.groupBy("conv", F.floor(F.col("nth") / width).alias("block")).agg(*[
        F.max(F.when(F.col("nth") % width == i, F.col("id"))).alias(c) for i, c in enumerate(names(width))])
    empty = members.filter("n = 0").select(
        "conv", F.lit(0).cast("bigint").alias("block"), *[F.lit(None).cast("binary").alias(c) for c in names(width)])
    return store(blocks.unionByName(empty), "positional")


def rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """Aggregates of every prefix of (key, t1 ... tW), with its depth in the block as ``level``."""
    listed = ", ".join(names(width))
    made = rows.sparkSession.sql(
        f"SELECT key, {listed}, grouping_id() AS rolled, {aggregates} FROM {{rows}} GROUP BY key, ROLLUP ({listed})", rows=rows)
    # Of a prefix of d turns the other columns are rolled up: width - d bits of ones.
    level = reduce(lambda case, d: case.when(F.col("rolled") == (1 << (width - d)) - 1, F.lit(d)), range(width + 1), F)
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in names(width)])
    # Columns that are null because the conversation is shorter are no turns.
    return made.withColumn("level", level).drop("rolled").filter(F.col("level") == present)


def path(columns: list[Column]) -> Column:
    """A name for the prefix in the given columns, which is null from its end on."""
    return F.sha2(F.concat_ws("/", F.col("key").cast("string"), *[F.hex(c) for c in columns]), 256).substr(1, 32)


def block_nodes(rows: DataFrame, start: int, width: int) -> DataFrame:
    """Stored nodes of a block: key, turn columns, level, smallest member, members, path, and the path of the parent."""
    found = rollup(rows.select("key", "conv", *names(width)), width, "min(conv) AS member, count(*) AS n_members")
    if start:
        found = found.filter("level > 0")  # the key is a node of the block before
    columns = [F.col(c) for c in names(width)]
    above = [F.when(b.isNotNull(), a) for a, b in zip(columns, columns[1:])]
    return store(found.withColumns({"path": path(columns), "above": path(above)}), "trie-nodes")


def block_ends(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Stored rows (conv, member, n_members): the last node of each conversation in the block."""
    ends = nodes.select("path", "member", "n_members")
    return store(join_groups(rows.select("conv", path([F.col(c) for c in names(width)]).alias("path")), ends, "path", "n_members",
                             rows.count()).select("conv", "member", "n_members"), "block-ends")


def subtrees(nodes: DataFrame, below: DataFrame, start: int, width: int) -> DataFrame:
    """Stored rows of a block with what its subtrees hold; level 0 of a later block is the total under its key.

    ``below`` has (member, more, leaves, saved) of the subtrees that hang from nodes of the last level.
    """
    inner = store(nodes.filter("level > 0").groupBy(F.col("above").alias("path")).agg(F.count(F.lit(1)).alias("inside")), "children")
    tops = nodes.join(inner, "path").select(F.col("path").alias("above"), F.col("member").alias("parent"), "inside")
    nearest = F.lit(None).cast("bigint") if not start else F.col("key")
    known = nodes.filter(F.col("level") <= (1 if start else 0)).withColumn("parent", nearest).unionByName(
        join_groups(nodes.filter(F.col("level") > (1 if start else 0)), tops, "above", "inside", nodes.count()).select(
            *nodes.columns, "parent"))
    last = F.coalesce(*[F.col(c) for c in reversed(names(width))])
    children = (F.coalesce("inside", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_children")
    own = known.join(inner, "path", "left").join(
        below.withColumn("level", F.lit(width)), ["member", "level"], "left").select(
        "key", *names(width), F.col("level").alias("at"), "member", "n_members", "parent", children,
        (F.coalesce((F.col("n_members") - 1) * bytes_of(last), F.lit(0)) + F.coalesce("saved", F.lit(0))).alias("saved"),
        F.when(children == 0, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(0))).alias("leaves"))
    return store(rollup(own, width, "min_by(struct(member, n_members, parent, n_children), at) AS node, count_if(at = 1) AS more, "
                                    "sum(leaves) AS leaves, sum(saved) AS saved").select(
        "key", "level", "node", "more", "leaves", "saved"), "subtrees")


def end_digests(ends: DataFrame) -> DataFrame:
    """(member, depth, ends_sha256) of the nodes where conversations end: their ids as they come in order, hashed as a stream."""
    out = T.StructType.fromDDL("member bigint, depth bigint, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for member, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != (member, depth):
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (member, depth), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=out.names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=out.names)

    return with_workers(ends).repartition("member", "depth").sortWithinPartitions("member", "depth", "conv").mapInArrow(run, out)


def prefix_trie(turns: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct prefix of the conversations: the nodes of their trie.

    ``turns`` has (conv, nth, id), ``members`` (conv, n) of every conversation. Returns ``member`` (the node's smallest
    conversation), ``depth``, ``parent`` (the parent's smallest conversation, null for the root), ``n_members``,
    ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved`` (over the subtree: members but one, times the
    bytes of the node's last text) and ``ends_sha256`` (of the ids of the conversations that end there, ascending). No
    conversations give no node.
    """
    blocks = positional(turns, members, width)
    rows = store(blocks.filter("block = 0").withColumn("key", F.lit(ROOT).cast("bigint")), "block")
    levels, ends, alone, start = [], [], [], 0
    while True:
        nodes = block_nodes(rows, start, width)
        levels.append((start, nodes))
        placed = store(block_ends(rows, nodes, width).join(members, "conv"), "placed")
        ends.append(placed.filter(F.col("n") <= start + width).select("member", F.col("n").alias("depth"), "conv"))
        onward = placed.filter(F.col("n") > start + width)
        alone.append(onward.filter("n_members = 1").select("conv", "n", F.lit(start + width).cast("bigint").alias("at")))
        shared = onward.filter("n_members > 1").select("conv", F.col("member").alias("key"))
        if shared.isEmpty():
            break
        start += width
        rows = store(blocks.filter(F.col("block") == start // width).join(shared, "conv"), "block")
    # After a node with one member the conversation goes on alone.
    single = store(reduce(DataFrame.unionByName, alone), "single")
    ends.append(single.select(F.col("conv").alias("member"), F.col("n").alias("depth"), "conv"))
    tail = join_groups(turns.select("conv", "nth"), single, "conv", "n", turns.count()).filter("nth >= at").select(
        F.col("conv").alias("member"), (F.col("nth") + 1).alias("depth"), F.col("conv").alias("parent"),
        F.lit(1).cast("bigint").alias("n_members"), (F.col("nth") + 1 < F.col("n")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved"))
    found, totals = [tail], None
    for start, nodes in reversed(levels):
        below = single.filter(F.col("at") == start + width).select(
            F.col("conv").alias("member"), *[F.lit(v).cast("bigint").alias(c) for c, v in (("more", 1), ("leaves", 1), ("saved", 0))])
        if totals is not None:
            below = below.unionByName(totals)
        sums = subtrees(nodes, below, start, width)
        totals = sums.filter("level = 0").select(F.col("key").alias("member"), "more", "leaves", "saved")
        found.append((sums.filter("level > 0") if start else sums).select(
            "node.member", (F.col("level") + start).cast("bigint").alias("depth"), "node.parent", "node.n_members",
            "node.n_children", F.col("leaves").alias("n_leaves"), "saved"))
    digests = store(end_digests(reduce(DataFrame.unionByName, ends)), "end-digests")
    return reduce(DataFrame.unionByName, found).join(digests, ["member", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def rebuilt_trie(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 group: int = 5, heads: int = 9, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (see ``rebuilt`` and ``prefix_trie``).

    Turns are ordered by ``turn``, null first, ties by their content; repeated rows are turns of their own. Null roles and
    texts are empty. Rows without an id belong to no conversation. Other columns are ignored.
    """
    turns, members = rebuilt(turn_rows(df, conversation, turn, role, text), group, heads)
    return prefix_trie(turns, members, width)
