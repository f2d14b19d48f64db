"""The trie of conversations' prefixes by ROLLUP over columns of turn ids.

A turn's id is a digest of its role and text and the length of the text. A conversation's turns are dealt to blocks of ``BLOCK``
positions; a block is one row with the ids of its positions in columns, keyed by the node at which the block before ended. ``ROLLUP`` over these columns gives all prefixes of
all blocks in one aggregation, and ``grouping_id`` their depth, whatever the length of a conversation: no loop runs over blocks or depths.

A node is named by its depth and two 64-bit exclusive ors over hashes of (position, turn id): a running window gives them up to a block,
its columns within it.

Sums over subtrees need no climbing. Every node belongs to its smallest member, so a conversation owns the end of its path from the first node that no smaller
one shares. A subtree's distinct nodes are the part of its smallest member's path that lies in it and what its other members own. So a second
ROLLUP over the same rows adds up what conversations own, and every sum follows from it.

Members that end at a node are hashed in order of their numbers by tasks that read sorted rows: first runs of numbers, cut by range and size, then the runs of a node. No
list of members is held, though a third of all conversations may end at one node.

Defined results: rows without a conversation id belong to none and are left out; a null role or text is empty; rows of a conversation with equal turns are
ordered by the digest of role and text; repeated rows are turns of their own; texts of any length count whole; an empty table gives no rows, since no conversation starts
at the root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.llm.common import prepared
from prepkit.session import stage

#: Positions of a block, the columns of one ROLLUP.
BLOCK = 4
#: Signs of one run of conversation numbers that are hashed together.
RUN_SIGNS = 1 << 20
_IDS = [f"t{i}" for i in range(BLOCK)]
NODE = ["depth", "key1", "key2"]


def turn_id(role: Column, text: Column) -> Column:
    """Digest of a turn (16 bytes) and the code points of its text (4 bytes)."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.md5(whole.cast("binary")), F.lpad(F.hex(F.length(text)), 8, "0")))


def signs(turn: Column) -> Column:
    """Code points of the text of a turn id."""
    return F.coalesce(F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("bigint"), F.lit(0))


def _lane(number: int, position: Column, turn: Column) -> Column:
    return F.when(turn.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(number), position.cast("bigint"), turn))


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_id)``: turns in order, from 0."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("turn_id")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "turn_id")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that share openings: the first ``h`` turns of conversation ``c - c % every`` and then the own turns after the first ``h``, where ``h`` is the CRC-32 of
    the number ``c`` in decimal, modulo ``most``.

    Rows ``(conv_id, part, pos, turn_id)``; each conversation has one row of part 0 without a turn.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.filter(F.col("pos") < most - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id"))).alias("head"))
    every_id = turns.filter("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    opened = every_id.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    none = F.array().cast("array<struct<pos:int,turn_id:binary>>")
    first = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("turn_id")))
    opening = F.explode(F.concat(first, F.coalesce(F.filter("head", lambda x: x["pos"] < F.col("h")), none))).alias("x")
    opening = opened.select("conv_id", opening).select("conv_id", (F.col("x.pos") >= 0).cast("int").alias("part"), "x.pos", "x.turn_id")
    own = turns.filter(F.col("pos") >= h).select("conv_id", F.lit(2).alias("part"), "pos", "turn_id")
    return opening.unionByName(own)


def blocks(parts: DataFrame) -> DataFrame:
    """One row per conversation and block: ``conv_id``, ``block``, the node before it (``before1``, ``before2``, signs up to there), ids of its turns, and length and signs of the conversation.

    ``parts`` is as :func:`rebuilt` gives it; a conversation without turns has one block without ids.
    """
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # The row of part 0 comes first, so the turns count from 1.
    at = parts.withColumn("depth", F.row_number().over(order) - 1)
    n = F.col("depth") - 1
    at = at.withColumns({"l1": _lane(1, n, F.col("turn_id")), "l2": _lane(2, n, F.col("turn_id")), "signs": signs(F.col("turn_id"))})
    at = at.withColumns({
        "before1": F.coalesce(F.bit_xor("l1").over(so_far), F.lit(0)),
        "before2": F.coalesce(F.bit_xor("l2").over(so_far), F.lit(0)),
        "signs_before": F.coalesce(F.sum("signs").over(so_far), F.lit(0)),
    })
    cell = F.greatest(n, F.lit(0))
    block, place = F.floor(cell / BLOCK).cast("int"), cell % BLOCK
    # Position 0 of a block carries the node before it; in block 0 the row without a turn does so too.
    made = at.withColumns({"block": block, "place": place}).groupBy("conv_id", "block").agg(
        *[F.max(F.when((F.col("place") == i) & F.col("turn_id").isNotNull(), F.col("turn_id"))).alias(c) for i, c in enumerate(_IDS)],
        *[F.min_by(c, "depth").alias(c) for c in ("before1", "before2", "signs_before")],
        F.max("depth").alias("end_depth"),
        F.sum("signs").alias("block_signs"),
    )
    whole = Window.partitionBy("conv_id")
    return made.withColumns({"length": F.max("end_depth").over(whole), "total": F.sum("block_signs").over(whole)}).drop("block_signs")


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """One row per node: its name, its parent's name, the signs up to its parent, and the measures over its members.

    A shorter conversation has nulls in later columns; the groups these make are no nodes. The empty prefix of a later block is the last node of the block before.
    """
    ids, fixed = ", ".join(_IDS), "block, before1, before2, signs_before"
    sql = f"SELECT {fixed}, {ids}, {BLOCK} - bit_count(grouping_id()) AS k, {measures} FROM {{rows}} GROUP BY {fixed}, ROLLUP({ids})"
    groups = rows.sparkSession.sql(sql, rows=rows)
    last = F.coalesce(*[F.when(F.col("k") == i + 1, F.col(c)) for i, c in enumerate(_IDS)])
    nodes = groups.filter(((F.col("k") == 0) & (F.col("block") == 0)) | last.isNotNull())

    def key(lane: int, upto: Column) -> Column:
        out = F.col(f"before{lane}")
        for i, c in enumerate(_IDS):
            out = out.bitwiseXOR(F.when(F.lit(i) < upto, _lane(lane, F.col("block") * BLOCK + i, F.col(c))).otherwise(F.lit(0)))
        return out

    to_parent = F.col("signs_before")
    for i, c in enumerate(_IDS):
        to_parent = to_parent + F.when(F.lit(i) < F.col("k") - 1, signs(F.col(c))).otherwise(F.lit(0))
    names = {"depth": (F.col("block") * BLOCK + F.col("k")).cast("bigint"), "up_signs": to_parent}
    names |= {f"key{n}": key(n, F.col("k")) for n in (1, 2)} | {f"up{n}": key(n, F.col("k") - 1) for n in (1, 2)}
    return nodes.withColumns(names).drop("block", "before1", "before2", "signs_before", "k", *_IDS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and number, as comma-joined runs of numbers of one node."""
    names = [*NODE, "first", "run"]
    node, first, held, size = None, None, [], 0
    for batch in batches:
        out = []
        for *key, number in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != node or size > RUN_SIGNS:
                if held:
                    out.append((*node, first, ",".join(held)))
                node, first, held, size = key, number, [], 0
            held.append(str(number))
            size += len(held[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, first, ",".join(held))], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by node and first number, as one digest per node."""
    names = [*NODE, "ends_sha256"]
    node, digest = None, None
    for batch in batches:
        out = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
        for key, run in zip(keys, batch.column(4)):
            if key != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(run.as_py().encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, digest.hexdigest())], names=names)


def ends(rows: DataFrame) -> DataFrame:
    """Digest of the numbers of the conversations that end at a node, for nodes where any do."""
    upto = [F.col(f"before{n}") for n in (1, 2)]
    for i, c in enumerate(_IDS):
        upto = [u.bitwiseXOR(_lane(n, F.col("block") * BLOCK + i, F.col(c))) for n, u in zip((1, 2), upto)]
    last = rows.filter("end_depth = length").select(F.col("length").cast("bigint").alias("depth"), upto[0].alias("key1"), upto[1].alias("key2"), "conv_id")
    sorted_ids = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    named = "depth bigint, key1 bigint, key2 bigint"
    runs = sorted_ids.mapInArrow(_runs, f"{named}, first bigint, run string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{named}, ends_sha256 string")


def trie(parts: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations given as ``(conv_id, part, pos, turn_id)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (summed over the
    node's subtree, each node's other members times the signs of its last text) and ``ends_sha256``.
    """
    prepared(parts.sparkSession)
    rows = stage(blocks(parts), "trie-blocks")
    # What each conversation owns: its path from the first node whose smallest member it is; and whether its last node has no children.
    owned = _rolled(rows, "min(conv_id) AS conv_id, max(length) AS longest").groupBy("conv_id").agg(
        F.min_by("up_signs", "depth").alias("up_to_own"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf")
    )
    marked = rows.join(owned, "conv_id", "left").withColumns({
        "own": F.coalesce(F.col("total") - F.col("up_to_own"), F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0)),
    })
    measures = """min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS member_signs, sum(own) AS own_signs, sum(leaf) AS n_leaves,
        min_by(total - own, conv_id) AS before_own"""
    nodes = stage(_rolled(marked, measures), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"), F.col("up2").alias("key2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    # Members' signs from this node on, less those of its distinct nodes: the smallest member's from here and what the others own.
    distinct = F.col("own_signs") + F.col("before_own") - F.col("up_signs")
    saved = F.col("member_signs") - F.col("n_convs") * F.col("up_signs") - distinct
    out = nodes.join(children, NODE, "left").join(ends(rows), NODE, "left").join(parents, ["depth", "up1", "up2"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves",
        saved.cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
