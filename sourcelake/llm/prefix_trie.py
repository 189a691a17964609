"""The trie of conversation prefixes, peeled from its deepest turns upwards.

A prefix is known by the exclusive or of its turns' hashes, each taken together
with the turn's place: 128 bits that running sums give for every prefix at once.
Prefixes of one text alone need no regrouping: such a tail is stripped as a whole.
The rest is peeled level by level from the greatest depth that different texts
share: texts that end there join the nodes that survived, nodes are regrouped
with partial sums, finished, and handed to their parents by stripping the last
turn.  There are as many rounds as turns in the longest prefix that two different
texts share.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.llm.common import cut, ranked, shuffle_parts, written

#: Turns of a conversation whose running sums one task forms in a row.
BLOCK = 256
#: Rebuilt conversations begin with turns of the first of ``FAMILY`` neighbours, fewer than ``HEADS``.
FAMILY, HEADS = 5, 9
NODE = ["depth", "p1", "p2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def crc(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def numbered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, t1, t2, n_bytes, rank, size): turns by (turn, role, text), nulls of turn first."""
    rows = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.select(
        "*", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", F.lit("hash"), "role").alias("t2"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    return ranked(rows, ["conv_id"], ["turn", "role", "text"], ["conv_id", "t1", "t2", "n_bytes"])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length), and their turns (conv_id, pos, t1, t2, n_bytes)."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = own.select("conv_id", "own", (crc(F.col("conv_id")) % HEADS).alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("donor"))
    owners = own.select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    lead = F.least("head", F.coalesce("given", F.lit(0)))
    convs = cut(own.join(owners, "donor", "left").select("conv_id", "donor", "head", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")))
    mine = turns.join(convs, "conv_id").where("rank >= head").select("conv_id", (F.col("lead") + F.col("rank") - F.col("head")).alias("pos"), "t1", "t2", "n_bytes")
    # at most 8 turns of a donor, for at most 9 conversations
    heads = turns.where(F.col("rank") < HEADS - 1).withColumnRenamed("conv_id", "donor")
    theirs = heads.join(convs, "donor").where("rank < head").select("conv_id", F.col("rank").alias("pos"), "t1", "t2", "n_bytes")
    return convs.select("conv_id", "length"), mine.unionByName(theirs)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, n_bytes, so_far) of every turn: the prefix that ends with it, its parent, bytes of the turn and up to it.

    Running sums are formed in blocks of turns, and blocks are added up by their
    totals, so one long conversation is the work of many tasks.
    """
    rows = turns.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), F.xxhash64("pos", "t1", "t2").alias("x1"), F.xxhash64("t2", "pos", F.lit(1), "t1").alias("x2"), "n_bytes")
    rows = cut(rows)
    run = Window.partitionBy("conv_id", "block").orderBy("pos")
    rows = rows.select("*", F.bit_xor("x1").over(run).alias("p1"), F.bit_xor("x2").over(run).alias("p2"), F.sum("n_bytes").over(run).alias("so_far"))
    far = cut(rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("n_bytes").alias("bytes")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("conv_id", "block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2"), F.sum("bytes").over(before).alias("bytes")).where("block > 0")
    later = rows.where("block > 0").join(far, ["conv_id", "block"])
    later = later.select("conv_id", "pos", "x1", "x2", "n_bytes", F.col("p1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("p2"), (F.col("so_far") + F.col("bytes")).alias("so_far"))
    both = rows.where("block = 0").select("conv_id", "pos", "x1", "x2", "n_bytes", "p1", "p2", "so_far").unionByName(later)
    return both.select("conv_id", (F.col("pos") + 1).alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "n_bytes", "so_far")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of groups of ``ends(conv_id, depth, p1, p2)``.

    The ids of a group are sorted over many tasks and joined to runs of text; a
    digest then streams over its group's runs and holds its state alone.
    """
    parts = shuffle_parts(ends.sparkSession)
    dealt = ends.select(*NODE, "conv_id").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def runs(batches):
        for batch in batches:
            groups: list[list] = []
            for depth, p1, p2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not groups or groups[-1][:3] != [depth, p1, p2]:
                    groups.append([depth, p1, p2, conv, []])
                groups[-1][4].append(str(conv))
            columns = list(zip(*((*g[:4], ",".join(g[4])) for g in groups), strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*NODE, "first", "ids"])

    told = dealt.mapInArrow(runs, "depth long, p1 long, p2 long, first long, ids string")
    sorted_runs = told.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")

    def digests(batches):
        key, state = None, None
        names = [*NODE, "ends_sha256"]

        def row(key, state):
            return pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest()), strict=True))], schema=schema)

        schema = pa.schema([*((n, pa.int64()) for n in NODE), ("ends_sha256", pa.string())])
        for batch in batches:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield row(key, state)
                key, state = at, hashlib.sha256(ids.encode())
        if key is not None:
            yield row(key, state)

    return sorted_runs.mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(df: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    Turns are ordered by turn (null first), then role, then text; null roles and
    texts are empty; repeated rows are turns of their own.  Rows without a conv_id
    belong to no conversation and are left out.  A conversation that is left
    without turns is a member of the root.  An empty table has no node.  Further
    columns are not read.
    """
    spark = df.sparkSession
    convs, turns = rebuilt(cut(numbered_turns(df)))
    convs = cut(convs)
    root = convs.agg(F.min("conv_id")).first()[0]
    rows = cut(prefixes(turns))

    # distinct texts: their copies, the smallest conv_id for all of them
    last = convs.join(rows, "conv_id").where("depth = length").select("conv_id", *NODE, "so_far")
    none = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(0).cast("long").alias("so_far"))
    ends = cut(last.unionByName(none))
    texts = cut(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max("so_far").alias("total")))
    alone = texts.where("copies = 1").select(*NODE, F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    several = end_digests(ends.join(texts.where("copies > 1").select(*NODE), NODE))
    ended = cut(alone.unionByName(several))

    # the nodes, and how many texts each has
    told = rows.join(texts.select("conv_id", F.col("depth").alias("length"), "copies", "total"), "conv_id")
    nodes = told.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("texts"), F.min("conv_id").alias("conv_id"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("n_bytes").alias("n_bytes"),
        F.max("so_far").alias("so_far"), F.max("length").alias("length"), F.max("copies").alias("copies"), F.max("total").alias("total"),
    )
    nodes = written(nodes.repartitionByRange(shuffle_parts(spark), "depth", "p1"), "trie-nodes")
    shared = nodes.where("texts > 1")
    tails = nodes.where("texts = 1").select(
        *NODE, "q1", "q2", "conv_id", F.col("copies").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("total") - F.col("so_far") + F.col("n_bytes"))).alias("saved_tokens"),
    )

    # what the peeling begins with: the tops of the tails, stripped, and texts that end on shared nodes
    carried = ["conv_id", "n_convs", "n_leaves", "saved_tokens"]
    tops = tails.groupBy("conv_id").agg(F.min_by(F.struct("depth", "q1", "q2", "n_convs", "saved_tokens"), "depth").alias("top"))
    tops = cut(tops.select("conv_id", "top.*"))
    stripped = tops.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", F.lit(1).alias("child"))
    whole = texts.join(tops.select("conv_id"), "conv_id", "left_anti")
    whole = whole.select(*NODE, "conv_id", F.col("copies").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(0).alias("child"))
    starts = written(stripped.unionByName(whole).repartitionByRange(shuffle_parts(spark), "depth", "p1"), "trie-starts")

    level = starts.agg(F.max("depth")).first()[0]
    done, survivors = [tails.select(*NODE, "q1", "q2", *carried, "n_children")], None
    while level is not None and level >= 0:
        coming = starts.where(F.col("depth") == level)
        if survivors is not None:
            up = survivors.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), *carried, F.lit(1).alias("child"))
            coming = coming.unionByName(up)
        merged = coming.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("child").alias("n_children"))
        merged = merged.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")))
        if level:
            turn = shared.where(F.col("depth") == level).select(*NODE, "q1", "q2", "n_bytes")
            merged = merged.join(turn, NODE).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes")
        else:
            merged = merged.withColumns({"q1": F.lit(0).cast("long"), "q2": F.lit(0).cast("long")})
        survivors = cut(merged)
        done.append(survivors)
        level -= 1

    peeled = done[1:] or [done[0].limit(0)]
    forks = peeled[0]
    for part in peeled[1:]:
        forks = forks.unionByName(part)
    every = forks.unionByName(done[0])
    # a node's parent is a shared one, or a node of its own tail
    above = forks.where("depth > 0 and n_children > 0").select(F.col("depth").alias("d"), F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.col("conv_id").alias("above"))
    deep = every.where("depth > 1")
    deep = deep.join(above, (deep["depth"] - 1 == above["d"]) & (deep["q1"] == above["r1"]) & (deep["q2"] == above["r2"]), "left")
    deep = deep.select(*every.columns, F.coalesce("above", "conv_id").alias("parent_conv_id"))
    flat = every.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long")))
    named = deep.unionByName(flat).join(ended, NODE, "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )
