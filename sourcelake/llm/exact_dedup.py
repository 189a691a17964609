"""Exact dedup by deterministic block naming, in DataFrame operations only.

The bytes of a text are cut into blocks of a fixed size.  All distinct blocks
are sorted and numbered; a block's number is its name, so equal names mean
equal blocks.  Then each document's row of names is halved again and again:
adjacent pairs of names are numbered in the same way, until one name is left.
Names of different depths are kept apart by a document's number of blocks, so
two documents have the same (blocks, name) if and only if their bytes are equal;
no hash stands for a text anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import cut, one_of_each, sha, shuffle_parts

#: Bytes of a block.
BLOCK = 4096


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the integer ``name`` of their keys' values.

    Keys are grouped (map side first), and the groups of each partition sorted
    and numbered.  Names are written before they are joined, so both sides of the
    join are dealt anew and Spark can split a key that many rows share.
    """
    names = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("many")).drop("many")
    names = names.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return rows.join(cut(names), keys)


def named_blocks(cells: DataFrame, total: int) -> DataFrame:
    """``named`` for blocks, which are too large to be written twice.

    Blocks with more than a share of all cells are fewer than twice the number of
    partitions by that definition, so their names are broadcast; no task gets all
    cells of a frequent block.  Frequent blocks have names under -1, others from 0.
    """
    groups = cells.groupBy("block").agg(F.count(F.lit(1)).alias("many"))
    names = groups.sortWithinPartitions("block").withColumn("name", F.monotonically_increasing_id())
    often = max(2, total // (2 * shuffle_parts(cells.sparkSession)))
    hot = F.broadcast(names.where(F.col("many") > often).select("block", (-2 - F.col("name")).alias("hot")))
    tried = cells.join(hot, "block", "left")
    found = tried.where("hot is not null").withColumnRenamed("hot", "name")
    rest = tried.where("hot is null").drop("hot").join(names.where(F.col("many") <= often).drop("many"), "block")
    return found.unionByName(rest)


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, copies, blocks, name): the identity (blocks, name) of each distinct (doc_id, text).

    The digest only tells rows of one doc_id apart (and is a result); texts are
    compared through their names alone.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / BLOCK)).cast("int")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), sha(F.col(text_col)).alias("sha"), body.alias("body"), blocks.alias("blocks"))
    total = docs.agg(F.sum("blocks")).first()[0] or 0
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring(F.col("body"), i * BLOCK + 1, F.lit(BLOCK)))
    cells = docs.select("doc_id", "sha", "blocks", F.posexplode(cell).alias("at", "block"))
    first = named_blocks(cells, total)
    level = cut(first.select("doc_id", "sha", "blocks", F.col("blocks").alias("width"), "at", "name", F.lit(1).cast("long").alias("copies")))
    done = []
    while True:
        done.append(level.where("width = 1").select("doc_id", "sha", "blocks", "name", "copies"))
        level = level.where("width > 1")
        if level.isEmpty():
            break
        # a pair is at half its place; an odd last name pairs with -1
        even = F.col("at") % 2 == 0
        pairs = cut(
            level.groupBy("doc_id", "sha", "blocks", F.ceil(F.col("width") / 2).cast("int").alias("width"), F.floor(F.col("at") / 2).cast("int").alias("at"))
            .agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"), F.sum(F.when(even, F.col("copies"))).alias("copies"))
        )
        level = cut(named(pairs, ["left", "right"]).select("doc_id", "sha", "blocks", "width", "at", "name", "copies"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "sha", "blocks", "name").agg(F.sum("copies").alias("copies"))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, copies, keep_id, group_size, stays) of each distinct (doc_id, text)."""
    known = cut(identities(df, id_col, text_col))
    groups = cut(known.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    both = known.join(groups, ["blocks", "name"])
    return both.select("doc_id", "sha", "copies", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``df``.

    Texts are equal if their bytes are; null counts as empty.  Of equal texts the
    row with the largest doc_id stays; of repeated rows with that id, one (which,
    makes no difference).  A row with a null id stays only if its group has no id.
    An empty table gives an empty result; further columns are not read.
    """
    rows = judged(df, id_col, text_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are."""
    return one_of_each(df, judged(df, id_col, text_col), id_col, text_col)
