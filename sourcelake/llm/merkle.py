"""A Merkle manifest of documents by nested intervals of leaf ranks.

Every node is labelled with the interval of leaf ranks that it covers.  The
nodes of a level are found in buckets of as many ranks as a node of the next
level covers, so an ancestor's interval meets what lies inside it by an equality
of buckets and a test of containment.  A node's siblings are what its parent's
interval holds besides its own.  Hash paths are handed down from the root, and
documents get theirs from their run of at most 16 leaves, so that no path is
shuffled for a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import cut, ranked, written

FANOUT = 16
#: A node's siblings at each level from its own to the root: those on its left and on its right, joined.
PATH = "array<struct<left:string,right:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level (key, bucket, lo, hi, size, kids, digest), lowest first, and the tops (key, height, lo, hi, top).

    ``leaves`` has (key, rank, size, digest).  A level's run is a node of the next;
    a key is at its top when one node is left.
    """
    nodes = leaves.select("key", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "size", "digest")
    levels, width = [], 1
    tops = [nodes.where("size = 1")]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while width < largest:
        wide = width * FANOUT
        runs = nodes.where(F.col("size") > width).groupBy("key", F.floor(F.col("lo") / wide).alias("bucket"))
        runs = runs.agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))  # 16 at most
        runs = cut(runs.select("key", "bucket", "size", "kids", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.sha2(joined(F.col("kids")), 256).alias("digest")))
        levels.append(runs)
        nodes, width = runs.select("key", "lo", "hi", "size", "digest"), wide
        tops.append(nodes.where(F.col("size") <= width))
    found = None
    for height, part in enumerate(tops):
        part = part.select("key", F.lit(height).alias("height"), "lo", "hi", F.col("digest").alias("top"))
        found = part if found is None else found.unionByName(part)
    return levels, cut(found)


def siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval holds left and right of [lo, hi)."""
    return F.struct(joined(F.filter(kids, lambda x: x["hi"] <= lo)).alias("left"), joined(F.filter(kids, lambda x: x["lo"] >= hi)).alias("right"))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, bucket, kids, top, path) of the runs of leaves; ``tops`` has (key, height, lo, hi, top, path)."""
    at = tops.select("key", "height", "lo", "hi", "top", "path").where("height > 0")
    below = None
    for height in range(len(levels), 0, -1):
        width = FANOUT**height
        nodes = at.where(F.col("height") == height).drop("height")
        nodes = nodes if below is None else nodes.unionByName(below)
        nodes = nodes.select("key", F.floor(F.col("lo") / width).alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "top", "path")
        runs = levels[height - 1].select("key", "bucket", "lo", "hi", "kids")
        met = nodes.join(runs, ["key", "bucket"]).where("from <= lo and hi <= to")
        if height == 1:
            return cut(met.select("key", "bucket", "kids", "top", "path"))
        kids = met.select("key", "top", "path", "kids", F.explode("kids").alias("kid"))
        path = F.concat(F.array(siblings(F.col("kids"), F.col("kid")["lo"], F.col("kid")["hi"])), F.col("path"))
        below = cut(kids.select("key", F.col("kid")["lo"].alias("lo"), F.col("kid")["hi"].alias("hi"), "top", path.alias("path")))
    return at.select("key", F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("array<struct<lo:long,hi:long,digest:string>>").alias("kids"), "top", "path").limit(0)


def attach(leaves: DataFrame, runs: DataFrame, tops: DataFrame) -> DataFrame:
    """``leaves`` (key, rank, size, ...) with their ``top`` and ``path``."""
    rest = leaves.where("size > 1").withColumn("bucket", F.floor(F.col("rank") / FANOUT)).join(runs, ["key", "bucket"])
    own = siblings(F.col("kids"), F.col("rank"), F.col("rank") + 1)
    rest = rest.select(*leaves.columns, "top", F.concat(F.array(own), F.col("path")).alias("path"))
    lone = leaves.where("size = 1").join(tops.where("height = 0").select("key", "top", "path"), "key")
    return rest.unionByName(lone.select(*leaves.columns, "top", "path"))


def folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def leaf_digest(text: Column, of: dict[str, Column]) -> Column:
    return digest(field(of["doc_id"]), field(of["source"]), field(of["lang"]), field(of["n_chars"]), field(text))


def manifest(df: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``df``.

    Leaves of a source ascend by doc_id, null first; rows with the same doc_id by
    their leaf, so the order of repeated rows makes no difference, each being a
    leaf of its own.  Nulls of any column are hashed as ``-``, the null source is a
    source of its own, and a null doc_id is never tampered with.  Where ``every``
    divides the crc32 of the doc_id, ``folded_root`` starts from the leaf of the
    text with A-Z lower-cased.  A lone leaf is its source's subroot, a lone subroot
    the root, and an empty list of siblings has the hash of nothing.  An empty table
    gives an empty result; further columns are not read.
    """
    of = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("long")}
    text = F.col("text")
    touched = F.coalesce(F.crc32(of["doc_id"].cast("string").cast("binary")) % every == 0, F.lit(False)) & text.isNotNull()
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a null source is before all others
    leaves = df.select(
        key.alias("key"), of["doc_id"].alias("doc_id"), leaf_digest(text, of).alias("leaf"),
        F.when(touched, leaf_digest(F.translate(text, UPPER, UPPER.lower()), of)).alias("other"),
    )
    leaves = cut(ranked(written(leaves, "leaves"), ["key"], ["doc_id", "leaf"], ["key", "doc_id", "leaf", "other"]))
    levels, subroots = grow(leaves.withColumnRenamed("leaf", "digest"))

    sources = ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), F.col("top").alias("digest"), "height", "lo", "hi"), ["key"], ["source"], ["key", "source", "digest", "height", "lo", "hi"])
    sources = cut(sources)
    upper, tops = grow(sources)
    tops = tops.withColumn("path", F.array().cast(PATH))
    root = tops.first()
    root = root["top"] if root else None
    paths = attach(sources, descend(upper, tops), tops)
    subroots = cut(paths.select(F.col("source").alias("key"), "height", "lo", "hi", F.col("digest").alias("top"), "path"))

    docs = attach(leaves, descend(levels, subroots), subroots)
    siblings_of = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    docs = docs.select("doc_id", "leaf", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), F.sha2(siblings_of, 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return docs.withColumn("verified", F.col("folded_root") == F.col("root"))
