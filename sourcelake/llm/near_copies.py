"""Near copies by the Jaccard similarity of five-word shingles, at least 0.8.

MinHash bands only propose pairs; every pair is then checked on the whole sets
of shingle hashes, so no link is wrong.  ``BANDS`` bands of ``ROWS`` minima miss
a pair of similarity s with probability (1 - s**ROWS)**BANDS: 0.00006 at 0.8, less
above.  First each member of a band's bucket is checked against the bucket's
smallest one, which settles a large group of copies in linear time; pairs that
are not connected by then are checked one by one, with no cap on any bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm import simhash
from sourcelake.llm.common import chunks, cut, id_text, in_batches, map_texts, sha, written
from sourcelake.llm.components import components
from sourcelake.llm.simhash import SEED, keep_first, shingles

WORDS = 5
BANDS, ROWS = 32, 6
#: Hashes that are permuted at once.
HASHES = 1 << 13
_draw = np.random.default_rng(SEED)
FLIPS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, sorted; a text without words has the empty shingle's."""
    body, starts, ends = shingles(text, words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed long for each band: the digest of its minima and its number."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(found), HASHES):
        part = found[lo : lo + HASHES]
        for k in range(BANDS * ROWS):
            low[k] = min(low[k], ((part ^ FLIPS[k]) * FACTORS[k]).min())
    keys = [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def node(digest: Column) -> Column:
    """128 bits of a text's sha256: equal texts are one node."""
    return F.unhex(F.substring(digest, 1, 32))


def signatures(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha, node, n, keys): n distinct shingles."""

    def make():
        def sign(texts):
            found = [hashes(t, words) for t in texts]
            return [
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                pa.array([len(h) for h in found], pa.int32()),
                pa.array([band_keys(h) for h in found], pa.list_(pa.int64())),
            ]

        return sign

    signed = map_texts(id_text(df, id_col, text_col), make, "sha string, n int, keys array<long>")
    return signed.select("doc_id", "sha", node(F.col("sha")).alias("node"), "n", "keys")


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def similar(df: DataFrame, pairs: DataFrame, words: int, text_col: str) -> DataFrame:
    """The pairs(a, b) of nodes whose shingle sets have a Jaccard similarity of at least 0.8."""
    if pairs.isEmpty():
        return pairs

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(pc.binary_length(texts).to_pylist()):
                found = [hashes(t, words).view(np.int64) for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    texts = df.select(node(sha(df[text_col])).alias("node"), F.coalesce(df[text_col], F.lit("")).alias("text")).join(wanted.hint("merge"), "node", "left_semi")
    sets = cut(in_batches(texts).mapInArrow(run, "node binary, found array<long>").groupBy("node").agg(F.first("found").alias("found")))
    one = cut(pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("left")), "a"))
    both = one.join(sets.select(F.col("node").alias("b"), F.col("found").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    return both.where(shared * 9 >= (F.size("left") + F.size("right")) * 4).select("a", "b")


def fingerprint_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the nodes of each group of ``simhash.grouped``, linked to the group's smallest one."""
    rows = cut(simhash.grouped(df, 3, id_col, text_col).select(F.col("root").alias("group"), node(F.col("sha")).alias("node")).distinct())
    lowest = cut(rows.groupBy("group").agg(F.min("node").alias("a")))
    return cut(rows.join(lowest, "group").where("a < node").select("a", F.col("node").alias("b")).distinct())


def links(df: DataFrame, prints: DataFrame, words: int, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """(a, b): enough pairs of similar nodes to connect all that are connected by similar pairs of a common bucket.

    ``known`` links are among them; members of a bucket that they connect are left out of the comparison of all pairs.
    """
    members = cut(prints.select(F.explode("keys").alias("key"), "node", "n"))
    ends = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last"))
    leads = written(ends.where(F.col("lead")["node"] < F.col("last")).select("key", "lead"), "leads")
    met = cut(members.join(leads, "key").select("key", "node", "n", "lead"))
    lead = F.col("lead")
    to_lead = met.where((F.col("node") != lead["node"]) & sizes_fit(F.col("n"), lead["n"]))
    tried = cut(to_lead.select(lead["node"].alias("a"), F.col("node").alias("b")).distinct())
    found = cut(similar(df, tried, words, text_col))
    if known is not None:
        found = cut(found.union(known))
    # buckets whose members are not all connected yet: each pair of different groups
    roots = components(found)
    grouped = cut(met.distinct().join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    open_keys = written(grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "open")
    rest = cut(grouped.join(open_keys, "key", "left_semi"))
    other = rest.select("key", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    across = rest.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("root2")) & sizes_fit(F.col("n"), F.col("n2")))
    left = cut(across.select(F.col("node").alias("a"), "b").distinct().join(tried, ["a", "b"], "left_anti"))
    return found.union(similar(df, left, words, text_col))


def grouped(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(doc_id, sha, root) of every row: rows with one root are connected by links, ``known`` ones too.

    Texts without words are one group.  Words are lower-cased in A-Z only and
    split as in ``simhash``; a text of fewer words than a shingle is one shingle.
    """
    prints = cut(signatures(df, words, id_col, text_col))
    roots = components(links(df, prints, words, text_col, known))
    return prints.join(roots, "node", "left").select("doc_id", "sha", F.coalesce("root", "node").alias("root"))


def drop_near_copies(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns as they are: that with the smallest id (then digest; null ids last)."""
    return keep_first(df, grouped(df, words, id_col, text_col), id_col, text_col)


def drop_linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``drop_near_copies`` after ``simhash``: groups are connected by fingerprints at most two bits apart, and by similar texts."""
    return keep_first(df, grouped(df, WORDS, id_col, text_col, fingerprint_links(df, id_col, text_col)), id_col, text_col)
