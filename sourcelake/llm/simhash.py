"""SimHash near-duplicates by anchor-point covering.

A fingerprint has bit i set if more than half of the text's shingle hashes have
it.  The 64 bits are cut into groups of odd length.  In each group the two
constant words are a perfect covering code (every word is within half the
group's length of one), so the anchors of the 64-bit space are the vectors of
group majorities, and each fingerprint has one nearest anchor: its home.  A
fingerprint within the threshold of another lies within covering radius plus
threshold of the other's home, group by group: as many bits as must change for
its majorities to become the anchor's are at most the threshold.  It is
replicated to all such anchors; each anchor compares those that live there with
those that visit.  Every link is found, with no cap on any anchor.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import cut, id_text, map_texts, one_of_each
from sourcelake.llm.components import components

#: Odd lengths that add up to 64; more and shorter groups: more anchors, fewer visitors each, more replicas.
GROUPS = (3,) * 18 + (5,) * 2
DISTANCE = 2
SEED = 42
#: Hashes whose bits are unpacked at once.
HASHES = 1 << 16
UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle begins and ends; fewer words than a shingle are one."""
    body = b" ".join(text.encode().translate(UPPER).split())  # bytes split at \\x20\\x09-\\x0D
    gaps = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 32)
    starts, ends = np.r_[0, gaps + 1].tolist(), np.r_[gaps, len(body)].tolist()
    if len(starts) < words:
        return body, [0], [len(body)]
    return body, starts[: len(starts) - words + 1], ends[words - 1 :]


def fingerprint(text: str, words: int = 3) -> int:
    """Of the shingles of ``words`` words each; 0 for a text without words."""
    body, starts, ends = shingles(text, words)
    if not body:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(starts), HASHES):
        h = np.array([digest(body[a:b], SEED) for a, b in zip(starts[lo : lo + HASHES], ends[lo : lo + HASHES], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, sha): the fingerprint's bits as a signed long, and the text's digest."""

    def make():
        return lambda texts: [
            pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        ]

    return map_texts(id_text(df, id_col, text_col), make, "fp long, sha string")


def home(fp: Column) -> Column:
    """The vector of group majorities, a bit for each group."""
    at, bits = 0, []
    for k, n in enumerate(GROUPS):
        ones = F.bit_count(F.shiftright(fp, at).bitwiseAND(F.lit((1 << n) - 1)))
        bits.append(F.when(ones * 2 > n, F.lit(1 << k)).otherwise(F.lit(0)))
        at += n
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def visits(fp: Column) -> Column:
    """Masks of majorities that change within the threshold: the anchors to visit, as differences to home."""
    at, flips = 0, []
    for k, n in enumerate(GROUPS):
        ones = F.bit_count(F.shiftright(fp, at).bitwiseAND(F.lit((1 << n) - 1)))
        need = F.abs(ones * 2 - n) / 2 + F.lit(0.5)  # bits to change until the majority does
        flips.append(F.struct(F.lit(1 << k).alias("mask"), need.cast("int").alias("need")))
        at += n
    return F.filter(F.array(*flips), lambda x: x["need"] <= DISTANCE)


def linked(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most two bits."""
    assert DISTANCE == 2 and sum(GROUPS) == 64 and all(n % 2 for n in GROUPS)
    known = prints.select("fp", home(F.col("fp")).alias("home"), visits(F.col("fp")).alias("flips"))
    ones = F.filter("flips", lambda x: x["need"] == 1)
    single = F.transform("flips", lambda x: x["mask"])
    pairs = F.flatten(F.transform(ones, lambda x, i: F.transform(F.slice(ones, i + 2, F.size(ones)), lambda y: x["mask"] + y["mask"])))
    visitors = known.select("fp", F.explode(F.concat(F.array(F.lit(0)), single, pairs)).alias("mask"), "home").select("fp", F.col("home").bitwiseXOR(F.col("mask")).alias("anchor"))
    living = known.select(F.col("fp").alias("other"), F.col("home").alias("anchor"))
    met = visitors.join(living, "anchor").where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE))
    return met.select(F.col("fp").alias("a"), F.col("other").alias("b"))


def grouped(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, fp, component_id): the smallest doc_id reachable over links, itself included.

    Null, empty and wordless texts share fingerprint 0.  Rows map one to one: a
    repeated row is linked to its twin; a row with a null id stays, and its
    component_id is that of its group's smallest id (null if all are).  Words
    are lower-cased in A-Z only.  An empty table gives an empty result.
    """
    prints = cut(fingerprints(df, words, id_col, text_col))
    # one row for each distinct fingerprint: copies are never paired
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(first))
    of_fp = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(of_fp.join(smallest, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "sha", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprint in 16 hex digits.  See ``grouped``."""
    return grouped(df, words, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each root of groups(doc_id, sha, root): that with the smallest id (then digest; null ids last)."""
    rows = cut(groups.groupBy("root", "doc_id", "sha").agg(F.count(F.lit(1)).alias("copies")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("sha"))
    best = cut(rows.groupBy("root").agg(F.min(rank).alias("best")))
    stays = F.col("doc_id").eqNullSafe(F.col("best")["doc_id"]) & (F.col("sha") == F.col("best")["sha"])
    return one_of_each(df, rows.join(best, "root").select("doc_id", "sha", "copies", stays.alias("stays")), id_col, text_col)


def drop_near_duplicates(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns as they are: that with the smallest id (then digest; null ids last)."""
    return keep_first(df, grouped(df, words, id_col, text_col), id_col, text_col)


def masks() -> list[int]:
    """All differences of at most two bits (for tests)."""
    return [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in itertools.combinations(range(64), 2))]
