"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words that a document shares with a benchmark item; they
are found with a rolling hash over word numbers.  Only where an item is seeded
does tiling start: running Karp-Rabin finds the longest common runs of unmarked
words, marks them as tiles, and goes on with shorter ones, so that a passage
whose parts were put in another order is still covered.  An item whose words
are covered to the threshold contaminates the document.

The benchmark is broadcast in blocks of a bounded size; documents are read once
for each block and are never shuffled.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import chunks, id_text, in_batches, keep_rows

WORD = re.compile(r"\w+")
SEED_WORDS = 5
#: Bytes of benchmark text that one broadcast block holds, about.
BLOCK_BYTES = 8_000_000
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tile(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length), none overlapping.

    Negative numbers in ``text`` match nothing.  Longer runs are marked first; of
    equal ones, the first in the item, then in the text.
    """
    in_text, in_item = [x < 0 for x in text], [False] * len(item)
    tiles, s = [], max(least, min(20, len(item)))
    while True:
        longest, found = scan(text, item, in_text, in_item, s)
        if longest > 2 * s:
            s = longest
            continue
        queue = sorted(found, key=lambda m: (-m[2], m[1], m[0]))
        for t, p, n in queue:
            if not any(in_text[t : t + n]) and not any(in_item[p : p + n]):
                in_text[t : t + n] = [True] * n
                in_item[p : p + n] = [True] * n
                tiles.append((t, p, n))
        # what an earlier tile cut short is found again before runs get shorter
        if queue and scan(text, item, in_text, in_item, s)[1]:
            continue
        if s <= least:
            return tiles
        s = max(least, s // 2)


def scan(text: list[int], item: list[int], in_text: list[bool], in_item: list[bool], s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal common runs of at least s unmarked words, found by running Karp-Rabin hashes."""
    starts = defaultdict(list)
    for at, code in rolling(text, in_text, s):
        starts[code].append(at)
    longest, found = 0, []
    for p, code in rolling(item, in_item, s):
        for t in starts.get(code, ()):
            if text[t : t + s] != item[p : p + s]:
                continue
            if t and p and not in_text[t - 1] and not in_item[p - 1] and text[t - 1] == item[p - 1]:
                continue  # not maximal: the run that begins before holds it
            n = s
            while t + n < len(text) and p + n < len(item) and not in_text[t + n] and not in_item[p + n] and text[t + n] == item[p + n]:
                n += 1
            found.append((t, p, n))
            longest = max(longest, n)
    return longest, found


def rolling(seq: list[int], marked: list[bool], s: int):
    """(place, hash) of each window of s words without a marked one."""
    mod, base = (1 << 61) - 1, 1_000_003
    top = pow(base, s, mod)
    code = run = 0
    for i, x in enumerate(seq):
        if marked[i]:
            code = run = 0
            continue
        code = (code * base + x + 1) % mod
        run += 1
        if run > s:
            code = (code - top * (seq[i - s] + 1)) % mod
        if run >= s:
            yield i - s + 1, code


class Benchmark:
    """A block of items, numbered words, and their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := words_of(t or ""))]
        self.word: dict[str, int] = {}
        self.ids = [[self.word.setdefault(x, len(self.word) + 1) for x in w] for _, w in self.items]
        self.seeds: dict[int, tuple[np.ndarray, dict[int, set[int]]]] = {}
        by: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, ids in enumerate(self.ids):
            n = min(SEED_WORDS, len(ids))  # an item of fewer words is one seed
            for code in hashes(np.array(ids, dtype=U64), n).tolist():
                by[n][code].add(k)
        for n, found in by.items():
            self.seeds[n] = (np.array(sorted(found), dtype=U64), dict(found))

    def covered(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, number of tiles, covered words, words) of every seeded item of a text."""
        get = self.word.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
        if not ids.any():
            return []
        known = np.r_[0, np.cumsum(ids == 0)]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (codes, owner) in self.seeds.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] == known[:-n])  # windows of known words only
            code = hashes(ids.astype(U64), n)[at]
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[k] == code
            for a, c in zip(at[hit].tolist(), code[hit].tolist(), strict=True):
                for item in owner[c]:
                    places[item].append((a, n))
        out = []
        for item, seeds in sorted(places.items()):
            want = self.ids[item]
            part: list[int] = []
            end = -1
            for a, n in seeds:  # the seeded stretches, apart by -1
                if a > end and part:
                    part.append(-1)
                part += ids[max(a, end) : a + n].tolist()
                end = a + n
            tiles = tile(part, want, min(SEED_WORDS, len(want)))
            out.append((self.items[item][0], len(tiles), sum(t[2] for t in tiles), len(want)))
        return out


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    if len(ids) < n:
        return np.zeros(0, dtype=U64)
    code = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        code = code * BASE + ids[k : len(ids) - n + 1 + k]
    return code


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The benchmark in lists of a bounded size; one block is on the driver at a time.

    Whoever iterates gets each block from a query of its own.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows
        yield sorted(((r[0], r[1]) for r in part.distinct().collect()), key=lambda r: (r[0] is None, r[0], r[1]))


@functools.lru_cache(maxsize=1)
def prepared(items: tuple) -> Benchmark:
    return Benchmark(list(items))


def overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, coverage) of every seeded pair.

    Words are runs of letters, digits and underscores in lower case.  An item of
    fewer than five words is seeded by all of them; one without words, null or
    empty, matches nothing, as does a null or empty document.  Repeated
    documents and items give a row each (equal (item_id, text) rows count once);
    null ids stay null.  Empty tables give an empty result.
    """
    docs = in_batches(id_text(df, id_col, text_col))
    schema = "doc_id long, item_id long, n_tiles long, covered_words long, item_words long, coverage double"

    def tiled(items: tuple) -> DataFrame:
        def run(batches):
            block = prepared(items)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                out = []
                for lo, hi in chunks([n or 0 for n in pa.compute.binary_length(texts).to_pylist()]):
                    for k, text in enumerate(texts.slice(lo, hi - lo).to_pylist(), lo):
                        out += [(ids[k], i, n, c, m, c / m) for i, n, c, m in block.covered(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

        import pyarrow.compute  # noqa: F401

        return docs.mapInArrow(run, schema)

    found = None
    for items in blocks(benchmark, item_col, item_text_col):
        part = tiled(tuple(items))
        found = part if found is None else found.unionAll(part)
    return found


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = 0.8, **columns: str) -> DataFrame:
    """Pairs of ``overlaps`` that reach the threshold, with a column ``contaminated`` (true)."""
    return overlaps(df, benchmark, **columns).where(F.col("coverage") >= threshold).withColumn("contaminated", F.lit(True))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that no item contaminates."""
    for items in blocks(benchmark, item_col, item_text_col):

        def make(items=tuple(items)):
            block = prepared(items)
            return lambda texts: [all(c < threshold * n for _, _, c, n in block.covered(t)) for t in texts]

        df = keep_rows(df, text_col, make)
    return df
