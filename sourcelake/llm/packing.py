"""Documents packed into sequences of a fixed capacity by minimum bin slack.

Per bin, the longest length that is left is laid down, and a subset-sum table
over the lengths that are left, kept as the bits of an integer, finds the fullest
combination for the rest of the bin.  That combination is then removed.  Lengths
are at most the capacity, so the state of this search is a histogram with one
count for each length, however many documents there are; a combination is removed
as often as the counts allow at once, which bin after bin would do as well.  The
result is a plan of slots: for each length, ranges of ranks and where they go.
Pieces are ranked within their length over all tasks and look their slot up.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import id_text, map_texts, ranked, written

#: Units whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
#: Units that the library encodes in one go.
TOGETHER = 10_000
#: One space or line end between two characters that are no white space.
GAP = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Before a unit that has no space before it and does not begin with a line end.
BARE = "\0"


class UnitIds:
    """Ids of texts by way of their distinct units, each of which the library encodes once.

    A unit is a word with the space or line end before it.  The tokenizer's own
    pattern always splits there: a space between two visible characters begins a
    pre-token, and a line end between them is one.  Texts with runs of white space
    are cut at such gaps alone.  A tokenizer that is not of this kind gets whole
    texts.

    Units are kept without their space: ``word`` for " word", ``\\nword`` as it is,
    and any other after ``BARE``.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        kind = json.loads(self.model.to_str())
        splitter = kind["pre_tokenizer"] or {}
        added = [t["content"] for t in kind["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
        self.by_units = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space") and not kind["normalizer"] and not kind["post_processor"] and not added
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        special = {t["content"] for t in kind["added_tokens"]}
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():  # a character of a byte-level token is a byte
            self.width[i] = len(token.encode()) if token in special else len(token)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.uneven: set[str] = set()
        self.begin = [np.zeros(1, dtype=np.int64)]
        self.flat = [np.zeros(0, dtype=np.int32)]
        self.size = 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, kept: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        at = len(self.index)
        self.index.update(zip(kept, range(at, at + len(kept)), strict=True))
        self.flat.append(ids.astype(np.int32))
        self.begin.append(ends + self.size)
        self.size += len(ids)

    def one_by_one(self, kept: list[str]) -> None:
        found = self.library([self.whole(u) for u in kept])
        self.add(kept, np.array([i for ids in found for i in ids], dtype=np.int32), np.cumsum([len(ids) for ids in found], dtype=np.int64))

    def together(self, words: list[str]) -> None:
        """Words with a space before them, encoded as one text and told apart by their bytes."""
        ids = np.array(self.library([" " + " ".join(words)])[0], dtype=np.int32)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), dtype=np.int64, count=len(words)) + 1)
        reach = np.cumsum(self.width[ids])
        at = np.searchsorted(reach, ends)
        if at[-1] >= len(reach) or (reach[at] != ends).any():
            self.one_by_one(words)
        else:
            self.add(words, ids, at + 1)

    def learn(self, kept: set[str]) -> None:
        others = {u for u in kept if not u or u[0] == BARE or u[0].isspace() or u[-1].isspace()}
        self.uneven.update(u for u in others if not u or u[-1].isspace())
        words = list(kept.difference(others))
        for lo in range(0, len(words), TOGETHER):
            self.together(words[lo : lo + TOGETHER])
        self.one_by_one(list(others))
        self.flat, self.begin = [np.concatenate(self.flat)], [np.concatenate(self.begin)]

    @staticmethod
    def whole(kept: str) -> str:
        return kept[1:] if kept[:1] == BARE else kept if kept[:1] == "\n" else " " + kept

    @staticmethod
    def at_gaps(text: str) -> list[str]:
        units = (text[lo:hi] for lo, hi in itertools.pairwise([0, *(m.start() for m in GAP.finditer(text)), len(text)]))
        return [u[1:] if u[0] == " " and u[1:2] not in ("", BARE, "\n") else BARE + u for u in units]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_units:
            return [np.array(x, dtype=np.int32) for x in self.library(texts)]
        if len(self.index) > REMEMBERED:
            self.forget()
        split = [self.at_gaps(t) if BARE in t else (BARE + t.replace("\n", " \n")).split(" ") if t else [] for t in texts]
        self.learn_new(split)
        if self.uneven:
            split = [self.at_gaps(t) if not self.uneven.isdisjoint(units[:-1]) else units for t, units in zip(texts, split, strict=True)]
            self.learn_new(split)
        counts = [len(u) for u in split]
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=sum(counts))
        begin, flat = self.begin[0], self.flat[0]
        sizes = begin[at + 1] - begin[at]
        after = np.cumsum(sizes)
        ids = flat[np.repeat(begin[at] - (after - sizes), sizes) + np.arange(int(sizes.sum()))]
        return np.split(ids, np.r_[0, after][np.cumsum(counts)[:-1]]) if texts else []

    def learn_new(self, split: list[list[str]]) -> None:
        new = set().union(*split).difference(self.index)
        if new:
            self.learn(new)


@functools.lru_cache(maxsize=1)
def unit_ids(tokenizer_file: str) -> UnitIds:
    """One in each worker, so that tasks that follow know the units of those before."""
    return UnitIds(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of ``docs(doc_id, text)``, row by row."""

    def make():
        encode = unit_ids(tokenizer_file).encode

        def fn(texts: list[str]) -> list[pa.Array]:
            cuts = []
            for ids in encode(texts):
                ids = np.append(ids, end_id).astype("<u4")
                first = len(ids) % capacity or capacity  # the first piece is the shorter one
                borders = [0, *range(first, len(ids) + 1, capacity)]
                cuts.append([{"piece": k, "start": lo, "length": hi - lo, "ids_crc32": zlib.crc32(ids[lo:hi].tobytes())} for k, (lo, hi) in enumerate(itertools.pairwise(borders))])
            return [pa.array(cuts, kind)]

        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return fn

    cut_up = map_texts(docs, make, "cuts array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    return cut_up.select("doc_id", F.explode("cuts").alias("p")).select("doc_id", "p.*")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats, whose sum is the greatest that ``counts`` can make within ``room``."""
    reached, steps = 1, []  # bit s: some combination sums to s
    for length in sorted((n for n, have in counts.items() if have and n <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reached))
            reached |= (reached << (length * times)) & ((1 << (room + 1)) - 1)
            left, times = left - times, times * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * times
            total -= length * times
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many sequences have each; every length is used as often as it is counted."""
    counts, found = dict(counts), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = Counter([longest, *fullest(counts, capacity - longest)])
        counts[longest] += 1
        times = min(counts[n] // k for n, k in chosen.items())
        found.append((sorted(chosen.elements(), reverse=True), times))
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return found


def slots(found: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Columns: length, first rank, pieces of this length in a sequence, first sequence, offset of the first; sorted."""
    rows, used, sequence = [], Counter(), 0
    for lengths, times in found:
        at = 0
        for n, same in itertools.groupby(lengths):
            k = len(list(same))
            rows.append((n, used[n], k, sequence, at))
            used[n] += k * times
            at += n * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(df: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document's ids end with ``end_id``, so a null or empty text is one piece of
    length 1.  A document of more than ``capacity`` ids is cut into pieces of that
    length, the first of which may be shorter.  Repeated rows and rows without a
    doc_id are packed like any other; pieces of one length are ranked by (doc_id,
    piece, crc).  An empty table gives an empty result; further columns are not read.
    The histogram in the driver has one count for each length up to ``capacity``.
    """
    found = written(pieces(id_text(df, id_col, text_col), tokenizer_file, end_id, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    table = slots(plan(counts, capacity), capacity)

    def placed(batches):
        keys = table[:, 0] << 44 | table[:, 1]  # ranks are below 2**44
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            n, first, each, sequence, at = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            turn, place = np.divmod(rank - first, each)
            columns = [*(batch.column(c) for c in names[:5]), pa.array(sequence + turn), pa.array(at + place * n)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    order = ranked(found, ["length"], ["doc_id", "piece", "ids_crc32", "start"], names[:5])
    return order.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
