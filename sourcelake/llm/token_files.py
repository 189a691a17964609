"""Token ids in binary shards with a shared compression dictionary.

Each document's ids are serialised as little-endian integers and compressed on
their own, with one zstandard dictionary that was trained on serialised id
arrays of a bounded sample.  A shard is a byte string:

    8 bytes   magic
    8 bytes   hash of the dictionary (0: none)
    4 bytes   bytes of an id (2 or 4)
    4 bytes   number of documents n
    n x 9     doc_id (signed, 8 bytes) and whether there is one (1 byte)
    n x 4     ids of each document
    (n+1) x 4 where each document's compressed frame begins, from the first
    the frames

so a document is read with its index entry, its frame and the dictionary alone.
Shards are rows of a table in the shared folder, written and read by Spark on
any store, in ascending order of (part, seq) and so of doc_id.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelake.llm.common import id_text, map_texts, new_path, shuffle_parts, written

MAGIC = b"SLTOKEN1"
#: Sample that the dictionary is trained on: documents, and characters of them, about.
SAMPLE_ROWS, SAMPLE_CHARS = 1_000, 4_000_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
#: Compressed bytes after which a shard ends.
SHARD_BYTES = 4_000_000
#: Distinct words whose ids a task remembers; beyond, it starts anew.
REMEMBERED = 600_000
#: Words encoded together, and marks that may end one of them.
BATCH = 1_000
MARKS = tuple(".,;:!?")


@dataclass(frozen=True)
class Written:
    """Where the shards are, and the dictionary they need."""

    path: str
    dictionary: bytes


class WordIds:
    """Ids of texts by way of their distinct words, each of which goes through the library once.

    Words that are letters alone, or letters and one mark, are encoded together:
    the library makes one pre-token of each run, and a pre-token's last token
    ends a word.  If a batch has another number of ends than expected, its words
    are encoded one by one, as are all other words.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        suffix = json.loads(self.model.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.begin = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int64)
        self.size, self.new = 0, []

    def learn(self, words: list[str]) -> None:
        plain, marked, others = [], [], []
        for w in words:
            (plain if w.isalpha() else marked if w[-1:] in MARKS and w[:-1].isalpha() else others).append(w)
        if not self.joins:
            plain, marked, others = [], [], words
        for part, each in ((plain, 1), (marked, 2)):
            for lo in range(0, len(part), BATCH):
                self.together(part[lo : lo + BATCH], each)
        self.one_by_one(others)
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in self.new)])
        self.begin = np.concatenate([self.begin, *(ends for _, ends in self.new)])
        self.new = []

    def together(self, words: list[str], each: int) -> None:
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != each * len(words):  # every run has an end at least, so equal means one each
            self.one_by_one(words)
        else:
            self.add(words, ids, ends[each - 1 :: each])

    def one_by_one(self, words: list[str]) -> None:
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        self.add(words, np.array([i for ids in found for i in ids], dtype=np.int64), np.cumsum([len(ids) for ids in found], dtype=np.int64))

    def add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.new.append((ids, self.size + ends))
        self.size += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]  # white space is dropped, and no token reaches over it
        if len(self.index) > REMEMBERED:
            self.forget()
        self.learn(list(set().union(*split).difference(self.index)))
        counts = [len(words) for words in split]
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=sum(counts))
        sizes = (self.begin[1:] - self.begin[:-1])[at]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[at] - (after - sizes), sizes) + np.arange(int(sizes.sum()))]
        return np.split(ids, np.r_[0, after][np.cumsum(counts)[:-1]]) if texts else []


@functools.lru_cache(maxsize=1)
def word_ids(tokenizer_file: str) -> WordIds:
    """One in each worker, so that tasks that follow know the words of those before."""
    return WordIds(tokenizer_file)


def width_of(tokenizer_file: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 4


def train(docs: DataFrame, tokenizer_file: str, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample, chosen by a hash of the key; empty if there is too little."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not size["n"]:
        return b""
    share = min(1.0, SAMPLE_ROWS / size["n"], SAMPLE_CHARS / max(1, size["chars"] or 0))
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < int(1e6 * share))

    def make():
        encode = word_ids(tokenizer_file).encode
        return lambda texts: [pa.array([np.append(ids, end_id).astype(f"<u{width}").tobytes() for ids in encode(texts)], pa.binary())]

    rows = map_texts(part, make, "ids binary").collect()
    samples = sorted(bytes(r["ids"]) for r in rows if len(r["ids"]) >= 8)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary) if dictionary else 0


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)


def shard_of(rows: list[tuple[int | None, int, bytes]], dictionary: bytes, width: int) -> bytes:
    index = b"".join(struct.pack("<qB", i or 0, i is not None) for i, _, _ in rows)
    sizes = np.array([n for _, n, _ in rows], dtype="<u4").tobytes()
    at = np.cumsum([0, *(len(f) for _, _, f in rows)]).astype("<u4").tobytes()
    head = MAGIC + struct.pack("<QII", dictionary_hash(dictionary), width, len(rows))
    return b"".join([head, index, sizes, at, *(f for _, _, f in rows)])


class Shard:
    """Reads one document at a time."""

    def __init__(self, content: bytes, dictionary: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token shard")
        digest, self.width, self.count = struct.unpack_from("<QII", content, 8)
        if digest != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.content, n = content, self.count
        self.sizes = np.frombuffer(content, "<u4", n, 24 + 9 * n)
        self.at = np.frombuffer(content, "<u4", n + 1, 24 + 13 * n)
        self.begin = 24 + 13 * n + 4 * (n + 1)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def doc_id(self, k: int) -> int | None:
        value, there = struct.unpack_from("<qB", self.content, 24 + 9 * k)
        return value if there else None

    def ids(self, k: int) -> np.ndarray:
        lo, hi = self.begin + int(self.at[k]), self.begin + int(self.at[k + 1])
        return np.frombuffer(self.zstd.decompress(self.content[lo:hi]), dtype=f"<u{self.width}")


def write(df: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> Written:
    """Encode every text of ``df``, add ``end_id`` to each, and write the shards.

    A null or empty text has the end id alone.  Repeated rows are written again;
    equal doc_ids lie side by side, those without one first.  A document is in
    one shard, however long; an empty table gives no shard.
    """
    docs = id_text(df, id_col, text_col)
    width = width_of(tokenizer_file)
    dictionary = train(docs, tokenizer_file, end_id, width)

    def make():
        encode, zstd = word_ids(tokenizer_file).encode, compressor(dictionary)

        def fn(texts: list[str]) -> list[pa.Array]:
            arrays = [np.append(ids, end_id).astype(f"<u{width}") for ids in encode(texts)]
            return [pa.array([len(a) for a in arrays], pa.int64()), pa.array([zstd.compress(a.tobytes()) for a in arrays], pa.binary())]

        return fn

    # written before it is sorted: drawing range borders would encode all texts twice
    frames = written(map_texts(docs, make, "n_tokens long, frame binary"), "frames")
    parts = shuffle_parts(df.sparkSession)
    ordered = frames.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "frame")

    def pack(batches):
        part, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def shard():
            content = shard_of(rows, dictionary, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(r[1] for r in rows)], pa.int64()), pa.array([content], pa.binary())], names=["part", "seq", "n_ids", "content"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append(row)
                held += len(row[2])
                if held >= SHARD_BYTES:
                    yield shard()
                    rows, held, seq = [], 0, seq + 1
        if rows:
            yield shard()

    path = new_path(df.sparkSession, "token-shards")
    ordered.mapInArrow(pack, "part int, seq int, n_ids long, content binary").write.parquet(path)
    return Written(path, dictionary)


def read(spark: SparkSession, files: Written) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone.

    ``start`` counts the ids of all documents before it; the crc is that of the
    ids as little-endian unsigned 32-bit integers.
    """
    shards = spark.read.parquet(files.path)
    dictionary = files.dictionary

    def unpack(batches):
        for batch in batches:
            for part, seq, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                shard = Shard(content, dictionary)
                sizes = shard.sizes.astype(np.int64)
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(shard.count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * shard.count, pa.int32()), pa.array([seq] * shard.count, pa.int32()), pa.array([shard.doc_id(k) for k in range(shard.count)], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "content").mapInArrow(unpack, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # ids before each shard: sums of whole parts (as many rows as partitions), then inside a part
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before_by("part")), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("offset"))
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def before_by(column: str):
    return Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
