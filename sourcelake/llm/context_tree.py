"""Language-model scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes and an end mark; the context of a byte are the bytes
before it, back to a start mark.  Each byte is decomposed into eight binary
decisions along a tree of 255 nodes, and every context of every depth keeps a
Krichevsky-Trofimov estimate at each of them.  Weighting mixes the estimates of
all depths: a context's weighted probability is half its own estimate plus half
the product of its children's.

Counting, the products (a grouped sum for each depth, deepest first) and the
predictions (a join for each depth, shallowest first) are Spark jobs over tables
of contexts, which grow with the corpus.  Their result, a log-probability for
each distinct gram of context and byte, is applied to the texts in blocks of a
bounded size that are broadcast in turn; so are the word counts of the base
score.  Texts are never shuffled.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.common import chunks, id_text, in_batches, in_parts, shuffle_parts
from sourcelake.llm.common import written as written_table

#: Bytes of context.
DEPTH = 5
#: Start and end mark: a byte that UTF-8 never has.
MARK = 255
#: Entries of a broadcast block (20 bytes each).
BLOCK_ENTRIES = 4_000_000
#: Distinct grams or words that a task adds up before it hands them on.
HELD = 1_500_000
#: Characters of texts that a task takes apart at a time.
AT_ONCE = 1_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SECOND_SEED = 0x9E3779B97F4A7C15


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` through a table; the shuffle files that made it can go then.

    Spark drops a finished job's shuffle files when the driver has collected the
    objects that refer to them, which by itself may be half an hour later.
    """
    out = written_table(df, what)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def grams(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed (context, byte) of every byte and end mark, and how many each text has."""
    parts = [t.encode() for t in texts]
    pad = bytes([MARK]) * depth
    flat = np.frombuffer(b"".join(pad + p + bytes([MARK]) for p in parts), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(p) + 1 for p in parts])
    code = np.zeros(len(flat) - depth, dtype=np.int64)
    for k in range(depth + 1):
        code = code << 8 | flat[k : len(flat) - depth + k]
    begin = np.cumsum(sizes + depth) - sizes - depth
    keep = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return code[keep], sizes


def words(text: str) -> list[bytes]:
    """Words in A-Z lower case, split at bytes \\x20 and \\x09-\\x0D, then the end (empty)."""
    return [*text.encode().translate(LOWER).split(), b""]


def keys(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A word's 128 bits: two hashes with different seeds."""
    one = np.array([xxhash.xxh64_intdigest(w, 0) for w in found], dtype=np.uint64).view(np.int64)
    two = np.array([xxhash.xxh64_intdigest(w, SECOND_SEED) for w in found], dtype=np.uint64).view(np.int64)
    return one, two


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n): how often each gram is in training texts, 0 if only in others."""

    def run(batches):
        code, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            train, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for lo, hi in chunks([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], AT_ONCE):
                found, sizes = grams(texts.slice(lo, hi - lo).to_pylist(), depth)
                own, times = added(found, np.repeat(train[lo:hi].astype(np.int64), sizes))
                code, n = added(np.r_[code, own], np.r_[n, times])
                if len(code) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["gram", "n"])
                    code, n = code[:0], n[:0]
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["gram", "n"])

    import pyarrow.compute  # noqa: F401

    return docs.select("train", "text").mapInArrow(run, "gram long, n long")


def added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(n, first)


def word_counts(docs: DataFrame) -> DataFrame:
    """(one, two, n): the counts of training words by their 128 bits."""

    def run(batches):
        held: dict[bytes, int] = {}
        get = held.get
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in words(text):
                    held[w] = get(w, 0) + 1
                if len(held) > HELD // 3:
                    yield rows_of(held)
                    held.clear()
        if held:
            yield rows_of(held)

    def rows_of(held: dict[bytes, int]) -> pa.RecordBatch:
        one, two = keys(list(held))
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(list(held.values()), pa.int64())], names=["one", "two", "n"])

    parts = docs.where("train").select("text").mapInArrow(run, "one long, two long, n long")
    return parts.groupBy("one", "two").agg(F.sum("n").alias("n"))


def log_gamma(x: Column) -> Column:
    """Natural logarithm of gamma for x >= 0.5: Stirling's series, seven steps further up."""
    y = x + 7
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - F.log(product)


def log_kt(n0: Column, n1: Column) -> Column:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def decisions(counts: DataFrame) -> DataFrame:
    """(context, byte, n) -> (context, node, bit, n), eight binary decisions each."""
    k = F.explode(F.array(*[F.struct((F.lit(1 << i) + F.shiftright(F.col("byte"), 8 - i)).cast("int").alias("node"), F.shiftright(F.col("byte"), 7 - i).bitwiseAND(1).alias("bit")) for i in range(8)])).alias("k")
    return counts.select("*", k).select(*counts.columns, "k.node", "k.bit")


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, logp): log10 probability of each gram's byte in its context."""
    spark = counts.sparkSession
    parts = shuffle_parts(spark)
    # dealt by context, so that a context's bytes and nodes are grouped where they are
    context = F.shiftright("gram", 8).alias("context")
    by_byte = written(
        counts.select(context, F.col("gram").bitwiseAND(255).cast("int").alias("byte"), "n").groupBy("context", "byte").agg(F.sum("n").alias("n")), "grams"
    )
    ones = F.sum(F.col("n") * F.col("bit")).alias("n1")
    level = decisions(by_byte.repartition(parts, "context")).groupBy("context", "node").agg((F.sum("n") - F.sum(F.col("n") * F.col("bit"))).alias("n0"), ones)
    # deepest first: own estimate, children's product, weight of the own estimate
    levels = {depth: written(level.withColumn("lw", F.when(F.col("n0") + F.col("n1") > 0, log_kt(F.col("n0"), F.col("n1"))).otherwise(F.lit(0.0))).withColumn("w", F.lit(1.0)), "level")}
    for d in range(depth - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << 8 * d) - 1).alias("context")
        up = levels[d + 1].groupBy(shorter, "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        up = up.withColumn("own", F.when(F.col("n0") + F.col("n1") > 0, log_kt(F.col("n0"), F.col("n1"))).otherwise(F.lit(0.0)))
        gap = F.col("below") - F.col("own")
        most = F.greatest("below", "own") + F.log1p(F.exp(-F.abs(gap))) - math.log(2)
        levels[d] = written(up.select("context", "node", "n0", "n1", most.alias("lw"), (1 / (1 + F.exp(gap))).alias("w")), "level")
    # shallowest first: what the depths above have mixed (mixed), what is left for deeper ones (left), prediction of a one
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    row = levels[0].select("context", "node", estimate.alias("p"), (F.col("w") * estimate).alias("mixed"), (1 - F.col("w")).alias("left"))
    for d in range(1, depth + 1):
        above = row.select(F.col("context").alias("shorter"), "node", F.col("p").alias("p0"), F.col("mixed").alias("m0"), F.col("left").alias("l0"))
        here = levels[d].withColumn("shorter", F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1)).join(above, ["shorter", "node"])
        # a context that training has not seen predicts as the one above it
        p = F.when(F.col("n0") + F.col("n1") > 0, F.col("m0") + F.col("l0") * estimate).otherwise(F.col("p0"))
        row = here.select("context", "node", p.alias("p"), (F.col("m0") + F.col("l0") * F.col("w") * estimate).alias("mixed"), (F.col("l0") * (1 - F.col("w"))).alias("left"))
    # a context has 255 nodes at most: one map for each, so that grams need not be taken apart before they are dealt
    maps = row.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("node", "p"))).alias("p"))
    log = F.lit(0.0)
    for i in range(8):
        one = F.element_at("p", (F.lit(1 << i) + F.shiftright(F.col("byte"), 8 - i)).cast("int"))
        log = log + F.log10(F.when(F.shiftright(F.col("byte"), 7 - i).bitwiseAND(1) == 1, one).otherwise(1 - one))
    told = by_byte.select("context", "byte").join(maps, "context")
    return told.select((F.shiftleft("context", 8) + F.col("byte")).alias("gram"), log.alias("logp"))


def blocks(df: DataFrame, key: str, columns: list[str]):
    """The table in blocks of a bounded size, each sorted by key, as numpy arrays; one on the driver at a time."""
    n = 1 + df.count() // BLOCK_ENTRIES
    for k in range(n):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else df
        got = part.select(key, *columns).toArrow().sort_by(key)
        yield [got.column(c).combine_chunks().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0) for c in [key, *columns]]


def add_scores(df: DataFrame, counts: Iterator, model: Iterator, depth: int) -> DataFrame:
    """``df`` with the log-probabilities of ``model`` added to ``score``, and the words of ``counts`` to ``n_known`` and ``known_log``.

    All blocks are applied in one Python worker a task: a worker for each block
    would hold a Python, and the texts, for each of them.
    """
    context = df.sparkSession.sparkContext
    words_of, grams_of = [context.broadcast(b) for b in counts], [context.broadcast(b) for b in model]

    def run(batches):
        known_words, known_grams = [word_block(b.value) for b in words_of], [b.value for b in grams_of]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            new = {name: batch.column(batch.schema.get_field_index(name)).to_numpy().copy() for name in ("n_known", "known_log", "score")}
            for lo, hi in chunks([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], AT_ONCE):
                part = texts.slice(lo, hi - lo).to_pylist()
                split = [words(t) for t in part]
                own = list(set().union(*split))
                a, b = keys(own)
                for block in known_words:
                    add_words(split, own, a, b, block, new["n_known"][lo:hi], new["known_log"][lo:hi])
                del split, own, a, b
                found, sizes = grams(part, depth)
                gram, back = np.unique(found, return_inverse=True)
                value = np.zeros(len(gram))
                for code, logp in known_grams:
                    if len(code):
                        at = np.minimum(np.searchsorted(code, gram), len(code) - 1)
                        value += np.where(code[at] == gram, logp[at], 0.0)
                new["score"][lo:hi] += np.add.reduceat(value[back], np.cumsum(sizes) - sizes)
            for name, x in new.items():
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(x))
            yield batch

    import pyarrow.compute  # noqa: F401

    return df.mapInArrow(run, df.schema)


def word_block(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A block's keys, the logarithms of its counts, and how many entries with equal first halves, if there are any, lie side by side."""
    one, two, n = block
    run_length = 1
    while len(one) > run_length and (one[run_length:] == one[:-run_length]).any():
        run_length += 1
    return one, two, np.log10(n + 0.5), run_length


def add_words(split: list[list[bytes]], own: list[bytes], a: np.ndarray, b: np.ndarray, block, known: np.ndarray, total: np.ndarray) -> None:
    """Adds a block's words to ``known`` and the sum of their log10(c + 0.5) to ``total``; ``a``, ``b``: the keys of the distinct words ``own``."""
    one, two, log, run_length = block
    value = np.full(len(own), np.nan)
    at = np.searchsorted(one, a)
    for k in range(run_length):
        j = np.minimum(at + k, max(len(one) - 1, 0))
        hit = (one[j] == a) & (two[j] == b) if len(one) else np.zeros(len(own), dtype=bool)
        value[hit] = log[j[hit]]
    table = {w: v for w, v in zip(own, value.tolist(), strict=True) if v == v}
    get = table.get
    for k, ws in enumerate(split):
        vs = [v for w in ws if (v := get(w)) is not None]
        known[k] += len(vs)
        total[k] += math.fsum(vs)


def score(df: DataFrame, depth: int = DEPTH, held_parts: int = 5, held_part: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from all rows that are not held out (a null id is not).
    ``score`` is the log10 probability of the text's bytes and its end, so it
    adds up; ``n_bytes`` counts them.  An empty or null text is an end mark
    alone.  Without training rows every byte has probability 1/256 and no word is
    known.  Rows map one to one; an empty table gives an empty result.
    """
    docs = in_batches(id_text(df, id_col, text_col)).withColumn("train", ~in_parts(F.col("doc_id"), held_parts, held_part))
    counts = written(word_counts(docs), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    model = written(gram_scores(gram_counts(docs, depth), depth), "model")
    out = docs.select("doc_id", "text", "train", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("known_log"), F.lit(0.0).alias("score"))
    # one block at a time is on the driver: each is handed over as it comes
    out = add_scores(out, blocks(counts, "one", ["two", "n"]), blocks(model, "gram", ["logp"]), depth)
    n_tokens = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")) + 1
    out = out.withColumn("n_tokens", n_tokens.cast("long"))
    base = F.col("known_log") + (F.col("n_tokens") - F.col("n_known")) * math.log10(0.5) - F.col("n_tokens") * math.log10(total["n"] + 0.5 * (total["v"] + 1))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (F.octet_length("text") + 1).cast("long").alias("n_bytes"),
    )
