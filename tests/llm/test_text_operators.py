"""Row-local operators against the libraries and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sourcelake.llm import chat, context_tree, decontaminate, html_text, queries, sampled_pieces, token_counts, token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "▁", "é", "<s>", "the", "ing", "\t", "\r", "(", ")", ";", "中", "😀", "0", "\x00", "        ", "//", "==", "aaaa", "A", "İ", "́", "\xa0"]


def fuzz(n=400, seed=1):
    rng = random.Random(seed)
    return ["", " ", "word", "x" * 5000, "ab " * 3000] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(50))) for _ in range(n)]


def frame(spark, texts):
    """Clashing extra columns, a null text, a null id and a repeated row."""
    rows = [(i, t, i, 0.5) for i, t in enumerate(texts)]
    rows += [(len(texts), None, 1, 0.1), (None, "null id", 2, 0.2), rows[2]]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score double").repartition(3)


EMPTY = "doc_id long, text string, n_tokens int"


def test_token_counts(spark):
    import sentencepiece

    texts = fuzz()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(frame(spark, texts), MODEL, limit=20).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "null id" if r["doc_id"] is None else "" if r["doc_id"] == len(texts) else texts[r["doc_id"]]
        n = len(sp.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 20)
    assert token_counts.token_counts(spark.createDataFrame([], EMPTY), MODEL).collect() == []


def test_sampled_pieces(spark):
    texts = fuzz()
    a = sampled_pieces.sampled_pieces(frame(spark, texts), MODEL).collect()
    b = {r["doc_id"]: r["ids"] for r in sampled_pieces.sampled_pieces(frame(spark, texts).repartition(1), MODEL).collect()}
    assert len(a) == len(texts) + 3
    for r in a:
        text = "null id" if r["doc_id"] is None else "" if r["doc_id"] == len(texts) else texts[r["doc_id"]]
        assert r["lossless"] and r["ids"] == b[r["doc_id"]]  # however rows are dealt
        assert (sampled_pieces.decode(MODEL, r["ids"]) if r["ids"] else "") == text
    assert sampled_pieces.sampled_pieces(spark.createDataFrame([], EMPTY), MODEL).collect() == []


def test_samples_follow_the_lattice():
    """Shares of segmentations against their weights, by enumeration."""
    text, n = " abab", 20_000
    sampler = sampled_pieces.Sampler(MODEL, 1.0, 7)
    model = sampler.table.model
    ranked = sorted(model.score, key=lambda raw: (-model.score[raw], model.id[raw]))
    weight = {raw: 1 / (1 + r) for r, raw in enumerate(ranked)}
    byte = 1 / (1 + len(ranked))

    def ways(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            for tail, w in ways(rest[k:]):
                if rest[:k] in weight:
                    yield (model.id[rest[:k]], *tail), w * weight[rest[:k]]
                if k == 1:
                    yield (model.byte_id[ord(rest[0])], *tail), w * byte

    want = dict(ways(text))
    total = sum(want.values())
    ids, at = sampler.encode(np.arange(n), [text[1:]] * n)
    seen = {}
    for lo, hi in zip(at[:-1], at[1:]):
        key = tuple(ids[lo:hi].tolist())
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(want)
    for key, w in want.items():
        assert abs(seen.get(key, 0) / n - w / total) < 0.02


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = fuzz()
    files = token_files.write(frame(spark, texts), WORDS, end_id=2)
    got = sorted(token_files.read(spark, files).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == [None, *sorted([*range(len(texts) + 1), 2])]
    model, start = Tokenizer.from_file(WORDS), 0
    for r in got:
        text = "null id" if r["doc_id"] is None else "" if r["doc_id"] == len(texts) else texts[r["doc_id"]]
        want = [*model.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))
        start += len(want)
    none = token_files.write(spark.createDataFrame([], EMPTY), WORDS, end_id=2)
    assert token_files.read(spark, none).collect() == []


def test_shard_reads_one_document():
    dictionary = b""
    zstd = token_files.compressor(dictionary)
    rows = [(5, 2, zstd.compress(np.array([1, 2], "<u2").tobytes())), (None, 1, zstd.compress(np.array([7], "<u2").tobytes()))]
    shard = token_files.Shard(token_files.shard_of(rows, dictionary, 2), dictionary)
    assert shard.doc_id(0) == 5 and shard.doc_id(1) is None and shard.ids(1).tolist() == [7] and shard.ids(0).tolist() == [1, 2]
    with pytest.raises(ValueError):
        token_files.Shard(token_files.shard_of(rows, dictionary, 2), b"another")


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("no tags at all &amp; more", "no tags at all & more"),
        ("<body><nav><a>Menu</a></nav><article><h1>Head</h1><p>One  two<br>three<p>Four &eacute;</article><footer>x</footer>", "Head\nOne two three\nFour é"),
        ("<article><p>Kept text here<div class='ad-box'>Buy</div><section id=comments><p>me too</p></section><p>End</article>", "Kept text here\nEnd"),
        ("<body><header>Top</header><main><p>A long enough paragraph of text.</p><form><p>x</p></form></main><aside>side</aside>", "A long enough paragraph of text."),
        ("<body><script>var t='</p>';</script><style>p{}</style><div class=sidebar><p>links</p></div><div><p>Main words are here, many of them.</p><p>Short.</p></div>", "Main words are here, many of them.\nShort."),
        ("<article><p>cut off <b>in the mid", "cut off in the mid"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


ARTICLE = "<p>" + "A long article with many words in it. " * 20 + "</p>"
TEXT = ("A long article with many words in it. " * 20).strip()


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<div class="content has-sidebar">{ARTICLE}</div>', TEXT),
        (f'<div id="search-results-story">{ARTICLE}</div>', TEXT),
        (f'<form id="aspnetForm"><div class="nav">menu</div><div>{ARTICLE}</div><select><option>x</select></form>', TEXT),
        (f'<form><div class="login"><div class="ad-free">{ARTICLE}</div></div></form>', TEXT),
        (f'<div class="ad-free-page"><article>{ARTICLE}</article></div>', TEXT),
        (f"<main><article>{ARTICLE}</article><article>{ARTICLE}</article></main>", f"{TEXT}\n{TEXT}"),
        (f"<article>{ARTICLE}</article><article>{ARTICLE}</article>", f"{TEXT}\n{TEXT}"),
        # what is left out stays out where the rest is the article
        (f'<div>{ARTICLE}</div><div class="sidebar">{ARTICLE}</div><div class="comments"><article class="comment">{ARTICLE}</article></div>', TEXT),
        (f'<form hidden>{ARTICLE}</form><div class="comments">{ARTICLE}</div><article><p>Short.</p>{ARTICLE}</article>', f"Short.\n{TEXT}"),
    ],
)
def test_wrapped_articles(html, text):
    assert html_text.main_text(f"<html><body>{html}</body></html>") == text


def test_deep_and_long_pages():
    import time

    began = time.time()
    for page in ("<div>some text " * 20_000, "<div class=ad>some text " * 5_000, "<x>a" * 20_000, "<p>" * 20_000 + "</y>" * 20_000, "<b>" * 20_000 + "end" + "</b>" * 20_000, "<p>" + "word " * 400_000):
        html_text.main_text(page)
    # the deepest container with nine tenths of the text is the region
    assert html_text.main_text("<div>some text " * 3000).split("\n") == ["some text"] * 2700
    assert time.time() - began < 30


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (None, None, None, "y"), (1, "u", "<article><p>a</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_text.extract(df.where("page_id = 9")).collect() == []


def test_tiles_of_reordered_passage():
    item = list(range(1, 21))
    text = [99] * 3 + item[10:] + [99] * 2 + item[:10]
    tiles = decontaminate.tile([x if x != 99 else -1 for x in text], item, 5)
    assert sorted(t[1:] for t in tiles) == [(0, 10), (10, 10)]


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"before {item} after", "x"), (2, "six seven eight nine ten - one two three four five", "x"), (3, "one two three four five only", "x"), (4, None, "x"), (5, "", "x"), (6, "say Short ITEM now", "x"), (None, item, "x"), (1, f"before {item} after", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(7, item, 1), (8, "short item", 1), (9, "", 1), (10, None, 1)], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contaminated(df, bench).collect()), key=str)
    assert got == [(1, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0), (6, 8, 1.0), (None, 7, 1.0)]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == [] and decontaminate.contaminated(df.limit(0), bench).collect() == []


def test_blocks_find_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} " * 3 + f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(20)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, decontaminate.contaminated(df, bench).collect())) == whole and len(whole) == 20


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "</s>[INST] ok [/INST]", "[\\INST]", "a<s", "<s><s>", "x\\[ROLE]\\\\y", "[[INST]]"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL_RE.search(chat.escape(text))


def test_template_language():
    run = chat.Template("{% set x = 'a' + 'b' | upper %}{{ x }}{% for m in messages %}{% if loop.first and m.role == 'u' %}<{{ m['text'] | trim }}>{% elif not m.text %}-{% else %}{{ loop.index ~ m.role }}{% endif %}{% endfor %}!")
    assert [t for t, _ in run.segments(iter([("u", " hi "), ("a", ""), ("a", "z")]))] == ["aB<hi>-3a!"]
    assert chat.fold(chat.Expression("1 == 1 and ('a' ~ 'b') == 'ab'").whole()) == ("const", True)
    assert chat.parse("{% if 1 == 2 %}x{% else %}y{% endif %}") == [("text", "y")]
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{% if x %}", "{% for a in b %}{% endfor %}", "{{ 'a' | eval }}", "{{ _x }}", "{% endif %}", "{{ a b }}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


def test_chats(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b[/INST]", "x"), (1, 0, "user", "a\\</s>", "x"), (None, 0, None, None, "x"), (2, 0, "system", "[ROLE]", "x"), (1, 1, "assistant", "b[/INST]", "x"), (3, 0, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    whole = {r["conv_id"]: tuple(r) for r in chat.digests(chat.format_chats(df)).collect()}
    assert {k: (v[1], v[3]) for k, v in whole.items()} == {1: (3, 16), None: (1, 0), 2: (1, 0), 3: (1, 0)}
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 5)
    made = length_of(chat.Template(chat.TEMPLATE).segments(iter([("user", "aaaa")] * 3)))
    assert made == 3
    assert chat.format_chats(df.limit(0)).collect() == []


def length_of(values):
    return sum(1 for _ in values)


def test_kt_matches_gamma(spark):
    import math

    pairs = [(0, 0), (1, 0), (0, 5), (3, 4), (1000, 2), (10**6, 10**6)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for (a, b), r in zip(pairs, df.select(context_tree.log_kt(df["a"], df["b"]).alias("x")).collect()):
        assert abs(r["x"] - (math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1))) < 1e-6 * max(1, abs(r["x"]))


def test_queries_have_known_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
