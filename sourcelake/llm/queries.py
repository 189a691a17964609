"""The operators' queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sourcelake.llm import chat, context_tree, decontaminate, exact_dedup, html_text, merkle, packing, prefix_trie, sampled_pieces, simhash, token_counts, token_files, toxicity
from sourcelake.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text "
        "UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'"
    )
    return chat.digests(chat.format_chats(chats.unionByName(probe)))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, files)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat": op2_chat,
    "op3_context_tree": op3_context_tree,
    "op4_token_files": op4_token_files,
    "op5_html_text": op5_html_text,
    "op6_sampled_pieces": op6_sampled_pieces,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_packing": op13_packing,
}

#: Null text counts as empty; equal texts form a group, and the largest doc_id stays.
OP1_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""

#: formatted_chars: fixed marks of a turn, and one more character for each escaped control string or backslash.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, role = 'assistant' AS learnt, length(text)
    + (length(text) - length(replace(text, '\', '')))
    + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]|\[/TEXT\]'))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 23 + length(role) END AS chars
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (learnt), '') AS loss,
    sum(chars)::BIGINT AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""



def crc32(of: str) -> str:
    """SQL for the crc32 of a short ASCII text: the polynomial is divided out bit by bit."""
    steps = f"flatten(list_transform(string_split({of}, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {steps}), lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295)"


#: A prefix is known by the digests of its turns, in a row; every prefix counts its members and sums over what begins with it.
OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS donor, ({crc32("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), placed AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, md5(length(role) || ':' || role || text) AS digest
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), paths AS (
  SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), members AS (
  SELECT *, path[:32 * (depth - 1)] AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM paths
), nodes AS (
  SELECT path, depth, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends
  FROM members GROUP BY path, depth
), children AS (
  SELECT above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above
), sized AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.above = n.path
), subtrees AS (
  SELECT m.path, count(*) FILTER (s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.bytes)::BIGINT AS saved_tokens
  FROM sized s JOIN members m ON m.conv_id = s.conv_id AND m.depth <= s.depth GROUP BY m.path
)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, t.n_leaves, t.saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN subtrees t ON t.path = s.path LEFT JOIN nodes p ON s.depth > 0 AND p.path = s.above AND p.depth = s.depth - 1
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


#: Two trees after each other: one for each source over its leaves, one over the subroots; then every leaf is folded up both.
OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN coalesce({crc32("doc_id::VARCHAR")} % 5 = 0, false) THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS begin
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM docs
), grown AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, size FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(size) + 15) // 16 FROM grown WHERE size > 1 GROUP BY tree, level, pos // 16
), subroots AS (
  SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM grown WHERE size = 1
), crown AS (
  SELECT '' AS tree, 0 AS level, pos, digest, size FROM subroots
  UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(size) + 15) // 16 FROM crown WHERE size > 1 GROUP BY tree, level, pos // 16
), runs AS (
  SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS kids
  FROM (SELECT * FROM grown WHERE size > 1 UNION ALL SELECT * FROM crown WHERE size > 1) GROUP BY tree, level, pos // 16
), crowns AS (SELECT digest AS root, level AS height FROM crown WHERE size = 1
), folded AS (
  SELECT l.doc_id, l.leaf, l.begin AS cur, l.tree, 0 AS level, l.pos, '' AS proof, s.height, s.digest AS subroot, s.pos AS place, row_number() OVER () AS row
  FROM leaves l JOIN subroots s ON s.tree = l.tree
  UNION ALL
  SELECT doc_id, leaf, CASE WHEN level = f.height THEN cur ELSE sha256(array_to_string(kids[:pos % 16], '') || cur || array_to_string(kids[pos % 16 + 2:], '')) END,
    CASE WHEN level = f.height THEN '' ELSE f.tree END, CASE WHEN level = f.height THEN 0 ELSE level + 1 END, CASE WHEN level = f.height THEN place ELSE pos // 16 END,
    CASE WHEN level = f.height THEN proof ELSE proof || array_to_string(kids[:pos % 16], '') || array_to_string(kids[pos % 16 + 2:], '') END,
    CASE WHEN level = f.height THEN c.height ELSE f.height END, subroot, place, row
  FROM (SELECT f.*, r.kids FROM folded f LEFT JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 16) f, crowns c
  WHERE f.tree <> '' OR f.level < f.height
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM folded f, crowns c WHERE f.tree = '' AND f.level = c.height
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_chat": OP2_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
