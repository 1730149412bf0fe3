"""One query per operator over the whole supplied tables, and the SQL that checks them where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import bpe, chat_format, chunk_dedup, exact_dedup, html_extract, language_id, lexical, mixing, near_dedup, prefix_trie, secret_scan, suffix_dedup, topk
from tablegauge.session import literal_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def held_out() -> Column:
    """Whether a document is kept out of training: crc32 of its id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(load(spark, sf_dir, "documents"), TOKENIZER, carry=["doc_id"], with_ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", F.col("keep_value").alias("keep_id"), "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(load(spark, sf_dir, "documents"), spans=False)
    return out.select(F.col("ident").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.chunk_dedup(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed",
                      F.to_json("removed").alias("removed"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_dedup(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_shingles", "component_id", (F.col("row.doc_id") == F.col("component_id")).alias("kept"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(load(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "copies")


OP8_SQL = r"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size / weight AS full_at, 1.5 * sum(source_size) OVER () AS budget FROM s),
c AS (SELECT DISTINCT full_at, budget, sum(2 * source_size) OVER (ORDER BY full_at) AS capped,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY full_at) AS open FROM r),
l AS (SELECT max(level) AS level FROM (
    SELECT CAST((budget - coalesce(lag(capped) OVER o, 0)) AS DOUBLE) / coalesce(lag(open) OVER o, (SELECT sum(weight) FROM s)) AS level,
      coalesce(lag(full_at) OVER o, -1) AS before, full_at FROM c WINDOW o AS (ORDER BY full_at)) WHERE level < full_at AND level >= before),
t AS (SELECT source, source_size, least(2.0 * source_size, (SELECT level FROM l) * weight) AS target,
    CAST(('0x' || substr(md5(CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END), 1, 5)) AS BIGINT) / 1048576.0 AS shift FROM s),
p AS (SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(shift AS DOUBLE) AS shift,
    CASE WHEN source_size > 0 THEN CAST(target AS DOUBLE) / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS nth
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(shift + (nth + 1) * rate) - floor(shift + nth * rate) AS BIGINT) AS copies FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * size AS taken, copies FROM k"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language_id.train(docs, "text", "lang", "doc_id", ~held_out())
    out = language_id.identify(docs, model, carry=["doc_id"])
    return out.select("row.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", held_out())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_scan(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = literal_table(spark, [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))],
                          "conv_id bigint, turn bigint, role string, text string")
    template = chat_format.InstructTemplate()
    out = chat_format.read_back(chat_format.format_chats(turns.unionByName(probe), template), template)
    return out.select(F.col("ident").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP11_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 12 ELSE 16 + len(role) + 2 * (len(role) - len(replace(replace(role, '%', ''), chr(10), '')))
    + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(INST|REPLY|ROLE)\]')) END
  + len(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(INST|REPLY|ROLE)\]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(len(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("ident").alias("doc_id"), "score")


OP12_SQL = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY 1),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
t AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f CROSS JOIN s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id) CROSS JOIN s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie.rebuilt_trie(load(spark, sf_dir, "conversations"))
    return out.select(F.col("member").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n_members").alias("n_convs"),
                      "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


OP13_SQL = r"""WITH t AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'id': id, 'size': size} ORDER BY turn NULLS FIRST, substr(id, 1, 32), size) AS turns,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, bit: xor(v // 2, (v % 2) * 3988292384))), 4294967295) % 9 AS h FROM t GROUP BY c),
r AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5),
p AS (SELECT c, len(turns) AS n, d, list_transform(turns[1:d], lambda x: x.id) AS ids, turns[d].size AS size
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT ids, d AS depth, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * any_value(size) END AS own,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY ids, d),
k AS (SELECT ids[1:depth - 1] AS ids, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.ids = k.ids),
s AS (SELECT ids[1:e] AS ids, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.ids = s.ids LEFT JOIN n u ON m.depth > 0 AND u.ids = m.ids[1:m.depth - 1]"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bpe, op2_exact_dedup, op3_exact_topk, op4_suffix_dedup, op5_chunk_dedup, op6_near_dedup, op7_html_extract, op8_mixing, op9_language_id, op10_secret_scan,
        op11_chat_format, op12_ranked_search, op13_prefix_trie)}

ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_exact_topk": OP3_SQL, "op8_mixing": OP8_SQL, "op11_chat_format": OP11_SQL, "op12_ranked_search": OP12_SQL,
           "op13_prefix_trie": OP13_SQL}
