"""The operators as queries over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
  FROM words WHERE w IS NOT NULL
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
"""


@query("op5_near_dup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT doc_id, p FROM windows WHERE v IN (SELECT v FROM windows GROUP BY v HAVING count(*) > 1)
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM repeated),
gone_of AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) k
  ANTI JOIN gone ON gone.doc_id = k.doc_id AND gone.p = k.p GROUP BY k.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN gone_of USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fairtag.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op7_sql(shards: int = 8, parts: int = 4096) -> str:
    """Every row's least draw over all shards; the tree leads to the same leaf, because a node's draw is its least leaf's."""
    draw = "-ln((('0x' || substr(md5(key || '/' || {s}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"
    draws = lambda n: "[" + ", ".join(draw.format(s=s) for s in range(n)) + "]"
    return f"""
WITH crc_table AS (
  SELECT list(CASE WHEN true THEN list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) END ORDER BY i) AS t
  FROM range(256) r(i)
), bytes AS (
  SELECT rowid AS r, doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), rows_ AS (
  SELECT r, doc_id, size::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null') AS key,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda j: ('0x' || h[2 * j + 1:2 * j + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM bytes, crc_table
), placed AS (
  SELECT *, {draws(shards)} AS d, {draws(shards + 1)} AS g,
    ('0x' || substr(md5(key || '/' || size || '/' || text_crc32), 1, 12))::BIGINT % {parts} AS part
  FROM rows_
)
SELECT doc_id, size, text_crc32, 'key' AS law, (list_position(d, list_min(d)) - 1)::INTEGER AS shard,
  row_number() OVER (PARTITION BY list_position(d, list_min(d)) ORDER BY part, doc_id, size, text_crc32) - 1 AS slot,
  (list_position(g, list_min(g)) - 1)::INTEGER AS grown_shard
FROM placed
"""


@query("op7_sharding", _op7_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.secrets import find_secrets, span_digests

    return span_digests(find_secrets(table(spark, sf_dir, "documents")))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
) WHERE rank <= 5
"""


@query("op9_top_k", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.top_k import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


def _remainder(modulus: int):
    """crc32 of doc_id as text, by ``modulus``; a row without doc_id counts as 'null'."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.language import fit, predict

    documents = table(spark, sf_dir, "documents")
    network = fit(documents.where(_remainder(4) != 2))
    return predict(documents, network).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    return score(documents, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


@query("op4_urls")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def _crc32_sql(value: str, table: str = "t") -> str:
    """Unsigned crc32 of the bytes of a text; ``table`` lists the 256 remainders of CRC_TABLE."""
    hexed = f"hex(encode({value}))"
    steps = f"list_prepend(4294967295::BIGINT, list_transform(range(0, len({hexed}) // 2), lambda j: ('0x' || {hexed}[2 * j + 1:2 * j + 2])::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


CRC_TABLE = """crc_table AS (
  SELECT list(CASE WHEN true THEN list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) END ORDER BY i) AS t
  FROM range(256) r(i)
)"""
OP13_SQL = f"""
WITH {CRC_TABLE}, turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, turn,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, k, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM turns
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), built AS (
  SELECT i.conv_id, 0 AS part, p.pos, p.k, p.chars FROM ids i JOIN placed p ON p.conv_id = i.base AND p.pos < i.h
  UNION ALL SELECT i.conv_id, 1, p.pos, p.k, p.chars FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.pos >= i.h
), paths AS (SELECT conv_id, list(k ORDER BY part, pos) AS p, list(chars ORDER BY part, pos) AS c FROM built GROUP BY conv_id),
whole AS (SELECT ids.conv_id, coalesce(p, []) AS p, coalesce(c, []) AS c FROM ids LEFT JOIN paths USING (conv_id)),
members AS (
  SELECT conv_id, d, len(p) = d AS ends, array_to_string(p[1:d], '') AS node,
    CASE WHEN d > 0 THEN array_to_string(p[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN c[d] ELSE 0 END AS chars
  FROM (SELECT conv_id, p, c, unnest(range(0, len(p) + 1)) AS d FROM whole)
), nodes AS (
  SELECT node, parent, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
  FROM members GROUP BY node, parent, d
), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT a.node, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((b.n - 1) * b.chars) AS saved
  FROM nodes a JOIN nodes b ON starts_with(b.node, a.node) LEFT JOIN children k ON k.node = b.node GROUP BY a.node
)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below ON below.node = x.node LEFT JOIN children ON children.node = x.node LEFT JOIN nodes up ON up.node = x.parent
"""


@query("op13_conversation_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), units AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS d FROM rows_
), formed AS (
  SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
         WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM formed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


@query("op11_fill_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.fill_middle import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


@query("op12_pii")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fairtag.llm.pii import find_private, span_digests

    return span_digests(find_private(table(spark, sf_dir, "documents")))
