"""The registered queries of the operators, and the SQL they are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.llm import bpe, chat, collocations, decontaminate, fim, fingerprints, kneser, langid, quality, simhash, suffixes, topk, urlrules
from fleetledger.llm.common import held_out_fold, table


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=50))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out_fold(F.col("doc_id"), 10, 0)
    model = kneser.fit(docs.where(~held))
    return kneser.score(model, docs).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", "perplexity",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out_fold(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held))
    return langid.identify(model, docs).select("doc_id", held.alias("held_out"), "lang_pred", "score", "share")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


#: The rules of the registered query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP9_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(h, p, v) AS (VALUES {_RULES}),
best AS (
  SELECT c.page_id, c.host, c.path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM cut c JOIN rules ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)
  GROUP BY ALL
)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM cut c LEFT JOIN best b ON c.page_id = b.page_id AND c.host = b.host AND c.path = b.path
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         list([role, text] ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM turns GROUP BY conv_id
), starts AS (
  SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n_turns)) AS k FROM whole)
)
SELECT min(conv_id) AS conv_id, CAST(0 AS BIGINT) AS part, n_turns, count(*) AS n_logged, any_value(text) AS text
FROM whole WHERE l NOT IN (SELECT l FROM starts) GROUP BY l, n_turns
"""


def op2_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")), top=2)
    return quality.grade(model, docs)


QUERIES = {
    "op2_quality_grades": op2_quality_grades,
    "op4_chat_format": op4_chat_format,
    "op9_url_rules": op9_url_rules,
    "op1_fingerprints": op1_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op7_language_id": op7_language_id,
    "op8_kneser_ney": op8_kneser_ney,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_simhash_neardup": op6_simhash_neardup,
}
ORACLE: dict[str, str] = {
    "op4_chat_format": OP4_SQL,
    "op9_url_rules": OP9_SQL,
}


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    arranged = fim.transform(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    return arranged.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks
  FROM documents
), d AS (
  SELECT doc_id, text, toks, len(toks) AS n,
         ('0x' || substr(h, 1, 8))::UBIGINT % (len(toks) + 1) AS k1, ('0x' || substr(h, 9, 8))::UBIGINT % (len(toks) + 1) AS k2,
         ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS d3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS d4
  FROM t
), f AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 50 THEN 'plain'
              WHEN d4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(toks[1:least(k1, k2)], '') AS p, array_to_string(toks[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
         array_to_string(toks[greatest(k1, k2) + 1:], '') AS s
  FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, id_col="vec_id", vec_col="embedding", k=5, scale=256)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id IS DISTINCT FROM b.vec_id
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s
) WHERE rank <= 5
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return collocations.collocations(docs, min_words=2, max_words=3, threshold=10, keep_share=50, top=2000)


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, o, unnest(list_transform(range(1, len(ws) - o + 2), lambda i: array_to_string(ws[i:i + o - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) v(o) WHERE len(ws) >= o
), f AS (
  SELECT lang, phrase, any_value(o) AS o, count(*) AS f FROM g GROUP BY lang, phrase
), c AS (
  SELECT lang, phrase, o, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE o >= 2 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.o, c.a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM c, (VALUES (1), (2)) v(k) WHERE k < c.o
), scored AS (
  SELECT cuts.*, fl.f AS l, fr.f AS r,
         CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rp
), best AS (
  SELECT lang, phrase, o, a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, min(score) AS score FROM scored GROUP BY ALL
), inner_ AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a AS fl FROM c WHERE o = 3
  UNION ALL SELECT lang, array_to_string(ws[2:3], ' ') AS phrase, a AS fl FROM c WHERE o = 3
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.fl >= 50 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM kept
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n,
       CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""


QUERIES |= {"op11_fim": op11_fim, "op12_topk": op12_topk, "op13_collocations": op13_collocations}
ORACLE |= {"op11_fim": OP11_SQL, "op12_topk": OP12_SQL, "op13_collocations": OP13_SQL}
