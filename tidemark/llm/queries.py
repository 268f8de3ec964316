"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat, decontaminate, fim, htmltext, langid, lm, maxsketch, mixing, pqdedup, quality, simhash, toxicity, urlfilter,
)
from tidemark.llm.frames import cut, held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return docs.select("doc_id", "lang", toxicity.toxicity_score(net, F.col("text")).alias("score")).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        toxicity.threshold_of(net, F.col("lang")).alias("threshold"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language(docs, ~held_out("doc_id", 5, 0))
    return docs.select("doc_id", langid.predict_language(model, F.col("text")).alias("p")).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 5, 1)
    scored = lm.score_corpus(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.with_fim(table(spark, sf_dir, "documents").select("doc_id", "text"), "r").select("doc_id", "r.*")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"),
                       F.sha2(fim.restore(F.col("text"), F.col("form")), 256).alias("restored_sha256"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsketch.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut(quality.with_statistics(docs, "stats").select("doc_id", "stats"))
    model = quality.fit_quality(rows, table(spark, sf_dir, "labels"), "stats", ~held_out("doc_id", 3, 1))
    scored = rows.select("doc_id", quality.quality_score(model, F.col("stats")).alias("score"))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language, op3_mixing, op4_decontamination, op5_chat, op6_simhash,
                                   op7_lm, op8_html, op9_embeddings, op10_urls, op11_fim, op12_search, op13_quality,
                                   pipeline)}

# The rules of the contract, stated a second time for DuckDB.
_SIZES = r"""sizes AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents)"""

ORACLE = {
    "op3_mixing": rf"""
WITH {_SIZES},
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
                  2 * source_size AS cap FROM per),
leveled AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
            FROM ranked),
lam AS (SELECT min_by(lev, cap::DOUBLE / w) AS l FROM leveled WHERE lev * w <= cap),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(l * w, cap::DOUBLE)) AS target FROM leveled, lam),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                 ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
          FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (size * (floor(rate)::BIGINT + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated""",
    "op4_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT k, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT k, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT k, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM h)) GROUP BY k),
hi AS (SELECT k, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s
       FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hw USING (k) LEFT JOIN hi USING (k)""",
    "op5_chat": r"""
WITH t AS (SELECT DISTINCT conv_id AS c, turn AS t, replace(replace(coalesce(role, 'unknown'), '<\', '<\\'), '<|', '<\|') AS r,
                  replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|') AS x FROM conversations),
who AS (SELECT DISTINCT c, r AS a FROM t WHERE r <> 'system'),
s AS (SELECT t.c, a, t, r, x, floor(t / 32)::BIGINT AS p,
             CASE WHEN r = a THEN '<|assistant|>' || chr(10) WHEN r = 'system' THEN '<|system|>' || chr(10)
                  ELSE '<|user name=' || r || '|>' || chr(10) END AS h
      FROM t JOIN who ON t.c IS NOT DISTINCT FROM who.c),
o AS (SELECT *, coalesce(sum(length(h) + length(x) + 1) OVER (PARTITION BY c, a, p ORDER BY t NULLS FIRST, r, x
                                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(h) AS b FROM s)
SELECT c AS conv_id, a AS assistant, p AS piece, count(*)::BIGINT AS n_turns,
       string_agg(h || x || chr(10), '' ORDER BY t NULLS FIRST, r, x) AS text,
       sum(length(h) + length(x) + 1)::BIGINT AS n_chars,
       coalesce(string_agg(CASE WHEN r = a THEN b::BIGINT::VARCHAR || '-' || (b + length(x))::BIGINT::VARCHAR END, ','
                           ORDER BY t NULLS FIRST, r, x), '') AS mask,
       sum(CASE WHEN r = a THEN length(x) ELSE 0 END)::BIGINT AS mask_chars
FROM o GROUP BY c, a, p""",
    "op10_urls": r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, url, html FROM pages),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                              ('allow', 'org', '/fr/')),
k AS (SELECT row_number() OVER () AS k, * FROM u),
m AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM k, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k LEFT JOIN m USING (k)""",
    "op11_fim": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf
      FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p""",
    "op12_search": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                             'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT k, doc_id, 75 + (25 * len(w) * nd) // l AS m FROM d, c WHERE len(w) > 0),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
g AS (SELECT tf.k, doc_id, tf.term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS gain
      FROM tf JOIN df USING (term) JOIN m ON tf.k = m.k, c),
s AS (SELECT i, item_id, k, doc_id, sum(gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""",
}
