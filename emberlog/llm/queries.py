"""Registered queries of the operators in this folder, over their whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.llm import (
    collocations, exact_dedup, filter_audit, interpolation, multi_index, order_minhash, packing, secret_scan,
    sharding, tag_paths, toxicity, warc)
from emberlog.llm.bpe import decoded, encoded
from emberlog.llm.common import read
from emberlog.plans.registry import query


def remainder(of: Column | str, by: int) -> Column:
    """crc32 of a number written as text, modulo `by`."""
    column = F.col(of) if isinstance(of, str) else of
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(by))


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"))


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    both = decoded(ids, ranks, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_order_minhash")
def order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_copies(read(spark, sf_dir, "documents")).drop("sha")


@query("op4_deleted_interpolation")
def deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder("doc_id", 10)
    part = F.when(rest == 0, 2).when(rest == 1, 1).otherwise(0)
    return interpolation.scored(read(spark, sf_dir, "documents"), part)


@query("op5_tag_path_ratios")
def tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extracted(read(spark, sf_dir, "pages"))


@query("op6_naive_bayes_grams")
def naive_bayes_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_stratified_interleaving")
def stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Base32 of a hex digest `h`: every five hex digits are four letters.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"((('0x' || substr(h, {at}, 5))::BIGINT >> {by}) & 31)::INT + 1, 1)"
    for at in range(1, 41, 5) for by in (15, 10, 5, 0))


@query("op8_arc_to_warc", f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
           CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to
    FROM g""")
def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_heavy_hitter_dedup", r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
               FROM documents)
    SELECT doc_id, first(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           row_number() OVER best = 1 AS kept, h AS text_sha256
    FROM d WINDOW best AS (PARTITION BY h ORDER BY n DESC, doc_id)""")
def heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(read(spark, sf_dir, "documents"))


@query("op10_inverted_multi_index")
def inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_rollup_collocations", r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    q AS (SELECT lang, row_number() OVER () AS q, string_split_regex(piece, '[\x20\x09]+') AS ws FROM p),
    w AS (SELECT lang, q, i, w FROM (SELECT lang, q, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q) WHERE w <> ''),
    x AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4,
                 lead(w, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY q ORDER BY i)),
    f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM x GROUP BY ALL
          UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL
          UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL
          UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM x WHERE w4 IS NOT NULL GROUP BY ALL
          UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM x
          WHERE w5 IS NOT NULL GROUP BY ALL),
    n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
    often AS MATERIALIZED (SELECT lang || chr(1) || phrase AS key, f FROM f WHERE f >= 100),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
    cut AS (SELECT c.*, x.k AS cut, array_to_string(ws[1:x.k], ' ') AS head, array_to_string(ws[x.k + 1:], ' ') AS tail
            FROM c, range(1, 5) AS x(k) WHERE x.k < c.k),
    scored AS (SELECT cut.lang, cut.phrase, a, l.f AS l, r.f AS r, n, cut,
                      1000 * a::HUGEINT * n // (l.f::HUGEINT * r.f) AS score
               FROM cut JOIN often l ON l.key = cut.lang || chr(1) || head
               JOIN often r ON r.key = cut.lang || chr(1) || tail JOIN n ON n.lang = cut.lang),
    low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    sub AS (SELECT lang, array_to_string(ws[i.v:i.v + z.v - 1], ' ') AS phrase, max(a) AS longer
            FROM c, range(2, 5) AS z(v), range(1, 5) AS i(v)
            WHERE z.v < k AND i.v + z.v - 1 <= k GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR longer < a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
           a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM kept QUALIFY rank <= 2000""")
def rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def _spans_sql(rule: secret_scan.Rule, number: int) -> str:
    """Spans of one rule's matches: texts between matches and matches follow each other in turn."""
    pattern = rule.pattern.replace("'", "''")
    keep = (rule.keep or rule.pattern).replace("'", "''")
    return f"""
        SELECT doc_id, '{rule.kind}' AS kind, {number} AS k, start AS s, start + length(v) AS e
        FROM (SELECT doc_id, m[i] AS v, regexp_full_match(m[i], '{keep}') AS ok, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
                     + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
              FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p
                    FROM d))) WHERE ok"""


@query("op12_secret_scan", f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(secret_scan.BASE + secret_scan.MORE))}),
    j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base,
                 string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans
          FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN j USING (doc_id)""")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf_dir, "documents"))


@query("op13_diagram_audit", r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                 (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END)
                 || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
                 || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
                 || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
                 || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
          FROM t LEFT JOIN l USING (doc_id)),
    g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT o, step, substr(o, step, 1) AS f, '[' || substr(o, 1, step - 1) || ']' AS before
          FROM o, range(1, 6) AS r(step)),
    j AS (SELECT g.*, o, step, f, contains(fails, f) AS bad_here,
                 step > 1 AND regexp_matches(fails, CASE WHEN step > 1 THEN before ELSE 'Z' END) AS gone FROM g, s),
    a AS (SELECT part, o AS filter_order, step::INT AS step, f,
                 coalesce(sum(n) FILTER (NOT gone AND NOT bad_here), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (NOT gone AND bad_here), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (gone AND bad_here), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (NOT gone AND bad_here), 0)::BIGINT AS good_lost,
                 coalesce(sum(bad) FILTER (NOT gone AND bad_here), 0)::BIGINT AS toxic_lost
          FROM j GROUP BY ALL)
    SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM a""")
def diagram_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
