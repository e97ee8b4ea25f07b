"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bitsliced, decontaminate, hostrules, html, lines, mixing, neardup, passages, phrases, quality, records, simhash, toxicity
from lodestone.llm.common import fold_of, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_ranking(docs, labels, where=fold_of("doc_id", 5) != 0)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, least=0.8)
    return found.select("doc_id", "class_id", "kept")


def op5_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer, path = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, tokenizer=tokenizer, end_id=2)
    found = records.read_records(spark, path, width=records.token_width(tokenizer), ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hostrules.judge_hosts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *hostrules.COUNTS, "base_failed", "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit_lexicon(docs, labels, where=fold_of("doc_id", 4) != 2)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, most=2000, share=50)


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, most=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bitsliced.top_k(docs, bitsliced.build(docs), table(spark, sf_dir, "benchmark"), 10)


OPERATORS = (
    op1_quality_classifier, op2_repeated_passages, op3_mix_sources, op4_near_duplicates, op5_dedup_lines,
    op6_token_records, op7_extract_html, op8_host_rules, op9_decontaminate, op10_toxicity,
    op11_phrases, op12_simhash_groups, op13_ranked_search,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3, "op8_host_rules": OP8, "op9_decontaminate": OP9, "op11_phrases": OP11, "op13_ranked_search": OP13}


OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) AS sym,
  (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / ((1.0::DOUBLE + size) / (1.0::DOUBLE + size + 4.0::DOUBLE * sym)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
p AS (SELECT *, 2.0::DOUBLE * source_size / w AS stop FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM p WINDOW b AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, (SELECT level FROM l WHERE level <= stop ORDER BY stop, source NULLS LAST LIMIT 1) * w), 2.0::DOUBLE * source_size) AS target FROM p),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 1 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS n FROM documents),
g AS (SELECT n, i, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT n, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT n, count(DISTINCT p) AS c FROM (SELECT n, unnest(range(i, i + 5)) AS p FROM (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS k FROM g) WHERE k > 1)) GROUP BY n),
ln AS (SELECT n, count(*) - count(DISTINCT x) AS c FROM (SELECT n, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY n),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ln.c, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.c, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (n) LEFT JOIN ln USING (n)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS docs, CAST(sum(base_failed::INT) AS DOUBLE) AS failed FROM f GROUP BY source),
s AS (SELECT count(*) AS n, avg(failed / docs) AS mean, avg(failed / docs * failed / docs) AS sq, avg(1.0 / docs) AS inv FROM h),
v AS (SELECT *, greatest(sq - mean * mean - mean * (1 - mean) * inv, 0.0) AS var FROM s),
b AS (SELECT mean, CASE WHEN var > 1e-9 THEN least(greatest(mean * (1 - mean) / var - 1, 1.0), 1000.0) ELSE 1000.0 END AS k, n FROM v),
pr AS (SELECT CASE WHEN n < 2 THEN 0.5 WHEN mean > 0 AND mean < 1 THEN mean * k ELSE greatest(mean, 0.01) END AS a, CASE WHEN n < 2 THEN 0.5 WHEN mean > 0 AND mean < 1 THEN (1 - mean) * k ELSE greatest(1 - mean, 0.01) END AS b FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate - 2 * sqrt(rate * (1 - rate) / (docs + a + b + 1)) <= least(0.5, 3 * a / (a + b)) AS kept
FROM f JOIN (SELECT source, docs, a, b, (failed + a) / (docs + a + b) AS rate FROM h, pr) x ON f.source IS NOT DISTINCT FROM x.source
"""

OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
f AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
g AS (SELECT t, count(*) AS df FROM f GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM g, s),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(d.w) AS BIGINT) * nd) // l AS m FROM d, s WHERE len(d.w) > 0),
x AS (SELECT item_id, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""

OP11 = r"""
WITH p AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
g1 AS (SELECT lang, x, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, unnest(w) AS x FROM p) GROUP BY ALL),
g2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, sum(f) AS n FROM g1 GROUP BY lang),
c2 AS (SELECT g2.lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, a.f AS l, b.f AS r, 1000000 * g2.f * g2.f // (a.f * b.f) AS score,
  (SELECT max(h.f) FROM g3 h WHERE h.lang = g2.lang AND ((h.x = g2.x AND h.y = g2.y) OR (h.y = g2.x AND h.z = g2.y))) AS longer
  FROM g2 JOIN g1 a ON a.lang = g2.lang AND a.x = g2.x JOIN g1 b ON b.lang = g2.lang AND b.x = g2.y),
c3 AS (SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z AS phrase, g3.f AS a, a.f AS l1, q.f AS r1, p.f AS l2, c.f AS r2,
  1000000 * g3.f * g3.f // (a.f * q.f) AS s1, 1000000 * g3.f * g3.f // (p.f * c.f) AS s2
  FROM g3 JOIN g1 a ON a.lang = g3.lang AND a.x = g3.x JOIN g1 c ON c.lang = g3.lang AND c.x = g3.z
  JOIN g2 p ON p.lang = g3.lang AND p.x = g3.x AND p.y = g3.y JOIN g2 q ON q.lang = g3.lang AND q.x = g3.y AND q.y = g3.z),
c AS (SELECT lang, phrase, a, l, r, score FROM c2 WHERE longer IS NULL OR 100 * longer < 50 * a
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM k JOIN t USING (lang) WHERE rank <= 2000
"""
