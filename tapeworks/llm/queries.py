"""The registered queries of the corpus operators, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.base import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.token_files import tokens_of

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    found = tokens_of(spark, table(spark, sf_dir, "documents"), definition)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.byte_bpe import encode_decode, read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, ranks, public_tokenizers.PATTERN, keep=False)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm import language_id as lid

    docs = table(spark, sf_dir, "documents")
    profiles = lid.learn(docs.filter(~lid.held_out()))
    found = lid.identify(docs, profiles)
    return found.select("doc_id", lid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.sharding import shuffle_rows

    dealt = shuffle_rows(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# DuckDB has no zero-length-safe strip of these six blanks but by pattern.
SQL["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS body, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
spread AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.i, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN spread s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated"
    )


SQL["op5_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.s, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.win = i.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm import secret_scan as scan

    docs = table(spark, sf_dir, "documents")
    found = scan.scan(docs, scan.learn(docs))

    def of(kinds: list[int]):
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    counts = [F.size(of([k])).cast("long").alias(f"n_{scan.KINDS[k]}") for k in range(3)]
    base = F.sha2(scan.written(of([0, 1, 2])), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), scan.written(F.col("spans")).alias("spans"))


@query
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.topk_search import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


SQL["op2_topk_search"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep=False)


SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w)),
later AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.ngram_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) AS c,
         regexp_matches(body, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY body) AS e
  FROM docs LEFT JOIN known USING (doc_id)),
cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good,
         count(*) FILTER (WHERE toxic) AS toxic
  FROM judged GROUP BY ALL),
letter AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, o, step, n, good, toxic, fails[o[step]] AS fails_this,
         list_contains([fails[x] FOR x IN o[1:step - 1]], true) AS gone,
         len([x FOR x IN fails IF x]) AS n_fails
  FROM cells, steps),
done AS (
  SELECT part, o, step, sum(CASE WHEN NOT gone AND NOT fails_this THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fails_this THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails_this THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails_this AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails_this THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fails_this THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY part, o, step)
SELECT part, array_to_string([chr(CAST(64 + x AS INTEGER)) FOR x IN o], '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM done
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, CAST(sum(all_n) AS HUGEINT) AS all_total, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
own AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, CAST(coalesce(t.total, 0) AS HUGEINT) AS total, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL) t USING (lang, source)
  LEFT JOIN langs l ON l.lang = g.lang),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         1 + 1000000000 * (coalesce(o.n, 0) + 1) // (g.total + g.v) AS p,
         1 + 1000000000 * (CAST(k.all_n AS HUGEINT) + 1) // (l.all_total + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM filled x JOIN filled y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM filled WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.llm.lsh_forest import near_groups

    found = near_groups(table(spark, sf_dir, "documents"), size=2, least=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# Every pair that shares a shingle is counted, then the links are followed to their smallest ends.
SQL["op12_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT u, v FROM (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reached AS (
  SELECT doc_id, doc_id AS component_id FROM documents
  UNION SELECT l.v, r.component_id FROM reached r JOIN links l ON l.u = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(component_id) AS component_id,
       d.doc_id = min(component_id) AS kept
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
