"""Registered queries of the corpus operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontamination, embedding_dedup, filter_audit, html_extraction, language_id, line_dedup, packing, passage_dedup, prefix_trie, simhash_dedup, suffix_dedup, tokens, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r,
  coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []::VARCHAR[]) AS w FROM documents),
iw AS (SELECT item_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []::VARCHAR[]) AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM il)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens)),
hit AS (SELECT r, n, s, item_id FROM dwin JOIN win USING (n, t)),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
l AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hs AS (SELECT host, count(*) AS n, sum(bad) AS k, string_split(host, '.') AS a FROM p JOIN l USING (page_id) GROUP BY host),
ks AS (SELECT *, CASE WHEN len(a) >= 3 AND length(a[-1]) = 2 AND a[-2] IN ('ac','co','com','edu','gov','net','org') THEN 3 ELSE 2 END AS keep FROM hs),
st AS (SELECT host, n, k, array_to_string(a[greatest(len(a) - keep + 1, 1):], '.') AS domain,
  array_to_string(list_slice(a[greatest(len(a) - keep + 2, 1):], 1, keep - 1), '.') AS suffix FROM ks),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM st GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM st GROUP BY ALL),
lv AS (SELECT 'h' AS lv, n, k FROM st UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s),
mo AS (SELECT lv, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*) AS g, sum(k::DOUBLE * k / n) AS kk, sum(n::DOUBLE * n) AS nn FROM lv GROUP BY lv),
m2 AS (SELECT lv, (k + 0.5e0) / (n + 1e0) AS mean, kk - k * k / n AS spread, n, nn, g FROM mo),
m3 AS (SELECT lv, mean, spread - mean * (1 - mean) * (g - 1) AS over, mean * (1 - mean) * (n - nn / n - (g - 1)) AS below FROM m2),
m4 AS (SELECT lv, mean, 1e0 / least(greatest(CASE WHEN below > 0 THEN over / below ELSE 1e-3 END, 1e-3), 1 - 1e-3) - 1e0 AS m FROM m3),
ms AS (SELECT suffix, (k + m * mean) / (n + m) AS ms FROM s, m4 WHERE lv = 's'),
md AS (SELECT domain, suffix, (k + m * ms) / (n + m) AS md FROM d JOIN ms USING (suffix), m4 WHERE lv = 'd'),
ab AS (SELECT host, n, k + m * md AS a, n - k + m * (1 - md) AS b FROM st JOIN md USING (domain, suffix), m4 WHERE lv = 'h'),
r AS (SELECT host, n, a / (a + b) - 1.645e0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS lower FROM ab),
j AS (SELECT page_id, host, path, n, lower,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p LEFT JOIN r USING (host))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n, 0) AS n_outcomes, round(lower, 6) AS bad_at_least
FROM j
"""


@query("op5_url_filter", OP5_SQL)
def op5(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, source, coalesce('=' || source, '-') AS host, row_number() OVER () AS r,
  string_split(text, chr(10)) AS ls FROM documents),
dist AS (SELECT host, text, any_value(ls) AS ls FROM d WHERE text IS NOT NULL GROUP BY host, text),
tot AS (SELECT host, count(*) AS pages FROM dist GROUP BY host),
ln AS (SELECT host, text, trim(l, ' ') AS l FROM (SELECT host, text, unnest(ls) AS l FROM dist)),
cnt AS (SELECT host, l, count(DISTINCT text) AS n FROM ln WHERE l <> '' GROUP BY host, l),
bad AS (SELECT host, list(l) AS bl FROM cnt JOIN tot USING (host) WHERE n >= 5 AND n > 0.1 * pages GROUP BY host),
k AS (SELECT d.*, list_filter(ls, lambda x: NOT list_contains(coalesce(bl, []::VARCHAR[]), trim(x, ' '))) AS kept FROM d LEFT JOIN bad USING (host))
SELECT doc_id, CASE WHEN len(kept) = len(ls) THEN text ELSE array_to_string(kept, chr(10)) END AS text, source,
  coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped
FROM k
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark, sf_dir):
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_packing")
def op4(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_simhash")
def op10(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def fold(doc_id: str = "doc_id"):
    """The fold a document is in: 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, learn=fold() != 1)
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op1_html_extraction")
def op1(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query("op6_embedding_dedup")
def op6(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return passage_dedup.near_duplicate_passages(table(spark, sf_dir, "documents"))


@query("op11_suffix_array_dedup")
def op11(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
lo AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 200, 100 * list_unique(ws) < 50 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(lo < doc_id, false)] AS fails
  FROM w JOIN lo USING (t) LEFT JOIN g USING (doc_id)),
l AS (SELECT unnest(['A','B','C','D','E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS ord FROM l a, l b, l c, l d, l e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
s AS (SELECT ord, step, substr(ord, step, 1) AS x, instr('ABCDE', substr(ord, step, 1)) AS i, list_transform(range(1, step), lambda k: instr('ABCDE', substr(ord, k, 1))) AS prev
  FROM (SELECT ord, unnest(range(1, 6)) AS step FROM o)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
r AS (SELECT part, ord, step, x, n, good, toxic, fails[i] AS own, len(list_filter(prev, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS n_fails FROM m, s),
a AS (SELECT part, ord AS filter_order, step::INT AS step, x,
  sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND own THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND own THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND own THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND own THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, ord, step, x)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM a
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc_bits AS (SELECT conv_id, list_transform(range(0, length(conv_id::VARCHAR)), lambda k: ascii(substr(conv_id::VARCHAR, k + 1, 1))) AS bytes FROM (SELECT DISTINCT conv_id FROM n)),
crc AS (SELECT conv_id, xor(4294967295::BIGINT, list_reduce(bytes, lambda acc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(acc, x::BIGINT)), 4294967295::BIGINT)) AS v FROM crc_bits),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS ts FROM n GROUP BY conv_id),
r AS (SELECT l.conv_id, list_concat(coalesce(base.ts[1:(v % 4)::INT], []), l.ts[(v % 4)::INT + 1:]) AS ts
  FROM l JOIN crc USING (conv_id) LEFT JOIN l base ON base.conv_id = l.conv_id - l.conv_id % 20),
m AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS depth, ts FROM r),
p AS (SELECT conv_id, depth, ts[1:depth] AS k, len(ts) = depth AS is_end FROM m),
g AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end) AS ids FROM p GROUP BY k, depth),
c AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN g.depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(k[-1].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS val
  FROM g LEFT JOIN c USING (k, depth)),
up AS (SELECT k[1:a] AS k, a AS depth, val, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v)),
s AS (SELECT k, depth, sum(val)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY k, depth)
SELECT v.conv_id, v.depth::BIGINT AS depth, par.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM v JOIN s USING (k, depth) LEFT JOIN g par ON v.depth > 0 AND par.depth = v.depth - 1 AND par.k = v.k[1:v.depth - 1]
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf_dir):
    turns, conversations = prefix_trie.share_openings(prefix_trie.number_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, conversations)
