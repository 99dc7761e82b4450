"""The operators over the driver's tables: QUERIES and, where SQL can express one, ORACLES."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from evigraph.llm import chunk_dedup, cross_polytope, filter_audit, fm_dedup, jaccard_join, language_id, ngram_lm, packing, pfair_mix, resample, simhash, token_files, url_reputation
from evigraph.llm.common import table
from evigraph.session import work_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


URL_RULES = [
    url_reputation.Rule("block", "net", "/"),
    url_reputation.Rule("allow", "example.net", "/en/"),
    url_reputation.Rule("block", "example.com", "/de/"),
    url_reputation.Rule("allow", "org", "/fr/"),
]

STRENGTH_SQL = """, {name}_s AS (SELECT coalesce(max(CASE WHEN more > 0 THEN 1 / least(greatest((z - k) / more, 0.001), 0.5) - 1 ELSE 1.0 END), 1.0) AS s
    FROM (SELECT sum(power(bad - n * mu, 2) / (n * mu * (1 - mu))) AS z, count(*) AS k, sum(n - 1) AS more FROM {name}_g WHERE n > 0))"""


@query("op1_token_files")
def op1(spark, sf):
    form = token_files.Format(public_tokenizers.path("byte_bpe_50k.json"))
    manifest = token_files.write_token_files(table(spark, sf, "documents"), work_path(spark, "tokens"), form)
    return token_files.read_token_files(spark, manifest).drop("shard")


@query(
    "op2_url_reputation",
    r"""WITH parted AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
, label AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)
, sites AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site, count(bad) AS n, coalesce(sum(bad), 0) AS bad
    FROM parted LEFT JOIN label ON page_id = doc_id GROUP BY 1)
, kinds AS (SELECT *, CASE WHEN regexp_matches(site, '^[0-9.]*$|^\[') OR NOT contains(site, '.') THEN 0
    WHEN regexp_matches(site, '\.(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN 2 ELSE 1 END AS k, string_split(site, '.') AS parts FROM sites)
, hosts AS (SELECT host, n, bad, CASE WHEN k = 0 THEN site ELSE array_to_string(parts[-k:], '.') END AS suffix,
    CASE WHEN k = 0 THEN site ELSE array_to_string(parts[-(k + 1):], '.') END AS domain FROM kinds)
, suffix_g AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS mu FROM hosts, (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS m FROM hosts) GROUP BY 1)"""
    + STRENGTH_SQL.format(name="suffix")
    + """, domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2)
, domain_g AS (SELECT g.domain, g.suffix, g.n, g.bad, (up.bad - g.bad + s * up.mu) / (up.n - g.n + s) AS mu FROM domain_n g JOIN suffix_g up USING (suffix), suffix_s)"""
    + STRENGTH_SQL.format(name="domain")
    + """, host_g AS (SELECT g.host, g.n, g.bad, (up.bad - g.bad + s * up.mu) / (up.n - g.n + s) AS mu FROM hosts g JOIN domain_g up USING (domain, suffix), domain_s)"""
    + STRENGTH_SQL.format(name="host")
    + """, ab AS (SELECT host, bad + s * mu AS a, n - bad + s * (1 - mu) AS b FROM host_g, host_s)
, bounds AS (SELECT host, a / (a + b) AS bad_rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM ab)
, rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
, hit AS (SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(r.verdict, length(rhost || rpath)) AS verdict
    FROM (SELECT DISTINCT host, path FROM parted) JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, lower
FROM parted p LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path LEFT JOIN bounds b ON p.host = b.host""",
)
def op2(spark, sf):
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return url_reputation.judge(table(spark, sf, "pages"), labels, URL_RULES)


@query("op3_elias_fano_lm")
def op3(spark, sf):
    return ngram_lm.score(table(spark, sf, "documents"))


@query("op4_pfair_mix")
def op4(spark, sf):
    return pfair_mix.interleave(table(spark, sf, "documents"))


@query("op5_simhash_vp_tree")
def op5(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op6_exact_complement_packing")
def op6(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op7_chunk_dedup",
    """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def op7(spark, sf):
    return chunk_dedup.exact_groups(table(spark, sf, "documents"))


@query("op8_cross_polytope")
def op8(spark, sf):
    return cross_polytope.nearest(table(spark, sf, "embeddings"))


@query("op9_language_bayes")
def op9(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query(
    "op10_fm_index_dedup",
    r"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, win AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13)
, k AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM win)
, f AS (SELECT h, min(doc_id) AS d FROM k GROUP BY h)
, gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (h) WHERE d < doc_id)
, pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w)
, kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
)
def op10(spark, sf):
    return fm_dedup.without_repeats(table(spark, sf, "documents")).drop("spans")


@query(
    "op11_filter_potential",
    r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1)
, f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id)
, m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2)
, c(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))
, o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM c p, c q, c r, c s, c t
    WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31)
, k AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, range(1, 6) AS g(step))
, r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, k GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
)
def op11(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_sampled_sort_resample")
def op12(spark, sf):
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_multi_order_jaccard")
def op13(spark, sf):
    return jaccard_join.similar_groups(table(spark, sf, "documents"))
