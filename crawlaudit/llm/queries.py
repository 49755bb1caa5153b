"""Queries of the operators over the given tables, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, editprint, exact, infill, language, licences, mixing, neighbours, pack, secret_scan, simhash, substring, urls
from .common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Register a query, with check SQL when it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register(fn) if fn else register


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(read(spark, sf_dir, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query(sql="""SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents) WINDOW g AS (PARTITION BY norm)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents")).drop("bucket")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


# Each level of the budget tree: the children of a node in the order of supply / weight, and the first that does not fill up.
_DEAL = """{at}_c AS (SELECT {keys}, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens, {weight} AS weight FROM leaves GROUP BY {keys}),
{at}_g AS (SELECT c.*, {given} AS given FROM {at}_c c {join}),
{at}_o AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY supply / weight, {at}) AS n,
    given - (sum(supply) OVER (PARTITION BY {parent} ORDER BY supply / weight, {at} ROWS UNBOUNDED PRECEDING) - supply) AS left_,
    sum(weight) OVER (PARTITION BY {parent} ORDER BY supply / weight, {at} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_ FROM {at}_g),
{at}_s AS (SELECT {parent} AS p, min(n) AS stop, arg_min(left_, n) AS pool, arg_min(weights_, n) AS pool_weights FROM {at}_o
    WHERE supply::HUGEINT * weights_ > weight::HUGEINT * left_ GROUP BY {parent}),
{at}_b AS (SELECT o.*, CASE WHEN s.stop IS NULL OR o.n < s.stop THEN o.supply ELSE (o.weight::HUGEINT * s.pool) // s.pool_weights END AS got
    FROM {at}_o o LEFT JOIN {at}_s s ON s.p = {oparent}),
"""
_MIX_SQL = f"""WITH rows_ AS (SELECT doc_id, 'd' || (regexp_extract(source, '([0-9]+)$', 1)::INT % 4) AS domain, lang, source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
docs AS (SELECT * FROM rows_ WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 3 AS supply FROM docs GROUP BY ALL),
{_DEAL.format(at='domain', keys='domain', weight="CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", parent='1', oparent='1',
    given='least(floor((SELECT sum(tokens) FROM leaves) * 0.5)::BIGINT, (SELECT sum(supply) FROM leaves))', join='')}
{_DEAL.format(at='lang', keys='domain, lang', weight="CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 ELSE 2 END", parent='domain', oparent='o.domain',
    given='b.got', join='JOIN domain_b b USING (domain)')}
{_DEAL.format(at='source', keys='domain, lang, source', weight='1', parent="domain || '|' || lang", oparent="o.domain || '|' || o.lang",
    given='b.got', join='JOIN lang_b b USING (domain, lang)')}
dealt AS (SELECT d.*, (b.got // b.tokens)::BIGINT AS whole, (b.got % b.tokens)::BIGINT AS rest FROM docs d JOIN source_b b USING (domain, lang, source)),
drawn AS (SELECT *, whole + 1 AS epoch, ('0x' || substr(md5('7|' || (whole + 1) || '|' || doc_id), 1, 15))::BIGINT AS draw FROM dealt WHERE rest > 0),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM drawn)
SELECT doc_id, domain, lang, source, epoch, tokens, least(tokens, rest - before)::BIGINT AS taken FROM placed WHERE before < rest
UNION ALL SELECT doc_id, domain, lang, source, unnest(range(1, whole + 1)) AS epoch, tokens, tokens AS taken FROM dealt WHERE whole > 0"""


@query(sql=_MIX_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"), fraction=0.5, epochs=3).drop("text_hash")


_FOLD = "regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0./_?=&#%:@\\-]', '~', 'g')"
_CHANCE = lambda v: f"""(({v}_2 + 4.0 * (({v}_1 + 4.0 * (({v}_0 + 4.0 * (1.0 / 40)::DOUBLE) / ({v}_0_all + 4.0))) / ({v}_1_all + 4.0))) / ({v}_2_all + 4.0))"""
_COUNTS = lambda v: f"""sum({v}) OVER (PARTITION BY substr(g, 3, 1)) AS {v}_0, sum({v}) OVER () AS {v}_0_all, sum({v}) OVER (PARTITION BY substr(g, 2, 2)) AS {v}_1,
    sum({v}) OVER (PARTITION BY substr(g, 2, 1)) AS {v}_1_all, sum({v}) OVER (PARTITION BY g) AS {v}_2, sum({v}) OVER (PARTITION BY substr(g, 1, 2)) AS {v}_2_all"""


@query(sql=f"""WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
ruled AS (SELECT *, '^^' || {_FOLD} AS f, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts),
urls AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM ruled),
different AS (SELECT DISTINCT f, verdict FROM urls),
grams AS (SELECT f, verdict, substr(f, i, 3) AS g FROM (SELECT f, verdict, unnest(range(1, length(f) - 1)) AS i FROM different)),
counts AS (SELECT g, sum((verdict = 'allow')::INT)::DOUBLE AS allow, sum((verdict = 'block')::INT)::DOUBLE AS block FROM grams WHERE verdict IS NOT NULL GROUP BY g),
contexts AS (SELECT g, {_COUNTS('allow')}, {_COUNTS('block')} FROM counts),
ratios AS (SELECT g, round((ln({_CHANCE('allow')}) - ln({_CHANCE('block')})) * 1000000)::BIGINT AS ratio FROM contexts),
scores AS (SELECT f, verdict, floor(sum(coalesce(ratio, 0))::DOUBLE / (count(*) * 1000))::BIGINT AS score FROM grams LEFT JOIN ratios USING (g) GROUP BY f, verdict),
ranked AS (SELECT score, sum(count(*)) OVER (ORDER BY score) AS below, sum(count(*)) OVER () AS everything FROM scores WHERE verdict = 'allow' GROUP BY score),
bar AS (SELECT CASE WHEN (SELECT count(*) FROM scores WHERE verdict = 'block') > 0 THEN min(score) END AS bar FROM ranked WHERE below > everything * 0.05)
SELECT page_id, host, path, rule, coalesce(u.verdict, CASE WHEN coalesce(s.score, 0) < (SELECT bar FROM bar) THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN u.verdict IS NULL THEN coalesce(s.score, 0) END AS score
FROM urls u LEFT JOIN (SELECT f, score FROM scores WHERE verdict IS NULL) s ON u.verdict IS NULL AND s.f = u.f""")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


_CANONICAL = lambda x: """trim(regexp_replace(regexp_replace(lower({0}), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(copyright[^\\p{{L}}\\p{{N}}\\n]*(\\(c\\)|©|[0-9]{{4}})|\\(c\\)[^\\p{{L}}\\p{{N}}\\n]*[0-9]{{4}}|©)[^\\n]*$', ' ', 'g'),
    '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))""".format(x)
def _spelled(x: str) -> str:
    for pattern, instead in licences.SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
    return x


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_KNOWN = ", ".join(f"({_QUOTED(licence)}, {_QUOTED(text)})" for licence, text in [*licences.known_texts(), *licences.full_texts()])


@query(sql=f"""WITH known AS (SELECT c, min(licence) AS licence FROM (SELECT licence, {_spelled(_CANONICAL('text'))} AS c FROM (VALUES {_KNOWN}) v(licence, text)) GROUP BY c),
units AS (SELECT doc_id, 'whole' AS kind, text AS u FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 'paragraph', u FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS u FROM documents) WHERE contains(u, chr(10))
    UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda x: {_spelled(_CANONICAL('x'))}), lambda c: c <> '') AS p FROM documents),
firsts AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts),
begun AS (SELECT doc_id, p, i FROM firsts WHERE p[i][:20] IN (SELECT c[:20] FROM known WHERE length(c) >= {licences.LONG})
    OR EXISTS (SELECT 1 FROM known WHERE length(c) >= {licences.LONG} AND starts_with(c, p[i]))),
runs AS (SELECT doc_id, array_to_string(p[i:j], ' ') AS c FROM (SELECT doc_id, p, i, unnest(range(i, len(p) + 1)) AS j FROM begun)),
looked AS (SELECT doc_id, kind, {_spelled(_CANONICAL('u'))} AS c FROM units UNION ALL SELECT doc_id, 'run', c FROM runs),
found AS (SELECT doc_id, max(CASE WHEN kind = 'whole' THEN licence END) AS licence, count(*) FILTER (kind = 'line') AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
    FROM looked JOIN known USING (c) GROUP BY doc_id)
SELECT doc_id, licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices FROM documents LEFT JOIN found USING (doc_id)""")
def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_of_every(read(spark, sf_dir, "embeddings"))


_P = lambda c, n: f"1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
_F = "((p - q) * (p - q)) // (p + q)"


@query(sql=f"""WITH rows_ AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM rows_),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM rows_),
sizes AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM rows_) LEFT JOIN kept k USING (lang) GROUP BY lang),
used AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, v, coalesce(sum(c), 0) AS n FROM groups g JOIN sizes USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL),
lang_totals AS (SELECT lang, any_value(v) AS v, sum(n) AS n FROM totals GROUP BY lang),
shares AS (SELECT t.lang, t.source, k.term, coalesce(u.c, 0) AS c, {_P('coalesce(u.c, 0)', 't.n')} AS p
    FROM totals t JOIN kept k ON k.lang = t.lang LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term),
lang_shares AS (SELECT w.lang, w.term, {_P('w.c', 'l.n')} AS q FROM (SELECT lang, term, sum(c) AS c FROM used GROUP BY lang, term) w JOIN lang_totals l USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum({_F}) AS f FROM shares a JOIN (SELECT lang, source, term, p AS q FROM shares) b ON a.lang = b.lang AND a.term = b.term
        GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_F} AS value FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {divergence.TOP}""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


@query
def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.fingerprint_documents(read(spark, sf_dir, "documents")).drop("edited_text")


@query(sql="""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS two,
    ('0x' || substr(s, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
    WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(read(spark, sf_dir, "documents")).drop("pieces", "output")
