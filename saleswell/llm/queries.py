"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from saleswell.llm import chat, lm, packing, pieces, prints, ranked, resample, simhash, substrings, topk, toxicity, urlfilter, vectors
from saleswell.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_lm_scoring")
def lm_scoring(spark, sf_dir):
    return lm.corpus_scores(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op3_exact_topk", TOPK_SQL)
def exact_topk(spark, sf_dir):
    return topk.top_products(table(spark, sf_dir, "embeddings"))


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), r AS (SELECT vec_id AS node, vec_id AS met FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.met = l.a),
c AS (SELECT node, min(met) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op4_embedding_near_dedup", VECTOR_SQL)
def embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_substring_dedup")
def substring_dedup(spark, sf_dir):
    return substrings.removal_report(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, length(role) + length(text) + 24 AS n,
    length(role) + length(text) - length(translate(role || text, '\<[', '')) AS brackets,
    length(role || text) - length(replace(role || text, '\', '')) AS slashes,
    length(role || text) - length(replace(replace(role || text, '<', ''), '[', '')) AS opens
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + slashes + 2 * opens) AS BIGINT) AS formatted_chars, false AS rewrites_history
FROM o GROUP BY conv_id
"""


@query("op7_chat_formatting", CHAT_SQL)
def chat_formatting(spark, sf_dir):
    control = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digest_chats(chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)))


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    fp = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", fp.alias("fingerprint"), "component_id")


@query("op9_sentencepiece")
def sentencepiece_codec(spark, sf_dir):
    return pieces.piece_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


URL_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2020-01-01' + CAST(abs(page_id) * 53 % 2000 AS INTEGER) AS fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/') AS parts
  FROM pages
), e AS (
  SELECT CASE WHEN abs(page_id) % 5 = 4 THEN 'allow' ELSE 'block' END AS list, CASE WHEN abs(page_id) % 5 < 2 THEN 'host' WHEN abs(page_id) % 5 = 2 THEN 'domain' ELSE 'prefix' END AS kind,
    CASE WHEN abs(page_id) % 5 < 2 THEN host WHEN abs(page_id) % 5 = 2 THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE host || '/' || parts[2] || '/' END AS value,
    abs(page_id) % 5 <> 1 AS adds, DATE '2020-01-01' + CAST(abs(page_id) * 37 % 1500 AS INTEGER) AS day
  FROM p WHERE host <> '' AND (abs(page_id) % 5 < 3 OR len(parts) > 2)
), d AS (SELECT list, kind, value, day, bool_or(adds) AS adds FROM e WHERE day IS NOT NULL GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM d),
k AS (
  SELECT DISTINCT url, fetched_on, 'host' AS kind, host AS value FROM p WHERE host <> '' AND fetched_on IS NOT NULL
  UNION SELECT url, fetched_on, 'domain', unnest([array_to_string(list_slice(string_split(host, '.'), i, -1), '.') FOR i IN range(1, len(string_split(host, '.')) + 1)]) FROM p WHERE host <> '' AND fetched_on IS NOT NULL
  UNION SELECT url, fetched_on, 'prefix', unnest([host || array_to_string(list_slice(parts, 1, i), '/') || '/' FOR i IN range(1, len(parts))]) FROM p WHERE host <> '' AND fetched_on IS NOT NULL
), m AS (
  SELECT url, fetched_on, count(*) FILTER (list = 'block') AS b, count(*) FILTER (list = 'allow') AS a, min(kind || ':' || value) FILTER (list = 'block') AS rule
  FROM k JOIN v USING (kind, value) WHERE adds AND fetched_on >= day AND (until IS NULL OR fetched_on < until) GROUP BY url, fetched_on
)
SELECT page_id, url, p.fetched_on, coalesce(host, '') AS host, coalesce(b, 0) AS n_block, coalesce(a, 0) AS n_allow, coalesce(b, 0) > 0 AND coalesce(a, 0) = 0 AS blocked, rule
FROM p LEFT JOIN m USING (url, fetched_on)
"""


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day, which the table lacks, spread over 2000 days by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), (F.abs("page_id") * 53 % 2000).cast("int")).alias("fetched_on"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries from the pages' own hosts: each page adds or removes one by the remainder of its id."""
    turn, host, url = F.abs("page_id") % 5, urlfilter.host_of(F.col("url")), F.col("url")
    labels, folders = F.split(host, r"\."), urlfilter.directories(host, url)
    return pages.where(host != "").select(
        F.when(turn == 4, "allow").otherwise("block").alias("list"),
        F.when(turn < 2, "host").when(turn == 2, "domain").otherwise("prefix").alias("kind"),
        F.when(turn < 2, host).when(turn == 2, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")).otherwise(F.get(folders, F.lit(1))).alias("value"),
        F.when(turn == 1, "remove").otherwise("add").alias("action"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.abs("page_id") * 37 % 1500).cast("int")).alias("day"),
    )


@query("op10_url_filters", URL_SQL)
def url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urlfilter.evaluate(page_captures(pages), page_entries(pages))


RESAMPLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT 's' AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), w AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t
), f AS (
  SELECT side, row, unnest(words) AS feature FROM w
  UNION ALL SELECT side, row, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) FROM w
), c AS (SELECT side, row, feature, count(*) AS k FROM f GROUP BY ALL),
d AS (SELECT DISTINCT feature, hex(encode(feature)) AS h, strlen(feature) AS n FROM c),
b AS (SELECT feature, n, i, CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS byte FROM (SELECT feature, h, n, unnest(range(1, n + 1)) AS i FROM d)),
z AS (
  SELECT 0 AS step, byte, byte AS state FROM range(256) r(byte)
  UNION ALL SELECT step + 1, byte, CASE WHEN state & 1 = 1 THEN xor(state >> 1, 3988292384) ELSE state >> 1 END FROM z WHERE step < 8
), tab AS (SELECT byte, state FROM z WHERE step = 8),
-- crc32 is linear: what a byte, or the start value, has become after the bytes that follow it.
far AS (
  SELECT 0 AS rest, byte, state FROM tab
  UNION ALL SELECT rest + 1, far.byte, xor(far.state >> 8, tab.state) FROM far JOIN tab ON tab.byte = far.state & 255 WHERE rest < (SELECT max(n) FROM d)
), start AS (
  SELECT 0 AS n, CAST(4294967295 AS BIGINT) AS state
  UNION ALL SELECT n + 1, xor(start.state >> 8, tab.state) FROM start JOIN tab ON tab.byte = start.state & 255 WHERE n < (SELECT max(n) FROM d)
), bucket AS (
  SELECT feature, xor(xor(any_value(start.state), 4294967295), bit_xor(far.state)) % 10000 AS bucket
  FROM b JOIN far ON far.rest = b.n - b.i AND far.byte = b.byte JOIN start ON start.n = b.n GROUP BY feature
), total AS (SELECT bucket, coalesce(sum(k) FILTER (side = 's'), 0) AS s, coalesce(sum(k) FILTER (side = 't'), 0) AS t FROM c JOIN bucket USING (feature) GROUP BY bucket),
al AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM total),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM total, al),
g AS (SELECT row, sum(k * gain) AS total FROM c JOIN bucket USING (feature) JOIN gain USING (bucket) WHERE side = 's' GROUP BY row),
m AS (
  SELECT row, doc_id, len(words) AS n_words, greatest(2 * len(words) - 1, 0) AS n, coalesce(total, 0) AS total,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN g USING (row) WHERE side = 's'
), v AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST((total - ((total % n + n) % n)) // n AS BIGINT) END AS weight FROM m
), x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM v),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n) AS rank, 25 * count(*) OVER () // 100 AS quota FROM x WHERE n_words >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN rank <= quota THEN rank END AS BIGINT) AS rank FROM x LEFT JOIN r USING (row)
"""


@query("op11_importance_resampling", RESAMPLE_SQL)
def importance_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RANKED_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), al AS (SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM t WHERE len(terms) > 0),
e AS (SELECT row, doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, terms, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY row, doc_id, n, term, terms),
d AS (SELECT term, count(*) AS df FROM e GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM d, al),
p AS (SELECT row, doc_id, term, 1000000000 * tf // (1000 * tf + 8 * (100 - 90 + 90 * n * n_all // l_all)) AS impact FROM e, al),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_ranked_search", RANKED_SQL)
def ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    return prints.fingerprints(table(spark, sf_dir, "documents"))
