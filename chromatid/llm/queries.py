"""The queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid.llm import chat_format, cotrain, decontam, divergence, embed_dedup, fill_middle, html_extract, mixing, nearest, ngram_join, token_store, url_rules, warc
from chromatid.llm.common import new_path, read

#: The rules of op5's contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(read(spark, sf_dir, "conversations"))


_NAME = "role"
for _c in chat_format.ENCODED:
    _NAME = f"replace({_NAME}, chr({ord(_c)}), '%{ord(_c):02X}')"
#: Every dialogue whole for each participant but the system; turns by number (null last), role and text; what no row can hold in parts, the later
#: ones behind the system turns of the first.
OP1_SQL = f"""
WITH r AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS x FROM conversations),
t AS (SELECT *, (coalesce(sum(strlen(x) + {chat_format.TURN_BYTES}) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  // {chat_format.PART_BYTES})::BIGINT AS part, true AS real FROM r),
p AS (SELECT conv_id AS c, part AS later FROM t WHERE part > 0 GROUP BY ALL),
a AS (SELECT * FROM t UNION ALL SELECT conv_id, turn, role, x, later, false FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c WHERE part = 0 AND role = 'system'),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM r WHERE role IS DISTINCT FROM 'system'),
m AS (SELECT a.*, speaker, role IS NOT DISTINCT FROM speaker AS own, '<|im_start|>' || CASE WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
  ELSE 'user name=' || coalesce({_NAME}, '%') END || chr(10) AS head FROM a JOIN s ON conv_id IS NOT DISTINCT FROM c),
o AS (SELECT *, row_number() OVER w AS nth, length(head) + coalesce(sum(length(head) + length(x) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
  FROM m WINDOW w AS (PARTITION BY conv_id, part, speaker ORDER BY real, turn NULLS LAST, role NULLS FIRST, x))
SELECT conv_id, part, speaker, count(*) FILTER (WHERE real) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || x || '<|im_end|>' || chr(10), '' ORDER BY nth) AS rendered,
  coalesce(string_agg(st || '-' || (st + length(x) + 10), ',' ORDER BY st) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, part, speaker
"""


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_benchmark_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.regions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes documents into a token store in the shared folder and reads every document's digest back."""
    path = new_path(spark, "tokens")
    token_store.write_store(read(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read_digests(spark, path)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), rules)


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP5_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, url, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM a),
m AS (SELECT host, path, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY host, path
  ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS n
  FROM d JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT a.page_id, a.host, a.path, m.rule, coalesce(m.rule_verdict, 'allow') AS verdict
FROM a LEFT JOIN m ON a.host = m.host AND a.path = m.path AND m.n = 1
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(read(spark, sf_dir, "pages")))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("key")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_near(read(spark, sf_dir, "embeddings"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the transformed texts and of what is rebuilt from them."""
    out = fill_middle.transform(read(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restore(), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_quality_scores": op2_quality_scores,
    "op3_benchmark_regions": op3_benchmark_regions,
    "op4_token_store": op4_token_store,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_mix": op8_mix,
    "op9_html_text": op9_html_text,
    "op10_embedding_links": op10_embedding_links,
    "op11_nearest": op11_nearest,
    "op12_source_divergence": op12_source_divergence,
    "op13_fill_in_middle": op13_fill_in_middle,
}
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
  AND len(list_filter(x, lambda y: y <> 0)) > 0),
link AS (SELECT a.vec_id AS s, b.vec_id AS d FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT link.s, reach.r FROM reach JOIN link ON link.d = reach.id),
n AS (SELECT s, count(*) AS n FROM link GROUP BY s),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.s = v.vec_id
"""

_VECTOR = "x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0"
OP11_SQL = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), ok AS (SELECT * FROM v WHERE {_VECTOR}),
d AS (SELECT q.nth, q.vec_id AS query_id, c.vec_id, c.nth AS other,
  sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, b: a + b)) AS score FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.nth <> c.nth AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score, vec_id NULLS LAST, other)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), '{divergence.UPPER}', '{divergence.LOWER}') AS x FROM documents),
w AS (SELECT nth, lang, source, unnest(regexp_extract_all(x, '{divergence.TERM_PATTERN}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT nth) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, (1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (coalesce(n.n, 0) + l.v)::HUGEINT)::BIGINT AS p,
  (1 + 1000000000 * (k.total + 1)::HUGEINT // (l.n + l.v)::HUGEINT)::BIGINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE count > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

_CUT = "array_to_string(t[{0} + 1:{1}], '')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(x, '(?s)[A-Za-z]+|[^A-Za-z]') AS t, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, {_CUT.format("0", "a")} AS prefix, {_CUT.format("a", "b")} AS middle, {_CUT.format("b", "n")} AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM s
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_perspectives": OP1_SQL,
    "op5_url_filter": OP5_SQL,
    "op10_embedding_links": OP10_SQL,
    "op11_nearest": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
