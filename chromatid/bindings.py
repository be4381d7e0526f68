"""Views of the test tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    category = F.when(F.col("l_returnflag") == "A", "color").when(F.col("l_returnflag") == "N", "spacing").otherwise("radius")
    return li.select(category.alias("category"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.concat(F.lit("file"), F.col("l_suppkey").cast("string")).alias("file"))


AUDIT_VALUES = """audit_values AS (SELECT CASE l_returnflag WHEN 'A' THEN 'color' WHEN 'N' THEN 'spacing' ELSE 'radius' END AS category,
  l_quantity::INT::VARCHAR AS value, 'file' || l_suppkey AS file FROM lineitem)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = {"view": "hardcoded-value", "click": "naming-inconsistency", "error": "accessibility-conflict", "purchase": "value-divergence", "signup": "orphaned-token"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type").isin("view", "purchase"), "warning").otherwise("info")
    place = F.when(F.col("user_id") % 5 == 0, F.lit("index.tsx:1")).otherwise(
        F.concat(F.lit("src/"), (F.col("user_id") % 10).cast("string"), F.lit("/"), "event_type", F.lit(".tsx:"), (F.col("event_id") % 100 + 1).cast("string"))
    )
    whole = F.floor("value").cast("long")
    token = F.when((F.col("event_type") == "click") & (F.col("value") >= 50), F.concat(whole.cast("string"), F.lit(" → token-"), (whole % 7).cast("string"), F.lit(" (90%)")))
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), kind.alias("type"), severity.alias("severity"), F.lit("component").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("entity_name"), place.alias("location"),
        whole.cast("string").alias("actual"), F.when(token.isNotNull(), F.array(token)).otherwise(F.array().cast("array<string>")).alias("token_suggestions"),
        F.col("ts").cast("timestamp").alias("detected_at"),
    )


SIGNALS = """signals AS (SELECT event_id AS seq, event_id::VARCHAR AS id,
  CASE event_type WHEN 'view' THEN 'hardcoded-value' WHEN 'click' THEN 'naming-inconsistency' WHEN 'error' THEN 'accessibility-conflict'
    WHEN 'purchase' THEN 'value-divergence' ELSE 'orphaned-token' END AS type,
  CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type IN ('view', 'purchase') THEN 'warning' ELSE 'info' END AS severity,
  user_id::VARCHAR AS entity_id, 'User' || user_id AS entity_name,
  CASE WHEN user_id % 5 = 0 THEN 'index.tsx:1' ELSE 'src/' || (user_id % 10) || '/' || event_type || '.tsx:' || (event_id % 100 + 1) END AS location,
  floor(value)::BIGINT::VARCHAR AS actual,
  CASE WHEN event_type = 'click' AND value >= 50 THEN 'token-' || (floor(value)::BIGINT % 7) END AS token, ts FROM events)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("framework"),
        F.col("p_type").alias("variant"), F.col("p_size").alias("size"),
    )


COMPONENTS = "components AS (SELECT p_partkey AS seq, 'part:' || p_partkey AS id, p_name AS name, p_brand AS framework, p_type AS variant, p_size AS size FROM part)"


def named_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with names in several conventions, and with version suffixes, by key."""
    k = F.col("p_partkey")
    word = F.regexp_extract("p_name", r"^(\w+)", 1)
    name = (
        F.when(k % 10 == 0, F.concat(word, F.lit("-card")))
        .when(k % 10 == 1, F.concat(F.initcap(word), F.lit("New")))
        .when(k % 10 == 2, F.concat(F.initcap(word), F.lit("V2")))
        .when(k % 10 == 3, F.concat(word, F.lit("_old")))
        .otherwise(F.concat(F.initcap(word), F.lit("Box"), (k % 3).cast("string")))
    )
    return table(spark, sf_dir, "part").select(k.alias("seq"), F.concat(F.lit("part:"), k.cast("string")).alias("id"), name.alias("name"))


NAMED_COMPONENTS = r"""named AS (SELECT p_partkey AS seq, 'part:' || p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN w || '-card' WHEN 1 THEN c || 'New'
  WHEN 2 THEN c || 'V2' WHEN 3 THEN w || '_old' ELSE c || 'Box' || (p_partkey % 3) END AS name
  FROM (SELECT *, regexp_extract(p_name, '^(\w+)', 1) AS w, upper(substr(p_name, 1, 1)) || lower(substr(regexp_extract(p_name, '^(\w+)', 1), 2)) AS c FROM part))"""


def component_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("component"), F.col("o_orderpriority").alias("prop"), F.col("o_orderstatus").alias("type"), (F.col("o_orderkey") % 2 == 0).alias("required"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("day"))


COMPONENT_PROPS = "props AS (SELECT o_custkey AS component, o_orderpriority AS prop, o_orderstatus AS type, o_orderkey % 2 = 0 AS required, o_orderkey AS seq, o_orderdate AS day FROM orders)"


def _hex(key: str, factor: int) -> F.Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col(key) * factor % 16777216), 6, "0")))


def color_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_hex("p_partkey", 104729).alias("value"), F.col("p_brand").alias("scope"), F.col("p_partkey").alias("seq"))


def color_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("color-"), k.cast("string")).alias("token"), _hex("s_suppkey", 7919).alias("hex"), k.alias("seq"))


COLORS = """color_values AS (SELECT '#' || lpad(lower(to_hex((p_partkey * 104729) % 16777216)), 6, '0') AS value, p_brand AS scope, p_partkey AS seq FROM part),
color_tokens AS (SELECT 'color-' || s_suppkey AS token, '#' || lpad(lower(to_hex((s_suppkey * 7919) % 16777216)), 6, '0') AS hex, s_suppkey AS seq FROM supplier),
vc AS (SELECT DISTINCT value, ('0x' || substr(value, 2, 2))::INT AS r, ('0x' || substr(value, 4, 2))::INT AS g, ('0x' || substr(value, 6, 2))::INT AS b FROM color_values),
tc AS (SELECT token, hex, seq, ('0x' || substr(hex, 2, 2))::INT AS r, ('0x' || substr(hex, 4, 2))::INT AS g, ('0x' || substr(hex, 6, 2))::INT AS b FROM color_tokens),
vt AS (SELECT value, token, hex, seq, sqrt(((vc.r - tc.r) * (vc.r - tc.r) + (vc.g - tc.g) * (vc.g - tc.g) + (vc.b - tc.b) * (vc.b - tc.b))::DOUBLE) AS d FROM vc, tc)"""

UNITS = ("px", "rem", "em")


def spacing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), unit).alias("value"), F.col("p_brand").alias("scope"), F.col("p_partkey").alias("seq"))


def spacing_tokens(spark: SparkSession) -> DataFrame:
    return spark.range(1, 41).select(F.concat(F.lit("space-"), F.col("id").cast("string")).alias("token"), (F.col("id") * 4).cast("double").alias("px"), F.col("id").alias("seq"))


SPACINGS = """spacing_values AS (SELECT p_size || CASE p_partkey % 3 WHEN 0 THEN 'px' WHEN 1 THEN 'rem' ELSE 'em' END AS value,
  (p_size * CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 16 END)::DOUBLE AS px, p_brand AS scope, p_partkey AS seq FROM part),
spacing_tokens AS (SELECT 'space-' || i AS token, (i * 4)::DOUBLE AS px, i AS seq FROM range(1, 41) t(i))"""


def design_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of suppliers' names; some are written otherwise in the code."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Brand.color-"), (k % 97).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k.cast("string")).alias("id"), name.alias("name"), (k % 50).cast("string").alias("value_key"), k.alias("seq"))


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("Brand.color-"), (k % 89).cast("string"))).otherwise(F.concat(F.lit("brand-color_"), (k % 101).cast("string")))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), name.alias("name"), (k % 61).cast("string").alias("value_key"), k.alias("seq"))


TOKENS = """design AS (SELECT 'd' || s_suppkey AS id, 'Brand.color-' || (s_suppkey % 97) AS name, (s_suppkey % 50)::VARCHAR AS value_key, s_suppkey AS seq FROM supplier),
code AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Brand.color-' || (c_custkey % 89) ELSE 'brand-color_' || (c_custkey % 101) END AS name,
  (c_custkey % 61)::VARCHAR AS value_key, c_custkey AS seq FROM customer)"""


def class_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole line of every document, as a class list."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "classes"))
    return d.select("classes", "file", (F.col("pos") + 1).alias("line"))


CLASS_STRINGS = """class_strings AS (SELECT source AS file, unnest(string_split(text, chr(10))) AS classes FROM documents)"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USES supplier to part, CHANGED order to supplier, AUTHORED customer to order, all distinct."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = li.count()
    pairs = lambda a, b: spread(li.select(a, b), rows, a, b).distinct()  # noqa: E731 (keys take less memory than names, and the scan's tasks hold none of them)
    e = pairs("l_suppkey", "l_partkey").select(F.lit("USES").alias("type"), n("s", "l_suppkey").alias("src"), n("p", "l_partkey").alias("dst"))
    e = e.union(pairs("l_orderkey", "l_suppkey").select(F.lit("CHANGED"), n("o", "l_orderkey"), n("s", "l_suppkey"))).union(o.select(F.lit("AUTHORED"), n("c", "o_custkey"), n("o", "o_orderkey")))
    return e


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p, o = (table(spark, sf_dir, t) for t in ("supplier", "part", "orders"))
    n = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    none, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    a = s.select(n("s", "s_suppkey").alias("id"), F.lit("Component").alias("type"), F.col("s_name").alias("name"), none.alias("author"), never.alias("timestamp"), F.col("s_suppkey").alias("seq"))
    b = p.select(n("p", "p_partkey"), F.lit("Token"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name")), none, never, F.col("p_partkey"))
    c = o.select(n("o", "o_orderkey"), F.lit("Commit"), F.lit("commit"), n("c", "o_custkey"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey"))
    return a.union(b).union(c).withColumn("deprecated", F.lit(False))


GRAPH = """edges AS (SELECT DISTINCT 'USES' AS type, 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION ALL SELECT DISTINCT 'CHANGED', 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION ALL SELECT 'AUTHORED', 'c' || o_custkey, 'o' || o_orderkey FROM orders),
nodes AS (SELECT 's' || s_suppkey AS id, 'Component' AS type, s_name AS name, NULL AS author, NULL::TIMESTAMP AS ts, s_suppkey AS seq FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'Token', CASE WHEN p_partkey % 10 = 0 THEN '_' || p_name ELSE p_name END, NULL, NULL, p_partkey FROM part
  UNION ALL SELECT 'o' || o_orderkey, 'Commit', 'commit', 'c' || o_custkey, o_orderdate::TIMESTAMP, o_orderkey FROM orders)"""


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k imports parts k div 2 and k div 3."""
    p = table(spark, sf_dir, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("src"))
    both = p.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))).alias("dst"))
    return both.where("dst >= 1").select(F.lit("IMPORTS").alias("type"), "src", "dst").distinct()


IMPORT_EDGES = """imports AS (SELECT DISTINCT src, dst FROM
  (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part WHERE p_partkey >= 2) WHERE dst >= 1)"""


def looped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports, and parts in rings: 24 parts after another make a ring of 3, one of 9 and one of 12; k imports k + 1, and the last of a ring its first."""
    k = F.col("p_partkey")
    at = k % 24
    first = F.when(at == 2, k - 2).when(at == 11, k - 8).when(at == 23, k - 11).otherwise(k + 1)
    ring = table(spark, sf_dir, "part").select(F.lit("IMPORTS").alias("type"), k.alias("src"), first.alias("dst"))
    return import_edges(spark, sf_dir).union(ring).distinct()


LOOPED_EDGES = (
    IMPORT_EDGES
    + """, looped AS (SELECT src, dst FROM imports UNION SELECT p_partkey, CASE p_partkey % 24 WHEN 2 THEN p_partkey - 2 WHEN 11 THEN p_partkey - 8
  WHEN 23 THEN p_partkey - 11 ELSE p_partkey + 1 END FROM part)"""
)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    author = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("User")).otherwise(F.lit("user")), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("sha"), author.alias("author"), F.concat(author, F.lit("@example.com")).alias("email"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))


COMMITS = """commits AS (SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 2 = 0 THEN 'User' ELSE 'user' END || o_custkey AS author,
  CASE WHEN o_orderkey % 2 = 0 THEN 'User' ELSE 'user' END || o_custkey || '@example.com' AS email, o_orderdate::TIMESTAMP AS ts FROM orders)"""
