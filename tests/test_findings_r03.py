"""Findings of round 3: groups of any size, long lines, whole jobs."""

from collections import Counter

from pyspark.sql import functions as F


def parts_and_rows(df):
    rows = df.withColumn("_p", F.spark_partition_id()).collect()
    return len({r["_p"] for r in rows}), Counter(tuple(r)[:-1] for r in rows)


def test_pairs_of_one_component_are_spread_over_tasks(spark):
    from chromatid.operators import match

    ids = [(f"v{i}", "Button", str(i), i) for i in range(4100)]
    c = spark.createDataFrame(ids, "id string, name string, variant string, seq long")
    pairs = match.variant_pairs(c).withColumn("_p", F.spark_partition_id())
    by_part = {r["_p"]: r["count"] for r in pairs.groupBy("_p").count().collect()}
    assert sum(by_part.values()) == 4100 * 4099 // 2 and len(by_part) > 1
    left = spark.createDataFrame([("k", i) for i in range(20)] + [("one", 1), ("none", 2), (None, 3)], "key string, a int")
    right = spark.createDataFrame([("k", i) for i in range(15)] * 2 + [("one", 1), (None, 3)], "key string, b int")
    parts, got = parts_and_rows(match.group_pairs(left, right, "key", tile=4))
    assert parts > 1 and got == Counter(tuple(r) for r in left.join(right, "key").collect())


def test_contrast_pairs_of_one_component_are_spread_over_tasks(spark):
    from chromatid.operators import match

    s = spark.range(4200).selectExpr("'c' AS component", "IF(id % 2 = 0, 'color', 'background') AS property", "'#' || lpad(hex(id * 3989), 6, '0') AS value")
    pairs = match.contrast_pairs(s, least=30.0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in pairs) == 2100 * 2100 and len(pairs) > 1


def test_examples_of_one_name_are_spread_over_tasks(spark):
    from chromatid.operators import search

    c = spark.range(8200).selectExpr("id", "'Card' AS name", "IF(id % 2 = 0, 'production', 'example') AS context").where("id % 2 = 0 or id < 600")
    pairs = search.related_examples(c).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in pairs) == 4100 * 300 and len(pairs) > 1


def test_a_class_of_very_many_words(spark):
    from chromatid.sources import classes

    words = "-".join(["item", "b"] * 200_000)
    f = spark.createDataFrame([("p", f"cn-{words}\ncn-card-header")], "path string, content string")
    got = {(r.line, len(r["class"]), len(r.block), len(r.element or ""), r.modifier) for r in classes.prefixed_classes(f, "cn").collect()}
    assert got == {(1, 3 + len(words), len(words) - 7, 6, None), (2, 14, 4, 6, None)}


def test_groups_match_as_the_whole_does(spark):
    import random

    from chromatid.operators import match

    draw = random.Random(5)
    rows = [(f"s{s}", f"t{g}-{draw.randrange(6)}", draw.choice([0.5, 0.7, 0.9]), s, draw.randrange(9), g) for s in range(60) for g in [s % 7] for _ in range(3)]
    rows = list({r[:2]: r for r in rows}.values())
    pairs = spark.createDataFrame(rows, "source_id string, target_id string, score double, source_seq long, target_seq long, part int")
    want = {tuple(r) for r in match.greedy(pairs.drop("part")).collect()}
    for alone in (4, 20, 1000):
        assert {tuple(r) for r in match.greedy(pairs, alone, "part").collect()} == want


def test_copies_of_components_are_compared_once(spark):
    from chromatid.operators import match

    side = lambda k, n: spark.range(n).selectExpr("id AS seq", f"'{k}' || id AS id", "'Button' || (id % 3) AS name", "array('size') AS props", "array('sm') AS variants", "CAST(array() AS array<string>) AS dependencies")
    s, t = match._profiles(side("s", 300), "source"), match._profiles(side("t", 600), "target")
    assert match._profile_scores(s, t, 0.55).count() == 9
    got = match.component_scores(side("s", 300), side("t", 600), 0.55).groupBy("score").count().collect()
    assert {(round(r.score, 6), r["count"]) for r in got} == {(0.9, 60_000), (round(0.4 * 6 / 7 + 0.5, 6), 120_000)}


def test_name_similarity_compares_all_names_of_a_brand_and_size(spark, tmp_path):
    from chromatid.queries import ORACLE_SQL, QUERIES

    rows = [(1, "anvil", "B1", 1), (5, "apple", "B1", 1), (900, "bolt", "B1", 1), (901, "cog", "B2", 1), (902, "dial", "B1", 2), (903, "bolt", "B1", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    assert {(r.a, r.b) for r in QUERIES["name_similarity"](spark, str(tmp_path)).collect()} == {("anvil", "apple"), ("anvil", "bolt"), ("apple", "bolt")}
    assert "p_brand" in ORACLE_SQL["name_similarity"] and "partkey" not in ORACLE_SQL["name_similarity"]


def test_color_counts_are_brute_force_at_the_edges(spark):
    import math

    from chromatid.operators import styles

    rgb = [(r, g, b) for r in (0, 18, 29, 255) for g in (0, 24, 30, 240) for b in (0, 1, 29, 255)]
    text = lambda c: "#%02x%02x%02x" % c
    values = spark.createDataFrame([(text(c),) for c in rgb] + [("#000",), ("black",), (text(rgb[0]),)], "value string")
    palette = spark.createDataFrame([(text(c),) for c in rgb] * 2, "color string")
    weight = {c: 1 + 2 * (c == (0, 0, 0)) for c in rgb}
    for reach in (30.0, 1.0, 41.5):
        want = {text(p): sum(n for c, n in weight.items() if math.dist(p, c) < reach) for p in rgb}
        assert {tuple(r) for r in styles.replaced_colors(values, palette, reach).collect()} == set(want.items())
    assert "SortMergeJoin [_k" not in styles.replaced_colors(values, palette)._jdf.queryExecution().toString()


def test_files_of_one_stored_part_are_read_by_several_tasks(spark):
    from chromatid.sources import classes, literals

    f = spark.range(0, 40, 1, 1).selectExpr("'f' || id AS path", "'const v = cva(\"bg-primary\", { variants: { size: { sm: \"text-ring p-1\", lg: \"p-2\" } } })' AS content")
    leaves, _ = literals.call_leaves(f, "cva")
    assert leaves.select(F.spark_partition_id()).distinct().count() > 1
    selected = f.withColumn("content", F.lit("group/menu"))
    assert classes.selector_classes(selected).select(F.spark_partition_id()).distinct().count() > 1
    definitions = classes.variant_definitions(leaves)
    assert definitions._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {(r.axes, r.options, r.defaults, *r.base, *r.tokens) for r in definitions.collect()}
    assert got == {(1, 2, 0, "bg-primary", "primary", "ring")}
    assert {tuple(r) for r in classes.definition_tokens(leaves).collect()} == {("primary", 40, 40), ("ring", 40, 40)}


def test_checkpoints_are_not_broadcast_by_their_file_s_size(spark, tmp_path):
    from chromatid.session import measured

    spark.range(2000).selectExpr("id", "concat('a', id) AS a", "concat('b', id) AS b").write.parquet(f"{tmp_path}/t.parquet")
    rows = measured(spark.read.parquet(f"{tmp_path}/t.parquet").select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("x")))
    joined = rows.join(rows.where("x = 1").select("id", F.lit(1).alias("y")), "id")
    assert joined.count() == 100_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_ownership_is_spread_over_tasks_of_so_many_rows(spark, tmp_path, monkeypatch):
    from chromatid import bindings, session
    from chromatid.operators import graph

    monkeypatch.setattr(session, "TASK_ROWS", 50, raising=False)

    commits = [(f"o{i}", "Commit", f"c{i * i % 7}", i) for i in range(300)] + [("s1", "Component", None, 1), (None, "Commit", "c1", 2)]
    nodes = spark.createDataFrame(commits, "id string, type string, author string, seq long").withColumn("timestamp", F.timestamp_seconds("seq"))
    links = [(("CHANGED", "ADDED", "USES")[i % 3], f"o{i % 310}", f"s{i % 11}") for i in range(900)] + [("CHANGED", None, "s1"), ("ADDED", "o1", None)]
    owners = {}
    for kind, src, dst in links:
        if kind != "USES" and src and int(src[1:]) < 300:
            owners.setdefault(dst, {}).setdefault(commits[int(src[1:])][2], []).append(int(src[1:]))
    want = Counter()
    for entity, by in owners.items():
        for rank, (author, seqs) in enumerate(sorted(by.items(), key=lambda x: (-len(x[1]), min(x[1]))), 1):
            want[entity, author, len(seqs), max(seqs), rank] += 1
    got = graph.ownership(nodes, spark.createDataFrame(links, "type string, src string, dst string")).withColumn("last", F.unix_timestamp("last"))
    parts, rows = parts_and_rows(got)
    assert rows == want
    assert parts > 1

    keys = [(i % 40, i % 9, i % 5) for i in range(400)] + [(None, 1, 2), (1, None, 2)] * 2
    spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for kind, pairs in (("USES", {(s, p) for _, p, s in keys}), ("CHANGED", {(o, s) for o, _, s in keys})):
        parts, rows = parts_and_rows(bindings.graph_edges(spark, str(tmp_path)).where(F.col("type") == kind))
        a, b = ("s", "p") if kind == "USES" else ("o", "s")
        assert parts > 1 and rows == Counter((kind, None if x is None else f"{a}{x}", None if y is None else f"{b}{y}") for x, y in pairs)
