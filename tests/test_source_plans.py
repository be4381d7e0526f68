"""Themes, compound groups, design tags, the one-scan dispatch and plugins on cases of their own."""

import json

import pytest
from pyspark.sql import functions as F

from chromatid import plugins
from chromatid.plans import dispatch
from chromatid.sources import components, design, literals


def files(spark, **content):
    return spark.createDataFrame(list(content.items()), "path string, content string")


# Themes.
def test_themes_merge_and_resolve(spark):
    theme = """module.exports = preset({ theme: { colors: { a: 'red', a: 'blue', b: { DEFAULT: "theme('colors.a')", 1: '#111' }, self: "theme(colors.self)", two: "theme(colors.b) theme(colors.a)" },
      extend: { colors: { b: { 1: '#222' }, 'x$1\\\\d': 'theme("colors.b.1")' }, spacing: { s: 'calc(theme(spacing.none.x) + 1px)' }, zIndex: { a: '1' } } } })"""
    got = {r.key: (r.value, r.origin, r.state) for r in literals.theme_tokens(files(spark, t=theme, u="export default 5", v=None)).collect()}
    assert got == {
        "colors.a": ("blue", "theme", "whole"), "colors.b": ("blue", "theme", "whole"), "colors.b.1": ("#222", "extend", "whole"), "colors.self": ("theme(colors.self)", "theme", "cycle"),
        "colors.two": ("blue blue", "theme", "whole"), "colors.x$1\\d": ("#222", "extend", "whole"), "spacing.s": ("calc(theme(spacing.none.x) + 1px)", "extend", "missing"),
    }


def test_a_chain_of_references(spark):
    chain = ", ".join(f"c{i}: \"theme('spacing.c{i - 1}')\"" for i in range(1, 12))
    got = {r.key: r.value for r in literals.theme_tokens(files(spark, t=f"export default {{ theme: {{ spacing: {{ c0: '9px', {chain} }} }} }}")).collect()}
    assert got == {f"spacing.c{i}": "9px" for i in range(12)}


# Groups by rules.
def by_rules(rows):
    """The rules one after another, as they are said."""
    out = {}

    def roots(names, follows):
        found = []
        for n in sorted(set(names), key=len):
            if any(o != n and o.startswith(n) and follows(n, o) for o in names) and not any(n != r and n.startswith(r) and (follows is not dashed or n[len(r)] == "-") for r in found):
                found.append(n)
        return found

    def dashed(n, o):
        return o[len(n)] == "-"

    def capital(n, o):
        return o[len(n)].isupper()

    primary = {}
    for path, name, selector, seq in rows:
        if selector and selector.split(",")[0].strip():
            primary[selector.split(",")[0].strip()] = seq
    for r in roots(list(primary), dashed):
        for s, seq in primary.items():
            if s == r or s.startswith(r + "-"):
                out[seq] = ("".join(w[:1].upper() + w[1:] for w in r.split("-")), s == r, "selector")
    for rule, key in (("file", lambda p: p), ("folder", lambda p: p.rpartition("/")[0])):
        places = {}
        for path, name, selector, seq in rows:
            if selector and selector.split(",")[0].strip() and seq not in out:
                places.setdefault(key(path), []).append((name, seq))
        for members in places.values():
            if len(members) < 2:
                continue
            for r in roots([n for n, _ in members], capital):
                inside = [(n, s) for n, s in members if n.startswith(r)]
                for n, s in inside if len(inside) > 1 else []:
                    out[s] = (r, n == r, rule)
    return out


def test_rules_claim_members_in_turn(spark):
    rows = [
        ("a/x.ts", "Mat", "mat-form", 0), ("a/x.ts", "MatLabel", "mat-form-label, other", 1), ("a/x.ts", "MatX", "x", 2), ("a/x.ts", "MatXY", "y", 3), ("b/m.ts", "Again", "mat-form", 4), ("b/m.ts", "Select", None, 5),
        ("b/m.ts", "SelectItem", "q", 6), ("b/n.ts", "Select", "r", 7), ("b/n.ts", "Selector", "s", 8), ("b/o.ts", "SelectItemPart", "t", 9), ("b/o.ts", "Tab", "u", 10), ("b/o.ts", "TabTab", "tab", 11), ("c.ts", "A", "mat", 12),
        ("c.ts", "AB", "  ", 13), ("c.ts", "ABC", "tab-panel", 14), ("d/a.ts", "A", "aa", 15), ("d/b.ts", "AbC", "bb", 16), ("d/b.ts", "Ab", "cc", 17), ("d/c.ts", "A", "dd", 18),
    ]
    df = spark.createDataFrame(rows, "path string, name string, selector string, seq long")
    got = {r.seq: (r.group, r.root, r.rule) for r in components.compounds_by_rules(df).collect()}
    want = by_rules(rows)
    assert got == {seq: want.get(seq, (None, False, None)) for *_, seq in rows} and {x[2] for x in want.values()} == {"selector", "file", "folder"}


# Design files.
def tags_of(spark, node, meta=None, page="Page"):
    content = json.dumps({"components": meta or {}, "document": {"children": [{"name": page, "children": [node]}]}})
    found, errors = design.components(files(spark, f=content))
    assert errors.count() == 0
    out = {}
    for r in design.tags(found).collect():
        out.setdefault(r.id, set()).add(r.tag)
    return out


def a_set(definitions=None, children=None, **more):
    return {"id": "s", "name": "Set", "type": "COMPONENT_SET", "componentPropertyDefinitions": definitions, "children": children, **more}


def variant(*options, preset=None):
    return {"type": "VARIANT", "variantOptions": list(options), **({"defaultValue": preset} if preset else {})}


@pytest.mark.parametrize(
    ("definitions", "children", "has", "not_"),
    [
        ({"A": variant("true", "false")}, None, {"boolean-variant-antipattern"}, {"orphan-variant-definitions", "incomplete-variant-matrix"}),
        ({"A": variant("x", "y")}, [], {"empty-component-set", "incomplete-variant-matrix", "orphan-variant-definitions"}, {"single-variant"}),
        ({"A": variant("x", "y")}, ["A=x", "A=Y"], {"variant-value-case-mismatch"}, {"undefined-variant-values", "orphan-variant-definitions", "incomplete-variant-matrix"}),
        ({"A": variant("x", "y")}, ["A=x", "A=y", "a=z"], {"naming-inconsistency"}, {"undefined-variant-property", "undefined-variant-values"}),
        ({"A": variant("x", "y")}, ["A=x", "A=y", "B=z"], {"undefined-variant-property"}, {"naming-inconsistency"}),
        ({"Size": variant("small", "medium", "large")}, ["Size=small"], {"size-progression", "variant-complexity:3", "single-variant"}, {"unordered-size-variants"}),
        ({"Scale": variant("lg", "sm", "foo")}, ["Scale=lg"], {"unordered-size-variants"}, {"size-progression"}),
        ({"T": variant("Success", "ERROR"), "U": variant("ghost", "solid")}, None, {"semantic-state-variants", "semantic-hierarchy-variants"}, {"variant-value-inconsistency"}),
        ({"T": variant("sm", "md"), "U": variant("Large Thing", "Small")}, None, {"variant-value-inconsistency"}, {"mixed-naming-convention"}),
        ({"Tone": variant("a"), "size-of": variant("b")}, ["x", "y"], {"mixed-naming-convention", "single-variant"}, {"excessive-variants"}),
        ({n: variant("a", "b") for n in "ABCDE"}, None, {"excessive-variants", "variant-complexity:32"}, {"single-variant"}),
        ({"N": variant("1", "2", "three", "four")}, None, {"numeric-variant-values"}, set()),
        ({"N": variant("1", "two", "three")}, None, set(), {"numeric-variant-values"}),
        ({"is on": {"type": "BOOLEAN"}, "visible": {"type": "BOOLEAN"}}, None, {"inconsistent-boolean-naming", "visibility-toggles:1"}, set()),
        ({"Show a": {"type": "BOOLEAN"}, "show b": {"type": "BOOLEAN"}, "Key": {"type": "TEXT"}}, None, {"visibility-toggles:2", "reserved-property-name"}, {"inconsistent-boolean-naming"}),
        ({"V": variant("a|b"), "W": variant("c", preset="c")}, None, {"special-char-variant-values", "default-variant:W=c", "variant-dimension:V[1]"}, set()),
        (None, None, {"component-set", "empty-component-set"}, {"variant-complexity:1"}),
    ],
)
def test_tags_of_sets(spark, definitions, children, has, not_):
    nodes = None if children is None else [{"id": f"c{i}", "name": n, "type": "COMPONENT"} for i, n in enumerate(children)]
    got = tags_of(spark, a_set(definitions, nodes))["s"]
    assert has <= got and not got & not_


def test_tags_of_places_and_descriptions(spark):
    inner = {"id": "c", "name": "old-thing", "type": "COMPONENT"}
    frame = {"name": "F", "type": "FRAME", "children": [{"name": "G", "type": "GROUP", "children": [inner, {"id": "p", "name": "Placeholder", "type": "COMPONENT", "boundVariables": {"x": 1}}]}]}
    got = tags_of(spark, frame, {"c": {"key": "k", "description": "", "remote": False}, "p": {"description": "Do not use."}})
    assert got["c"] == {"deprecated", "missing-description", "component-key:k", "hierarchy:F/G/old-thing", "depth:3", "containing-frame:G"}
    assert got["p"] == {"deprecated", "slot-component", "uses-variables", "hierarchy:F/G/Placeholder", "depth:3", "containing-frame:G"}


# One scan for all styles.
def test_all_signals_come_from_one_scan(spark, tmp_path):
    content = {"a.tsx": "<p style={{ color: '#fff', padding: 4 }} />", "b.vue": "<b :style=\"{ margin: '2px' }\"></b><style>i { gap: 3px }</style>", "c.css": ".x { color: #000 }", "d.svelte": '<u style:top="1px">', "e.html": "<!-- <a style='left: 1px'> -->"}
    files(spark, **content).write.parquet(str(tmp_path / "tree"))
    tree = spark.read.parquet(str(tmp_path / "tree"))
    got = dispatch.signals(tree)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInPandas") == 1
    assert {(r.path, r.type, r.value) for r in got.collect()} == {
        ("a.tsx", "color-value", "#fff"), ("a.tsx", "spacing-value", "4px"), ("b.vue", "spacing-value", "2px"), ("b.vue", "spacing-value", "3px"), ("c.css", "color-value", "#000"), ("d.svelte", "spacing-value", "1px"),
    }


def test_families_go_by_the_ending(spark):
    paths = {"x/a.component.ts": "angular", "a.ts": "jsx", "a.mdx": "jsx", "a.blade.php": "html", "a.less": "css", "css": "html", "b.vue.txt": "html"}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", dispatch.family("path").alias("f")).collect()
    assert {r.path: r.f for r in rows} == paths


# Plugins.
def test_a_plugin_reads_in_parallel(spark):
    p = plugins.Plugin("counted", "2", "n long, part long", detects=("x", "y"), partitions=lambda o: list(range(int(o["parts"]))), scan=lambda part, o: ((n, part) for n in range(3)))
    plugins.install(spark, p)
    df = spark.read.format("counted").option("parts", 5).load()
    assert df.rdd.getNumPartitions() == 5 and df.groupBy("part").count().where("count = 3").count() == 5
    assert plugins.listed([p, plugins.folder()]) == [("counted", "2", "x,y", True, False), ("folder", "1", "", True, True)]
    with pytest.raises(Exception, match="can't be written"):
        df.write.format("counted").mode("append").save()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    plugins.install(spark, plugins.folder("folder-test"))
    schema, root = "a long, b string", str(tmp_path / "out")

    def written():
        return sorted(tuple(r) for r in spark.read.format("folder-test").option("path", root).option("schema", schema).load().collect())

    def write(df):
        df.write.format("folder-test").mode("append").option("path", root).option("schema", schema).save()

    good = spark.range(100).select(F.col("id").alias("a"), F.concat(F.lit("é\n"), F.col("id")).alias("b")).repartition(4)
    assert written() == []
    write(good)
    want = sorted((i, f"é\n{i}") for i in range(100))
    assert written() == want
    bad = good.withColumn("b", F.when(F.col("a") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="lost"):
        write(bad)
    assert written() == want
    write(good.limit(0))
    write(good.where("a < 2"))
    assert written() == sorted(want + want[:2])
