"""Order-dependent operators against plain Python, detectors and sources on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatid.operators import aggregate, compare, detect, filters, graph, grouping, match, tokenize
from chromatid.plans import audit, drift
from chromatid.sinks import reports
from chromatid.sources import components, extract, files, history, markup, tokens_json
from chromatid.streaming import incremental


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_greedy_matching_is_sequential(spark):
    rng = np.random.default_rng(0)
    pairs = [(f"s{i}", f"t{j}", float(rng.integers(70, 76)) / 100, i, j) for i in range(40) for j in range(40) if rng.random() < 0.15]
    got = {(r.source_id, r.target_id) for r in match.greedy(frame(spark, "source_id string, target_id string, score double, source_seq long, target_seq long", *pairs)).collect()}
    free, want = {p[1] for p in pairs}, set()
    for i in range(40):
        mine = [p for p in pairs if p[3] == i and p[1] in free]
        if mine:
            best = max(mine, key=lambda p: (p[2], -p[4]))
            want.add((best[0], best[1]))
            free.discard(best[1])
    assert got == want


def test_exact_before_fuzzy(spark):
    schema = "seq long, id string, name string, props array<string>, variants array<string>, dependencies array<string>"
    s = frame(spark, schema, (1, "a", "Button", ["onClick", "size"], ["lg"], []), (2, "b", "Card", [], [], []), (3, "c", "button-component", [], [], []))
    t = frame(spark, schema, (1, "x", "BUTTON", ["onClick", "size"], ["lg"], []), (2, "y", "Buttons", ["onClick", "size"], ["lg"], []))
    assert [tuple(r) for r in match.exact_components(s, t).collect()] == [("a", "x")]
    found = match.fuzzy_components(s.where("id = 'a'"), t.where("id = 'y'")).first()
    assert (found.source_id, found.target_id, found.kind) == ("a", "y", "partial") and found.score == pytest.approx(0.4 * (1 - 1 / 7) + 0.5)
    assert match.fuzzy_components(s.where("id = 'b'"), t).count() == 0


def test_groups_take_turns(spark):
    schema = "seq long, id string, type string, severity string, entity_id string, location string, actual string, token_suggestions array<string>"
    rows = [(i, f"v{i}", "hardcoded-value", "warning", "e", "a/b.tsx", "#fff", []) for i in range(3)]
    rows += [(10 + i, f"t{i}", "x", "info", f"e{i}", None, None, ["#fff → white (90%)"]) for i in range(2)]
    rows += [(20 + i, f"p{i}", "x", "critical", f"q{i}", f"dir/{i}.tsx", None, []) for i in range(2)] + [(30, "z", "x", "info", "alone", None, None, [])]
    a = grouping.assign(frame(spark, schema, *rows))
    got = {(r.strategy, r.key): (r.n, r.critical, r.warning, r.info) for r in grouping.groups(a).collect()}
    assert got == {("value", "value:#fff"): (3, 0, 3, 0), ("suggestion", "suggestion:white"): (2, 0, 0, 2), ("path", "path:dir"): (2, 2, 0, 0)}
    assert grouping.reduction(a).first().asDict() == {"signals": 8, "groups": 3, "ungrouped": 1, "ratio": 2.0}
    assert grouping.reduction(a.limit(0)).first().ratio == 1.0
    own = grouping.assign(frame(spark, schema, *rows), strategies={"type": F.col("type")})
    assert {r.strategy for r in own.collect()} == {"type"}
    assert {r.key for r in grouping.assign(frame(spark, schema, *rows), strategies={"path": grouping.keys(["a/**"])["path"]}).where("strategy is not null").collect()} == {"path:a/**", "path:dir"}


def color_clusters(values):
    rgb = lambda c: [int(c[i : i + 2], 16) for i in (1, 3, 5)]
    n, seen = {}, {}
    for k, v in enumerate(values):
        n[v] = n.get(v, 0) + 1
        seen.setdefault(v, k)
    found = []
    for c in sorted(n, key=lambda c: (-n[c], seen[c])):
        near = next((f for f in found if sum((a - b) ** 2 for a, b in zip(rgb(c), rgb(f[0]))) ** 0.5 < 50), None)
        if near:
            near[1] += n[c]
        else:
            found.append([c, n[c]])
    return sorted(found, key=lambda f: -f[1])


def size_clusters(px):
    n = {}
    for p in px:
        n[p] = n.get(p, 0) + 1
    found = []
    for p in sorted(n):
        near = next((f for f in found if p and f[0] and abs(p - f[0]) <= 2), None)
        if near:
            near[0] = p if n[p] > near[1] else near[0]
            near[1] += n[p]
        else:
            found.append([p, n[p]])
    return found


def test_clustering_is_sequential(spark):
    rng = np.random.default_rng(2)
    values = [f"#{int(x):06x}" for x in rng.integers(0, 1 << 24, 60)] * 2 + [f"#{int(x):02x}0000" for x in rng.integers(0, 255, 60)]
    df = frame(spark, "scope string, value string, seq long", *[("a", v, k) for k, v in enumerate(values)])
    got = [[r.representative, r.n] for r in tokenize.color_clusters(df).orderBy("cluster").collect()]
    assert got == color_clusters(values)
    px = [int(x) for x in rng.integers(0, 40, 80)] + [0, 0]
    sizes = frame(spark, "scope string, value string", *[("a", f"{p}px") for p in px])
    clusters = tokenize.size_clusters(sizes)
    assert sorted([r.value, r.n] for r in clusters.collect()) == sorted(size_clusters(px))
    tokens = tokenize.size_tokens(clusters)
    named = [r for r in tokens.collect() if not r.orphan]
    assert len(named) <= 10 and sum(r.n for r in tokens.collect()) == len(px)
    radii = {r.name: r.value for r in tokenize.radius_tokens(clusters).collect()}
    assert radii["radius-none"] == "0" and radii["radius-full"] == "9999px"
    share = tokenize.coverage(tokens, sizes).first()
    assert share.input == len(px) and share.covered == sum(r.n for r in named) and 0 <= share.percent <= 100


def test_color_names(spark):
    rows = [("a", v, k) for k, v in enumerate(["#ff0000"] * 5 + ["#00ff00"] * 4 + ["#0000ff"] * 3 + ["#ffff00"] * 2 + ["#ffffff", "#000000"])]
    got = {r.name: r.value for r in tokenize.color_tokens(tokenize.color_clusters(frame(spark, "scope string, value string, seq long", *rows))).collect()}
    assert got == {"color-primary-500": "#ff0000", "color-secondary-500": "#00ff00", "color-orphan-1": "#0000ff", "color-accent-1": "#ffff00", "color-neutral-50": "#ffffff", "color-neutral-100": "#000000"}


def test_palette_keeps_its_distance(spark):
    rows = [("a", v, k) for k, v in enumerate(["#101010"] * 3 + ["#111111"] * 2 + ["#ffffff"])]
    assert [r.color for r in tokenize.palette(frame(spark, "scope string, value string, seq long", *rows)).orderBy("rank").collect()] == ["#101010", "#ffffff"]


def test_health(spark):
    schema = "category string, value string, file string"
    assert aggregate.health(frame(spark, schema)).first().score == 100
    v = frame(spark, schema, ("color", "#3b82f6", "Button"), ("color", "#3b82f6", "Card"), ("color", "#ef4444", "Alert"), ("spacing", "16px", "Button"), ("spacing", "8px", "Card"))
    assert aggregate.health(v).first().asDict() == {"unique_values": 4, "total_usages": 5, "files_affected": 3, "score": 85}
    assert aggregate.health(v, frame(spark, "value string", ("x",))).first().score == 80


def test_filters(spark):
    s = frame(spark, "seq long, id string, type string, severity string, entity_name string, location string", (1, "a", "t", "info", "A", "src/a.ts:3"), (2, "b", "u", "critical", "B", None), (3, "a", "t", "warning", None, "src/b.ts:1:2"))
    assert [r.id for r in filters.min_severity(s, "warning").collect()] == ["b", "a"]
    assert filters.ignore(s, [("t", "A"), ("u", "[")]).count() == 2
    assert filters.new_since(s, frame(spark, "id string", ("a",))).count() == 1
    assert {r.seq for r in filters.staged(s, frame(spark, "path string", ("a.ts",))).collect()} == {1, 2}
    assert [r.seq for r in filters.by_severity(s).collect()] == [2, 3, 1]
    assert filters.any_at_least(s, "critical").first().exceeds
    assert drift.verdict(s, drift.Options(kind="t"), "critical").first().exit_code == 0
    assert drift.verdict(s, drift.Options(kind="t"), "critical", max_drift=1).first().exit_code == 1
    paths = frame(spark, "path string", ("src/a/b.ts",), ("lib/a.js",))
    assert [r.path for r in paths.where(filters.matches_globs(F.col("path"), ["src"], ["*.js"])).collect()] == ["src/a/b.ts"]
    intents = frame(spark, "drift_id string, status string, expires_at timestamp", ("b", "active", None), ("a", "resolved", None))
    assert [r.id for r in filters.active_intents(s, intents, F.current_timestamp()).collect()] == ["b"]


def test_detectors(spark):
    c = frame(spark, "seq long, id string, name string, deprecated boolean, reason string, props array<string>, issues array<string>", (1, "1", "IconButton", True, "old", ["size"], ["no label"]), (2, "2", "Link", False, None, ["aria-label"], ["x"]))
    assert [(r.type, r.severity, r.detail) for r in detect.deprecated(c).collect()] == [("deprecated-pattern", "warning", "old")]
    assert [(r.entity_id, r.detail) for r in detect.accessibility(c).collect()] == [("1", "no label")]
    props = frame(spark, "component string, prop string, type string, seq long", *[(f"c{i}", "onClick", "fn", i) for i in range(8)], ("z", "pressMe", "fn", 9), ("y", "onClick", "string", 10))
    assert [r.entity_id for r in detect.handlers(props).collect()] == ["z"]
    assert [(r.entity_id, r.detail) for r in detect.prop_types(props).collect()] == [("y", "fn")]
    styles = frame(spark, "component string, property string, value string", ("A", "color", "#777"), ("A", "background", "white"), ("B", "color", "black"), ("B", "background-color", "#fff"))
    assert [r.entity_id for r in detect.contrast(styles).collect()] == ["A"]
    n = frame(spark, "seq long, id string, name string", (1, "a", "Card"), (2, "b", "CardNew"), (3, "c", "CardGroup"))
    assert [r.detail for r in detect.duplicates(n).collect()] == ["a, b"]
    occurrences = frame(spark, "classes string, file string, line int", ("a b", "x", 1), ("b a", "y", 1), ("b  a", "y", 2), ("c", "x", 1))
    assert [r.entity_name for r in detect.repeated_patterns(occurrences).collect()] == ["a b"]
    v = frame(spark, "name string, id string, prop string, type string, seq long", ("B", "1", "size", "string", 1), ("B", "2", "size", "number", 2), ("B", "2", "icon", "node", 3))
    assert {(r.prop, r.difference) for r in detect.variant_divergence(v).collect()} == {("size", "prop-type"), ("icon", "prop-missing")}
    e = frame(spark, "name string, context string", ("A", "production"), ("a", "example"), ("B", "production"), ("C", "example"))
    assert detect.example_coverage(e).first().asDict() == {"with_example": 1, "without_example": 1, "example_only": 1, "percent": 50}
    side = lambda *x: frame(spark, "id string, name string, seq long", *x)
    assert {(r.entity_id, r.severity) for r in detect.orphaned(side(("1", "A", 1), ("2", "B", 2)), side(("3", "a", 1), ("4", "C", 2))).collect()} == {("2", "warning"), ("4", "info")}


def test_graph(spark):
    nodes = frame(spark, "seq long, id string, type string, name string, author string, timestamp timestamp, deprecated boolean", (1, "t1", "Token", "x", None, None, False), (2, "t2", "Token", "_y", None, None, False), (3, "c1", "Component", "C", None, None, None), (4, "t1", "Token", "later", None, None, False))
    edges = frame(spark, "seq long, id string, type string, src string, dst string", (1, "e1", "USES", "c1", "t2"), (2, "e1", "USES", "c1", "t2"), (3, "e2", "USES", "c1", "gone"), (4, "e3", "USES", "c1", "c1"), (5, "e4", "TESTED_BY", "c1", "t1"))
    n, e = graph.build(nodes, edges)
    assert n.count() == 3 and {r.id for r in e.collect()} == {"e1", "e4"} and n.where("id = 't1'").first().name == "x"
    assert [r.id for r in graph.without_in(n, e, "Token", "USES").collect()] == ["t1"]
    assert graph.coverage(n, e).first().asDict() == {"token_coverage": 0.5, "test_coverage": 1.0, "story_coverage": 0.0, "component_coverage": 1.0}
    assert [(r.id, r.n) for r in graph.deprecated_usages(n, e).collect()] == [("t2", 1)]
    assert graph.dot(n, e).count() == 5 and "source" in graph.cytoscape(n, e).where("element like '%source%'").first().element
    chain = frame(spark, "type string, src long, dst long", *[("IMPORTS", k + 1, k) for k in range(9)])
    assert {r.distance for r in graph.impact(chain, frame(spark, "id long", (0,))).collect()} == {1, 2, 3, 4}


def test_snapshots(spark):
    a, b = frame(spark, "id long, x string", (1, "a"), (2, None), (3, "c")), frame(spark, "id long, x string", (2, None), (3, "d"), (4, "e"))
    assert {(r.id, r.change) for r in compare.diff(a, b, ["x"]).collect()} == {(1, "removed"), (3, "modified"), (4, "added")}
    d, c = frame(spark, "name string", ("A-b",), ("C",)), frame(spark, "name string", ("ab",), ("D",))
    assert {(r.key, r.side) for r in compare.name_report(d, c).collect()} == {("ab", "matched"), ("c", "design only"), ("d", "code only")}


TS = """import React, { useState as us } from 'react';
import * as path from "path";
import './side.css';
export { Button } from './button';
export * from './all';
const lazy = import('./lazy');
const req = require('lodash/get');
// const x = '#123456';
const c = '#ff0000'; /* #00ff00 */
export function Panel() { useEffect(() => {}); return <Card.Header size="lg" onClick={go} key="k"><PanelItem/></Card.Header>; }
function PanelItem() {}
function PanelHeader() {}
const s = 'p-[13px] bg-[#fff] text-[14px]';
"""


def test_sources(spark):
    f = frame(spark, "path string, content string, mtime double", ("src/a.tsx", TS, 5.0), ("src/button.tsx", "x", 5.0), ("src/all/index.ts", "", 5.0), ("node_modules/x.ts", "", 1.0), ("src/a.test.tsx", "", 1.0))
    assert {r.path for r in files.discover(f, ["**/*.ts", "**/*.tsx"], files.excludes()).collect()} == {"src/a.tsx", "src/button.tsx", "src/all/index.ts"}
    assert {r.path for r in files.discover(f, ["**/*.ts*"], files.excludes(["**/button*"])).collect()} == {"src/a.tsx", "src/all/index.ts", "src/a.test.tsx"}
    assert {(r.pattern, r.n) for r in files.pattern_stats(f, ["src/**", "*.css"]).collect()} == {("src/**", 4), ("*.css", 0)}
    assert {r.code for r in files.scan_warnings(f, ["*.css"]).collect()} == {"PATTERN_NO_MATCH"}
    edges = extract.imports(f)
    got = {(r.kind, r.module, tuple(r.names), r.external) for r in edges.collect()}
    assert got == {
        ("mixed", "react", ("React", "useState"), True), ("namespace", "path", ("path",), True), ("side-effect", "./side.css", (), False), ("re-export", "./button", ("Button",), False),
        ("re-export-all", "./all", (), False), ("dynamic", "./lazy", (), False), ("require", "lodash/get", (), True),
    }
    assert {(r.module, r.target) for r in extract.resolve(edges, f).collect()} == {("./button", "src/button.tsx"), ("./all", "src/all/index.ts")}
    assert {(r.package, r.n) for r in extract.packages(edges).collect()} == {("react", 1), ("path", 1), ("lodash", 1)}
    assert {(r.kind, r.name, r.line) for r in extract.usages(f).where("kind = 'hex'").collect()} == {("hex", "#ff0000", 9), ("hex", "#fff", 13)}
    c = components.declared(f, "react")
    assert {r.name for r in c.collect()} == {"Panel", "PanelItem", "PanelHeader"}
    assert {(r.root, r.member) for r in components.compounds(c).collect()} == {("Panel", "PanelItem"), ("Panel", "PanelHeader")}
    assert {(r.component, r.prop) for r in components.jsx_props(f).collect()} == {("Card.Header", "size"), ("Card.Header", "onClick")}
    assert [(r.hook, r.n) for r in components.hooks(f).collect()] == [("useEffect", 1)]
    cache = frame(spark, "path string, cached_mtime double, result string", ("src/a.tsx", 9.0, "[]"), ("src/button.tsx", 1.0, "old"), ("src/all/index.ts", 9.0, "x"))
    split = {r.path: (r.hit, r.result) for r in files.cache_split(f, cache, frame(spark, "path string", ("src/all/index.ts",))).collect()}
    assert split["src/a.tsx"] == (True, "[]") and split["src/button.tsx"] == (False, None) and split["src/all/index.ts"] == (False, None) and split["node_modules/x.ts"] == (False, None)
    merged = files.merge_cache(cache, frame(spark, "path string, cached_mtime double, result string", ("src/a.tsx", 10.0, "new")))
    assert merged.count() == 3 and merged.where("path = 'src/a.tsx'").first().result == "new"


CSS = """:root { --brand: #3b82f6; }
@media (min-width: 768px) and (max-width: 64rem) { .a { color: #FFF; background: rgb(1, 2, 3) } }
.b { margin: 4px 8px; padding: var(--x); width: calc(1px + 2px); border-radius: 0; color: red; font-size: 12px; display: flex }
"""


def test_css_and_audit(spark):
    f = frame(spark, "path string, content string", ("a.css", CSS), ("p.html", "<style>p{margin:0}</style><!-- <p style='x'> --><p style=\"color: #abc\">x</p><script>var a='style=\"color:#000\"'</script>"))
    got = {(r.file, r.category, r.value) for r in audit.values(f).collect()}
    assert got == {
        ("a.css", "breakpoint", "768px"), ("a.css", "breakpoint", "64rem"), ("a.css", "color", "#fff"), ("a.css", "color", "rgb(1,2,3)"), ("a.css", "spacing", "4px"), ("a.css", "spacing", "8px"),
        ("a.css", "radius", "0"), ("a.css", "color", "red"), ("a.css", "typography", "12px"), ("p.html", "spacing", "0"), ("p.html", "color", "#abc"),
        ("a.css", "spacing", "768px"), ("a.css", "spacing", "64rem"),  # the media query's own widths read as declarations, too
    }
    assert audit.report(f).first().unique_values > 5
    assert {"breakpoint-xs", "breakpoint-sm"} <= {r.name for r in audit.vocabulary(f).collect()}
    assert [(r.name, r.value) for r in extract.css_variables(f).collect()] == [("--brand", "#3b82f6")]
    assert ":root" in tokenize.css(audit.vocabulary(f)).first().css


def test_token_files(spark):
    trees = {
        "dtcg": {"color": {"$type": "color", "brand": {"$value": "#fff", "$description": "d"}, "deep": {"er": {"$value": "#000"}}}},
        "tokens-studio": {"space": {"sm": {"value": "4px", "type": "spacing"}}},
        "style-dictionary": {"size": {"font": {"base": {"value": 16}}}},
    }
    f = frame(spark, "path string, content string", *[(k, json.dumps(t)) for k, t in trees.items()], ("bad", "{"))
    tokens, errors = tokens_json.read(f)
    got = {(r.path, r.name, r.value, r.category, r.format) for r in tokens.collect()}
    assert got == {
        ("dtcg", "color.brand", "#fff", "color", "dtcg"), ("dtcg", "color.deep.er", "#000", "color", "dtcg"), ("tokens-studio", "space.sm", "4px", "spacing", "tokens-studio"),
        ("style-dictionary", "size.font.base", "16", "typography", "style-dictionary"),
    }
    assert [r.path for r in errors.collect()] == ["bad"]


def test_history(spark):
    import datetime as dt

    c = frame(spark, "sha string, author string, email string, timestamp timestamp", ("1", "Ann", "A@x", dt.datetime(2024, 1, 1)), ("2", "ann", "a@x", dt.datetime(2024, 3, 1)), ("3", "Bob", "b@x", dt.datetime(2023, 1, 1)))
    people = history.developers(c)
    assert {(r.email, r.name, r.commits) for r in people.collect()} == {("a@x", "Ann", 2), ("b@x", "Bob", 1)}
    assert [r.email for r in history.active_since(people, c, F.lit(dt.datetime(2024, 3, 5))).collect()] == ["a@x"]
    changes = frame(spark, "sha string, path string, insertions int, deletions int", ("1", "src/tokens/a.ts", 3, 0), ("2", "README", 1, 1), ("3", "x.css", 0, 2))
    assert {r.sha for r in history.design_history(c, changes).collect()} == {"1", "3"}
    assert [r.sha for r in history.file_history(c, changes, "README").collect()] == ["2"]
    assert {r.s for r in changes.select(history.change_status(F.col("insertions"), F.col("deletions")).alias("s")).collect()} == {"added", "modified", "deleted"}


def test_fixes_are_applied_from_the_right(spark):
    lines = frame(spark, "path string, line int, text string", ("a", 1, "color: #fff; background: #fff;"), ("a", 2, "nothing"))
    fixes = frame(spark, "path string, line int, column int, original string, replacement string", ("a", 1, 8, "#fff", "var(--w)"), ("a", 1, 26, "#fff", "var(--bg)"), ("a", 2, 1, "#000", "x"))
    assert [r.text for r in reports.apply_fixes(lines, fixes).orderBy("line").collect()] == ["color: var(--w); background: var(--bg);", "nothing"]


def test_stories_and_inheritance(spark):
    s = frame(spark, "seq long, id string, title string, name string, type string", (1, "a--x", "UI/Button", "Primary", "story"), (2, "a--y", "UI/Button", "Large", None), (3, "a--d", "UI/Button", "Docs", "docs"))
    assert [(r.key, r.id, r.stories) for r in components.story_index(s).collect()] == [("ui-button", "a--x", ["Primary", "Large"])]
    c = frame(spark, "seq long, name string, extends string, props array<string>", (1, "Base", None, ["a"]), (2, "Child", "Base", []), (3, "Own", "Base", ["b"]))
    assert {r.name: r.props for r in components.inherit_props(c).collect()} == {"Base": ["a"], "Child": ["a"], "Own": ["b"]}


def test_streams(spark, tmp_path):
    import datetime as dt

    source = str(tmp_path / "in")
    schema = "id string, type string, severity string, detected_at timestamp"
    rows = [("a", "t", "info", dt.datetime(2024, 1, 1, 5)), ("a", "t", "info", dt.datetime(2024, 1, 1, 5)), ("b", "t", "info", dt.datetime(2024, 1, 2, 5))]
    frame(spark, schema, *rows).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    seen = []
    baseline = frame(spark, "id string", ("b",))
    for df, mode, sink in (
        (incremental.deduplicated(stream), "append", lambda batch, at: seen.extend(r.id for r in batch.collect())),
        (stream, "append", incremental.new_against(baseline, lambda batch, at: seen.extend("new " + r.id for r in batch.collect()))),
        (incremental.daily_counts(stream), "complete", lambda batch, at: seen.extend((str(r.day), r.n) for r in batch.collect())),
    ):
        q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"c{len(seen)}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(x for x in seen if isinstance(x, str)) == ["a", "b", "new a", "new a"]
    assert {x for x in seen if isinstance(x, tuple)} >= {("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)}


def test_styles(spark):
    from chromatid.operators import styles

    o = frame(spark, "classes string, file string, line int", ("hover:a  hover:b flex bg-primary", "x", 1), ("hover:a hover:b text-primary/50", "y", 1), ("bg-primary hover:bg-muted-foreground flex items-center justify-between", "y", 2))
    assert {(r.kind, r.pattern, r.n, r.files) for r in styles.extractable(o).collect()} == {("hover-effect", "hover:a hover:b", 2, 2)}
    got = {r.token: (r.n, r.files, r.examples) for r in styles.semantic_tokens(o).collect()}
    assert got == {"primary": (3, 2, ["bg-primary", "text-primary/50"]), "muted-foreground": (1, 1, ["hover:bg-muted-foreground"])}
    f = frame(spark, "path string, content string", ("t.ts", "export const getSpacing = n => theme.spacing(n)"), ("a.ts", "getSpacing(2); colors('x')"))
    assert {(r.name, r.category, r.path) for r in styles.utilities(f).collect()} == {("getSpacing", "spacing", "a.ts"), ("theme.spacing", "spacing", "t.ts"), ("spacing()", "spacing", "t.ts"), ("colors()", "color", "a.ts")}
    v = frame(spark, "component string, kind string, property string, value string", ("A", "color", "fill", "#fff"), ("A", "fontSize", "font", "12px"), ("B", "shadow", "s", "x"), ("B", "other", "o", "y"))
    assert {(r.entity_id, r.detail) for r in styles.utility_signals(v, styles.utilities(f)).collect()} == {("A", "colors()"), ("A", "getSpacing or spacing() or theme.spacing")}
    assert {(r.category, r.n) for r in styles.utility_summary(v).collect()} == {("color", 1), ("spacing", 1), ("shadow", 1)}
    a = markup.arbitrary_values(frame(spark, "path string, content string", ("p.tsx", "p-[3px] m-[4px]\nbg-[#abc]")))
    assert {(r.entity_id, r.severity, r.location, r.detail) for r in styles.arbitrary_signals(a).collect()} == {("p.tsx", "info", "p.tsx:1", "m-[4px] p-[3px]"), ("p.tsx", "warning", "p.tsx:2", "bg-[#abc]")}
    values = frame(spark, "category string, value string", ("color", "#fff"), ("color", "white"), ("spacing", "4px"), ("font-family", "Arial"))
    one = styles.css_summary(values, frame(spark, "value string", ("var(--x)",), ("#fff",))).first()
    assert (one.unique_colors, one.unique_spacing, one.unique_fonts, one.declarations, one.tokenization) == (1, 1, 1, 2, 25)


def test_searches(spark):
    from chromatid.operators import search

    c = frame(spark, "id string, name string, props array<string>, variants array<string>, context string", ("1", "IconButton", ["onClick", "size"], ["Large"], "production"), ("2", "Card", ["buttonLabel"], [], "production"), ("3", "card", ["BUTTONLABEL", "Extra"], [], "example"))
    assert {(r.id, r.score) for r in search.by_name(c, "button").collect()} == {("1", 100.0)}
    assert {(r.id, r.score) for r in search.by_prop(c, "size").collect()} == {("1", 100.0)}
    assert {(r.id, r.score) for r in search.by_prop(c, "button").collect()} == {("2", 80.0), ("3", 80.0)}
    assert {(r.id, r.score) for r in search.by_pattern(c, "large").collect()} == set() and {r.id for r in search.by_pattern(c, "button").collect()} == {"1", "2", "3"}
    assert [(r.id, r.missing) for r in search.example_only(c).collect()] == [("2", ["extra"])]
    t = frame(spark, "id string, name string, hex string, category string", ("a", "primary", "#ff0000", "Color"), ("b", "primari", "#00ff00", "spacing"))
    assert {r.id for r in search.tokens_by_name(t, "primary").collect()} == {"a", "b"} and [r.id for r in search.tokens_by_color(t, "fe0000").collect()] == ["a"]
    assert [r.id for r in search.tokens_by_category(t, "color").collect()] == ["a"]
    i = frame(spark, "path string, module string", ("x.ts", "./ui/button"), ("y.ts", "../button"), ("z.ts", "./mybutton"))
    assert {(r.path, r.target) for r in search.importers(i, frame(spark, "target string", ("src/ui/button.tsx",))).collect()} == {("x.ts", "src/ui/button.tsx"), ("y.ts", "src/ui/button.tsx")}
    p = frame(spark, "path string", ("src/examples/a.tsx",), ("src/a.test.tsx",), ("src/a.tsx",), (None,))
    assert [r.c for r in p.select(search.component_context(F.col("path")).alias("c")).collect()] == ["example", "test", "production", "unknown"]
    v = frame(spark, "id string, name string, options array<array<string>>, children int", ("1", "B/Large", [["a", "b"], ["c", "d", "e"]], 5), ("2", "B/Small", [["a"]], 1))
    assert {(r.id, r.expected, r.incomplete, r.excessive) for r in search.variant_matrix(v).collect()} == {("1", 6, True, False), ("2", 1, False, False)}
    assert [(r.parent, r.n) for r in search.potential_variants(v).collect()] == [("B", 2)]
    s = frame(spark, "o array<string>", (["sm", "md", "lg"],), (["lg", "sm"],), (["x"],))
    assert [r.ok for r in s.select(search.sizes_in_order(F.col("o")).alias("ok")).collect()] == [True, False, True]


def test_nodes_on_cycles_of_any_length(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(52)} | {(100 + i, 100 + (i + 1) % 11) for i in range(11)} | {(39, 105), (107, 200), (200, 201), (300, 300)}
    nodes = {x for p in pairs for x in p}
    reach = {x: {b for a, b in pairs if a == x} for x in nodes}
    for k in nodes:
        for x in nodes:
            if k in reach[x]:
                reach[x] |= reach[k]
    want = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in nodes if x in reach[x]}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = graph.cycle_nodes(edges).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want) and want[110] == 100
    assert graph.cycle_nodes(edges.where("src between 100 and 109")).count() == 0


def test_greedy_settles_lines_of_any_length(spark):
    rows = [(f"s{i:05}", f"t{j:05}", 1.0 - 0.1 * (j != i - 1), i, j) for i in range(1, 1202) for j in (i - 1, i)]
    df = frame(spark, "source_id string, target_id string, score double, source_seq long, target_seq long", *rows)
    got = {r.source_id: r.target_id for r in match.greedy(df).collect()}
    assert got == {f"s{i:05}": f"t{i - 1:05}" for i in range(1, 1202)}
    waits = [(f"s{i}", f"t{j}", 1.0 if j == 0 else 0.9 - 0.001 * j, i, j) for i in range(6) for j in range(6)]
    df = frame(spark, "source_id string, target_id string, score double, source_seq long, target_seq long", *waits)
    want = {f"s{i}": f"t{i}" for i in range(6)}
    for alone in (0, 4, 1000):
        assert {r.source_id: r.target_id for r in match.greedy(df, alone).collect()} == want


def test_color_search_writes_the_wanted_rows_only(spark, monkeypatch):
    written = []
    real = match.durable
    monkeypatch.setattr(match, "durable", lambda df: (lambda out: (written.append(out), out)[1])(real(df)))
    values = spark.range(300).select(F.concat(F.lit("#8080"), F.lpad(F.lower(F.hex(F.col("id") % 60)), 2, "0")).alias("value"))
    tokens = spark.range(2000).select(F.concat(F.lit("t"), F.lpad("id", 4, "0")).alias("token"), F.concat(F.lit("#80"), F.lpad(F.lower(F.hex(F.col("id") % 200)), 2, "0"), F.lit("20")).alias("hex"))
    got = match.color_suggestions(values, tokens).collect()
    assert len(got) == 180 and {r["rank"] for r in got} == {1, 2, 3}
    assert max(x.count() for x in written if "_nth" in x.columns) <= 3 * 60


def test_color_clusters_are_the_same_whatever_the_step(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), f"#{rng.randrange(1 << 24):06x}" if rng.random() < 0.95 else "no color", i) for i in range(700)] + [("a", "#ffffff", 9)] * 4
    df = frame(spark, "scope string, value string, seq long", *rows)
    want = None
    for step in (3, 50, 1024):
        got = sorted((str(r.scope), r.cluster, r.representative, r.n, tuple(r.members)) for r in tokenize.color_clusters(df, step=step).collect())
        want = want or got
        assert got == want and sum(r[3] for r in got) == len(rows)
