"""Style, routes, stories and design files in source text."""

import json

from chromatid.operators import search
from chromatid.sources import markup

TSX = """<div className="md:hover:p-[13px] bg-[#fff]/50 -mt-[4px] w-(--side) [color:red] text-[14px] text-[color:var(--x)] p-[13px] p-[13px]" style={{ color: '#abc', fontSize: 12, marginTop: "4px" }}>
<p [style.width.px]="20" [ngStyle]="{'background-color': '#000'}" className={`btn-${size} flex`} />
const c = cn('flex gap-2', active && 'bg-primary', cva("x", { a: "y" }))
<a class="data-[state=open]:p-1 aria-checked:m-1 group-hover:x peer-focus:y">
.card { @apply flex  p-2; }
"""


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_utility_classes(spark):
    f = frame(spark, ("a.tsx", TSX))
    got = {(r.full_class, r.utility, r.value, r.kind) for r in markup.arbitrary_values(f).collect()}
    assert got == {
        ("md:hover:p-[13px]", "p", "13px", "spacing"), ("bg-[#fff]/50", "bg", "#fff", "color"), ("-mt-[4px]", "mt", "4px", "spacing"), ("w-(--side)", "w", "--side", "size"),
        ("[color:red]", "", "color:red", "css-property"), ("text-[14px]", "text", "14px", "typography"), ("text-[color:var(--x)]", "text", "var(--x)", "color"), ("p-[13px]", "p", "13px", "spacing"),
    }
    assert [(r.line, r.classes) for r in markup.apply_directives(f).collect()] == [(5, "flex  p-2")]
    assert {(r.helper, r["class"]) for r in markup.static_classes(f).collect()} >= {("cn", "flex"), ("cn", "gap-2"), ("cn", "bg-primary")}
    assert [r.pattern for r in markup.dynamic_classes(f).collect()] == ["btn-* flex"]
    assert {(r.kind, r.state) for r in markup.state_classes(f).collect()} == {("data", "state=open"), ("aria", "checked"), ("group", "hover"), ("peer", "focus")}


def test_styles_and_classes_over_several_lines(spark):
    code = """<div
  style={{
    color: '#abc', // don't: '1'
    ...(on ? { padding: 8 } : {}),
    margin: 4,
  }}
  className={`btn-${on ? `x-${y}` : "}"}
    flex`}
/>
.a { @apply flex
    p-2; }"""
    f = frame(spark, ("a.tsx", code), ("b.tsx", "style={{ color: 'red'"), ("c.tsx", None))
    assert {(r.line, r.property, r.value) for r in markup.inline_styles(f).collect()} == {(2, "color", "#abc"), (2, "padding", "8px"), (2, "margin", "4px")}
    assert [(r.line, r.pattern) for r in markup.dynamic_classes(f).collect()] == [(7, "btn-* flex")]
    assert [(r.line, r.classes) for r in markup.apply_directives(f).collect()] == [(10, "flex p-2")]


def test_inline_styles_and_signals(spark):
    s = markup.inline_styles(frame(spark, ("a.tsx", TSX)))
    got = {(r.line, r.property, r.value) for r in s.collect()}
    assert got == {(1, "color", "#abc"), (1, "font-size", "12px"), (1, "margin-top", "4px"), (2, "width", "20px"), (2, "background-color", "#000")}
    signals = markup.raw_signals(s.unionByName(s))
    assert {(r.type, r.value) for r in signals.collect()} == {("color-value", "#abc"), ("font-size", "12px"), ("spacing-value", "4px"), ("spacing-value", "20px"), ("color-value", "#000")}
    assert {(r.type, r.n) for r in markup.signal_stats(signals).collect()} == {("color-value", 2), ("font-size", 1), ("spacing-value", 2)}
    odd = spark.createDataFrame([("a", 1, "fontFamily", "Arial"), ("a", 1, "zIndex", "3"), ("a", 1, "whatever", "#fff"), ("a", 1, "color", "var(--x)")], "path string, line int, property string, value string")
    assert {(r.type, r.value) for r in markup.raw_signals(odd).collect()} == {("font-family", "Arial"), ("color-value", "#fff")}
    assert {(r.type, r.value) for r in markup.raw_signals(odd, normalized=False).collect()} == {("color-value", "#fff")}


def test_routes_stories_templates(spark):
    f = frame(
        spark, ("src/app/(shop)/cart/[...slug]/page.tsx", "'use client';\nx"), ("src/app/layout.tsx", "x"), ("src/app/util.ts", "x"),
        ("ui/button.stories.tsx", "export default { title: 'UI/Button', component: Button };\nexport const Primary = {};\nexport const Large = {};\n"), ("views/user-card.blade.php", "@include('partials.avatar') @extends(\"layout\")"),
    )
    assert {(r.route, r.kind, r.group, r.dynamic, r.client) for r in markup.routes(f).collect()} == {("/cart/[slug]", "page", "shop", True, True), ("/", "layout", None, False, False)}
    assert [(r.title, r.component, r.stories) for r in markup.stories(f).collect()] == [("UI/Button", "Button", ["Primary", "Large"])]
    t = markup.template_components(f.where("path like 'views/%'")).first()
    assert (t.name, t.dependencies) == ("UserCard", ["partials.avatar", "layout"])


def test_design_files(spark):
    node = {"id": "1", "name": "Button", "type": "COMPONENT_SET", "children": [{"id": "2", "name": "size=sm", "type": "COMPONENT"}], "componentPropertyDefinitions": {"Size": {"variantOptions": ["1", "2"]}, "size": {"variantOptions": ["x"]}, "icon-left": {}}}
    tree = {"document": {"children": [{"name": "Components", "children": [{"name": "F", "type": "FRAME", "children": [node]}]}, {"name": "Old", "children": [node]}]}}
    found, errors = markup.design_nodes(frame(spark, ("a.json", json.dumps(tree)), ("b.json", "{}")))
    got = {(r.id, r.type, r.hierarchy, r.set_id) for r in found.collect()}
    assert got == {("1", "COMPONENT_SET", "F/Button", None), ("2", "COMPONENT", "F/Button/size=sm", "1")} and errors.count() == 1
    assert {r.problem for r in markup.design_problems(found).collect()} == {"duplicate property", "mixed conventions", "single option", "numeric options"}
    matrix = search.variant_matrix(found.where("id = '1'").withColumn("options", found["options"])).first()
    assert matrix.actual == 1
