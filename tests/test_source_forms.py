"""Literals, class forms, variants, ordered claims, annotations, chains and projects on cases of their own, beside the queries' SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chromatid.operators import fill
from chromatid.sources import classes, components, history, literals, projects


def files(spark, **content):
    return spark.createDataFrame(list(content.items()), "path string, content string")


# Literals.
def leaves(text):
    return [(tuple(k), v, ok) for k, v, ok in literals.leaves(literals.Reader(text, 0).value())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('"a\\"b"', [((), 'a"b', True)]),
        ("{a: {b: {c: ['x', {d: `y`}]}}}", [(("a", "b", "c", "0"), "x", True), (("a", "b", "c", "1", "d"), "y", True)]),
        ("{ 'q-r': \"}\", /* { */ s: '{' // }\n }", [(("q-r",), "}", True), (("s",), "{", True)]),
        ("{a: `x ${f({b: `${c}`})} y`, ...rest, m() { return 1 }, [k]: 2, n}", [(("a",), "x * y", True), (("...rest",), "...rest", False), (("m",), "m() { return 1 }", False), (("[k]",), "2", False), (("n",), "n", False)]),
        ("{a: on ? 'x' : 'y', b: ('z'), c: 'x' + 'y', d: 'k' as const}", [(("a",), "on ? 'x' : 'y'", False), (("b",), "('z')", False), (("c",), "'x' + 'y'", False), (("d",), "k", True)]),
        ("[]", []),
    ],
)
def test_literals_are_trees(text, want):
    assert leaves(text) == want


@pytest.mark.parametrize("text", ["{a: 1", "[1, 2", "`x", "{a: `${b}", "{a: {b: 'c'}"])
def test_literals_that_never_end(text):
    with pytest.raises(ValueError, match="open"):
        literals.Reader(text, 0).value()


BUTTON = '''
const buttonVariants = cva(
  "inline-flex items-center disabled:opacity-50",
  {
    variants: {
      variant: {
        default: "bg-primary text-primary-foreground hover:bg-primary/90",
        destructive:
          "bg-destructive text-white hover:bg-destructive/90 focus-visible:ring-destructive/20",
        link: "text-primary underline-offset-4 hover:underline",
      },
      size: { default: "h-9 px-4 py-2 has-[>svg]:px-3", icon: "size-9" },
    },
    defaultVariants: { variant: "default", size: "default" },
  }
)'''


def test_variants_of_a_definition(spark):
    found, errors = literals.call_leaves(files(spark, a=BUTTON, b="no call", c=None), "cva")
    assert errors.count() == 0
    options = {(r.axis, r.option): r.classes for r in classes.variant_options(found).collect()}
    assert set(options) == {("variant", "default"), ("variant", "destructive"), ("variant", "link"), ("size", "default"), ("size", "icon")}
    assert options["size", "default"] == ["h-9", "px-4", "py-2", "has-[>svg]:px-3"]
    (d,) = classes.variant_definitions(found).collect()
    assert (d.name, d.line, d.axes, d.options, d.defaults) == ("buttonVariants", 2, 2, 5, 2) and d.base == ["inline-flex", "items-center", "disabled:opacity-50"]
    assert d.tokens == ["destructive", "primary", "primary-foreground"]
    assert {(r.axis, r.option) for r in classes.variant_defaults(found).collect()} == {("variant", "default"), ("size", "default")}


def test_semantic_tokens(spark):
    cases = {
        "bg-primary": "primary", "hover:bg-primary/90": "primary", "text-muted-foreground": "muted-foreground", "dark:md:border-input": "input", "ring-ring/50": "ring", "bg-brand-foreground": "brand-foreground",
        "text-white": None, "bg-gray-300": None, "text-sm": None, "p-4": None, "bg-chart-3": "chart-3", "bg-chart-3-foreground": "chart-3-foreground", "bg-x9-foreground": None, "shadow-sidebar-border": "sidebar-border",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", classes.semantic_token(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in rows} == cases


# Arbitrary values: classes of a line and what is claimed in it, by kind.
CLAIMED = [
    ("bg-[#ff6b6b] text-[#333] bg-[rgb(255,107,107)] border-[rgba(0,0,0,0.5)]", {"color": 4}),
    ("bg-[var(--primary-color)] text-[var(--text-color)]", {}),
    ("p-[17px] m-[2rem] gap-[10px] scroll-m-[10px] scroll-p-[20px] scroll-mt-[5px]", {"spacing": 6}),
    ("w-[100px] h-[50vh] min-w-[300px] text-[14px] text-[1.5rem] size-[--cell-size] max-w-[30ch]", {"size": 7}),
    ("before:h-[300px] before:w-[480px] after:h-[180px] after:w-[240px] [&>svg]:h-[0.9rem] [&_pre]:max-h-[650px]", {"size": 6}),
    ("dark:bg-[#1a1a1a] after:dark:via-[#0141ff] via-[#0141ff]/40 text-[hsl(280,100%,70%)] bg-[color:rgba(254,204,27,0.5)]", {"color": 5}),
    ("dark:drop-shadow-[0_0_0.3rem_#ffffff70]", {"other": 1}),
    ("grid-cols-[repeat(auto-fill,minmax(350px,1fr))] grid-cols-[.75fr_1fr] cols-[1fr] auto-rows-[auto]", {"grid": 4}),
    ("duration-[5s] delay-[200ms] transition-[opacity,transform]", {"timing": 3}),
    ("[--anchor-gap:--spacing(1)] md:[--cell-size:--spacing(10)] [background-size:20px_20px]", {"css-property": 3}),
    ("rounded-[2px] rounded-t-[4px] [&>kbd]:rounded-[calc(var(--radius)-5px)] border-[1.5px] border-t-[2px] ring-[3px] divide-x-[3px] outline-offset-[4px] stroke-[2px]", {"border": 9}),
    ("aspect-[2/0.5] z-[100] -z-[1] basis-[25%] grow-[2] -order-[1] columns-[3] object-[center_top]", {"layout": 8}),
    ("translate-x-[10px] -translate-x-[20px] rotate-[45deg] -rotate-[90deg] scale-x-[0.9] skew-y-[6deg] origin-[center_bottom]", {"transform": 7}),
    ("blur-[2px] saturate-[1.2] hue-rotate-[90deg] invert-[0.5] backdrop-blur-[4px] backdrop-contrast-[1.2]", {"filter": 6}),
    ("opacity-[.5] shadow-[0_0_0_1px_hsl(var(--sidebar-border))] hover:shadow-[0_35px_60px_-15px_rgba(0,0,0,0.3)]", {"visual": 3}),
    ("leading-[1.5] tracking-[-0.5px] font-[500] line-clamp-[3] [&>span]:line-clamp-[2] underline-offset-[4px] indent-[2em]", {"typography": 7}),
    ("before:content-[''] content-['Hello'] will-change-[opacity,transform] list-[upper-roman] cursor-[url(hand.cur),_pointer]", {"other": 5}),
    ("w-(--button-width) min-w-(--sidebar-width) p-(--card) text-(--primary-color) border-(--border-color)", {"size": 2, "spacing": 1, "css-property": 2}),
    ("border-[#ff0000] stroke-[#333333] shadow-[#abc] font-[Inter] ring-[#fff] foo-[bar] list[0] a[b]", {"color": 3}),
]


def test_claims_go_by_the_first_form_that_fits(spark):
    rows = spark.createDataFrame([(str(n), f'x\n<div className="{line}">') for n, (line, _) in enumerate(CLAIMED)], "path string, content string")
    found = classes.arbitrary_claims(rows).collect()
    for n, (line, want) in enumerate(CLAIMED):
        mine = [r for r in found if r.path == str(n)]
        kinds = {}
        for r in mine:
            kinds[r.kind] = kinds.get(r.kind, 0) + 1
            text = f'<div className="{line}">'
            assert r.line == 2 and text[r.col - 1 : r.col - 1 + len(r.full_class)] == r.full_class and r.value in r.full_class
        assert kinds == want, line


def test_no_two_claims_overlap():
    claims = [(k, classes._pattern(u, v, f)) for k, u, v, f in classes.CLAIMS]
    rng = random.Random(4)
    parts = ["p-[1px]", "bg-[#fff]", "[&>a]:", "hover:", "-", "z-[1]", "[--x:1]", "w-(--y)", " ", "line-clamp-[2]", "[", "]", "text-[", "color:red]"]
    for _ in range(300):
        line = "".join(rng.choice(parts) for _ in range(8))
        spans = [(at, at + len(t)) for at, t, *_ in classes.claimed(line, claims)]
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


# Prefixed classes.
def test_prefixed_classes_are_parts(spark):
    text = 'a cn-card cn-card-header\n"cn-tabs-list-variant-default" cn-tabs-list cn-card\ncn-alert-dialog-overlay xcn-no cn-9 ui-x cn-group-a-text-b cn-mode'
    got = {r["class"]: (r.line, r.n, r.block, r.element, r.modifier, r.component) for r in classes.prefixed_classes(files(spark, f=text), "cn").collect()}
    assert got == {
        "cn-card": (1, 2, "card", None, None, "card"), "cn-card-header": (1, 1, "card", "header", None, "card"), "cn-tabs-list-variant-default": (2, 1, "tabs", "list", "variant-default", "tabs"),
        "cn-tabs-list": (2, 1, "tabs", "list", None, "tabs"), "cn-alert-dialog-overlay": (3, 1, "alert-dialog", "overlay", None, "alert-dialog"),
        "cn-group-a-text-b": (3, 1, "group-a", "text-b", None, "group-a"), "cn-mode": (3, 1, "", None, "mode", "mode"),
    }
    tree = {(r.level, r.block, r.element, r.modifier): (r.classes, r.files, r.n) for r in classes.class_tree(classes.prefixed_classes(files(spark, f=text, g="cn-card"), "cn")).collect()}
    assert tree["all", None, None, None] == (7, 2, 9) and tree["block", "card", None, None] == (2, 2, 4) and tree["modifier", "tabs", "list", "variant-default"] == (1, 1, 1)


# Values along an order.
def test_fill_is_the_same_whatever_the_segments(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.choice([None, None, None, n])) for k in ("a", "b", None) for n in rng.sample(range(400), 150)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    want = set()
    for key in ("a", "b", None):
        last = None
        for _, n, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            last = v if v is not None else last
            want.add((key, n, last))
    for segment in (1, 7, 100, 10_000):
        assert {tuple(r) for r in fill.carried(df, "k", "n", "v", segment).select("k", "n", "v").collect()} == want


def test_pointers_end_and_circles_do_not(spark):
    links = [(i, i - 1 if i % 50 else None) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (303, 302), (400, 399), (401, 400), (500, 500)]
    got = {r.id: r.root for r in fill.followed(spark.createDataFrame(links, "id long, next long")).collect()}
    assert got == {i: i - i % 50 for i in range(200)} | {400: 399, 401: 399}
    assert fill.followed(spark.createDataFrame([], "id long, next long")).count() == 0


def test_chains_of_ten_both_ways(spark):
    rows = [(f"D{i}", f"D{i - 1}" if i else None, ["p"] if not i else [], i) for i in range(10)]
    rows += [(f"U{i}", f"U{i + 1}" if i < 9 else None, ["q"] if i == 9 else [], 100 + i) for i in range(10)]
    rows += [("L", "L", [], 200), ("A", "B", [], 201), ("B", "A", [], 202), ("T", None, ["old"], 203), ("T", None, ["new"], 204), ("V", "T", [], 205), ("W", "none", [], 206), ("X", "D3", ["own"], 207)]
    df = spark.createDataFrame(rows, "name string, extends string, props array<string>, seq long")
    got = {r.seq: r.props for r in components.inherit_in_order(df).collect()}
    by_name, props = {}, {}
    for name, _, p, seq in rows:
        by_name[name] = seq
        props[seq] = list(p)
    for _, extends, _, seq in rows:  # the rule as it is said: in input order, from the last component of the name
        if not props[seq] and props.get(by_name.get(extends)):
            props[seq] = list(props[by_name[extends]])
    assert got == props and got[9] == ["p"] and got[108] == ["q"] and got[107] == [] and got[205] == ["new"]


# Annotations.
def test_blame_of_both_formats(spark):
    a, c = "a" * 40, "c" * 40
    head = lambda x: [f"author {x}", f"author-mail <{x}@h>", "author-time 1700000000", "author-tz +0000", "summary author y", "filename f"]
    short = [f"{a} 1 1 2", *head("Ann"), "\tone", f"{a} 2 2", "\tauthor Bob", f"{c} 9 3 1", *head("Cy"), "\t", f"{a} 3 4 1", "\tfour"]
    long = [f"{a} 1 1 2", *head("Ann"), "\tone", f"{a} 2 2", *head("Ann"), "\tauthor Bob", f"{c} 9 3 1", *head("Cy"), "\t", f"{a} 3 4 1", *head("Ann"), "\tfour"]
    rows = [(p, n, t) for p, lines in (("s", short), ("l", long), ("x", ["\tno header"])) for n, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "path string, n long, text string").repartition(5)
    want = [(1, a, "Ann", "one"), (2, a, "Ann", "author Bob"), (3, c, "Cy", ""), (4, a, "Ann", "four")]
    for segment in (2, 1000):
        got = history.blame(df, segment=segment).collect()
        assert {p: sorted((r.line, r.sha, r.author, r.text) for r in got if r.path == p) for p in "slx"} == {"s": want, "l": want, "x": []}
        assert {r.email for r in got} == {"Ann@h", "Cy@h"} and {r.authored.year for r in got} == {2023}


# Projects.
TREE = {
    "package.json": '{"name": "top", "private": true, "devDependencies": {"typescript": "5"}, "workspaces": ["ignored/*"]}',
    "pnpm-workspace.yaml": "packages:\n  - 'packages/*'\n  - \"tools/**\"\n  - '!tools/old'\n",
    "packages/ui/package.json": '{"name": "@x/ui", "dependencies": {"react": "18", "next": "14"}}',
    "packages/ui/src/deep/Button.tsx": "", "packages/ui/tailwind.config.ts": "", "packages/README.md": "", "packages/ui/.storybook/main.ts": "",
    "packages/ui/examples/demo/package.json": '{"dependencies": {"vue": "3"}}', "packages/ui/examples/demo/App.vue": "",
    "tools/old/package.json": '{"name": "old"}', "tools/a/b/package.json": '{"name": "b", "dependencies": {"tailwindcss": "3", "lit-element": "1", "lit": "2"}}',
    "broken/package.json": "{nope", "broken/x.ts": "", "x.ts": "",
}


def test_projects_of_a_tree(spark):
    df = spark.createDataFrame(list(TREE.items()), "path string, content string")
    found = projects.manifests(df)
    near = {r.path: r.root for r in projects.nearest(df, found).collect()}
    assert near["packages/ui/src/deep/Button.tsx"] == "packages/ui" and near["packages/ui/examples/demo/App.vue"] == "packages/ui/examples/demo" and near["packages/README.md"] == "" and near["x.ts"] == ""
    assert [tuple(r) for r in projects.workspaces(df).collect()] == [("", "pnpm", ["packages/*", "tools/**", "!tools/old"])]
    assert {(r.workspace, r.root) for r in projects.members(found, projects.workspaces(df)).collect()} == {("", "packages/ui"), ("", "tools/a/b")}
    got = {(r.root, r.name): (r.confidence, r.evidence) for r in projects.frameworks(df).collect()}
    assert got["packages/ui", "react"] == ("high", 'Found "react" in package.json') and got["packages/ui", "tailwind"] == ("medium", "Found tailwind.config.ts")
    assert got["packages/ui", "storybook"] == ("medium", "Found .storybook/main.ts") and got["", "next"][0] == "high" and got["", "lit"] == ("high", 'Found "lit" in package.json')
    assert ("packages/ui", "vue") not in got and ("packages/ui/examples/demo", "vue") in got
    listed = {r.root: (r.name, r.tool, r.workspace, r.files) for r in projects.projects(df).collect()}
    assert listed[""] == ("top", "pnpm", None, 4 + 2) and listed["packages/ui"][1:3] == (None, "") and listed["packages/ui/examples/demo"][0] == "demo"
    assert listed["tools/old"][2] is None


def test_project_of_other_tools(spark):
    def tool(**more):
        df = spark.createDataFrame([(p.replace("__", "."), c) for p, c in more.items()], "path string, content string")
        return [(r.tool, r.globs) for r in projects.workspaces(df).collect()]

    space = '{"workspaces": {"packages": ["a/*"]}}'
    assert tool(package__json=space) == [("npm", ["a/*"])] and tool(package__json=space, yarn__lock="") == [("yarn", ["a/*"])]
    assert tool(package__json=space, yarn__lock="", turbo__json="{}") == [("turborepo", ["a/*"])] and tool(package__json='{"workspaces": []}') == []
    assert tool(lerna__json="{}") == [("lerna", ["packages/*"])] and tool(lerna__json='{"packages": ["m"]}', package__json=space) == [("lerna", ["m"])]
    assert tool(nx__json="{}") == [("nx", ["apps/*", "libs/*", "packages/*"])]


def test_prefix_pattern_is_one_of_words():
    assert re.fullmatch(rf"(?:{classes.MODIFIER_WORDS})", "variant") and not re.fullmatch(rf"(?:{classes.MODIFIER_WORDS})", "variants")


# Dynamic classes, classes that depend on what is around them, render props.
def test_dynamic_classes_by_context(spark):
    cases = {
        "<div className={`btn-${size}`}>": [("template-literal", "btn-{size}")], "<i className={`${p}-${v}`}>": [("template-literal", "{p}-{v}")], "<i className={`static`}>": [], '<i className="x">': [],
        "<i className={clsx(b, v && `${b}-${v}`)}>": [("clsx", "{b}-{v}")], "<i className={cx(`theme-${c}`)}>": [("cx", "theme-{c}")], "<i className={cn(`a-${x}`, 'b', `c-${y}`)}>": [("classnames", "a-{x}"), ("classnames", "c-{y}")],
        "<i className={on ? `${p}-on` : `${p}-off`}>": [("conditional", "{p}-on"), ("conditional", "{p}-off")], "<i className={\n  `a ${b}`\n}>": [("template-literal", "a {b}")],
        "<i className={`a-${x({ y: `in-${z}` })}`}>": [("template-literal", "a-{x({ y: `in-${z}` })}")], "<i className={'it`s' + `q-${r}`}>": [("template-literal", "q-{r}")], "<i className={`open ${x": [],
    }
    df = spark.createDataFrame([(str(n), c) for n, c in enumerate(cases)], "path string, content string")
    found = classes.dynamic_forms(df).collect()
    for n, (content, want) in enumerate(cases.items()):
        assert [(r.context, r.structure) for r in found if r.path == str(n)] == want, content


def test_selector_forms(spark):
    cases = {
        "md:data-[state=open]:p-1": {("data", "data-", "state", "open")}, "**:data-[a]:x": {("wildcard", "**", "a", "")}, "*:data-[a=b]:x": {("data", "*:data-", "a", "b"), ("wildcard", "*", "a", "b")},
        "group-has-data-[x]/n:y": {("data", "group-has-data-", "x", "")}, "ui-open:p-1 xui-open:p-1 ui-nope:p": {("headless", "ui", "open", "")}, "peer-data-checked:p-1": {("data-short", "peer-data-", "checked", "")},
        "[&_p]:a [&>li:first]:b [& p]:c": {("child", "_", "p", ""), ("child", ">", "li:first", "")}, "has-aria-invalid:b aria-checked=mixed:c": {("aria", "has-aria", "invalid", ""), ("aria", "aria", "checked", "")},
        "group/a peer/b @container/c @sm/d:e": {("named", "group", "a", ""), ("named", "peer", "b", ""), ("named", "@container", "c", ""), ("container", "sm", "d", "")}, "data-x={y} data-slot='z'": {("data-dynamic", "", "x", "y"), ("slot", "", "z", "")},
        "list[0] a:b text": set(),
    }
    df = spark.createDataFrame([(str(n), c) for n, c in enumerate(cases)], "path string, content string")
    found = classes.selector_classes(df).collect()
    for n, (content, want) in enumerate(cases.items()):
        assert {(r.form, r.kind, r["name"], r.value) for r in found if r.path == str(n)} == want, content
