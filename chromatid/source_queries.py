"""Queries of what files hold: class forms, variants, themes, projects, annotations. Each makes several spellings of a form from a table's keys, by expressions that both engines share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from chromatid import bindings as b
from chromatid import plugins, schemas
from chromatid.functions import colors, ids, strings
from chromatid.more_queries import K, View, pick
from chromatid.operators import detect, match, search
from chromatid.plans import dispatch, views
from chromatid.queries import query
from chromatid.session import shared_folder
from chromatid.sources import classes, components, design, extract, files, history, literals, projects


def text(template: str, **parts: str) -> str:
    """A template as an expression: «name» is the part's expression; quotes, dollars, backslashes and line ends go by their code."""
    out = []
    for piece in re.split(r"(«\w+»|['$\\\n\t])", template):
        if piece[:1] == "«":
            out.append(parts[piece[1:-1]])
        elif piece in ("'", "$", "\\", "\n", "\t"):
            out.append(f"chr({ord(piece)})")
        elif piece:
            out.append(f"'{piece}'")
    return " || ".join(out)


def rows(*cases: tuple, of: str, columns: str) -> str:
    """SQL: for each case (condition, rows of expressions) its rows, from the table that it holds of."""
    parts = [f"SELECT {', '.join(f'{e} AS {c}' for e, c in zip(row, columns.split(), strict=True))} FROM {of} WHERE {when}" for when, all_ in cases for row in all_]
    return "(" + " UNION ALL ".join(parts) + ")"


# Variants of class helpers: strings in three quotes, braces in strings and comments, lists, conditions, calls, two in a file, one that never ends.
_VARIANTS = [
    """const buttonVariants = cva("rounded-md bg-primary p-«k»", {
  variants: { size: { sm: "h-8", lg: 'h-«k» px-4' } },
})""",
    """// cards
export const cardVariants = cva(
  'border-input data-[x={1}]:p-«k»', // not } this
  {
    variants: {
      tone: {
        "dark-mode": "before:content-['}'] text-muted-foreground",
        light:
          "bg-background hover:bg-accent/50",
      },
      /* size: { no: "x" } */
      size: { s«k»: "w-1" },
    },
    defaultVariants: { tone: "light", size: "s«k»" },
  }
)""",
    """let x«k» = cva(`flex ${on ? `{a` : "b"} gap-2`, { compoundVariants: [{ tone: "a", size: "b", class: "bg-card" }],
  variants: { tone: { a: ["bg-primary/90", "ring-ring"], b: cond ? "x" : "y", c: fn({ d: "e" }) }, ...rest } } as const)""",
    """const plain = cva("text-red-500 text-white bg-chart-1");
var second = cva(base, { variants: {}, defaultVariants: { on: true, size: "md" } });""",
    """const broken = cva("a", { variants: { size: { sm: "h-1" } }""",
]
CVA = View("cva_files", "part", k=K, path=f"'c' || {K} || '.ts'", content=pick(K, *[text(t, k=K) for t in _VARIANTS]))
_OPTION = "path name line axis option classes"
_OPTIONS = rows(
    ("k % 5 = 0", [("path", "'buttonVariants'", "1", "'size'", "'sm'", "'h-8'"), ("path", "'buttonVariants'", "1", "'size'", "'lg'", "'h-' || k || ' px-4'")]),
    (
        "k % 5 = 1",
        [
            ("path", "'cardVariants'", "2", "'tone'", "'dark-mode'", "'before:content-[' || chr(39) || '}' || chr(39) || '] text-muted-foreground'"),
            ("path", "'cardVariants'", "2", "'tone'", "'light'", "'bg-background hover:bg-accent/50'"),
            ("path", "'cardVariants'", "2", "'size'", "'s' || k", "'w-1'"),
        ],
    ),
    ("k % 5 = 2", [("path", "'x' || k", "1", "'tone'", "'a'", "'bg-primary/90 ring-ring'")]),
    of="cva_files",
    columns=_OPTION,
)


@query(f"SELECT * FROM {_OPTIONS}", CVA.sql)
def variant_options(spark, d):
    leaves, _ = literals.call_leaves(CVA(spark, d), "cva")
    return classes.variant_options(leaves).withColumn("classes", F.array_join("classes", " "))


@query(
    "SELECT * FROM "
    + rows(
        ("k % 5 = 1", [("path", "'cardVariants'", "'tone'", "'light'"), ("path", "'cardVariants'", "'size'", "'s' || k")]),
        ("k % 5 = 3", [("path", "'second'", "'size'", "'md'")]),
        of="cva_files",
        columns="path name axis option",
    ),
    CVA.sql,
)
def variant_defaults(spark, d):
    return classes.variant_defaults(literals.call_leaves(CVA(spark, d), "cva")[0]).drop("line")


@query(
    "SELECT * FROM "
    + rows(
        ("k % 5 = 0", [("path", "'buttonVariants'", "1", "'rounded-md bg-primary p-' || k", "1", "2", "0", "'primary'")]),
        ("k % 5 = 1", [("path", "'cardVariants'", "2", "'border-input data-[x={1}]:p-' || k", "2", "3", "2", "'accent,background,input,muted-foreground'")]),
        ("k % 5 = 2", [("path", "'x' || k", "1", "'flex * gap-2'", "1", "1", "0", "'primary,ring'")]),
        ("k % 5 = 3", [("path", "'plain'", "1", "'text-red-500 text-white bg-chart-1'", "0", "0", "0", "'chart-1'"), ("path", "'second'", "2", "''", "0", "0", "1", "''")]),
        ("k % 5 = 4", [("path", "'broken'", "1", "''", "0", "0", "0", "''")]),
        of="cva_files",
        columns="path name line base axes options defaults tokens",
    ),
    CVA.sql,
)
def variant_definitions(spark, d):
    return classes.variant_definitions(literals.call_leaves(CVA(spark, d), "cva")[0]).withColumn("base", F.array_join("base", " ")).withColumn("tokens", F.array_join("tokens", ","))


@query(
    "SELECT token, count(DISTINCT path || name) AS definitions, count(*) AS uses FROM "
    + rows(
        ("k % 5 = 0", [("path", "'b'", "'primary'")]),
        ("k % 5 = 1", [("path", "'c'", f"'{t}'") for t in ("input", "muted-foreground", "background", "accent")]),
        ("k % 5 = 2", [("path", "'x'", "'primary'"), ("path", "'x'", "'ring'")]),
        ("k % 5 = 3", [("path", "'p'", "'chart-1'")]),
        of="cva_files",
        columns="path name token",
    )
    + " GROUP BY token",
    CVA.sql,
)
def variant_tokens(spark, d):
    return classes.definition_tokens(literals.call_leaves(CVA(spark, d), "cva")[0])


# Arbitrary values: forms that more than one pattern fits, values that decide, modifiers, variables, properties, and what isn't one.
_CLAIMS = [
    """<div className="bg-[#ff«h»] text-[«k»px] text-[rgb(1,2,3)] border-[1.5px] border-[var(--x)]">
  <a className="line-clamp-[«k»] hue-rotate-[90deg] backdrop-blur-[4px]" /></div>""",
    """<p class="before:lg:h-[«k»px] after:dark:via-[#0141ff]/40 -translate-x-[20px] [&>svg]:w-[0.9rem]">
w-(--button-«k») p-(--card) bg-(--background) ring-[3px] ring-[#fff]""",
    """grid-cols-[repeat(auto-fill,minmax(«k»px,1fr))] shadow-[0_0_1px_rgba(0,0,0,0.3)] bg-[color:hsl(0,0%,«k»%)]
md:[--cell-size:--spacing(«k»)] data-[state=open]:p-[«k»px] content-['*'] 2xl:z-[9]""",
    "const a = list[«k»]; x = map[key]; foo-[bar] font-[Inter] font-[«k»] stroke-[2px] stroke-[#333]",
]
MARKED = View("marked", "part", k=K, path=f"'m' || {K} || '.tsx'", content=pick(K, *[text(t, k=K, h=f"lpad(CAST({K} % 10000 AS VARCHAR(9)), 4, '0')") for t in _CLAIMS]))
_H = "lpad(CAST(k % 10000 AS VARCHAR(9)), 4, '0')"


@query(
    "SELECT * FROM "
    + rows(
        (
            "k % 4 = 0",
            [
                ("path", "1", f"'bg-[#ff' || {_H} || ']'", f"'#ff' || {_H}", "'color'"),
                ("path", "1", "'text-[' || k || 'px]'", "k || 'px'", "'size'"),
                ("path", "1", "'text-[rgb(1,2,3)]'", "'rgb(1,2,3)'", "'color'"),
                ("path", "1", "'border-[1.5px]'", "'1.5px'", "'border'"),
                ("path", "2", "'line-clamp-[' || k || ']'", "'' || k", "'typography'"),
                ("path", "2", "'hue-rotate-[90deg]'", "'90deg'", "'filter'"),
                ("path", "2", "'backdrop-blur-[4px]'", "'4px'", "'filter'"),
            ],
        ),
        (
            "k % 4 = 1",
            [
                ("path", "1", "'before:lg:h-[' || k || 'px]'", "k || 'px'", "'size'"),
                ("path", "1", "'after:dark:via-[#0141ff]/40'", "'#0141ff'", "'color'"),
                ("path", "1", "'-translate-x-[20px]'", "'20px'", "'transform'"),
                ("path", "1", "'[&>svg]:w-[0.9rem]'", "'0.9rem'", "'size'"),
                ("path", "2", "'w-(--button-' || k || ')'", "'--button-' || k", "'size'"),
                ("path", "2", "'p-(--card)'", "'--card'", "'spacing'"),
                ("path", "2", "'bg-(--background)'", "'--background'", "'css-property'"),
                ("path", "2", "'ring-[3px]'", "'3px'", "'border'"),
            ],
        ),
        (
            "k % 4 = 2",
            [
                ("path", "1", "'grid-cols-[repeat(auto-fill,minmax(' || k || 'px,1fr))]'", "'repeat(auto-fill,minmax(' || k || 'px,1fr))'", "'grid'"),
                ("path", "1", "'shadow-[0_0_1px_rgba(0,0,0,0.3)]'", "'0_0_1px_rgba(0,0,0,0.3)'", "'visual'"),
                ("path", "1", "'bg-[color:hsl(0,0%,' || k || '%)]'", "'hsl(0,0%,' || k || '%)'", "'color'"),
                ("path", "2", "'[--cell-size:--spacing(' || k || ')]'", "'--cell-size:--spacing(' || k || ')'", "'css-property'"),
                ("path", "2", "'p-[' || k || 'px]'", "k || 'px'", "'spacing'"),
                ("path", "2", "'content-[' || chr(39) || '*' || chr(39) || ']'", "chr(39) || '*' || chr(39)", "'other'"),
                ("path", "2", "'2xl:z-[9]'", "'9'", "'layout'"),
            ],
        ),
        (
            "k % 4 = 3",
            [
                ("path", "1", "'font-[' || k || ']'", "'' || k", "'typography'"),
                ("path", "1", "'stroke-[2px]'", "'2px'", "'border'"),
                ("path", "1", "'stroke-[#333]'", "'#333'", "'color'"),
            ],
        ),
        of="marked",
        columns="path line full_class value kind",
    ),
    MARKED.sql,
)
def arbitrary_claims(spark, d):
    return classes.arbitrary_claims(MARKED(spark, d)).drop("col")


# Block-element-modifier names.
_PREFIXED = [
    """<div class="cn-card cn-card-header"><b className={cn("cn-card", 'cn-alert-dialog-overlay')}>
cn-tabs-list-variant-default cn-card""",
    "ui-active:bg-blue-500 CN-Button-Group-Orientation-Horizontal `cn-avatar`  xcn-no cn-«k»x my-cn-card-title-row",
    "cn-size-lg cn-alert-dialog cn-b«k»-footer\n\"cn-b«k»-state-open\" cn-select-item-indicator",
]
PREFIXED = View("prefixed", "part", k=K, path=f"'p' || {K} || '.tsx'", content=pick(K, *[text(t, k=K) for t in _PREFIXED]))
_BEM = rows(
    (
        "k % 3 = 0",
        [
            ("path", "'cn-card'", "1", "3", "'card'", "NULL", "NULL"),
            ("path", "'cn-card-header'", "1", "1", "'card'", "'header'", "NULL"),
            ("path", "'cn-alert-dialog-overlay'", "1", "1", "'alert-dialog'", "'overlay'", "NULL"),
            ("path", "'cn-tabs-list-variant-default'", "2", "1", "'tabs'", "'list'", "'variant-default'"),
        ],
    ),
    (
        "k % 3 = 1",
        [
            ("path", "'cn-button-group-orientation-horizontal'", "1", "1", "'button'", "'group'", "'orientation-horizontal'"),
            ("path", "'cn-avatar'", "1", "1", "'avatar'", "NULL", "NULL"),
            ("path", "'cn-card-title-row'", "1", "1", "'card'", "'title-row'", "NULL"),
        ],
    ),
    (
        "k % 3 = 2",
        [
            ("path", "'cn-size-lg'", "1", "1", "''", "NULL", "'size-lg'"),
            ("path", "'cn-alert-dialog'", "1", "1", "'alert-dialog'", "NULL", "NULL"),
            ("path", "'cn-b' || k || '-footer'", "1", "1", "'b' || k", "'footer'", "NULL"),
            ("path", "'cn-b' || k || '-state-open'", "2", "1", "'b' || k", "NULL", "'state-open'"),
            ("path", "'cn-select-item-indicator'", "2", "1", "'select-item'", "'indicator'", "NULL"),
        ],
    ),
    of="prefixed",
    columns="path class line n block element modifier",
)


@query(f"SELECT * FROM {_BEM}", PREFIXED.sql)
def prefixed_classes(spark, d):
    return classes.prefixed_classes(PREFIXED(spark, d), "cn").drop("component")


_TREE = """SELECT CASE level_id WHEN 7 THEN 'all' WHEN 3 THEN 'block' WHEN 1 THEN 'element' ELSE 'modifier' END AS level, block, element, modifier, classes, files, n FROM (
SELECT grouping_id(block, element, modifier) AS level_id, block, element, modifier, count(DISTINCT class) AS classes, count(DISTINCT path) AS files, sum(n)::BIGINT AS n
FROM {rows} GROUP BY ROLLUP (block, element, modifier))"""


@query(
    _TREE.format(rows=f"(SELECT path, class, n, block, coalesce(element, '') AS element, coalesce(modifier, '') AS modifier FROM {_BEM})"),
    PREFIXED.sql,
)
def class_tree(spark, d):
    return classes.class_tree(classes.prefixed_classes(PREFIXED(spark, d), "cn"))


# Words as a prefix's classes: the documents' own lines with a hyphen for the spaces between their words.

@query(
    """+l AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(lower(text), chr(10))) AS x FROM documents),
w AS (SELECT path, unnest(regexp_extract_all(x, '\\b(the [a-z][a-z0-9]*(?: [a-z0-9]+)*)(?:[:"`'']|$)', 1)) AS c FROM l),
p AS (SELECT path, replace(substr(c, 5), ' ', '-') AS body, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT *, list_position(list_transform(string_split(body, '-'), lambda p: p IN ('variant', 'size', 'orientation', 'state', 'color', 'theme', 'mode', 'layout')), true) AS spot FROM p)
SELECT count(*) AS classes, sum(n)::BIGINT AS n, count(*) FILTER (WHERE spot > 0) AS modified, count(DISTINCT body) AS unlike FROM m""",
    "z AS (SELECT 1)",
)
def worded_classes(spark, d):
    docs = b.table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS path", "replace(text, ' ', '-') AS content")
    found = classes.prefixed_classes(docs, "the").withColumn("_", F.lit(1))
    return found.groupBy("_").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.count("modifier").alias("modified"), F.countDistinct("class").alias("unlike")).drop("_")


# Inheritance in order: chains written downwards and upwards, ten long, ends with and without props, a name that is given twice.
CHAINS = View(
    "chains", "part", k=K, seq=K, g=f"CAST(floor(({K} - 1) / 10) AS BIGINT)", i=f"({K} - 1) % 10",
    name=f"'C' || {K}",
    extends=f"CASE WHEN CAST(floor(({K} - 1) / 10) AS BIGINT) % 3 = 0 THEN CASE WHEN ({K} - 1) % 10 = 0 THEN NULL ELSE 'C' || ({K} - 1) END"
    f" WHEN CAST(floor(({K} - 1) / 10) AS BIGINT) % 3 = 1 THEN CASE WHEN ({K} - 1) % 10 = 9 THEN NULL ELSE 'C' || ({K} + 1) END ELSE 'C' || (CAST(floor(({K} - 1) / 10) AS BIGINT) * 10 + 5) END",
    prop=f"CASE WHEN CAST(floor(({K} - 1) / 10) AS BIGINT) % 3 = 0 AND ({K} - 1) % 10 = 0 OR CAST(floor(({K} - 1) / 10) AS BIGINT) % 3 = 1 AND ({K} - 1) % 10 = 9 THEN 'p' || {K}"
    f" WHEN CAST(floor(({K} - 1) / 10) AS BIGINT) % 3 = 2 AND ({K} - 1) % 10 = 7 THEN 'q' ELSE '' END",
)


@query(
    "+r AS (SELECT *, max(k) OVER () AS last FROM chains) SELECT name, seq, CASE WHEN prop <> '' THEN prop WHEN g % 3 = 0 THEN 'p' || (g * 10 + 1)"
    " WHEN g % 3 = 1 AND i = 8 AND g * 10 + 10 <= last THEN 'p' || (g * 10 + 10) ELSE '' END AS props FROM r",
    CHAINS.sql,
)
def inherited_in_order(spark, d):
    c = CHAINS(spark, d).select("name", "extends", "seq", F.filter(F.split("prop", ","), lambda p: p != "").alias("props"))
    return components.inherit_in_order(c).select("name", "seq", F.array_join("props", ",").alias("props"))


# Annotations: an order is a commit, its lines are lines of the file; every fifth commit says all of itself again.
NOTES = View(
    "notes", "orders", path="'src/f' || (CAST(floor(o_orderkey / 8) AS BIGINT) % 7) || '.css'", o="CAST(floor(o_orderkey / 8) AS BIGINT)", i="o_orderkey % 8 + 1", k="o_custkey",
    n="(CAST(floor(o_orderkey / 8) AS BIGINT) * 10 + o_orderkey % 8 + 1) * 10",
)


def _annotated() -> str:
    sha = "lpad(lower(hex(o)), 40, '0')"
    head = f"{sha} || ' ' || i || ' ' || (o * 10 + i)"
    parts = [
        ("0", "i % 2 = 1 OR i > 4", head),
        ("1", "i = 1 OR o % 5 = 0 AND (i % 2 = 1 OR i > 4)", "'author Dev ' || (o % 11)"),
        ("2", "i = 1 OR o % 5 = 0 AND (i % 2 = 1 OR i > 4)", "'author-mail <d' || (o % 11) || '@x.org>'"),
        ("3", "i = 1", "'author-time ' || (1600000000 + o)"),
        ("4", "i = 1", "'summary author of all'"),
        ("5", "i % 2 = 1 OR i > 4", "chr(9) || 'a' || k || ': 0'"),
        ("6", "i % 4 = 3", "chr(9) || 'author-mail <no>'"),
    ]
    return " UNION ALL ".join(f"SELECT path, n + {at} AS n, {e} AS text FROM notes WHERE {when}" for at, when, e in parts)


@query(
    "SELECT path, line, sha, author, email, authored, text FROM (SELECT path, (o * 10 + i)::INT AS line, lpad(lower(hex(o)), 40, '0') AS sha, CASE WHEN one OR o % 5 = 0 THEN 'Dev ' || (o % 11) END AS author,"
    " CASE WHEN one OR o % 5 = 0 THEN 'd' || (o % 11) || '@x.org' END AS email, CASE WHEN one THEN 1600000000 + o END AS authored, unnest(CASE WHEN i % 4 = 3 THEN ['a' || k || ': 0', 'author-mail <no>'] ELSE"
    " ['a' || k || ': 0'] END) AS text FROM (SELECT *, bool_or(i = 1) OVER (PARTITION BY o) AS one FROM notes) WHERE i % 2 = 1 OR i > 4)",
    NOTES.sql,
)
def blame_lines(spark, d):
    NOTES(spark, d).createOrReplaceTempView("notes")
    lines = spark.sql(_annotated())
    return history.blame(lines, segment=1000).withColumn("authored", F.unix_timestamp("authored"))


# Projects: workspaces of four tools, packages nested in packages, files deep below.
_BASE = f"CASE WHEN {K} % 10 = 0 THEN '' ELSE 'w' || ({K} % 10) || '/' END"
TREE_FILES = View(
    "tree_files", "part", f"{K} >= 1", k=K,
    path=f"""CASE WHEN {K} <= 10 THEN {_BASE} || 'package.json' WHEN {K} <= 20 THEN {_BASE} || {pick(K, repr('pnpm-workspace.yaml'), repr('lerna.json'), repr('nx.json'), repr('turbo.json'), repr('yarn.lock'))}
  WHEN {K} <= 60 THEN {_BASE} || 'packages/a' || {K} || '/package.json' WHEN {K} <= 100 THEN {_BASE} || 'apps/b' || {K} || '/inner/package.json'
  WHEN {K} % 3 = 0 THEN {_BASE} || 'packages/a' || (21 + {K} % 40) || '/src/x' || {K} || '.tsx' WHEN {K} % 3 = 1 THEN {_BASE} || 'apps/b' || (61 + {K} % 40) || '/inner/deep/y' || {K} || '.css'
  ELSE {_BASE} || 'tailwind.config.' || {K} END""",
    content=f"""CASE WHEN {K} <= 10 THEN '{{"name": "root' || {K} || '", "dependencies": {{"next": "1"}}' || CASE WHEN {K} % 5 IN (3, 4) THEN ', "workspaces": {{"packages": ["packages/*", "!packages/a' || ({K} + 30) || '"]}}'
  ELSE '' END || '}}' WHEN {K} <= 20 THEN CASE {K} % 5 WHEN 0 THEN {text('packages:' + chr(10) + '  - "packages/*"' + chr(10) + "  # - 'no/*'" + chr(10) + "  - 'apps/**'" + chr(10) + 'catalog:' + chr(10) + '  - x')}
  WHEN 1 THEN '{{"packages": ["apps/*/inner"]}}' ELSE '{{}}' END WHEN {K} <= 60 THEN '{{"name": "a' || {K} || '", "devDependencies": {{"vue": "3", "react-dom": "1"}}}}'
  WHEN {K} <= 100 THEN '{{"dependencies": {{"svelte": "4", "lit-element": "2"}}}}' ELSE '' END""",
)
_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
_MANIFESTS = f"m AS (SELECT k, {_DIR} AS root FROM tree_files WHERE path = 'package.json' OR path LIKE '%/package.json')"
_NEAREST = f"""+{_MANIFESTS}, f AS (SELECT path, root FROM tree_files LEFT JOIN m ON root = '' OR {_DIR} = root OR starts_with({_DIR}, root || '/'))
SELECT path, arg_max(root, length(root)) AS root FROM f GROUP BY path"""


@query(_NEAREST, TREE_FILES.sql)
def nearest_projects(spark, d):
    f = TREE_FILES(spark, d)
    return projects.nearest(f, projects.manifests(f))


_SPACES = [
    ("k BETWEEN 11 AND 20 AND k % 5 = 0", "'pnpm'", "'packages/*,apps/**'"),
    ("k BETWEEN 11 AND 20 AND k % 5 = 1", "'lerna'", "'apps/*/inner'"),
    ("k BETWEEN 11 AND 20 AND k % 5 = 2", "'nx'", "'apps/*,libs/*,packages/*'"),
    ("k <= 10 AND k % 5 = 3", "'turborepo'", "'packages/*,!packages/a' || (k + 30)"),
    ("k <= 10 AND k % 5 = 4", "'yarn'", "'packages/*,!packages/a' || (k + 30)"),
]
_SPACE_ROWS = rows(*[(w, [(_DIR, t, g)]) for w, t, g in _SPACES], of="tree_files", columns="root tool globs")


@query(f"SELECT * FROM {_SPACE_ROWS}", TREE_FILES.sql)
def workspace_globs(spark, d):
    return projects.workspaces(TREE_FILES(spark, d)).withColumn("globs", F.array_join("globs", ","))


_MEMBERS = f"""m AS (SELECT k, {_DIR} AS root FROM tree_files WHERE path = 'package.json' OR path LIKE '%/package.json'),
j AS (SELECT w.root AS workspace, tool, m.root, m.k, CASE WHEN w.root = '' THEN m.root ELSE substr(m.root, length(w.root) + 2) END AS x FROM {_SPACE_ROWS} w JOIN m ON m.root <> w.root AND (w.root = '' OR starts_with(m.root, w.root || '/'))),
i AS (SELECT workspace, root, k FROM j WHERE CASE WHEN tool = 'pnpm' THEN regexp_full_match(x, 'packages/[^/]*|apps/.*') WHEN tool = 'lerna' THEN regexp_full_match(x, 'apps/[^/]*/inner')
  WHEN tool = 'nx' THEN regexp_full_match(x, '(apps|libs|packages)/[^/]*') ELSE regexp_full_match(x, 'packages/[^/]*') AND x <> 'packages/a' || ((k - 1) % 10 + 31) END)"""


@query("+" + _MEMBERS + " SELECT workspace, root, CASE WHEN k <= 60 THEN 'a' || k ELSE 'inner' END AS name FROM i", TREE_FILES.sql)
def workspace_members(spark, d):
    f = TREE_FILES(spark, d)
    return projects.members(projects.manifests(f), projects.workspaces(f))


_FOUND = "'Found \"{}\" in package.json'"


@query(
    f"""+{_MEMBERS}, a AS (SELECT m.root, bool_or(m.k <= 10) AS next, bool_or(m.k BETWEEN 21 AND 60 OR i.k BETWEEN 21 AND 60) AS pack, bool_or(m.k > 60 OR i.k > 60) AS app FROM m LEFT JOIN i ON i.workspace = m.root GROUP BY m.root),
t AS (SELECT m.root, min(CASE WHEN m.root = '' THEN path ELSE substr(path, length(m.root) + 2) END) AS c FROM tree_files JOIN m ON {_DIR} = m.root WHERE path LIKE '%tailwind.config.%' GROUP BY m.root)
SELECT root, 'next' AS name, 'nextjs' AS scanner, 'high' AS confidence, {_FOUND.format('next')} AS evidence FROM a WHERE next
UNION ALL SELECT root, 'react', 'react', 'high', {_FOUND.format('react-dom')} FROM a WHERE pack UNION ALL SELECT root, 'vue', 'vue', 'high', {_FOUND.format('vue')} FROM a WHERE pack
UNION ALL SELECT root, 'svelte', 'svelte', 'high', {_FOUND.format('svelte')} FROM a WHERE app UNION ALL SELECT root, 'lit', 'webcomponents', 'high', {_FOUND.format('lit-element')} FROM a WHERE app
UNION ALL SELECT root, 'tailwind', 'tailwind', 'medium', 'Found ' || c FROM t""",
    TREE_FILES.sql,
)
def project_frameworks(spark, d):
    return projects.frameworks(TREE_FILES(spark, d))


@query(
    f"""+{_MEMBERS}, f AS (SELECT path, arg_max(root, length(root)) AS root FROM tree_files JOIN m ON root = '' OR {_DIR} = root OR starts_with({_DIR}, root || '/') GROUP BY path),
c AS (SELECT root, count(*) AS files FROM f GROUP BY root), w AS (SELECT root, arg_max(workspace, length(workspace)) AS workspace FROM i GROUP BY root)
SELECT m.root, CASE WHEN k <= 10 THEN 'root' || k WHEN k <= 60 THEN 'a' || k ELSE 'inner' END AS name, s.tool, w.workspace, coalesce(c.files, 0) AS files
FROM m LEFT JOIN {_SPACE_ROWS} s ON s.root = m.root LEFT JOIN w ON w.root = m.root LEFT JOIN c ON c.root = m.root""",
    TREE_FILES.sql,
)
def project_list(spark, d):
    return projects.projects(TREE_FILES(spark, d))


# Theme files: base and extension, lists, sizes, references over several steps, to nothing and in a circle; four ways to export.
_THEMES = [
    """module.exports = {
  content: ["./x"],
  theme: {
    colors: { brand: { DEFAULT: '#1«h»', 500: "#222" }, white: '#fff', mid: { deep: { er: '#0«h»' } } },
    spacing: { 0.5: '2px', '4': '«k»px', 8: theme('spacing.4'), 16: "calc(theme(spacing.8) * 2 + theme('spacing.4'))" },
    extend: { colors: { brand: { 500: '#333', 600: '#444' } }, fontFamily: { sans: ['Inter', `sans-serif`] }, fontSize: { lg: ['18px', { lineHeight: '1.5' }] } },
  },
  plugins: [require('x')],
}""",
    """/** @type {import('x').Config} */
const config = withUI({ theme: { extend: { borderRadius: { lg: "var(--radius)", x«k»: theme('borderRadius.lg') }, colors: { a: theme('colors.b'), b: theme('colors.c'), c: theme('colors.a'), d: theme('colors.none.x') } } } })
export default config""",
    "export default { darkMode: 'class', theme: { screens: { sm: '«k»px' }, spacing: fn({ a: '1px' }), maxWidth: { prose: 65 }, opacity: { 5: '0.05' } } } satisfies Config",
    "module.exports = require('./other')",
]
THEMES = View("themes", "part", k=K, path=f"'t' || {K} || '.js'", content=pick(K, *[text(t, k=K, h=f"lpad(CAST({K} % 100000 AS VARCHAR(9)), 5, '0')") for t in _THEMES]))
_K5 = "lpad(CAST(k % 100000 AS VARCHAR(9)), 5, '0')"


@query(
    "SELECT * FROM "
    + rows(
        (
            "k % 4 = 0",
            [
                ("path", "'colors.brand'", "'tw-brand'", f"'#1' || {_K5}", "'theme'", "'whole'"),
                ("path", "'colors.brand.500'", "'tw-brand-500'", "'#333'", "'extend'", "'whole'"),
                ("path", "'colors.brand.600'", "'tw-brand-600'", "'#444'", "'extend'", "'whole'"),
                ("path", "'colors.white'", "'tw-white'", "'#fff'", "'theme'", "'whole'"),
                ("path", "'colors.mid.deep.er'", "'tw-mid-deep-er'", f"'#0' || {_K5}", "'theme'", "'whole'"),
                ("path", "'spacing.0.5'", "'tw-spacing-0.5'", "'2px'", "'theme'", "'whole'"),
                ("path", "'spacing.4'", "'tw-spacing-4'", "k || 'px'", "'theme'", "'whole'"),
                ("path", "'spacing.8'", "'tw-spacing-8'", "k || 'px'", "'theme'", "'whole'"),
                ("path", "'spacing.16'", "'tw-spacing-16'", "'calc(' || k || 'px * 2 + ' || k || 'px)'", "'theme'", "'whole'"),
                ("path", "'fontFamily.sans'", "'tw-font-sans'", "'Inter, sans-serif'", "'extend'", "'whole'"),
                ("path", "'fontSize.lg'", "'tw-text-lg'", "'18px'", "'extend'", "'whole'"),
            ],
        ),
        (
            "k % 4 = 1",
            [
                ("path", "'borderRadius.lg'", "'tw-radius-lg'", "'var(--radius)'", "'extend'", "'whole'"),
                ("path", "'borderRadius.x' || k", "'tw-radius-x' || k", "'var(--radius)'", "'extend'", "'whole'"),
                ("path", "'colors.a'", "'tw-a'", "'theme(' || chr(39) || 'colors.b' || chr(39) || ')'", "'extend'", "'cycle'"),
                ("path", "'colors.b'", "'tw-b'", "'theme(' || chr(39) || 'colors.c' || chr(39) || ')'", "'extend'", "'cycle'"),
                ("path", "'colors.c'", "'tw-c'", "'theme(' || chr(39) || 'colors.a' || chr(39) || ')'", "'extend'", "'cycle'"),
                ("path", "'colors.d'", "'tw-d'", "'theme(' || chr(39) || 'colors.none.x' || chr(39) || ')'", "'extend'", "'missing'"),
            ],
        ),
        ("k % 4 = 2", [("path", "'screens.sm'", "'tw-screen-sm'", "k || 'px'", "'theme'", "'whole'"), ("path", "'maxWidth.prose'", "'tw-max-w-prose'", "'65'", "'theme'", "'whole'")]),
        of="themes",
        columns="path key name value origin state",
    ),
    THEMES.sql,
)
def theme_tokens(spark, d):
    return literals.theme_tokens(THEMES(spark, d))


# Groups by three rules in turn: selectors across files, then names in a file, then names in a folder; members that several rules would claim, and prefixes that aren't words.
_G = f"CAST(floor(({K} - 1) / 12) AS BIGINT)"
_I = f"({K} - 1) % 12"
_NAMED = ["Mat", "MatLabel", "MatHint", "Tab", "TabPanel", "Table", "Card", "CardBody", "Side", "SideNav", "Lone", "Tabs"]
NG = View(
    "ng", "part", f"{K} >= 1", seq=K, g=_G, i=_I,
    name=pick(_I, *[f"'{n}'" for n in _NAMED]) + f" || {_G}",
    path=f"'app' || {_G} || CASE WHEN {_I} IN (3, 4, 5, 11) THEN '/tab.ts' WHEN {_I} = 10 THEN '/x/lone.ts' ELSE '/f' || ({_I}) || '.ts' END",
    selector=f"CASE WHEN {_I} = 0 THEN 'mat' || {_G} || ', [mat]' WHEN {_I} = 1 THEN 'mat' || {_G} || '-label' WHEN {_I} = 2 THEN 'mat' || {_G} || '-hint-text' WHEN {_I} = 5 THEN 'mat' || {_G} || '-row'"
    f" WHEN {_I} = 8 THEN 'side' || {_G} WHEN {_I} = 9 THEN NULL ELSE 's' || {K} END",
)


@query(
    """+m AS (SELECT *, count(*) FILTER (WHERE i IN (1, 2, 5)) OVER (PARTITION BY g) AS below FROM ng)
SELECT name, seq, CASE WHEN i = 0 AND below > 0 OR i IN (1, 2, 5) THEN 'Mat' || g END AS "group", i = 0 AND below > 0 AS root, CASE WHEN i = 0 AND below > 0 OR i IN (1, 2, 5) THEN 'selector' END AS rule FROM m""",
    NG.sql,
)
def compounds_by_selector(spark, d):
    return components.compounds_by_rules(NG(spark, d)).select("name", "seq", "group", "root", "rule")


WORDS = ["Tab", "TabPanel", "Table", "TabPanelTitle", "Card", "CardBody", "Cardinal", "Nav", "NavItem", "Lone"]
_J = f"{K} % 10"
NAMED = View(
    "named", "part", seq=K, g=f"CAST(floor({K} / 10) AS BIGINT)", i=_J, name=pick(_J, *[f"'{n}'" for n in WORDS]),
    path=f"'lib' || CAST(floor({K} / 10) AS BIGINT) || CASE WHEN {_J} < 4 THEN '/tab.ts' WHEN {_J} = 4 THEN '/card.ts' ELSE '/f' || ({_J}) || '.ts' END", selector=f"CASE WHEN {_J} = 8 THEN NULL ELSE 'x' || {K} END",
)


@query(
    """+m AS (SELECT *, count(*) FILTER (WHERE i IN (1, 3)) OVER (PARTITION BY g) AS tabs, count(*) FILTER (WHERE i = 0) OVER (PARTITION BY g) AS tab, count(*) FILTER (WHERE i = 3) OVER (PARTITION BY g) AS titles,
  count(*) FILTER (WHERE i = 1) OVER (PARTITION BY g) AS panels, count(*) FILTER (WHERE i = 5) OVER (PARTITION BY g) AS bodies, count(*) FILTER (WHERE i = 4) OVER (PARTITION BY g) AS cards FROM named),
r AS (SELECT *, CASE WHEN i <= 3 AND tab > 0 AND tabs > 0 THEN 'Tab' WHEN i IN (1, 3) AND tab = 0 AND panels > 0 AND titles > 0 THEN 'TabPanel' WHEN i BETWEEN 4 AND 6 AND cards > 0 AND bodies > 0 THEN 'Card' END AS x FROM m)
SELECT name, seq, x AS "group", coalesce(name = x, false) AS root, CASE WHEN x IS NULL THEN NULL WHEN i <= 3 THEN 'file' ELSE 'folder' END AS rule FROM r""",
    NAMED.sql,
)
def compounds_by_name(spark, d):
    return components.compounds_by_rules(NAMED(spark, d)).select("name", "seq", "group", "root", "rule")


# Design files: one set with every fault of variants, one that is right, single components, sets in sets.
_DESIGNS = [
    """{"components": {"1:«k»": {"key": "key«k»", "description": "Fine", "remote": true}, "1:2": {"key": "c", "description": " "}}, "document": {"children": [{"name": "Page", "children": [
{"id": "1:«k»", "name": "Button", "type": "COMPONENT_SET", "boundVariables": {"fills": 1}, "componentPropertyDefinitions": {"Size": {"type": "VARIANT", "variantOptions": ["sm", "md", "lg"], "defaultValue": "sm"},
 "Tone": {"type": "VARIANT", "variantOptions": ["Primary", "Secondary"], "defaultValue": "Primary"}, "Show icon": {"type": "BOOLEAN", "defaultValue": true}},
 "children": [{"id": "1:2", "name": "Size=sm, Tone=Primary", "type": "COMPONENT"}, {"id": "1:3", "name": "Size=md, Tone=Secondary", "type": "COMPONENT"}]}]}]}}""",
    """{"document": {"children": [{"name": "Other", "children": [{"id": "no", "name": "X", "type": "COMPONENT"}]}, {"name": "Components", "children": [{"name": "Frame", "type": "FRAME", "children": [{"name": "Row", "type": "FRAME", "children": [
{"id": "2:1", "name": "_Deprecated/Chip", "type": "COMPONENT_SET", "componentPropertyDefinitions": {"state": {"type": "VARIANT", "variantOptions": ["on", "off"]}, "kind-of": {"type": "VARIANT", "variantOptions": ["lg", "sm", "a/b"]},
 "size": {"type": "VARIANT", "variantOptions": ["lg", "sm"]}, "ref": {"type": "TEXT"}, "Ref": {"type": "TEXT"}, "isOn": {"type": "BOOLEAN"}, "withX#1:2": {"type": "BOOLEAN"}},
 "children": [{"id": "2:2", "name": "State=on, size=LG", "type": "COMPONENT"}, {"id": "2:3", "name": "state=maybe, size=sm, more=1", "type": "COMPONENT"}, {"id": "2:4", "name": "Inner", "type": "COMPONENT_SET", "children": []}]},
{"id": "2:5", "name": ".slot", "type": "COMPONENT"}]}]}]}]}}""",
    """{"document": {"children": [{"name": "P", "children": [{"id": "3:«k»", "name": "Levels", "type": "COMPONENT_SET", "componentPropertyDefinitions": {"Level": {"type": "VARIANT", "variantOptions": ["1", "2", "x"]}}, "children": [{"id": "3:0", "name": "Level=1", "type": "COMPONENT"}]}]}]}}""",
    """{"document": """,
]
DESIGNS = View("designs", "part", k=K, path=f"'d' || {K} || '.json'", content=pick(K, *[text(t, k=K) for t in _DESIGNS]))


def _tagged(when: str, *of: tuple[str, str]) -> tuple:
    return when, [("path", i, t if t.startswith("'") else f"'{t}'") for i, all_ in of for t in re.split(r"(?<!\|)\|(?!\|)", all_)]


_TAGS = rows(
    _tagged(
        "k % 4 = 0",
        ("'1:' || k", "component-set|variant-value-inconsistency|incomplete-variant-matrix|orphan-variant-definitions|published|semantic-hierarchy-variants|uses-variables|size-progression"),
        ("'1:' || k", "default-variant:Size=sm, Tone=Primary|'component-key:key' || k|hierarchy:Button|variant-complexity:6|visibility-toggles:1|variant-dimension:Size[3]|variant-dimension:Tone[2]"),
        ("'1:2'", "missing-description|component-key:c|hierarchy:Button/Size=sm, Tone=Primary|containing-frame:Button"),
        ("'1:3'", "hierarchy:Button/Size=md, Tone=Secondary|containing-frame:Button"),
    ),
    ("k % 4 = 0", [("path", i, "'parent-component-set:1:' || k") for i in ("'1:2'", "'1:3'")]),
    _tagged(
        "k % 4 = 1",
        ("'2:1'", "component-set|naming-inconsistency|mixed-naming-convention|incomplete-variant-matrix|undefined-variant-values|orphan-variant-definitions|undefined-variant-property|variant-value-case-mismatch"),
        ("'2:1'", "duplicate-property-name|deprecated|reserved-property-name|special-char-variant-values|boolean-variant-antipattern|inconsistent-boolean-naming|exposes-nested-properties|unordered-size-variants"),
        ("'2:1'", "hierarchy:Frame/Row/_Deprecated/Chip|variant-complexity:12|depth:3|containing-frame:Row|variant-dimension:state[2]|variant-dimension:kind-of[3]|variant-dimension:size[2]"),
        ("'2:2'", "hierarchy:Frame/Row/_Deprecated/Chip/State=on, size=LG|depth:4|containing-frame:_Deprecated/Chip|parent-component-set:2:1"),
        ("'2:3'", "hierarchy:Frame/Row/_Deprecated/Chip/state=maybe, size=sm, more=1|depth:4|containing-frame:_Deprecated/Chip|parent-component-set:2:1"),
        ("'2:4'", "component-set|empty-component-set|nested-component-set|hierarchy:Frame/Row/_Deprecated/Chip/Inner|depth:4|containing-frame:_Deprecated/Chip"),
        ("'2:5'", "slot-component|hierarchy:Frame/Row/.slot|depth:3|containing-frame:Row"),
    ),
    _tagged(
        "k % 4 = 2",
        ("'3:' || k", "component-set|incomplete-variant-matrix|orphan-variant-definitions|numeric-variant-values|single-variant|hierarchy:Levels|variant-complexity:3|variant-dimension:Level[3]"),
        ("'3:0'", "hierarchy:Levels/Level=1|containing-frame:Levels|'parent-component-set:3:' || k"),
    ),
    of="designs",
    columns="path id tag",
)


@query(f"SELECT * FROM {_TAGS}", DESIGNS.sql)
def design_tags(spark, d):
    return design.tags(design.components(DESIGNS(spark, d))[0])


@query("SELECT path, 'PARSE_ERROR' AS code FROM designs WHERE k % 4 = 3", DESIGNS.sql)
def design_errors(spark, d):
    return design.components(DESIGNS(spark, d))[1].drop("message")


# Styles by syntax family, from one scan.
_STYLED = [
    (".tsx", """<div style={{ color: '#a«h»', marginTop: «k», opacity: 0.5, "--gap": '4px', ...rest, width: w }} className="x">
<p style="padding: 3px; top:«k»px" /></div>"""),
    (".vue", """<template><b :style="{ fontSize: '«k»px', color: dark ? 'a' : 'b' }" style='left: 1px'/></template>
<style scoped>
.a:hover { color: #b«h»; /* margin: 9px; */ }
.b { gap: «k»px }
</style>"""),
    (".component.html", """<i [style.width.px]="«k»" [style.color]="'#c«h»'" [ngStyle]="{ 'row-gap': '2px' }"></i> <!-- <i style="margin: 7px"> -->"""),
    (".svelte", """<u style:color="#d«h»" style:--x={'«k»px'} style:margin={m} style="height:1rem"></u>"""),
    (".html", """<a style="color:#e«h»">{{ style={{ color: 'no' }} }}</a>"""),
    (".scss", """$x: 1px;
.a { padding: «k»px; &:hover { color: #f«h» } }"""),
    (".css", """.only { margin: 0 }"""),
]
_H5 = f"lpad(CAST({K} % 100000 AS VARCHAR(9)), 5, '0')"
STYLED = View(
    "styled", "part", k=K, path=f"'s' || {K} || " + pick(K, *[f"'{e}'" for e, _ in _STYLED]), content=pick(K, *[text(t, k=K, h=_H5) for _, t in _STYLED]), h=_H5,
)
_STYLES = [
    ("jsx", [(1, "object", "color", "'#a' || h"), (1, "object", "margin-top", "CASE WHEN k = 0 THEN '0' ELSE k || 'px' END"), (1, "object", "opacity", "'0.5'"), (1, "object", "--gap", "'4px'"), (2, "attribute", "padding", "'3px'"), (2, "attribute", "top", "k || 'px'")]),
    ("vue", [(1, "object", "font-size", "k || 'px'"), (1, "attribute", "left", "'1px'"), (2, "block", "color", "'#b' || h"), (2, "block", "gap", "k || 'px'")]),
    ("angular", [(1, "binding", "width", "k || 'px'"), (1, "binding", "color", "'#c' || h"), (1, "object", "row-gap", "'2px'")]),
    ("svelte", [(1, "binding", "color", "'#d' || h"), (1, "binding", "--x", "k || 'px'"), (1, "attribute", "height", "'1rem'")]),
    ("html", [(1, "attribute", "color", "'#e' || h")]),
    ("css", [(1, "file", "padding", "k || 'px'"), (1, "file", "color", "'#f' || h")]),
    ("css", [(1, "file", "margin", "'0'")]),
]
_STYLE_ROWS = rows(
    *[(f"k % 7 = {n}", [("path", f"'{kind}'", str(line), f"'{form}'", f"'{name}'", value) for line, form, name, value in found]) for n, (kind, found) in enumerate(_STYLES)],
    of="styled",
    columns="path family line form property value",
)


@query(f"SELECT * FROM {_STYLE_ROWS}", STYLED.sql)
def dispatched_styles(spark, d):
    return dispatch.declarations(dispatch.scanned(STYLED(spark, d)))


@query(f"SELECT family, form, count(DISTINCT path) AS files, count(*) AS declarations FROM {_STYLE_ROWS} GROUP BY ALL", STYLED.sql)
def dispatch_summary(spark, d):
    return dispatch.summary(STYLED(spark, d))


# A plugin's sink and source: signals written by many tasks with one commit, and read back a task a file.
SIGNALS = View("own_signals", "part", id=f"'s' || {K}", line=K, message="p_name", severity=pick(K, "'info'", "'warning'", "NULL"))


@query("SELECT id, line, message, severity FROM own_signals", SIGNALS.sql)
def plugin_signals(spark, d):
    plugins.install(spark, plugins.folder("chromatid-folder"))
    signals = SIGNALS(spark, d).repartition(4, "id")
    path, schema = f"{shared_folder(spark).rstrip('/')}/signals-{uuid.uuid4().hex}", signals._jdf.schema().toDDL()
    signals.write.format("chromatid-folder").mode("append").option("path", path).option("schema", schema).save()
    return spark.read.format("chromatid-folder").option("path", path).option("schema", schema).load()


# What all pairs would say, as classes: variants of a component that differ, duplicates, examples of production components.
MANY = View(
    "many", "part", id=K, seq=K, name=f"'N' || ({K} % 7)", tone=pick(K, "'red'", "'red'", "'blue'"), size=f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE 's' || ({K} % 2) END", same="'x'",
)
_FIELDS = " UNION ALL ".join(f"SELECT id, name, '{f}' AS field, {f} AS value FROM many WHERE {f} IS NOT NULL" for f in ("tone", "size", "same"))


@query(
    f"""+f AS ({_FIELDS}), t AS (SELECT name, count(*) AS variants FROM many GROUP BY 1), h AS (SELECT name, field, value, count(*) AS members, min(id) AS first_id FROM f GROUP BY ALL),
s AS (SELECT name, field, sum(members)::BIGINT AS n FROM h GROUP BY ALL), a AS (SELECT * FROM h UNION ALL SELECT name, field, NULL, variants - n, NULL FROM s JOIN t USING (name) WHERE variants > n),
c AS (SELECT name, field, count(*) AS classes FROM a GROUP BY ALL HAVING count(*) > 1) SELECT a.*, classes FROM a JOIN c USING (name, field)""",
    MANY.sql,
)
def variant_classes(spark, d):
    m = MANY(spark, d)
    fields = m.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("tone", "size", "same")])).alias("f")).select("id", "f.*")
    return detect.variant_classes(m.select("id", "name"), fields.where("value is not null"))


VERSIONS = View("versions", "part", id=K, seq=K, name=f"'Name' || chr(CAST(97 + {K} % 26 AS INT)) || CASE {K} % 5 WHEN 0 THEN 'New' WHEN 1 THEN 'Old' WHEN 2 THEN 'V2' ELSE '' END")


@query(
    """+n AS (SELECT *, lower(regexp_replace(name, '(New|V2|Old)$', '')) AS base, regexp_matches(name, '(New|V2|Old)$') AS version FROM versions),
s AS (SELECT base, count(*) AS n, count(*) FILTER (WHERE version) AS v, min(seq) AS first, arg_min(version, seq) AS fv FROM n GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (WHERE version) > 0)
SELECT n.base, id, CASE WHEN fv THEN seq = first ELSE NOT version END AS head, version FROM n JOIN s ON s.base = n.base""",
    VERSIONS.sql,
)
def duplicate_classes(spark, d):
    return match.duplicate_classes(VERSIONS(spark, d))


_KIND = "CASE WHEN p_type < 'M' THEN 'production' WHEN p_type < 'S' THEN 'example' ELSE 'test' END"
SHOWN = View("shown_parts", "part", id=K, name="p_name", context=_KIND)


@query(
    """SELECT lower(name) AS key, count(*) FILTER (WHERE context = 'production') AS production, count(*) FILTER (WHERE context = 'example') AS examples,
min(id) FILTER (WHERE context = 'production') AS first_production, min(id) FILTER (WHERE context = 'example') AS first_example FROM shown_parts GROUP BY 1
HAVING count(*) FILTER (WHERE context = 'production') > 0 AND count(*) FILTER (WHERE context = 'example') > 0""",
    SHOWN.sql,
)
def example_classes(spark, d):
    return search.example_classes(SHOWN(spark, d))


# Classes that depend on what is around them, dynamic ones and render props.
_SELECTORS = [
    """<div data-slot="card-«k»" className="data-[state=open]:p-1 group-data-[size]/g«k»:m-2 has-data-[x]:y *:data-[slot=a]:w-4 data-closed:opacity-0 group-data-open:h-[1px]">
ui-active:bg-x ui-not-focus-visible:ring-2 group/menu peer-hover/name«k»:text-x @container/main @md/main:flex data-value={v«k» + 1}""",
    """[&_p]:mt-«k» [&>svg]:size-4 [&_[data-x=y]]:p-2 [.dark]:bg-b aria-invalid:ring-1 md:group-aria-expanded:rotate-180 **:data-[part]:!p-0 data-[a]:*:[b]:z-1
no-data- [x] aria-none:x group-«k»""",
]
SELECTORS = View("selectors", "part", k=K, path=f"'q' || {K} || '.tsx'", content=pick(K, *[text(t, k=K) for t in _SELECTORS]))


def _selected(line: int, *of: str) -> list[tuple]:
    """Rows of ``form kind name value target``; - is '', and «k» the key."""
    return [("path", str(line), *["''" if w == "-" else text(w, k="k") for w in row.split(" ")]) for row in of]


@query(
    "SELECT * FROM "
    + rows(
        (
            "k % 2 = 0",
            _selected(
                1, "slot - card-«k» - -", "data data- state open -", "data group-data- size - g«k»", "data has-data- x - -", "data *:data- slot a -", "wildcard * slot a w-4",
                "data-short data- closed - opacity-0", "data-short group-data- open - h-[1px]",
            )
            + _selected(
                2, "headless ui active - bg-x", "headless ui not-focus-visible - ring-2", "named group menu - -", "named-state peer name«k» hover text-x", "named @container main - -",
                "container md main - flex",
            )
            + [("path", "2", "'data-dynamic'", "''", "'value'", "'v' || k || ' + 1'", "''")],
        ),
        (
            "k % 2 = 1",
            _selected(
                1, "child _ p - mt-«k»", "child > svg - size-4", "child-attribute - [data-x=y] - p-2", "parent - dark - bg-b", "aria aria invalid - ring-1", "aria group-aria expanded md rotate-180",
                "wildcard ** part - !p-0", "wildcard-within * [b] - z-1", "data data- a - -",
            ),
        ),
        of="selectors",
        columns="path line form kind name value target",
    ),
    SELECTORS.sql,
)
def selector_classes(spark, d):
    return classes.selector_classes(SELECTORS(spark, d))


_DYNAMIC = [
    "<div className={`btn-${size} b«k»`} /><b className={`static`} /><i className=\"x\" />",
    """<b className={clsx(base, on && `${prefix}-«k»`, {
  a: 1 })} />
<b className={
  cn("x", `t-${props.size || 'md'}`, `u-${f(`in-${deep}`)}-v`)} />""",
    """<b className={isOn ? `${p}-on` : `${p}-off-«k»`} class={`${a} ${a}-${b}`}>
<b className={`open-${x}""",
]
DYNAMIC = View("dynamic", "part", k=K, path=f"'y' || {K} || '.tsx'", content=pick(K, *[text(t, k=K) for t in _DYNAMIC]))


@query(
    "SELECT * FROM "
    + rows(
        ("k % 3 = 0", [("path", "1", "'template-literal'", "'btn-{size} b' || k", "'size'", "'btn-| b' || k")]),
        (
            "k % 3 = 1",
            [
                ("path", "1", "'clsx'", "'{prefix}-' || k", "'prefix'", "'-' || k"),
                ("path", "4", "'classnames'", "'t-{props.size || ' || chr(39) || 'md' || chr(39) || '}'", "'props.size || ' || chr(39) || 'md' || chr(39)", "'t-'"),
                ("path", "4", "'classnames'", "'u-{f(`in-' || chr(36) || '{deep}`)}-v'", "'f(`in-' || chr(36) || '{deep}`)'", "'u-|-v'"),
            ],
        ),
        (
            "k % 3 = 2",
            [
                ("path", "1", "'conditional'", "'{p}-on'", "'p'", "'-on'"),
                ("path", "1", "'conditional'", "'{p}-off-' || k", "'p'", "'-off-' || k"),
                ("path", "1", "'template-literal'", "'{a} {a}-{b}'", "'a,b'", "'-'"),
            ],
        ),
        of="dynamic",
        columns="path line context structure variables parts",
    ),
    DYNAMIC.sql,
)
def dynamic_forms(spark, d):
    return classes.dynamic_forms(DYNAMIC(spark, d)).withColumn("variables", F.array_join("variables", ",")).withColumn("parts", F.array_join("parts", "|"))


_RENDER = [
    """<Tab className={({ selected, active }) => classNames("px-«k» py-1", selected ? "bg-a b" : 'bg-c', active && `ring-1`, !active && "no", other ? "x" : "y")} />""",
    """<Tab
  className={({ open }) => cn(
    'w-full',
    open ? "r«k»" : "")} className={({ a }) => a} className={cn("z")} />""",
]
RENDER = View("render", "part", k=K, path=f"'r' || {K} || '.tsx'", content=pick(K, *[text(t, k=K) for t in _RENDER]))


@query(
    "SELECT * FROM "
    + rows(
        (
            "k % 2 = 0",
            [
                ("path", "1", "'classNames'", c, b_, n)
                for c, b_, n in (
                    ("NULL", "'static'", "'px-' || k"), ("NULL", "'static'", "'py-1'"), ("'selected'", "'true'", "'bg-a'"), ("'selected'", "'true'", "'b'"), ("'selected'", "'false'", "'bg-c'"),
                    ("'active'", "'true'", "'ring-1'"), ("NULL", "'static'", "'no'"), ("NULL", "'static'", "'x'"), ("NULL", "'static'", "'y'"),
                )
            ],
        ),
        ("k % 2 = 1", [("path", "2", "'cn'", "NULL", "'static'", "'w-full'"), ("path", "2", "'cn'", "'open'", "'true'", "'r' || k")]),
        of="render",
        columns="path line helper condition branch class",
    ),
    RENDER.sql,
)
def render_prop_classes(spark, d):
    return classes.render_props(RENDER(spark, d)).drop("parameters")


# Functions and searches over the tables' own names and values.
_SHARE = "least(length(p_name), 5) / greatest(length(p_name), 5)"


@query(
    f"""+s AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'linen' THEN 100.0 WHEN contains(lower(p_name), 'linen') OR contains('linen', lower(p_name)) THEN 70 + 50 * {_SHARE}
  ELSE greatest(0, (1 - levenshtein(lower(p_name), 'linen') / greatest(length(p_name), 5)) * 100 - 20) END AS score FROM part) SELECT id, name, round(score, 6) AS score FROM s WHERE score >= 5""",
    "z AS (SELECT 1)",
)
def search_tokens_by_name(spark, d):
    t = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.tokens_by_name(t, "linen", least=5).withColumn("score", F.round("score", 6))


CONTROLS = View("controls", "part", id=K, name=pick(K, "'IconButton'", "'NavLink'", "'Card'", "'SELECT'", "'checkboxGroup'", "'Radical'", "'Radio' || p_size", "p_name"))


@query("SELECT id, regexp_matches(lower(name), 'button|link|input|select|checkbox|radio') AS interactive FROM controls", CONTROLS.sql)
def interactive_names(spark, d):
    return CONTROLS(spark, d).select("id", strings.is_interactive(F.col("name")).alias("interactive"))


@query("SELECT p_partkey AS id, CASE WHEN p_size * 2 + p_partkey % 3 >= 100 THEN 'exact' WHEN p_size * 2 + p_partkey % 3 >= 95 THEN 'high' WHEN p_size * 2 + p_partkey % 3 >= 70 THEN 'medium' ELSE 'low' END AS level FROM part")
def confidence_levels(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), colors.confidence_level(F.expr("p_size * 2 + p_partkey % 3")).alias("level"))


ID_PARTS = View("id_parts", "part", id=K, kind=pick(K, "'Component'", "'Token'"), key="p_name", path="p_brand", line="p_size", value="p_type")


@query(
    "SELECT id, lower(kind) || ':' || key AS node, lower(kind) || ':' || path || ':' || key AS edge, kind || ':' || path || ':' || line || ':' || substr(value, 1, 20) AS signal, substr(sha256(key), 1, 16) AS sha FROM id_parts",
    ID_PARTS.sql,
)
def built_ids(spark, d):
    c = {n: F.col(n) for n in ("kind", "key", "path", "line", "value")}
    made = {"node": ids.node_id(c["kind"], c["key"]), "edge": ids.edge_id(c["kind"], c["path"], c["key"]), "signal": ids.signal_id(c["kind"], c["path"], c["line"], c["value"]), "sha": ids.short_sha(c["key"])}
    return ID_PARTS(spark, d).select("id", *[e.alias(n) for n, e in made.items()])


TYPED = View(
    "typed", "part", id=K, kind=pick(K, "'color'", "'spacing'", "'raw'"), hex=f"'#AB' || lpad(CAST({K} % 50 AS VARCHAR(9)), 4, '0')", number=f"CAST({K} % 40 AS DOUBLE)", unit=pick(K, "'px'", "'rem'"), raw=f"'r' || ({K} % 9)",
)


@query(
    "SELECT value, count(*) AS tokens, min(id) AS first FROM (SELECT id, CASE kind WHEN 'color' THEN 'color:' || lower(hex) WHEN 'spacing' THEN 'spacing:' || number || unit ELSE kind || ':' || raw END AS value FROM typed) GROUP BY value HAVING count(*) > 1",
    TYPED.sql,
)
def equal_tokens(spark, d):
    value = schemas.token_value_key(F.col("kind"), F.col("hex"), F.col("number"), F.col("unit"), F.col("raw"))
    return TYPED(spark, d).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("tokens"), F.min("id").alias("first")).where("tokens > 1")


SVELTE = View(
    "svelte", "part", k=K, path=f"'C' || {K} || '.svelte'",
    content=pick(K, text("<script lang=\"ts\">\n  export let name«k»: string;\n  export let on = true;\n  let inner = 1;\n</script>", k=K), text("<script>\n  const export_ = 1;\nexport let $x«k»\n</script>", k=K)),
)


@query("SELECT path, unnest(CASE WHEN k % 2 = 0 THEN ['name' || k, 'on'] ELSE [chr(36) || 'x' || k] END) AS name FROM svelte", SVELTE.sql)
def declared_svelte(spark, d):
    return components.declared(SVELTE(spark, d), "svelte").select("path", "name")


PLACES = View("places", "part", k=K, path=pick(K, f"'packages/ui/src/a' || {K} || '.ts'", f"'apps/web/src/x/b' || {K} || '.ts'", f"'src/c' || {K} || '.ts'", f"'packages/@s/p/src/d' || {K} || '.ts'", f"'libs/x/lib/e' || {K} || '.ts'"))


@query("SELECT path FROM places WHERE k % 5 IN (0, 1, 3)", PLACES.sql)
def monorepo_files(spark, d):
    return files.discover(PLACES(spark, d), files.MONOREPO_PATTERNS, []).select("path")


SEEN = View("seen", "lineitem", path="'src/f' || (l_partkey % 50) || '.css'", line="l_linenumber", value="'#00' || lpad(CAST(l_suppkey % 40 AS VARCHAR(9)), 4, '0')", property=pick("l_partkey", "'color'", "'margin'"))


@query("SELECT path, line, value, count(*) AS n FROM seen WHERE property = 'color' GROUP BY ALL", SEEN.sql)
def repeated_signals(spark, d):
    """How often each raw signal's id was seen, over all of lineitem: what deduplication leaves is one row each."""
    s = SEEN(spark, d).where("property = 'color'")
    each = s.groupBy("path", "line", "value").agg(F.count(F.lit(1)).alias("n"))
    kept = s.withColumn("id", ids.signal_id(F.lit("color-value"), F.col("path"), F.col("line"), F.col("value"))).dropDuplicates(["id"])
    return kept.select("path", "line", "value").join(each, ["path", "line", "value"])


# Report views, context files, repositories, naming options.
DRIFT = View("drift", "lineitem", type=pick("l_partkey", "'hardcoded-value'", "'naming-inconsistency'", "'unused-token'"), entity_name="'E' || (l_suppkey % 40)", severity=pick("l_linenumber", "'info'", "'warning'", "'critical'"), message="'m' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity", seq="l_orderkey * 10 + l_linenumber")
OWNERS = View("owners", "supplier", entity_name="'E' || s_suppkey", team="'T' || (s_suppkey % 6)")
USES = View("uses", "part", f"{K} < 40", name=f"'E' || {K}", uses=f"({K} * 37 + 5) % 900 + 1500")
WORK = View("work", "orders", path="'src/' || (o_orderkey % 300) || '.tsx'", component="'E' || (o_orderkey % 50)", author="'d' || (o_custkey % 7)")
_RATED = """h AS (SELECT name, floor(100 * greatest(0, uses - coalesce(n, 0)) / uses + 0.5)::INT AS health FROM uses LEFT JOIN (SELECT entity_name, count(*) AS n FROM drift GROUP BY 1) d ON name = entity_name),
c AS (SELECT *, CASE WHEN health >= 90 THEN 'healthy' WHEN health < 50 THEN 'critical' WHEN health < 70 THEN 'attention' ELSE 'fair' END AS category FROM h)"""


@query(f"+{_RATED} SELECT * FROM c", DRIFT.sql, USES.sql)
def component_health(spark, d):
    return views.health(DRIFT(spark, d), USES(spark, d))


@query(
    f"""+{_RATED}, t AS (SELECT 'type' AS section, type AS name, count(*) AS value FROM drift GROUP BY type UNION ALL SELECT 'team', team, count(*) FROM drift JOIN owners USING (entity_name) GROUP BY team),
r AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY value DESC, name)::INT AS rank, name, value FROM t
  UNION ALL SELECT category, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN category = 'healthy' THEN -health ELSE health END, name)::INT, name, health FROM c WHERE category <> 'fair')
SELECT section, rank, name, value::VARCHAR AS value FROM r WHERE rank <= CASE section WHEN 'type' THEN 5 WHEN 'team' THEN 5 WHEN 'critical' THEN 2 ELSE 4 END""",
    DRIFT.sql, OWNERS.sql, USES.sql,
)
def team_dashboard(spark, d):
    return views.team_dashboard(DRIFT(spark, d), OWNERS(spark, d), USES(spark, d))


@query(
    """+m AS (SELECT * FROM work WHERE author = 'd3'), n AS (SELECT DISTINCT component AS name FROM m), a AS (SELECT entity_name AS name, count(*) AS n FROM drift GROUP BY 1),
e AS (SELECT author, sum(coalesce(n, 0)) AS n, count(*) AS of FROM (SELECT DISTINCT author, component AS name FROM work) LEFT JOIN a USING (name) GROUP BY author)
SELECT 'changes' AS section, 1 AS rank, 'files' AS name, count(DISTINCT path)::VARCHAR AS value FROM m UNION ALL SELECT 'changes', 2, 'components', count(DISTINCT component)::VARCHAR FROM m
UNION ALL SELECT * FROM (SELECT 'component', row_number() OVER (ORDER BY name)::INT AS r, name, CASE WHEN n IS NULL THEN 'clean' ELSE 'drift' END FROM n LEFT JOIN a USING (name)) WHERE r <= 3
UNION ALL SELECT * FROM (SELECT 'action', row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, seq, message)::INT AS r, entity_name, message FROM drift WHERE entity_name IN (SELECT name FROM n)) WHERE r <= 3
UNION ALL SELECT 'rate', 1, 'own', format('{:.4f}', (SELECT round(n / of, 4) FROM e WHERE author = 'd3')) UNION ALL SELECT 'rate', 2, 'team', format('{:.4f}', (SELECT round(sum(n) / sum(of), 4) FROM e))""",
    DRIFT.sql, WORK.sql,
)
def developer_brief(spark, d):
    return views.developer_brief(DRIFT(spark, d), WORK(spark, d), "d3")


KITS = View("kits", "part", framework=pick("p_size", "'react'", "'vue'", "'svelte'"), name="p_name")
VALUES = View("own_values", "part", category=pick("p_size", "'color'", "'spacing'"), name=f"'t' || {K}", value=f"'v' || {K}")


@query(
    """+k AS (SELECT DISTINCT framework AS key, name, chr(96) || name || chr(96) AS x FROM kits), v AS (SELECT category AS key, name, chr(96) || name || chr(96) || ' (' || value || ')' AS x FROM own_values),
l AS (SELECT 'components' AS section, * FROM k UNION ALL SELECT 'tokens', * FROM v), n AS (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY name) AS nth FROM l),
g AS (SELECT section, key, count(*) AS n, string_agg(x, ', ' ORDER BY nth) FILTER (WHERE nth <= 20) AS x FROM n GROUP BY ALL)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY key)::INT AS rank, '- **' || key || '**: ' || x || CASE WHEN n > 20 THEN ' and ' || (n - 20) || ' more' ELSE '' END AS line FROM g
UNION ALL SELECT 'avoid', row_number() OVER (ORDER BY n DESC, type)::INT, '- ' || type || ' (' || n || ' found)' FROM (SELECT type, count(*) AS n FROM drift GROUP BY type)""",
    DRIFT.sql, KITS.sql, VALUES.sql,
)
def context_lines(spark, d):
    return views.context_lines(KITS(spark, d), VALUES(spark, d), DRIFT(spark, d))


@query("SELECT kind, name, CASE kind WHEN 'Component' THEN '^[A-Z]' ELSE '^tk-' END AS expected FROM (SELECT kind, CASE WHEN id % 3 = 0 THEN 'Xy' || id ELSE 'tk-' || id END AS name FROM id_parts) WHERE (kind = 'Component') <> starts_with(name, 'Xy')", ID_PARTS.sql)
def names_off_convention(spark, d):
    names = ID_PARTS(spark, d).select("kind", F.expr("CASE WHEN id % 3 = 0 THEN 'Xy' || id ELSE 'tk-' || id END").alias("name"))
    return views.off_convention(names, {"Component": "^[A-Z]", "Token": "^tk-"})


_CONFIG = """[core]
	bare = false
[remote "fork"]
	url = git@no:x.git
[remote "origin"]
	fetch = +refs/heads/*
	url = https://git.example.org/r«k».git
[branch "main"]
	remote = origin"""
REFS = View(
    "refs", "part", root=f"'r' || CAST(floor({K} / 2) AS BIGINT)", k=f"CAST(floor({K} / 2) AS BIGINT)", path=pick(K, "'HEAD'", "'config'"),
    content=pick(K, f"CASE WHEN CAST(floor({K} / 2) AS BIGINT) % 3 = 0 THEN '0123abcd' ELSE 'ref: refs/heads/feature/x' || CAST(floor({K} / 2) AS BIGINT) || chr(10) END", f"CASE WHEN CAST(floor({K} / 2) AS BIGINT) % 5 = 0 THEN '[core]' ELSE {text(_CONFIG, k=f'CAST(floor({K} / 2) AS BIGINT)')} END"),
)


@query("SELECT root, max(CASE WHEN path = 'HEAD' THEN CASE WHEN k % 3 = 0 THEN 'HEAD' ELSE 'feature/x' || k END END) AS branch, max(CASE WHEN path = 'config' AND k % 5 <> 0 THEN 'https://git.example.org/r' || k || '.git' END) AS remote FROM refs GROUP BY root", REFS.sql)
def repositories(spark, d):
    return views.repository(REFS(spark, d))
