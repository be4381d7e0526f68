"""Projects of a source tree: each file's nearest manifest, workspaces and their members, and the frameworks that manifests and config files tell of.

Files are (path, content), paths relative to the tree. Folders are strings without a slash at the end; the tree itself is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What tells of a framework, in order: (name, scanner or plugin, packages, config files as a pattern of their path within the project).
FRAMEWORKS = [
    ("react", "react", "react react-dom", None),
    ("next", "nextjs", "next", None),
    ("remix", "react", "@remix-run/react", None),
    ("gatsby", "react", "gatsby", None),
    ("vue", "vue", "vue", None),
    ("nuxt", "vue", "nuxt nuxt3", None),
    ("svelte", "svelte", "svelte", None),
    ("sveltekit", "svelte", "@sveltejs/kit", None),
    ("angular", "angular", "@angular/core", None),
    ("lit", "webcomponents", "lit lit-element", None),
    ("stencil", "webcomponents", "@stencil/core", None),
    ("astro", "astro", "astro", None),
    ("tailwind", "tailwind", "tailwindcss", r"^tailwind\.config\.[^/]*$"),
    ("figma", "figma", None, r"^(\.figmarc|figma\.config\.[^/]*)$"),
    ("storybook", "storybook", "@storybook/react @storybook/vue3 @storybook/svelte", r"^\.storybook/.+$"),
]
# Workspace globs of tools that name none.
NX_GLOBS, DEFAULT_GLOBS = ["apps/*", "libs/*", "packages/*"], ["packages/*"]


def folder(path: Column | str) -> Column:
    """The folder that a path is in."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def above(of: Column | str) -> Column:
    """A folder and all above it, the tree itself included."""
    parts = F.filter(F.split(of, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def manifests(files: DataFrame) -> DataFrame:
    """(root, name, packages, workspaces) of every package.json: its folder, its name or the folder's, dependencies of both kinds, and workspace globs (null if it has none); what isn't JSON is none."""
    m = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("root", folder("path"))
    j = F.from_json("content", "name string, dependencies map<string,string>, devDependencies map<string,string>, workspaces string")
    m = m.where(F.get_json_object("content", "$").isNotNull()).select("root", j.alias("j"))
    keys = [F.coalesce(F.map_keys(f"j.{c}"), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies")]
    given = F.coalesce(F.from_json("j.workspaces", "array<string>"), F.from_json("j.workspaces", "packages array<string>")["packages"])
    name = F.coalesce("j.name", F.substring_index("root", "/", -1))
    return m.select("root", name.alias("name"), F.array_sort(F.array_union(*keys)).alias("packages"), F.when(F.size(given) > 0, given).alias("workspaces"))


def nearest(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root) of files with their nearest root (root) at or above their folder; null where there is none.

    Folders look for their root once, by an equi-join of all folders above them; files then join by folder.
    """
    f = files.select("path", folder("path").alias("folder"))
    steps = f.select("folder").distinct().select("folder", F.explode(above("folder")).alias("root"))
    found = steps.join(roots.select("root").distinct(), "root").groupBy("folder").agg(F.max_by("root", F.char_length("root")).alias("root"))
    return f.join(found, "folder", "left").select("path", "root")


def _list_of(yaml: Column | str) -> Column:
    """The entries of the list under ``packages:`` of a YAML text."""
    block = F.regexp_extract(yaml, r"(?m)^packages:[ \t]*(?:#.*)?\n((?:[ \t]*(?:-.*|#.*)?(?:\n|\z))*)", 1)
    return F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*['\"]?([^'\"#\s]+)"), F.lit(1))


def workspaces(files: DataFrame) -> DataFrame:
    """(root, tool, globs) of folders with workspaces; of several tools in a folder the first of pnpm, lerna, nx and package.json tells (as turborepo or yarn, by their files, else npm)."""
    at = files.withColumn("root", folder("path")).withColumn("file", F.substring_index("path", "/", -1))
    has = at.where(F.col("file").isin("turbo.json", "yarn.lock")).groupBy("root").agg(F.bool_or(F.col("file") == "turbo.json").alias("turbo"), F.bool_or(F.col("file") == "yarn.lock").alias("yarn"))
    told = at.where("file = 'pnpm-workspace.yaml'").select("root", F.lit(0).alias("k"), F.lit("pnpm").alias("tool"), _list_of("content").alias("globs"))
    lerna = F.coalesce(F.from_json(F.get_json_object("content", "$.packages"), "array<string>"), F.array(*[F.lit(g) for g in DEFAULT_GLOBS]))
    told = told.union(at.where("file = 'lerna.json'").select("root", F.lit(1), F.lit("lerna"), lerna))
    told = told.union(at.where("file = 'nx.json'").select("root", F.lit(2), F.lit("nx"), F.array(*[F.lit(g) for g in NX_GLOBS])))
    own = manifests(files).where("workspaces is not null").join(has, "root", "left")
    tool = F.when(F.col("turbo"), "turborepo").when(F.col("yarn"), "yarn").otherwise("npm")
    told = told.union(own.select("root", F.lit(3), tool, "workspaces"))
    return told.groupBy("root").agg(F.min_by(F.struct("tool", "globs"), "k").alias("t")).select("root", "t.tool", "t.globs")


def members(projects: DataFrame, spaces: DataFrame) -> DataFrame:
    """(workspace, root, name) of the manifests (root, name) below a workspace (root, globs) that its globs name; globs with ``!`` take out again."""
    up = projects.select("root", "name", F.explode(above("root")).alias("workspace")).where("root <> workspace")
    pairs = up.join(spaces.select(F.col("root").alias("workspace"), "globs"), "workspace")
    within = F.when(F.col("workspace") == "", F.col("root")).otherwise(F.expr("substr(root, char_length(workspace) + 2)"))
    one = pairs.select("workspace", "root", "name", within.alias("within"), F.explode("globs").alias("glob"))
    out = F.startswith("glob", F.lit("!"))
    body = F.regexp_replace(F.regexp_replace("glob", "^!?(?:\\./)?", ""), "/$", "")
    body = F.regexp_replace(body, r"[.+^$(){}|\[\]\\]", r"\\$0")
    body = F.replace(F.replace(F.replace(F.replace(body, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit("(?:.*/)?"))
    one = one.withColumn("out", out).withColumn("regex", F.concat(F.lit("^"), F.replace(body, F.lit("\u0002"), F.lit(".*")), F.lit("$")))
    hits = one.where(F.expr("within rlike regex")).groupBy("workspace", "root", "name").agg(F.bool_or("out").alias("out"))
    return hits.where("NOT out").select("workspace", "root", "name")


def frameworks(files: DataFrame) -> DataFrame:
    """(root, name, scanner, confidence, evidence) of each project: by a package among its own and its members' dependencies (high), else by a config file of its own.

    Config files count as high where packages can't tell, else as medium. Of several with one scanner the most confident stays, of equals the first of the table.
    """
    spark = files.sparkSession
    rules = [(k, n, s, p.split() if p else [], f, "medium" if p else "high") for k, (n, s, p, f) in enumerate(FRAMEWORKS)]
    rules = spark.createDataFrame(rules, "k int, name string, scanner string, packages array<string>, file string, weaker string")
    found = manifests(files)
    joined = members(found, workspaces(files)).select(F.col("workspace").alias("into"), "root").union(found.select("root", "root"))
    needs = joined.join(found.select("root", "packages"), "root").select(F.col("into").alias("root"), F.explode("packages").alias("package")).distinct()
    by_package = rules.select("k", "name", "scanner", F.posexplode("packages").alias("nth", "package"))
    strong = needs.join(F.broadcast(by_package), "package").groupBy("root", "k", "name", "scanner").agg(F.min_by("package", "nth").alias("package"))
    strong = strong.select("root", "k", "name", "scanner", F.lit("high").alias("confidence"), F.format_string('Found "%s" in package.json', "package").alias("evidence"))

    steps = files.select("path", F.explode(above(folder("path"))).alias("root")).join(found.select("root"), "root")
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substr(path, char_length(root) + 2)"))
    config = None
    for k, (name, scanner, packages, file) in enumerate(FRAMEWORKS):
        if file:
            hit = F.when(F.col("inner").rlike(file), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(scanner).alias("scanner"), F.lit("medium" if packages else "high").alias("confidence")))
            config = F.array(hit) if config is None else F.concat(config, F.array(hit))
    weak = steps.withColumn("inner", inner).select("root", "inner", F.explode(F.filter(config, lambda c: c.isNotNull())).alias("c"))
    weak = weak.groupBy("root", "c").agg(F.min("inner").alias("inner")).select("root", "c.*", F.format_string("Found %s", "inner").alias("evidence"))
    weak = weak.join(strong.select("root", "k"), ["root", "k"], "left_anti").select(strong.columns)
    best = Window.partitionBy("root", "scanner").orderBy(F.col("confidence") != "high", "k")
    return strong.union(weak).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "k")


def projects(files: DataFrame) -> DataFrame:
    """(root, name, tool, workspace, files) of every manifest: the tool of its own workspaces, the workspace it is a member of (the nearest), and how many files are nearest to it."""
    found = manifests(files)
    spaces = workspaces(files)
    of = members(found, spaces).groupBy("root").agg(F.max_by("workspace", F.char_length("workspace")).alias("workspace"))
    counts = nearest(files, found).groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    out = found.select("root", "name").join(spaces.select("root", "tool"), "root", "left").join(of, "root", "left").join(counts, "root", "left")
    return out.select("root", "name", "tool", "workspace", F.coalesce("files", F.lit(0)).alias("files"))
