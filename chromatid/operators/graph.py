"""Queries over a property graph: nodes (id, type, name, ...) and edges (id, type, src, dst, ...), as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromatid.session import durable, measured, spread

# Edges that a dependent has to what it depends on.
DEPENDENCIES = ("USES", "RENDERS", "IMPORTS", "EXTENDS")


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph: the first node of an id and the first edge of an id, by seq; edges need both ends and aren't loops."""

    def first(t: DataFrame) -> DataFrame:
        return t.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("_k = 1").drop("_k")

    n = first(nodes)
    ids = n.select("id")
    e = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, first(e)


def usages(edges: DataFrame, kind: str = "USES") -> DataFrame:
    """(dst, n, sources) of in-edges of a kind."""
    return edges.where(F.col("type") == kind).groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


def without_in(nodes: DataFrame, edges: DataFrame, node_type: str, kind: str) -> DataFrame:
    """Nodes of a type that no edge of the kind leads to."""
    used = edges.where(F.col("type") == kind).select(F.col("dst").alias("id"))
    return nodes.where(F.col("type") == node_type).join(used, "id", "left_anti")


def without_out(nodes: DataFrame, edges: DataFrame, node_type: str, kind: str) -> DataFrame:
    """Nodes of a type that no edge of the kind leaves, such as untested components."""
    used = edges.where(F.col("type") == kind).select(F.col("src").alias("id"))
    return nodes.where(F.col("type") == node_type).join(used, "id", "left_anti")


def impact(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, id, distance) of what depends on each start (id), directly or not.

    Nodes at max_depth are still looked from, so distances run to max_depth + 1. Each round joins a frontier with the edges and drops what was
    reached before.
    """
    e = edges.where(F.col("type").isin(*DEPENDENCIES)).select("src", "dst").distinct()
    front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    seen = durable(front)
    front = seen
    for distance in range(1, max_depth + 2):
        step = front.join(e, F.col("id") == F.col("dst")).select("start", F.col("src").alias("id")).distinct()
        front = durable(step.join(seen, ["start", "id"], "left_anti").withColumn("distance", F.lit(distance)))
        if front.isEmpty():
            break
        seen = durable(seen.union(front))
    return seen.where("distance > 0")


def impact_summary(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, direct, transitive, files, components, risk) of impact()'s rows."""
    r = reached.join(nodes.select("id", "type"), "id", "left")
    by = r.groupBy("start").agg(
        F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive"),
        F.count_if(F.col("type") == "File").alias("files"), F.count_if(F.col("type") == "Component").alias("components"),
    )
    n = F.col("direct") + F.col("transitive")
    return by.withColumn("risk", F.when(n > 20, "high").when(n > 5, "medium").otherwise("low"))


def ownership(nodes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(entity, author, commits, last, rank): who changed or added each entity, most commits first, then the earliest commit.

    rows is the number of such edges or an upper bound, counted if not given; the work is dealt to tasks by it. Commits of one author to one
    entity are counted in one task, without being held.
    """
    commits = nodes.where("type = 'Commit'").select(F.col("id").alias("src"), "author", "timestamp", "seq")
    e = edges.where("type in ('CHANGED', 'ADDED')").select("src", F.col("dst").alias("entity"))
    rows = e.count() if rows is None else rows
    changes = spread(spread(e, rows, "src").join(spread(commits, rows, "src"), "src"), rows, "entity", "author")
    by = changes.groupBy("entity", "author").agg(F.count(F.lit(1)).alias("commits"), F.max("timestamp").alias("last"), F.min("seq").alias("first_seq"))
    order = Window.partitionBy("entity").orderBy(F.desc("commits"), "first_seq")
    return spread(by, rows, "entity").withColumn("rank", F.row_number().over(order)).drop("first_seq")


def drift_authors(edges: DataFrame, affects: str = "AFFECTS", changed: str = "CHANGED", authored: str = "AUTHORED") -> DataFrame:
    """(drift, developer): whoever authored the first commit that changed the first thing a drift signal affects, by the edges' seq.

    Each entity's author is settled before signals are joined, so many signals on one entity don't multiply its commits.
    """
    a, c, d = (edges.where(F.col("type") == k) for k in (affects, changed, authored))
    author = d.groupBy(F.col("dst").alias("commit")).agg(F.min_by("src", "seq").alias("developer"))
    first = (
        c.select(F.col("dst").alias("entity"), F.col("src").alias("commit"), "seq").join(author, "commit").groupBy("entity").agg(F.min_by("developer", "seq").alias("developer"))
    )
    hops = a.select(F.col("src").alias("drift"), F.col("dst").alias("entity"), "seq").join(first, "entity")
    return hops.groupBy("drift").agg(F.min_by("developer", "seq").alias("developer"))


def repeat_offenders(signals: DataFrame, threshold: int = 3) -> DataFrame:
    """(file, n) of files with at least so many drift signals."""
    file = F.split_part(F.col("location"), F.lit(":"), F.lit(1)).alias("file")
    return signals.where("location is not null").groupBy(file).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def deprecated_usages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n) of deprecated tokens in use: marked so, or named with ``deprecated`` or a leading _."""
    marked = F.col("name").contains("deprecated") | F.col("name").startswith("_") | F.coalesce(F.col("deprecated"), F.lit(False))
    tokens = nodes.where((F.col("type") == "Token") & marked).select("id")
    return tokens.join(usages(edges).select(F.col("dst").alias("id"), "n"), "id")


def pr_files(edges: DataFrame) -> DataFrame:
    """(pr, file): files that the commits a pull request includes changed or added."""
    inc = edges.where("type = 'INCLUDES'").select(F.col("src").alias("pr"), F.col("dst").alias("commit"))
    ch = edges.where("type in ('CHANGED', 'ADDED')").select(F.col("src").alias("commit"), F.col("dst").alias("file"))
    return inc.join(ch, "commit").select("pr", "file").distinct()


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the shares of tokens used, and of components tested and documented; 1 where there are none."""

    def share(node_type: str, kind: str, end: str, name: str) -> DataFrame:
        met = edges.where(F.col("type") == kind).select(F.col(end).alias("id")).distinct().withColumn("met", F.lit(1))
        n = nodes.where(F.col("type") == node_type).join(met, "id", "left")
        return n.agg(F.coalesce(F.count("met") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias(name))

    tokens = share("Token", "USES", "dst", "token_coverage")
    tests, stories = share("Component", "TESTED_BY", "src", "test_coverage"), share("Component", "DOCUMENTED_BY", "src", "story_coverage")
    return tokens.crossJoin(tests).crossJoin(stories).withColumn("component_coverage", F.lit(1.0))  # one row each


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): nodes and edges by type."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.union(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when those from nodes without in-edges and to nodes without out-edges are dropped, again and again."""
    n = edges.count()
    while True:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = measured(kept.select("src", "dst"))
        if (left := edges.count()) == n:
            return edges
        n = left


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on a cycle of any length: component is the smallest id of its strongly connected component.

    Each node learns the smallest id that reaches it and the smallest that it reaches; where these agree they name its component. The rest goes on
    within equal pairs, as no cycle crosses them. A round of the labels takes a step, so there are as many as the longest way to a smallest id.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    loops = e.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    found = loops.limit(0)
    e = _trimmed(measured(e.where("src <> dst")))
    while not e.isEmpty():
        labels = measured(e.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("f"), F.col("id").alias("b")))
        while True:
            down = e.join(labels.select(F.col("id").alias("src"), "f"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("f").alias("f2"))
            up = e.join(labels.select(F.col("id").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("b").alias("b2"))
            both = labels.join(down, "id", "left").join(up, "id", "left")
            labels = measured(both.select("id", F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), (F.coalesce(F.col("f2") < F.col("f"), F.lit(False)) | F.coalesce(F.col("b2") < F.col("b"), F.lit(False))).alias("moved")))
            if labels.where("moved").isEmpty():
                break
        same = labels.where("f = b").select("id", F.col("f").alias("component"))
        found = measured(found.union(same.join(same.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", "component")))
        open_ = labels.where("f <> b")
        ends = e.join(open_.select(F.col("id").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), "src").join(open_.select(F.col("id").alias("dst"), "f", "b"), "dst")
        e = _trimmed(measured(ends.where("f = f1 and b = b1").select("src", "dst")))
    return found.union(loops.join(found.select("id"), "id", "left_anti"))


def component_cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length): for each strongly connected component the shortest cycle through its smallest node, of any length; ids joined by ``>``.

    From the smallest nodes on, a round takes a step: each node of a component that is reached first keeps its smallest predecessor. The first round that
    closes a component's cycle ends its search; the way back follows the predecessors. A node is its own cycle where it leads to itself.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    at = measured(cycle_nodes(e))
    inner = e.join(at.select(F.col("id").alias("src"), F.col("component").alias("c")), "src").join(at.withColumnRenamed("id", "dst"), "dst")
    inner = measured(inner.where("c = component").select("c", "src", "dst"))
    # (c, id, before): the nodes reached, by the round that reached them.
    reached = [measured(inner.select("c", F.col("c").alias("id"), F.lit(None).cast(inner.schema["src"].dataType).alias("before")).distinct())]
    seen, ends = reached[0], None
    while not reached[-1].isEmpty():
        step = reached[-1].select("c", F.col("id").alias("src")).join(inner, ["c", "src"])
        closed = step.where("dst = c").groupBy("c").agg(F.min("src").alias("last")).withColumn("round", F.lit(len(reached)))
        ends = measured(closed if ends is None else ends.union(closed.join(ends, "c", "left_anti")))
        new = step.join(ends, "c", "left_anti").join(seen.select("c", F.col("id").alias("dst")), ["c", "dst"], "left_anti")
        reached.append(measured(new.groupBy("c", F.col("dst").alias("id")).agg(F.min("src").alias("before"))))
        seen = measured(seen.union(reached[-1]))
    way = None
    for k in range(len(reached) - 2, -1, -1):  # the last node of cycles that the round after k closed, and of the way so far
        last = ends.where(F.col("round") == k + 1).select("c", F.col("last").alias("id"), F.lit("").alias("tail"), F.lit(0).alias("length"))
        here = last if way is None else way.union(last)
        here = here.join(reached[k], ["c", "id"])
        tail = F.when(F.col("length") == 0, F.col("id").cast("string")).otherwise(F.concat(F.col("id").cast("string"), F.lit(">"), "tail"))
        way = measured(here.select("c", F.coalesce("before", "id").alias("id"), tail.alias("tail"), (F.col("length") + 1).alias("length")))
    none = edges.sparkSession.createDataFrame([], "cycle string, length int")
    return none if way is None else way.select(F.col("tail").alias("cycle"), "length")


def cycles(edges: DataFrame, max_length: int = 8) -> DataFrame:
    """(cycle, length) of simple cycles up to a length: node ids joined by ``>``, beginning at the smallest, each cycle once.

    Their number grows exponentially with their length; cycle_nodes() finds the nodes of all cycles.
    """
    at = cycle_nodes(edges)
    e = edges.select("src", "dst").distinct().join(at.select(F.col("id").alias("src"), F.col("component").alias("c")), "src").join(at.withColumnRenamed("id", "dst"), "dst")
    e = measured(e.where("c = component").select("src", "dst"))
    paths = measured(e.where("src < dst").select(F.array("src", "dst").alias("path")))
    found = e.where("src = dst").select(F.array("src").alias("path"))
    for _ in range(max_length - 1):
        ends = paths.withColumn("at", F.element_at("path", -1)).join(e, F.col("at") == F.col("src"))
        found = found.union(ends.where(F.col("dst") == F.element_at("path", 1)).select("path"))
        longer = ends.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst")))
        paths = measured(longer.select(F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"), F.size("path").alias("length")).where(F.col("length") <= max_length)


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of a DOT file's body: nodes, then edges, for a text writer; lines carry an order in ``part``."""
    n = nodes.select(F.lit(0).alias("part"), F.format_string('  "%s" [label="%s"];', "id", F.coalesce("name", "id")).alias("line"))
    return n.union(edges.select(F.lit(1).alias("part"), F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "type").alias("line")))


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element) in JSON, one a node or edge."""
    n = nodes.select(F.to_json(F.struct(F.struct("id", F.coalesce("name", "id").alias("label"), "type").alias("data"))).alias("element"))
    return n.union(edges.select(F.to_json(F.struct(F.struct("id", F.col("src").alias("source"), F.col("dst").alias("target"), "type").alias("data"))).alias("element")))


def drifting_tokens(edges: DataFrame) -> DataFrame:
    """(token, expected, actual) of edges (type, src, expected, actual) that say a token drifts from its definition."""
    return edges.where("type = 'DRIFTS_FROM'").select(F.col("src").alias("token"), "expected", "actual")


def drift_in_pr(edges: DataFrame, prs: DataFrame) -> DataFrame:
    """(pr, drift): drift signals flagged in pull requests (pr: a number, or a node's id that begins with ``pr:``)."""
    wanted = prs.select("pr", F.when(F.col("pr").startswith("pr:"), F.col("pr")).otherwise(F.concat(F.lit("pr:"), "pr")).alias("dst"))
    return edges.where("type = 'FLAGGED_IN'").join(wanted, "dst").select("pr", F.col("src").alias("drift"))


def from_cytoscape(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, name, type), edges (type, src, dst)) of cytoscape()'s elements: a round trip."""
    d = elements.select(F.from_json("element", "data struct<id: string, label: string, type: string, source: string, target: string>").alias("x")).select("x.data.*")
    nodes = d.where("source is null").select("id", F.col("label").alias("name"), "type")
    return nodes, d.where("source is not null").select("type", F.col("source").alias("src"), F.col("target").alias("dst"))


def ask(question: str) -> str:
    """Which query a question in words means: unused tokens, untested or undocumented components, repeat offenders or coverage."""
    q = question.lower()
    routes = (
        ("unused tokens", "unused" in q and "token" in q), ("untested components", "untested" in q and "component" in q), ("undocumented components", "undocumented" in q and "component" in q),
        ("repeat offenders", "repeat" in q or "offender" in q), ("coverage", "coverage" in q),
    )
    found = next((name for name, fits in routes if fits), None)
    if found is None:
        raise ValueError(f"no query for {question!r}; there are: {', '.join(name for name, _ in routes)}")
    return found
