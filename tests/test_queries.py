"""Every query with SQL against DuckDB on the smallest tables; the others for their invariants."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

from chromatid import more_queries, source_queries  # noqa: F401 (they add their queries)
from chromatid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def value(x):
    return "~" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in names) for r in df.collect())
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = Counter(tuple(value(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_class_lists_are_whole_lines(spark):
    files = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "text").where("text is not null").collect():
        for line in r.text.split("\n"):
            files.setdefault(" ".join(sorted(x for x in re.split(r"[ \t\n\x0b\f\r]+", line) if x)), []).append(r.source)
    files.pop("", None)
    rows = {p: (len(f), len(set(f))) for p, f in files.items()}
    got = {r.pattern: (r.n, r.files) for r in QUERIES["class_patterns"](spark, SF).collect()}
    assert got == {p: x for p, x in rows.items() if x[0] >= 2} and max(len(p.split(" ")) for p in got) > 3
    got = {r.pattern: (r.n, r.files) for r in QUERIES["class_duplicates"](spark, SF).collect()}
    assert got == {p: x for p, x in rows.items() if x[1] >= 2 and len(p.split(" ")) >= 3} and max(len(p.split(" ")) for p in got) > 3


def hex_rgb(c):
    return tuple(int(c[i : i + 2], 16) for i in (1, 3, 5))


def test_color_vocabulary_is_brute_force(spark):
    from chromatid import bindings as b

    scopes = {}
    for r in b.color_values(spark, SF).collect():
        n, seq = scopes.setdefault(r.scope, {}).get(r.value, (0, r.seq))
        scopes[r.scope][r.value] = (n + 1, min(seq, r.seq))
    want = set()
    for scope, counts in scopes.items():
        clusters = []
        for c, (n, _) in sorted(counts.items(), key=lambda x: (-x[1][0], x[1][1])):
            near = next((k for k in clusters if math.dist(hex_rgb(k[0]), hex_rgb(c)) < 50), None)
            if near:
                near[1] += n
            else:
                clusters.append([c, n])
        clusters.sort(key=lambda k: -k[1])
        spread = lambda c: (max(hex_rgb(c)) - min(hex_rgb(c))) / max(1, max(hex_rgb(c)))
        grey = sorted((k for k in clusters if spread(k[0]) < 0.1), key=lambda k: -sum(hex_rgb(k[0])))
        other = [k for k in clusters if spread(k[0]) >= 0.1]
        named = dict(zip(("50", "100", "200", "300", "400", "500", "600", "700", "800", "900", "950"), grey, strict=False))
        rows = [(f"color-neutral-{n}", *k, False) for n, k in named.items()]
        lost = grey[11:] + other[2:3] + other[6:]
        rows += [(f"color-{n}-500", *k, False) for n, k in zip(("primary", "secondary"), other, strict=False)] + [(f"color-accent-{i + 1}", *k, False) for i, k in enumerate(other[3:6])]
        rows += [(f"color-orphan-{i + 1}", *k, True) for i, k in enumerate(lost)]
        want |= {(scope, *r) for r in rows}
    assert {tuple(r) for r in QUERIES["color_vocabulary"](spark, SF).collect()} == want and len(want) > 20


def test_suggested_palette_is_brute_force(spark):
    from chromatid import bindings as b

    scopes = {}
    for r in b.color_values(spark, SF).collect():
        n, seq = scopes.setdefault(r.scope, {}).get(r.value, (0, r.seq))
        scopes[r.scope][r.value] = (n + 1, min(seq, r.seq))
    want = set()
    for scope, counts in scopes.items():
        kept = []
        for c, _ in sorted(counts.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))[:20]:
            if len(kept) < 12 and all(math.dist(hex_rgb(c), hex_rgb(k)) >= 30 for k in kept):
                kept.append(c)
        want |= {(scope, c, i + 1) for i, c in enumerate(kept)}
    assert {tuple(r) for r in QUERIES["suggested_palette"](spark, SF).collect()} == want


def test_size_vocabularies_are_brute_force(spark):
    from chromatid import bindings as b

    scopes, total = {}, Counter()
    for r in b.spacing_values(spark, SF).collect():
        n, unit = re.fullmatch(r"([\d.]+)(px|rem|em)", r.value).groups()
        scopes.setdefault(r.scope, Counter())[math.floor(float(n) * (1 if unit == "px" else 16) + 0.5)] += 1
        total[r.scope] += 1
    spacing, radius, covered = set(), set(), set()
    names = "3xs 2xs xs sm md lg xl 2xl 3xl 4xl".split()
    for scope, counts in scopes.items():
        clusters = []
        for px, n in sorted(counts.items()):
            near = next((k for k in clusters if px and k[0] and abs(px - k[0]) <= 2), None)
            if near:
                near[0] = px if n > near[1] else near[0]
                near[1] += n
            else:
                clusters.append([px, n])
        by_use = sorted(clusters, key=lambda k: (-k[1], k[0]))
        top = sorted(by_use[:10])
        spacing |= {(scope, f"spacing-{names[i]}", f"{v}px", n, False) for i, (v, n) in enumerate(top)} | {(scope, f"spacing-orphan-{i + 1}", f"{v}px", n, True) for i, (v, n) in enumerate(by_use[10:])}
        covered.add((scope, total[scope], sum(n for _, n in top), math.floor(sum(n for _, n in top) * 100 / total[scope] + 0.5)))
        some = sorted(k for k in clusters if k[0])
        for i, (v, n) in enumerate(some):
            name = f"radius-{'sm md lg xl 2xl full'.split()[i]}" if i < 6 else f"radius-orphan-{i - 5}"
            radius.add((scope, name, "9999px" if i == 5 else f"{v}px", n, i > 5))
        radius |= {(scope, "radius-none", "0", n, False) for v, n in clusters if not v}
    for name, want in (("spacing_vocabulary", spacing), ("radius_vocabulary", radius), ("vocabulary_coverage", covered)):
        assert {tuple(r) for r in QUERIES[name](spark, SF).collect()} == want, name


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_fuzzy_match_is_brute_force(spark):
    from chromatid import queries

    s, t = (x.collect() for x in queries._shaped(spark, SF))
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0

    def score(a, b):
        x, y = a.name.lower(), b.name.lower()
        name = 1 - levenshtein(x, y) / max(len(x), len(y)) if x or y else 1.0
        return 0.4 * name + 0.3 * share(a.props, b.props) + 0.2 * share(a.variants, b.variants) + 0.1 * share(a.dependencies, b.dependencies)

    open_, want = list(t), {}
    for a in sorted(s, key=lambda r: r.seq):
        rated = [(-score(a, b), b.seq, b.id) for b in open_ if share(a.props, b.props) or share(a.variants, b.variants)]
        best = min(rated, default=None)
        if best and -best[0] >= 0.55 - 1e-12:
            want[a.id] = (best[2], round(-best[0], 6))
            open_ = [b for b in open_ if b.id != best[2]]
    got = {r.source_id: (r.target_id, r.score) for r in QUERIES["component_fuzzy_match"](spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and {"drift_pipeline", "impact_analysis"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
