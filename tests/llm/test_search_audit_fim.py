"""Nearest neighbours, source divergence and fill-in-middle against brute force, and on awkward tables."""

import hashlib
import heapq
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromatid.llm import divergence, fill_middle, nearest, queries

SF = "/root/testdata/sf0.001"

# Fill in the middle.
UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def fim(doc_id, text, fim_percent=90, spm_percent=20, seed="1"):
    """The contract, by regular expressions."""
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in fill_middle.SENTINELS) or h3 % 100 >= fim_percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_is_brute_force(spark):
    texts = ["", None, "a", "é", "<P", "<P>", "x<S>y", "<M", "<<M>>", "a<S", "P>", "日本語 text", "😀😀 ab😀", "word " * 5000, "\n\t ", "<P <S <M >", "A<p>b", "ß" * 3000, "a" * 100_000, "<" * 5000, "ab\x00cd"]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(5, "again"), (5, "again"), (None, "no id"), (2**40, "big id, fine"), (-3, "less than zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS h1", "'y' AS output", "3 AS digest")
    for fim_percent, spm_percent in ((90, 20), (100, 100), (100, 0)):
        out = fill_middle.transform(df, fim_percent=fim_percent, spm_percent=spm_percent)
        got = Counter(tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
        assert got == Counter((i, *fim(i, t, fim_percent, spm_percent)) for i, t in rows)
        back = out.select("doc_id", fill_middle.restore().alias("text"))
        assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.transform(df.limit(0)).count() == 0


AUTOMATON = fill_middle.Automaton()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aPSMz<>  é日😀\n1_")), max_size=40), max_size=12))
def test_scan_counts_units_code_points_and_sentinels(texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    emits = fill_middle.scan(AUTOMATON, data, np.unique(ends[:-1][ends[:-1] < ends[1:]]))
    for t, low, high in zip(texts, ends[:-1], ends[1:], strict=True):
        part = emits[low:high]
        assert np.count_nonzero(part & fill_middle.UNIT) == len(UNITS.findall(t)) and np.count_nonzero(part & fill_middle.CHAR) == len(t)
        assert np.count_nonzero(part & fill_middle.SENTINEL) == sum(t.count(s) for s in fill_middle.SENTINELS)


def test_scan_agrees_whatever_the_lanes_and_segments(monkeypatch):
    texts = ["aé<P>😀b" * 997, "<S", "P>" * 333, "日" * 4099, "", "q" * 5000]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    starts = np.unique(ends[:-1][ends[:-1] < ends[1:]])
    want = fill_middle.scan(AUTOMATON, data, starts)
    for block, lane in ((7, 3), (64, 64), (1000, 1), (1 << 20, 5)):
        monkeypatch.setattr(fill_middle, "BLOCK", block)
        monkeypatch.setattr(fill_middle, "LANE", lane)
        assert (fill_middle.scan(AUTOMATON, data, starts) == want).all()


def test_bytes_that_are_no_utf8_do_not_crash():
    data = np.frombuffer(b"a\x80\x80b\xf0\x9fz\xff\xffq\xc3", dtype=np.uint8)
    emits = fill_middle.scan(AUTOMATON, data, np.array([0]))
    assert [bool(x & fill_middle.UNIT) for x in emits] == [True, True, True, True, True, False, True, True, True, True, True]


def test_fim_sentinels_of_any_length(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    df = spark.createDataFrame([(k, f"some text {k} <|fim_ here|> <P>") for k in range(50)] + [(50, "has <|fim_middle|> in it")], "doc_id long, text string")
    rows = fill_middle.transform(df, fim_percent=100, sentinels=marks).select("*", fill_middle.restore(sentinels=marks).alias("back")).collect()
    assert {r.form for r in rows if r.doc_id < 50} == {"psm", "spm"} and all(all(r.output.count(m) == 1 for m in marks) for r in rows if r.doc_id < 50)
    assert {(r.doc_id, r.back) for r in rows} == {tuple(r) for r in df.collect()} and [r.form for r in rows if r.doc_id == 50] == ["plain"]
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("a", "xay", "z"), ("", "a", "b"), ("aba", "x", "y")):
        with pytest.raises(ValueError, match="overlap"):
            fill_middle.Automaton(bad)


# Nearest neighbours.
VECTORS = "vec_id long, embedding array<double>, label int"


def usable(x):
    return x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        try:
            total += (x - y) ** 2
        except OverflowError:
            total = math.inf
    return math.sqrt(total)


def nearest_brute(rows, k=10, every=100):
    ok = [(n, i, x) for n, (i, x, *_) in enumerate(rows) if usable(x)]
    out = []
    for n, i, x in ok:
        if i is None or i % every:
            continue
        near = heapq.nsmallest(k, ((distance(x, y), j is None, j or 0) for m, j, y in ok if m != n and len(x) == len(y)))
        out += [(i, r + 1, None if null else j, d) for r, (d, null, j) in enumerate(near)]
    return Counter(out)


def searched(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).selectExpr("*", "1 AS row", "'x' AS tile", "2 AS size", "3 AS score")
    return Counter(tuple(r) for r in nearest.search(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(c) for c in rng.normal(size=16)]) for k in range(700)]
    rows += [(k, [float(np.float32(c)) for c in rng.normal(size=16)]) for k in range(700, 900)]
    copy, near = rows[100][1], rows[200][1]
    rows += [(k, list(copy)) for k in range(1000, 1300)] + [(k, [c + 1e-9 * float(rng.normal()) for c in near]) for k in range(1300, 1700)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [math.nan] + [1.0] * 15), (2300, [math.inf] * 16), (2400, [None] + [1.0] * 15), (2500, []), (None, list(near)), (None, list(copy))]
    rows += [(2600, [1.0, 2.0]), (2700, [1.0, 2.0]), (2701, [-1.0, 0.5]), (2800, [3.0]), (300, rows[300][1]), (300, rows[301][1])]
    want = nearest_brute(rows)
    assert searched(spark, rows) == want and searched(spark, rows, tile_rows=37) == want
    assert sum(1 for q, r, v, d in want if q == 2600) == 2 and not any(q == 2800 for q, *_ in want)


def test_nearest_of_extreme_components(spark):
    rows = [(100 * k, [s * 10.0**e, 1.0, 0.0]) for k, (s, e) in enumerate(itertools.product((1, -1, 3), (300, 200, 150, 20, 0, -20, -300)))] + [(7, [5e-324, 0.0, 0.0]), (8, [1e-320, 0.0, 0.0])]
    assert searched(spark, rows, k=3) == nearest_brute(rows, k=3)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1e-200, 1e-3, 1.0, 1e9):
        m = rng.normal(size=(60, 48)) * scale * rng.choice([1, 1e-4], size=(60, 48))
        codes, steps, squares, bounds = nearest.quantise(m)
        tile = type("T", (), {"factor": codes.astype(np.float32), "step": steps, "square": squares, "bound": bounds})
        least, most = nearest.bracketed(tile, tile, slice(0, 60))
        exact = np.linalg.norm(m[:, None] - m[None], axis=2)
        assert (least <= exact).all() and (exact <= most).all()


def test_nearest_of_an_empty_table(spark):
    assert not searched(spark, []) and not searched(spark, [(1, [1.0]), (2, [2.0])]) and not searched(spark, [(100, [1.0])])


# Source divergence.
TERMS = re.compile(divergence.TERM_PATTERN)


def audit_brute(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERMS.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        mine, q = p(counts[lang, source]), p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(mine[t], x) for t, x in p(counts[lang, s]).items())) for ln, s in groups if ln == lang and s != source]
        terms = [(t, f(mine[t], q[t])) for t in kept if counts[lang, source][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, i, v, r + 1) for r, (i, v) in enumerate(ranked)]
    return Counter(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "'x' AS held", "2 AS p", "3 AS kept")
    return Counter(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_is_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["the", "The", "café", "CAFÉ", "日本", "a", "b1c", "don't", "x_y", "Ünder", "z" * 300, "😀", "q"]
    rows = []
    for _ in range(120):
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(6)}"
        rows.append((" ".join(rng.choice(words, size=rng.integers(0, 30), p=np.array([30, 9, 5, 4, 3, 9, 2, 1, 1, 1, 1, 1, 1]) / 68)), str(rng.choice(["en", "de"])), source))
    rows += [(None, "en", "empty"), ("", "en", None), ("alone alone", "fr", "one"), ("alone", "fr", "one"), ("few words", None, "a"), ("123 !", None, None)] + [("same same", "it", "x")] * 3 + [("", "it", "y")]
    rows += [("long " * 40_000, "en", "s1")]
    want = audit_brute(rows)
    assert audited(spark, rows) == want and {k[2] for k in want} == {"pair", "term"}
    assert any(k[:4] == ("", "a", "pair", "") and k[4] == 0 for k in want) and any(k[:2] == ("it", "y") for k in want)
    assert audited(spark, rows, min_docs=1, top=3) == audit_brute(rows, min_docs=1, top=3)
    assert not audited(spark, [])


def test_tallies_count_every_kept_term(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("coalesce(text, '') AS text", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source")
    terms = divergence.kept_terms(docs).cache()
    kept = dict(tuple(r) for r in terms.groupBy("lang").count().collect())
    groups = docs.select("lang", "source").distinct().join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang")
    tallies = divergence.joint_counts(terms, groups).groupBy("lang", "a", "b").agg(F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    assert tallies and all(r.n == kept[r.lang] and r.least > 0 for r in tallies)


def test_shares_beyond_a_long(spark):
    rows = spark.createDataFrame([(c, 3 * 10**12) for c in (0, 5, 9 * 10**9 - 1, 9 * 10**9, 10**12)], "c long, t long")
    got = {r.c: r.p for r in rows.select("c", divergence.share("c", "t").alias("p")).collect()}
    assert got == {c: 1 + 10**9 * (c + 1) // (3 * 10**12) for c in got}


@pytest.mark.parametrize("name", ["op11_nearest", "op12_source_divergence", "op13_fill_in_middle"])
def test_new_queries_agree_with_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(found.fetchall())
