"""Joins, decontamination, mixing, classification and the token store against brute force, and on awkward tables."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from chromatid.llm import cotrain, decontam, mixing, ngram_join, token_store
from chromatid.llm.common import WORD_PATTERN, connected_components, forest, new_path
from chromatid.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows, extra=()):
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


def some_docs(n=60):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rng = np.random.default_rng(3)
    return [(i, " ".join(rng.choice(words, 40)), "en", f"s{i % 3}", 200) for i in range(n)]


def test_connected_components_and_forest(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(100, i) for i in range(101, 160)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    linked = np.zeros((5, 5), dtype=bool)
    linked[4, 2] = linked[2, 4] = linked[2, 1] = linked[1, 2] = True
    assert forest(linked).tolist() == [0, 1, 1, 3, 1]
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def grams(text):
    w = regex.findall(WORD_PATTERN, (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    sets = [grams(t) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both / len(sets[i] | sets[j]) >= 0.8:
            n[i] += 1
            n[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, t) in enumerate(rows):
        if d is not None and sets[i]:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, ids.get(find(i)) if sets[i] else d, n[i]) for i, (d, t) in enumerate(rows)), key=str)


def near_copies():
    rows = [(r[0], r[1]) for r in some_docs(30)]
    rng = np.random.default_rng(5)
    base = rows[0][1].split()
    for k in range(40):  # one large group of near copies
        w = list(base) * 3
        w[int(rng.integers(0, 120))] = f"word{k % 7}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, rows[3][1]) for k in range(5)] + [(210, rows[3][1].upper().replace(" ", ", "))]
    rows += [(300, None), (301, ""), (302, "!!! ..."), (303, "two words"), (304, "Two WORDS."), (None, rows[4][1]), (None, None), (305, rows[5][1]), (305, rows[5][1])]
    return rows


@pytest.mark.parametrize("tile_rows", [256, 7])
def test_ngram_join_is_brute_force(spark, tile_rows):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component", "3 AS bands", "4 AS text_hash")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(df, tile_rows=tile_rows).collect()), key=str)
    assert got == brute_links(rows)


def test_ngram_join_keeps_one_of_each_class(spark):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).selectExpr("*", "1 AS _row", "2 AS row")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    with_words = [g for g in got if grams(g[1])]
    classes = {c for d, c, _ in brute_links(rows) if c is not None and c not in (300, 301, 302)}
    assert len(with_words) == len(classes) == len({d for d, _ in with_words})
    assert {d for d, _ in with_words} == classes
    assert {300, 301, 302} <= {d for d, _ in got}
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.join(empty).collect() == [] and ngram_join.keep_one(empty).collect() == []


def test_rows_without_words_and_rows_that_differ_stay_apart(spark):
    rows = [(7, t, lang, source, 1) for t in (None, "!!") for lang, source in (("en", "a"), ("en", "b"), ("de", "a"))]
    rows += [(8, "one two three four five six", "en", s, 1) for s in ("c", "a", "b")] + [(8, "one two three four five six", "en", "a", 1)] * 2
    rows += [(9, "Other words for the same id, again", "en", None, 1), (9, "Other words for the same id, again", "en", "x", 1), (None, "no id here at all, none", None, None, None), (None, "no id here at all, none", "q", None, None)]
    want = None
    for _ in range(2):
        for order in (rows, rows[::-1]):
            got = sorted(map(tuple, ngram_join.keep_one(spark.createDataFrame(order, DOCS).repartition(3)).collect()), key=str)
            assert sorted((r for r in got if r[0] == 7), key=str) == sorted(rows[:6], key=str)
            assert len([r for r in got if r[0] == 8]) == len([r for r in got if r[0] == 9]) == len([r for r in got if r[0] is None]) == 1
            want = want or got
            assert got == want
    twice = spark.createDataFrame([(7, None, "en", "a", 1)] * 3, DOCS)
    assert ngram_join.keep_one(twice).count() == 3


def test_band_plan_meets_its_recall():
    for threshold in (0.7, 0.8, 0.9):
        bands, rows = ngram_join.band_plan(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


BENCH = [(1, "The quick brown fox jumps over the lazy dog, while seven wizards quietly judge my vow of silence tonight."), (2, "Ein anderer Satz über schöne Gärten, der lang genug ist, um gefunden zu werden, und noch etwas länger."), (3, "tiny"), (4, None)]


def distance(p, w):
    row = [0] * (len(w) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(w, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_decontamination_is_brute_force():
    items = decontam.index([(i, t) for i, t in BENCH if t])
    rng = np.random.default_rng(2)
    filler = " ".join(r[1] for r in some_docs(4))
    found = 0
    for trial in range(120):
        item = int(rng.integers(0, 2))
        s = list(BENCH[item][1])
        for _ in range(int(rng.integers(0, len(s) // 9))):
            x, how = int(rng.integers(0, len(s))), int(rng.integers(0, 3))
            s[x : x + 1] = [] if how == 0 else [s[x], "q"] if how == 1 else ["z"]
        cut = int(rng.integers(0, 400)) if trial % 4 else 0
        text = filler[:cut] + " " + "".join(s) + (" " + filler[cut : cut + 300] if trial % 3 else "")
        p, w = decontam.normal(BENCH[item][1])[0], decontam.normal(text)[0]
        d, k = distance(p.tolist(), w.tolist()), decontam.edits_of(len(p), decontam.EDIT_RATE)
        hits = [h for h in decontam.search(text, items) if h["item_id"] == item + 1]
        assert (min((h["distance"] for h in hits), default=None)) == (d if d <= k else None)
        for h in hits:
            found += 1
            span = decontam.normal(text[h["start"] : h["end"]])[0]
            assert distance(p.tolist(), span.tolist()) == h["distance"] and 0 <= h["start"] < h["end"] <= len(text)
    assert found > 40


def test_decontamination_of_tables(spark):
    clean = some_docs(10)
    rows = clean + [(50, "x " * 50 + BENCH[0][1].upper() + " y" * 30, "en", "s", 1), (51, BENCH[1][1], None, None, None), (52, None, None, None, None), (53, "", None, None, None), (None, BENCH[0][1], None, None, None), (54, BENCH[0][1], "a", "b", 1), (54, BENCH[0][1], "a", "b", 1), (55, "z " * 60_000 + BENCH[0][1], "a", "b", 1)]
    df = docs(spark, rows, ["hits", "_hits", "h", "item_id"])
    bench = spark.createDataFrame([*BENCH, (9, BENCH[0][1])], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontam.regions(df, bench, block_bytes=120).collect()), key=str)
    assert got == sorted([(50, 1, 0), (51, 2, 0), (None, 1, 0), (54, 1, 0), (54, 1, 0), (55, 1, 0)], key=str)
    plan = decontam.regions(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench, block_bytes=120).collect()) == sorted([r[0] for r in clean] + [52, 53])
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([r[0] for r in clean] + [52, 53])
    assert decontam.regions(df, bench.limit(0)).count() == 0 and decontam.regions(df.limit(0), bench).count() == 0


def every_end(p, w, k):
    """{end: least distance} of parts of w that end there and are within k edits of p."""
    row = list(range(len(p) + 1))
    out = {}
    for j, c in enumerate(w, 1):
        new = [0]
        for i, e in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != e)))
        row = new
        if row[-1] <= k:
            out[j] = row[-1]
    return out


def brute_regions(p, w, k):
    """All regions that don't overlap, nearest first, then by end: each the shortest of its end and distance."""
    taken = []
    for end, d in sorted(every_end(p, w, k).items(), key=lambda x: (x[1], x[0])):
        back = every_distance = None
        row = list(range(len(p) + 1))
        for back in range(1, min(end, len(p) + k) + 1):
            new = [back]
            for i, e in enumerate(reversed(p), 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (w[end - back] != e)))
            row = new
            every_distance = row[-1]
            if every_distance == d:
                break
        start = end - back
        if every_distance == d and all(end <= x or y <= start for x, y, _ in taken):
            taken.append((start, end, d))
    return sorted(taken)


def found_regions(text, items):
    return sorted((h["item_id"], h["start"], h["end"], h["distance"]) for h in decontam.search(text, items))


def test_every_region_is_found_whatever_else_is_in_the_benchmark():
    item = "thirty characters of an item x"
    long = " ".join(f"w{i}" for i in range(500))
    for between in ("", " ", " and text between them, "):
        text = between.join([item] * 12)
        alone, beside = (found_regions(text, decontam.index(b)) for b in ([(1, item)], [(1, item), (2, long)]))
        assert len(alone) == 12 and alone == beside
    assert len(found_regions("yes yes yes yes no yes", decontam.index([(1, "yes")]))) == 5
    assert len(found_regions("yes yes yes yes no yes", decontam.index([(1, "yes"), (2, long)]))) == 5


def test_repeated_items_are_brute_force():
    rng = np.random.default_rng(11)
    cases = 0
    for trial in range(60):
        m = int(rng.choice([5, 9, 13, 26, 40, 75]))
        item = "".join(rng.choice(list("abcde "), m)).strip() or "abc"
        p = decontam.normal(item)[0]
        if len(p) < 4:
            continue
        parts = []
        for _ in range(int(rng.integers(1, 7))):
            x = list(item)
            for at in rng.choice(len(x), int(rng.integers(0, 1 + len(x) // 12)), replace=False):
                x[at] = rng.choice(["", "z", x[at] + "q"])
            parts += ["".join(x), "".join(rng.choice(list("abcde "), int(rng.integers(0, 12))))]
        text = "".join(parts)
        w = decontam.normal(text)[0]
        more = [(2, "another long item " * int(rng.integers(1, 40)))] if trial % 2 else []
        part = next(x for x in decontam.index([(1, item), *more]) if 1 in x.ids)
        got = sorted((s, e, d) for s, e, d, i, _ in part.regions(w) if part.ids[i] == 1)
        want = brute_regions(p.tolist(), w.tolist(), decontam.edits_of(len(p), decontam.EDIT_RATE))
        if part.short:
            want = [x for x in want if not decontam._within_word(w, x[0], x[1])]
        assert got == want, (item, text)
        cases += len(want) > 1
    assert cases > 20


def test_short_items_of_scripts_without_spaces():
    items = decontam.index([(1, "什么是机器学"), (2, "สวัสดี"), (3, "기계"), (4, "cat"), (5, "日本")])
    ids = lambda t: [h[0] for h in found_regions(t, items)]
    assert ids("他问什么是机器学习吗") == [1] and ids("ขอสวัสดีครับ") == [2] and ids("기계가 좋다") == [3] and ids("东京日本日本") == [5, 5]
    assert ids("concatenate") == [] and ids("a cat, cats; Cat!") == [4, 4] and ids("这是cat的") == [4]


def test_many_shared_grams_are_counted_in_turns(monkeypatch):
    text = ("z y " * 3000) + "the end of it all is near, says he"
    items = decontam.index([(1, "z y " * 30), (2, "the end of it all is near, says she")])
    want = found_regions(text, items)
    monkeypatch.setattr(decontam, "COUNTED", 1000)
    assert found_regions(text, items) == want and {h[0] for h in want} == {1, 2} and sum(h[0] == 1 for h in want) >= 99


def test_short_items_keep_their_edits_and_are_whole_words():
    short = {1: "ab, cd efg hij", 2: "tiny", 3: "?!", 4: "日本語の文章はここにあります、そして続きます。", 5: "x", 6: "Abcdefg hijklmn opqrs tu"}
    items = decontam.index(list(short.items()))
    assert {i for part in items for i in part.ids} == {1, 2, 4, 5, 6} and all((part.bound >= 1).all() for part in items)
    found = lambda text: [(h["item_id"], text[h["start"] : h["end"]], h["distance"]) for h in decontam.search(text, items)]
    assert found("destiny and tiny. Tiny!") == [(2, "tiny", 0), (2, "Tiny", 0)] or found("destiny and tiny. Tiny!") == [(2, "tiny", 0)]
    assert found("zz ab cd eefg hij zz")[0][0::2] == (1, 1) and found("y X") == [(5, "X", 0)] and found("boxes") == []
    assert found("前 日本語の文章はここにありまず、そして続きます。")[0][0::2] == (4, 1)
    assert found("İİİ so abcdefg hijklm opqrs tu") == [(6, "abcdefg hijklm opqrs tu", 1)]
    rng = np.random.default_rng(7)
    for _ in range(300):  # every item length, at the most edits it may have
        m = int(rng.integers(8, 40))
        item = "".join(rng.choice(list("abcdefgh"), m))
        k, p = decontam.edits_of(m, decontam.EDIT_RATE), list(item)
        for x in rng.choice(m, k, replace=False):
            p[x] = "z"
        hits = decontam.search("qq " + "".join(p) + " qq", decontam.index([(1, item)]))
        assert hits and hits[0]["distance"] <= k


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: cap * sizes[s] for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= over


def mix_rows():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        source = ["a", "b", "B", None, "tiny"][int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.095, 0.005]))]
        rows.append((i, " ".join(["w"] * int(rng.integers(1, 60))), "en", source, 1))
    return rows + [(9000, None, "en", "a", 0), (9001, "\t \n", "en", "a", 0), (None, "one two", None, None, None), (9002, "same same", "en", "b", 1), (9002, "same same", "en", "b", 1), (9003, "a b c", "en", "zero", 1)]


def test_mix_meets_its_targets_and_reruns_agree(spark):
    rows = mix_rows()
    df = docs(spark, rows, ["size", "p", "key", "epochs"])
    got = mixing.mix(df, chunk_rows=200).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(dict(sizes))
    source = {r[0]: r[3] for r in rows}
    taken, n = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[s] += r.taken
        n[s] += 1
    for s, t in taken.items():
        assert abs(t - want[s]) <= 60, (s, t, want[s])
    again = mixing.mix(df.repartition(7), chunk_rows=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).collect() == []
    out = mixing.mixed(df, chunk_rows=200)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0.0, 1.0)), max_size=40), st.integers(0, 1 << 30))
def test_flight_keeps_the_balance(units, seed):
    size, p = np.array([u[0] for u in units], dtype=float), np.array([u[1] for u in units])
    rng = np.random.default_rng(seed)
    out = mixing.flight(size, p, rng)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2 and ((out >= 0) & (out <= 1)).all()
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5) and (out * size).sum() == pytest.approx((p * size).sum(), abs=1e-4)
    done = mixing.landing(size, out, rng)
    assert set(np.unique(done)) <= {0.0, 1.0}


def test_two_levels_and_landing_are_unbiased():
    n, runs = 48, 4000
    size, p = np.random.default_rng(1).integers(1, 40, n).astype(float), np.full(n, 0.3)
    total = np.zeros(n)
    for run in range(runs):
        rng = np.random.default_rng(run)
        chunk, out = rng.integers(0, 4, n), p.copy()
        for c in range(4):
            out[chunk == c] = mixing.flight(size[chunk == c], p[chunk == c], rng)
        out = mixing.landing(size, mixing.flight(size, out, rng), rng)
        assert set(np.unique(out)) <= {0.0, 1.0} and abs((out * size).sum() - (p * size).sum()) <= 80
        total += out
    error = (0.3 * 0.7 / runs) ** 0.5
    assert np.abs(total / runs - p).max() < 4 * error


def test_rows_that_differ_in_other_columns_are_not_merged(spark):
    rows = [(1, "one two three", lang, "s", k) for lang in ("en", "de") for k in (1, 2)] + [(1, "one two three", "en", "s", 1)] * 2
    out = mixing.mixed(docs(spark, rows), max_epochs=1.0).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(rows)
    hot = docs(spark, [(7, "a b", "en", "s", 1)]).selectExpr("explode(sequence(1, 9000)) AS x", "*").drop("x").union(docs(spark, [(8, "c", "en", "t", 1)]))
    got = mixing.mix(hot).collect()
    assert len(got) == 9001 and {r.taken for r in got if r.doc_id == 8} == {3}
    assert abs(sum(r.taken for r in got if r.doc_id == 7) - got[0].target) <= 2


def test_classifier_finds_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    test = {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 0").collect()}
    got = cotrain.score(d, labels.where("doc_id % 4 <> 0")).collect()
    assert len(got) == d.count()
    hits = [(r.kept, test[r.doc_id] == 1) for r in got if r.doc_id in test]
    assert np.mean([a == b for a, b in hits]) >= 0.95
    assert np.mean([a for a, b in hits if b]) >= 0.97  # good documents stay


def test_classifier_on_awkward_tables(spark):
    rows = some_docs(80) + [(900 + i, "!!! %%% ### $$$ " * 20, "xx", f"s{i % 3}", 320) for i in range(60)] + [(None, None, None, None, None), (2000, "", "en", "s1", 0), (2000, "", "en", "s1", 0), (2001, "ok words " * 40_000, "en", "s1", None)]
    df = docs(spark, rows, ["content", "meta", "good", "h", "row"])
    labels = [(i, 1, 0) for i in range(60)] + [(900 + i, 0, 0) for i in range(40)] + [(5, 0, 0), (5, 1, 0), (None, 0, 0), (7, None, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotrain.score(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(60, 80)) <= kept and not kept & set(range(940, 960))
    out = cotrain.keep_good(df, lab)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    for nothing in (lab.limit(0), lab.where("quality = 1")):
        assert {r.score for r in cotrain.score(df, nothing).collect()} == {1.0}
    assert cotrain.keep_good(df, lab.limit(0)).count() == len(rows)
    assert cotrain.score(df.limit(0), lab).count() == 0


def test_classifier_learns_from_rare_classes(spark):
    junk = [(900 + i, "!!! %%% ### $$$ " * 20, "xx", f"s{i % 3}", 320) for i in range(60)]
    df = docs(spark, some_docs(120) + junk)
    # One to four labels of the rare class, wherever the hash puts them.
    for n in (1, 4):
        for rare, common in ((1, 0), (0, 1)):
            rows = [(i, 1, 0) for i in range(n if rare else 100)] + [(900 + i, 0, 0) for i in range(40 if rare else n)]
            kept = {r.doc_id for r in cotrain.keep_good(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
            assert kept == set(range(120)), (n, rare, common)
    # Fewer are taken than there are: the rare class is not left out.
    lab = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(900, 0, 0), (901, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in cotrain.score(df, lab, max_labelled=30).collect()}
    assert max(got[900 + i] for i in range(60)) < min(got[i] for i in range(120))
    assert cotrain.quotas({True: 1_000_000, False: 30_000}, 20_000) == {True: 18_000, False: 2_000} and cotrain.quotas({True: 90, False: 3}, 20) == {True: 18, False: 2}


def test_copies_hand_on_one_pseudo_label(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    known = lab.join(d, "doc_id").where("quality = 1 and length(text) > 200").orderBy("doc_id").first()
    copies = [(10**6, known.text + " once more", known.lang, known.source, known.n_chars)] * 400
    copies += [(None, known.text + " without an id", known.lang, known.source, known.n_chars)] * 50 + [(None, known.text + " and none either", known.lang, known.source, known.n_chars)]
    given, real = [], cotrain.fit
    monkeypatch.setattr(cotrain, "fit", lambda data: (given.append(data), real(data))[1])
    cotrain.score(d.union(spark.createDataFrame(copies, d.schema)), lab).collect()
    content = [data for data in given if len(data) > 1 and data[0][0].shape[1] > 100]
    rows = np.concatenate([x for x, _, w in content[-1][1:]])
    texts = [known.text + x for x in (" once more", " without an id", " and none either")]
    own = cotrain.features(spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], d.schema)).select("content").collect()
    times = [int(np.isclose(rows, np.array(r.content, dtype=np.float32), atol=1e-6).all(axis=1).sum()) for r in own]
    assert len(rows) > 20 and times == [1, 1, 1]


def test_folds_hold_both_classes():
    for sizes in ((1, 1), (2, 9), (1, 30), (5, 6)):
        y = np.random.default_rng(4).permutation(np.repeat([0.0, 1.0], sizes))
        held, rest = cotrain.folds(y)
        assert all(((y == c) & part).sum() >= 1 for c in (0, 1) for part in (held, rest))
        assert (held & rest).sum() == sum(n == 1 for n in sizes) and (held | rest).all()


def expected_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store_round_trip(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = real + [(9000, None), (9001, ""), (9002, "Don't I'LL <|endoftext|> café é Σίσυφος ΑΣ. 日本語 ½ a,b .,; x ,\n"), (None, "no id"), (9003, "same"), (9003, "same"), (9004, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS chunk", "3 AS no_id").repartition(5)
    path = new_path(spark, "store")
    token_store.write_store(df, path, tokenizer_path(), shard_chars=100_000)
    got = [tuple(r) for r in token_store.read_digests(spark, path).collect()]
    assert sorted(got, key=str) == sorted(expected_ids(rows), key=str)
    wanted = spark.createDataFrame([(0,), (9002,), (9003,), (123456,)], "doc_id long")
    ids = {r.doc_id: zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in token_store.fetch(spark, path, wanted).collect()}
    crc = {d: c for d, _, _, c in expected_ids(rows)}
    assert ids == {k: crc[k] for k in (0, 9002, 9003)}
    assert spark.read.parquet(f"{path}/dictionary").first().dict_hash == spark.read.parquet(f"{path}/chunks").first().dict_hash
    empty = new_path(spark, "store")
    token_store.write_store(df.limit(0), empty, tokenizer_path())
    assert token_store.read_digests(spark, empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list("ab'sÉé,.!? \n\tΣ́<|>")), max_size=30), min_size=1, max_size=4))
def test_encoder_is_the_tokenizer(texts):
    e = token_store.encoder(tokenizer_path())
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
