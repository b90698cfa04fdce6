"""Operators on whole tables against brute force on small fixtures."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, jaccard_join, url_filter, warc
from lotwise.llm.common import Scratch
from lotwise.llm.components import components, with_totals


def test_recall_near_the_threshold(spark):
    """1,000 pairs of texts whose sets' similarity is from 0.80 to 0.85: at least nine of ten are found, and nothing else."""
    rng, rows, want = random.Random(12), [], set()
    while len(want) < 1000:
        n = rng.randrange(80, 200)
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        copy = list(base)
        for at in rng.sample(range(6, n - 6), 2 + n // 100):
            copy[at] = f"v{rng.randrange(10**6)}"
        if rng.random() < 0.5:
            copy += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(n // 12))]
        a, b = (set(jaccard_join.shingles(" ".join(x), 5).tolist()) for x in (base, copy))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            k = 2 * len(want)
            want.add((k, k + 1))
            rows += [(k, " ".join(base)), (k + 1, " ".join(copy))]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Scratch(spark, "test")).collect()
    found = {}
    for r in got:
        found.setdefault(r.class_id, set()).add(r.doc_id)
    pairs = {tuple(sorted(c)) for c in found.values() if len(c) == 2}
    assert pairs <= want and all(len(c) <= 2 for c in found.values())
    print(f"recall from 0.80 to 0.85: {len(pairs) / 1000:.3f}")
    assert len(pairs) >= 900


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n)]


def near_copies():
    rng, out = random.Random(5), []
    for k in range(40):
        base = words(rng, rng.choice((3, 30, 120, 400)))
        out.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3, 100 if k == 7 else 2))):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            out.append("  ".join(copy))
    return [*out, None, "", " \n", "one", "one", out[0]]


def test_jaccard_join(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in jaccard_join.jaccard_classes(docs, Scratch(spark, "test")).collect()}
    sets, first = {}, {}
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        if w:
            s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            first.setdefault(s, k)
            sets[k] = s
    reps = {k: first[s] for k, s in sets.items()}
    lone = sorted(set(reps.values()))
    links = [(a, b) for i, a in enumerate(lone) for b in lone[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = {k: k for k in lone}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    want = {k: (root[reps[k]], reps[k], sum(reps[k] in p for p in links)) if k in reps else (k, k, 0) for k in range(len(texts))}
    missed = sum(got[k][2] != want[k][2] for k in want)
    assert got.keys() == want.keys() and missed <= 0.02 * len(want)
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)
    assert jaccard_join.jaccard_classes(docs.limit(0), Scratch(spark, "test")).count() == 0


def test_cells_of_blocks_give_the_same_links(spark):
    texts = [t for t in near_copies() if t and t.strip()]
    docs = spark.createDataFrame(list(enumerate(texts)), "rep long, text string").withColumn("row_key", F.col("rep").cast("string").cast("binary"))
    n = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda k: F.array_join(F.slice("w", k, 5), " "))))
    groups = docs.withColumn("w", F.split("text", " +")).select("rep", "row_key", F.lit(0).cast("long").alias("root"), n.cast("long").alias("n"))
    sizes = ({}, {"block_shingles": 2_000}, {"block_sets": len(texts) // 4}, {"block_shingles": 500})
    found = [{r.rep: r.n for r in jaccard_join.verify(docs.select("row_key", "text"), groups, Scratch(spark, "test"), **at).groupBy("rep").agg(F.sum("links").alias("n")).collect()} for at in sizes]
    assert all(f == found[0] for f in found) and found[0]


def keyed_rows():
    long = " ".join(f"w{k}" for k in range(60))
    near = long.replace("w30", "other")
    return [(1, long), (1, long), (1, long), (1, near), (1, "quite another text of more than five words"), (None, near.replace("w59", "last")), (None,
        "null id and words of its own here"), (None, "null id and words of its own here"), (2, long), (3, None), (3, None), (None, ""), (4, " ")]


def test_keys_that_repeat_or_are_null(spark):
    rows = keyed_rows()
    docs = spark.createDataFrame([(k, t, "clash", "c2") for k, t in rows], "doc_id long, text string, _row string, row_key string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_classes(docs, Scratch(spark, "test")).collect()), key=repr)
    want = [(1, 1, 1, 2)] * 3 + [(2, 1, 1, 2), (1, 1, 1, 2), (None, 1, None, 2), (1, 1, 1, 0), (None, None, None, 0), (None, None, None, 0), (3, 3, 3, 0), (3, 3, 3, 0),
        (None, None, None, 0), (4, 4, 4, 0)]
    assert got == sorted(want, key=repr)
    kept = jaccard_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert left in [sorted([(1, t), (1, rows[4][1]), (None, rows[6][1]), (3, None), (3, None), (None, ""), (4, " ")], key=repr) for t in (rows[0][1], rows[3][1])]
    assert jaccard_join.stage(spark, docs.limit(0), "").count() == 0


def test_totals_meet_rows_in_one_join(spark, monkeypatch):
    """Frequent keys are no case of their own: one plain join of rows and written totals, without an anti join or a broadcast of keys."""
    monkeypatch.setattr("lotwise.llm.components.FREQUENT", 10)
    rows = spark.createDataFrame([(k % 3 if k % 5 else 100 + k, k) for k in range(3000)] + [(None, 1)], "g long, v long")
    kept = with_totals(rows, "g", 3001, "n > 1", n=F.count("*"), most=F.max("v"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftAnti" not in plan and "Aggregate" not in plan and "Union" not in plan and "broadcast" not in plan
    got = sorted(tuple(r) for r in kept.collect())
    own = {g: [k for k in range(3000) if k % 5 and k % 3 == g] for g in range(3)}
    assert got == [(g, v, len(own[g]), max(own[g])) for g in range(3) for v in own[g]]


def test_few_large_nodes_are_compared(spark, monkeypatch):
    """Near copies and strangers in one large node: where large nodes have few rows, only those that are alike are linked, after one split."""
    monkeypatch.setattr("lotwise.llm.jaccard_join.FREQUENT", 10_000)
    rng = random.Random(9)
    common = " ".join(words(rng, 90))
    texts = [f"{common} {' '.join(words(rng, 3))}" for _ in range(90)] + [" ".join(words(rng, 100)) for _ in range(20)]
    rows = spark.createDataFrame([(k, jaccard_join.embed(jaccard_join.shingles(t)).tobytes()) for k, t in enumerate(texts)], "rep long, minhashes binary")
    scratch = Scratch(spark, "test")
    edges = jaccard_join.candidate_edges(rows, scratch)
    assert {r.node: r.root for r in components(edges, scratch, "c").collect()} == {k: 0 for k in range(90)}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/nodes-2")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_frequent_keys_are_not_gathered(spark, monkeypatch):
    """Totals, components and nodes are the same whichever keys count as frequent."""
    rng = random.Random(6)
    rows = spark.createDataFrame([(0 if k % 3 else rng.randrange(40), k) for k in range(600)], "g long, v long")
    edges = [(k, 500) for k in range(400)] + [(k + 1, k) for k in range(900, 960)] + [(500, 3), (901, 1000)]
    texts = spark.createDataFrame(list(enumerate(near_copies()[:120])), "doc_id long, text string")
    results = []
    for least in (1, 10**9):
        monkeypatch.setattr("lotwise.llm.components.FREQUENT", least)
        monkeypatch.setattr("lotwise.llm.jaccard_join.FREQUENT", least)
        totals = sorted(tuple(r) for r in with_totals(rows, "g", 600, total=F.sum("v")).collect())
        roots = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect())
        results.append((totals, roots, sorted(tuple(r) for r in jaccard_join.jaccard_classes(texts, Scratch(spark, "test")).collect())))
    assert results[0][:2] == results[1][:2] and len(results[0][0]) == 600
    assert all(len(r[2]) == len(results[0][2]) and sum(a != b for a, b in zip(r[2], results[0][2])) <= 4 for r in results)


def test_components(spark):
    edges = [(k + 1, k) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}


def brute_tiles(doc, item, least):
    """Longest common run of unmarked words, again and again."""
    a, b, out = list(doc), list(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and isinstance(a[i + n], int):
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return out
        out.append(best)
        a[i : i + n], b[j : j + n] = [f"x{i}"] * n, [f"y{j}"] * n


def test_tiles():
    rng = random.Random(3)
    for k in range(150):
        kinds = rng.choice((1, 2, 4, 6, 12))
        item = [rng.randrange(kinds) + 1 for _ in range(rng.choice((5, 12, 25)))]
        doc = [rng.randrange(kinds) + 1 for _ in range(rng.choice((4, 20, 40)))]
        cut = rng.randrange(1, len(item))
        doc[10:10] = item[cut:] + [90] + item[:cut] if k % 3 else []
        least = rng.choice((2, 4, 5))
        pairs = [(i, j) for i in range(len(doc) - least + 1) for j in range(len(item) - least + 1) if doc[i : i + least] == item[j : j + least]]
        want = brute_tiles(doc, item, least)
        i, j = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        found = decontaminate.matches((i, j), least) if pairs else []
        assert decontaminate.tiles(len(doc), len(item), least, found) == want
        assert decontaminate.tiles_by_rows(np.array(doc), np.array(item), least) == want


def brute_leaks(text, items, least, coverage):
    out, doc = [], re.findall(r"\w+", (text or "").lower())
    number = {w: k for k, w in enumerate(dict.fromkeys(doc + [w for _, t in items for w in re.findall(r"\w+", (t or "").lower())]))}
    for item_id, t in items:
        words = re.findall(r"\w+", (t or "").lower())
        if len(words) < least:
            got = [(0, 0, len(words))] if words and doc == words else []
        else:
            got = brute_tiles([number[w] for w in doc], [number[w] for w in words], least)
        n = sum(x[2] for x in got)
        if got and n >= coverage * len(words):
            out.append((item_id, n / len(words), len(got), max(x[2] for x in got)))
    return out


@pytest.mark.parametrize("frequent,pairs", [(64, 10**6), (1, 10**6), (0, 10**6), (3, 5)])
def test_leaks_equal_brute_force(monkeypatch, frequent, pairs):
    """Random items that share phrases, in documents that hold some whole, some in part, some in another order."""
    monkeypatch.setattr(decontaminate, "FREQUENT", frequent)
    monkeypatch.setattr(decontaminate, "MOST_PAIRS", pairs)
    rng = random.Random(8)
    phrase = "a phrase that all of them share".split()
    items = []
    for k in range(30):
        own = [rng.choice("uvwxyz") + str(rng.randrange(4)) for _ in range(rng.choice((2, 9, 16)))]
        at = rng.randrange(len(own))
        items.append((k if k % 7 else None, " ".join([*own[:at], *(phrase if k % 2 else []), *own[at:]])))
    items += [(50, None), (51, ""), (52, " ".join(phrase * 3)), (53, "a phrase"), (54, items[3][1])]
    block = decontaminate.Block(items, 4, 0.5)
    for _ in range(40):
        parts = [*rng.sample(items[:30], 3), (0, " ".join(phrase * rng.randrange(3)))]
        words = [w for _, t in parts for w in (lambda x: x[rng.randrange(3) :] if rng.random() < 0.5 else x[len(x) // 2 :] + x[: len(x) // 2])(t.split())]
        text = " ".join(words)
        assert block.leaks(text) == brute_leaks(text, items, 4, 0.5)
    assert block.leaks(None) == block.leaks("") == block.leaks("none of these") == []
    assert block.leaks("A  phrase!") == brute_leaks("A  phrase!", items, 4, 0.5) == [(53, 1.0, 1, 2)] and block.leaks("such a phrase") == []


def test_a_phrase_that_all_items_share_costs_little():
    monkeypatch.setattr("lotwise.llm.jaccard_join.FREQUENT", 10_000)
    rng = random.Random(9)
    phrase = "this very long phrase here is in all items".split()
    items = [(k, " ".join([*words(rng, 12), *phrase, *words(rng, 12)])) for k in range(20_000)]
    block = decontaminate.Block(items)
    text = " ".join([*words(rng, 600), *phrase, *words(rng, 580), *items[77][1].split(), *phrase])
    began = time.time()
    for _ in range(10):
        assert [x[0] for x in block.leaks(text)] == [77]
    assert time.time() - began < 1
    began = time.time()
    same = decontaminate.Block([(1, "again " * 400), (2, "again " * 399 + "then")]).leaks("again " * 100_000)
    assert [x[0] for x in same] == [1, 2] and time.time() - began < 60


def test_decontaminate(spark):
    rng = random.Random(4)
    items = [words(rng, 30) for _ in range(6)] + [["tiny", "item"], []]
    docs = {
        0: words(rng, 50) + items[0] + words(rng, 9), 1: items[1][15:] + words(rng, 20) + items[1][:15], 2: items[2][:8] + words(rng, 50), 3: words(rng, 80),
            4: [w.upper() for w in items[3]], 5: ["a", "tiny", "item"], 6: ["Tiny", "item!"],
    }
    rows = [(k, " ".join(v)) for k, v in docs.items()] + [(8, None), (9, "")]
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, (None, rows[3][1]), rows[3]]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k if k != 3 else None, " ".join(v), "clash") for k, v in enumerate(items)] + [(20, None, None)], "item_id long, text string, coverage string")
    want = {(0, 0), (1, 1), (4, None), (6, 6)}
    for block in (10, 1 << 20):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench, block_words=block).collect()} == want
        left = decontaminate.drop_leaking(frame, bench, block_words=block)
        assert left.columns == frame.columns and sorted((r.doc_id for r in left.collect()), key=repr) == [2, 3, 3, 5, 8, 9, None]
        # Tasks of one Python worker each: no worker feeds another.
        plan = left._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        assert all("MapInArrow" not in below for line, below in zip(lines, lines[1:]) if "MapInArrow" in line)
        assert ("LeftAnti" in plan) == (block == 10) and ("Exchange" in plan) == (block == 10)
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == 0 and decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def read_pages(spark, rows, path, min_bytes=0, segment_bytes=16_384):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    scratch = Scratch(spark, "test")
    warc.write_warc(pages, str(path), scratch, min_bytes, segment_bytes)
    return sorted((tuple(r) for r in warc.read_warc(spark, str(path), scratch).collect()), key=repr)


def brute_warc(rows):
    """One row each: the response is the smallest page_id of a payload (null last), all others revisit it."""
    out, groups = [], {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for own, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(x, len(own), warc.digest(own), "revisit" if k else "response", ids[0] if k else None) for k, x in enumerate(ids)]
    return sorted(out, key=repr)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", None, "", "é" * 9_000, "é" * 9_000, "x\r\n\r\nWARC/1.1\r\n" * 2_000, "<p>a</p>", "y" * 3_000_000]
    rows = [(k, None if k == 2 else f"http://h/{k} x", h) for k, h in enumerate(html)]
    for cut in (100, 16_384):
        assert read_pages(spark, rows[: -1 if cut == 100 else None], tmp_path / str(cut), 0, cut) == brute_warc(rows[: -1 if cut == 100 else None])
    assert all(r[3] == "response" for r in read_pages(spark, rows[:-1] * 2, tmp_path / "least", 10**6))
    assert read_pages(spark, [], tmp_path / "none") == []
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunk(warc.chunked(b"z" * 10_000)) == b"z" * 10_000
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabcd\r\n0\r\n\r\n")


def test_warc_keys_that_repeat_or_are_null(spark, tmp_path):
    long = "long é" * 5_000
    rows = [(1, "u", long), (1, "u", long), (1, "v", long), (1, "u", "other"), (None, "u", "x"), (None, None, "x"), (2, "u", "x"), (None, "w", None), (None, "w", ""), (5,
        None, long), *[(9, "u", "hot")] * 300]
    assert read_pages(spark, rows, tmp_path / "keys") == brute_warc(rows)


def test_url_filter(spark):
    link = lambda *hosts: "".join(f"<a class=x href='http://{h}/p'>l</a>" for h in hosts)
    rows = [
        (0, "http://A.example.com/en/x?q", ""), (1, "https://www.example.com/en/", ""), (2, "http://b.net/es/1#y", link("bad.org")), (3, "http://linker.org/z",
            link("b.net")), (4, "http://good.org/", link("linker.org")),
        (5, "http://site.com/a", link("good.org")), (6, None, None), (7, "no-scheme", ""), (8, "http://x.com", ""), (9, "http://notcom/x", ""), (10, "http://b.net/en/1",
            ""), (10, "http://b.net/en/1", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, Scratch(spark, "test")).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2] == ("b.net", "/es/1", "net/es/", "block") and got[5] == ("site.com", "/a", "com/", "allow")
    assert got[3] == ("linker.org", "/z", None, "block") and got[4] == ("good.org", "/", None, "allow") and got[10] == ("b.net", "/en/1", None, "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("x.com", "", None, "allow") and got[9] == ("notcom", "/x", None, "allow")
    assert url_filter.judge(pages.limit(0), Scratch(spark, "test")).count() == 0


def test_ranks_equal_a_dense_computation(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("b", "a", 1), ("c", "a", 3), ("d", "c", 1)]
    names = "abcd"
    m, t, d = np.zeros((4, 4)), np.array([1.0, 0, 0, 0]), np.array([0, 0, 1.0, 0])
    for s, o, n in edges:
        m[names.index(s), names.index(o)] = n
    out, back = m / np.maximum(m.sum(1, keepdims=True), 1), (m / np.maximum(m.sum(0, keepdims=True), 1)).T
    trust, distrust = 0.15 * t, 0.15 * d
    for _ in range(2000):
        trust, distrust = 0.15 * t + 0.85 * trust @ out, 0.15 * d + 0.85 * distrust @ back
    nodes = spark.createDataFrame([(x, float(t[k]), float(d[k])) for k, x in enumerate(names)], "host string, trusted double, blocked double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(nodes, spark.createDataFrame(edges, "src string, dst string, links long"), Scratch(spark, "test"), tolerance=1e-4).collect()}
    for k, x in enumerate(names):
        assert got[x] == pytest.approx((trust[k], distrust[k]), abs=1e-3)
    with pytest.raises(RuntimeError):
        url_filter.propagate(nodes, spark.createDataFrame(edges, "src string, dst string, links long"), Scratch(spark, "test"), rounds=3)


def test_pipeline(spark):
    """Every stage on its predecessor's rows: what stays are rows of the input, and the ids are those of the texts."""
    import corpus_pipeline
    from lotwise.llm import byte_bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, "en", "s", 0), (None, "a null id, and words enough to be judged as good ones are, said the man in the old house by the river", "en", "s", 9), (10**9, "", "en", "s", 0)]
    docs = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == docs.columns, name
        assert after.exceptAll(docs).count() == 0, name
        kept[name], docs = after.count(), after
    assert len({r.doc_id for r in docs.collect()}) == docs.count() == kept["decontaminate"] > 100
    coded = {r.doc_id: list(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    library = byte_bpe.encoding(*byte_bpe.vocabulary())
    assert coded == {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_stages_on_nothing(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert all(stage(spark, none, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
