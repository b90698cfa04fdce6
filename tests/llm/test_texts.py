"""Operators on single texts against the libraries and brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import html_pages
from lotwise.llm import byte_bpe, chat, html_extract, quality_classifier, quality_rules, token_counts

TEXTS = [None, "", " ", "a", "Hello, world's   end.\n\nx", "naïve café — “q” 你好 ½²", "x<|endoftext|>y", "a" * 30_000, "ab cd " * 20_000, "1a2b'sx" * 9_000,
    "word\x00\x85  z", "Und Und Und Und Und", "dup", "dup", "plain words 😀 and हिन्दी then more, 한국어 x<|endoftext|>😀 y", "e\u0301a שלום  abc1 ไทย\n\n z" * 300,
    "😀" * 9_000, "a 😀 b" * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "src0", len(t or ""), "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long, ids string")


def test_byte_bpe(docs):
    rank_file, pattern = byte_bpe.vocabulary()
    library = byte_bpe.encoding(rank_file, pattern)
    want = {k: library.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    coded = byte_bpe.encode(docs, rank_file, pattern, piece_chars=50)
    assert coded.columns.count("ids") == 1
    assert {r.doc_id: r.ids for r in coded.collect()} == want
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(coded, rank_file, pattern).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    for r in byte_bpe.round_trip_digests(docs, rank_file, pattern, piece_chars=50).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.round_trip_digests(docs.limit(0), rank_file, pattern).count() == 0


def test_token_counts(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = token_counts.counts(path, public_tokenizers.PATTERN).library
    for r in token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, 1024).collect():
        text = TEXTS[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_token_counts_of_an_empty_table(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(docs.limit(0), path, public_tokenizers.PATTERN, 1024).count() == 0
    twice = token_counts.count_tokens(docs.unionByName(docs), path, public_tokenizers.PATTERN, 1024)
    assert twice.count() == 2 * len(TEXTS) and twice.distinct().count() == len(TEXTS)


def test_token_counts_forget(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    own = token_counts.Counts(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = [f"Ouan zzq{k} xxq{k + 1} Ouan qqz{k % 3}" for k in range(30)]
    assert [own.count(t) for t in texts] == [len(own.library.encode(t, add_special_tokens=False)) for t in texts]


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 5)})


def test_quality_rules(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(100, "a\nb c d e f\na\n \n\nb c d e f\n#*|", None, None, None, "x"), (101, "one two three four five six " * 3, None,
        None, None, "x")], docs.schema))
    rows = quality_rules.with_features(more.withColumnRenamed("ids", "p_good").withColumnRenamed("p_good", "other")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
    clash = docs.withColumnRenamed("ids", "n_words")
    assert set(quality_rules.stage(spark, clash, "").columns) == set(clash.columns)
    assert quality_rules.stage(spark, docs.limit(0), "").count() == 0


CLEAN = "The river of the little settlement is wide, and in springtime the water reaches the houses beside the mill. "
DECORATED = "The*** rivers### of*** that%%% old&&& towns$$$ is*** widening,%%% and&&& spring*** water$$$ comes*** upward&&& houses%%% mills*** today$$$ again### "
PHONES = "Call the office of the mayor at 5552748 or 5559913 to request another form, and the secretary of the settlement is there from morning until noon. "


def rules_corpus():
    """Clean texts, decorated ones, and clean ones with many numbers, on which the digits rule disagrees with all others."""
    rng = random.Random(2)
    made = []
    for k in range(400):
        kind = "decorated" if k % 10 == 0 else "phones" if k % 20 == 1 else "clean"
        base = {"decorated": DECORATED, "phones": PHONES, "clean": CLEAN}[kind].split()
        rng.shuffle(base)
        made.append((k, kind, " ".join(base) + f" {rng.choice('abcdefgh') * 5}"))
    return made


def rules_verdicts(features):
    scored = quality_rules.score(features, quality_rules.fit(features))
    return {r.doc_id: (r.kept, r.fired) for r in scored.withColumn("fired", sum(F.coalesce(v, F.lit(0)) for v in quality_rules.votes())).collect()}


def test_rules_that_disagree(spark):
    made = rules_corpus()
    got = rules_verdicts(quality_rules.with_features(spark.createDataFrame([(k, t) for k, _, t in made], "doc_id long, text string")))
    assert all(got[k][0] == (kind != "decorated") for k, kind, _ in made)
    assert all(got[k][1] >= 1 for k, kind, _ in made if kind == "phones")


def test_the_posterior_decides(spark):
    """On the given documents, verdicts follow neither any one vote nor the base rule, and agree with labels not used."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    features = quality_rules.with_features(docs.select("doc_id", "text")).drop("text").cache()
    judged = rules_verdicts(features.where(~quality_rules.base_failed()))
    fired = {k: v for k, v in judged.items() if v[1]}
    assert 0 < sum(kept for kept, _ in fired.values()) < len(fired)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in judged}
    agreed = sum(judged[k][0] == bool(y) for k, y in labels.items()) / len(labels)
    print(f"agreement with labels: {agreed:.4f} of {len(labels)}")
    assert agreed >= 0.98 and sum(judged[k][0] for k, y in labels.items() if y) >= 0.98 * sum(labels.values())
    for name, was in [(n, getattr(quality_rules, n)) for n in ("STARTS", "SHARE_PRIOR", "SENSITIVITY_PRIOR", "ALARM_PRIOR")]:
        for factor in (0.5, 2):
            try:
                setattr(quality_rules, name, tuple(tuple(min(0.95, factor * x) for x in row) for row in was) if name == "STARTS" else tuple(factor * x for x in was))
                other = rules_verdicts(features.where(~quality_rules.base_failed()))
            finally:
                setattr(quality_rules, name, was)
            assert sum(other[k] != judged[k] for k in judged) <= 0.002 * len(judged), (name, factor)
    features.unpersist()


def test_fit_settles_like_a_plain_one():
    """settle() against expectation-maximisation written with arrays."""
    rng = np.random.default_rng(1)
    n_rules = len(quality_rules.RULES)
    bad = rng.random(3000) < 0.1
    votes = np.where(rng.random((3000, n_rules)) < np.where(bad[:, None], 0.7, 0.04), 1.0, 0.0)
    votes[rng.random(votes.shape) < 0.1] = np.nan
    rows = collections.Counter(tuple(None if x != x else int(x) for x in r) for r in votes)
    _, (prior, s, f) = quality_rules.settle(list(rows), list(rows.values()), quality_rules.STARTS[0])
    p, a, b = quality_rules.STARTS[0][0], np.full(n_rules, quality_rules.STARTS[0][1]), np.full(n_rules, quality_rules.STARTS[0][2])
    one, zero = votes == 1, votes == 0
    for _ in range(200):
        x = p * np.prod(np.where(one, a, np.where(zero, 1 - a, 1)), 1)
        y = (1 - p) * np.prod(np.where(one, b, np.where(zero, 1 - b, 1)), 1)
        q = (x / (x + y))[:, None]
        p = (q.sum() + 1) / 3010
        a = ((q * one).sum(0) + 1) / ((q * (one | zero)).sum(0) + 2)
        b = (((1 - q) * one).sum(0) + 1) / (((1 - q) * (one | zero)).sum(0) + 21)
    assert prior == pytest.approx(p, abs=1e-6) and s == pytest.approx(list(a), abs=1e-6) and f == pytest.approx(list(b), abs=1e-6)
    assert abs(prior - 0.1) < 0.02


def test_rules_on_very_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(300_000))
    row = quality_rules.with_features(spark.createDataFrame([(0, text), (1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].n_words == row[0].n_distinct == row[0].n_digits == 300_000 and row[0].n_repeat_words == 0 and row[0][2:] == row[1][2:] and row[2].n_words == 0


def test_quality_classifier(spark):
    rows = [(k, ("good words in a row, said %d." % (k * 37)) if k % 3 else ("bad*** words$$$ in&&& %d%%%%%%" % (k * 37)), int(k % 3 > 0)) for k in range(300)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(900, None), (901, ""), (902, "x" * 3_000_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(7, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(~quality_classifier.learnable(F.col("doc_id"))).collect()}
    assert len(held) > 30 and all((got[a] >= 0.3) == bool(c) for a, _, c in rows if a in held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 303
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    assert quality_classifier.fit(docs.limit(0), labels.limit(0)).bias == quality_classifier.MIDDLE


def brute_indicators(text):
    """Buckets of all n-grams of a whole text, one by one."""
    data, out = (text or "").encode(), set()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    kind = lambda c: int(quality_classifier._CLASS[c])
    shapes = [kind(x[0]) << 24 | kind(x[min(1, len(x) - 1)]) << 16 | kind(x[-1]) << 8 | (k > 0 and w[k - 1] == x) for k, x in enumerate(w)]
    for codes, salt in ((list(data), 0), (shapes, 1 << 40)):
        for n in (1, 2, 3):
            for k in range(len(codes) - n + 1):
                run = codes[k] + salt
                for c in codes[k + 1 : k + n]:
                    run = (run * 0x9E3779B97F4A7C15 + c) % 2**64
                out.add(int(quality_classifier.mix(np.array([run + n], np.uint64) % np.uint64(2**64 - 1))[0] >> np.uint64(64 - quality_classifier.BITS)))
    return out


def test_indicators_are_those_of_the_whole_text():
    stamps = np.zeros(1 << quality_classifier.BITS, np.int64)
    rng = random.Random(4)
    texts = ["", " ", "a", "ab", *(" ".join(rng.choice(("the", "The", "é!", "x9", "longerword" * 3)) for _ in range(60)) for _ in range(4)), "x" * 300]
    for text in texts:
        want = brute_indicators(text)
        for block in (7, 32, 1 << 20):
            got = quality_classifier.indicators(text, stamps, block)
            assert len(got) == len(set(got.tolist())) and set(got.tolist()) == want


def test_training_equals_a_plain_solver():
    """Log-count ratios by counting, and the dual problem by projected gradient."""
    rng = np.random.default_rng(3)
    rows = [(int(k % 3 > 0), np.unique(rng.integers(0, 40, 12) + (20 if k % 3 else 0))) for k in range(60)]
    model = quality_classifier.train(rows, epochs=3000)
    size = 1 << quality_classifier.BITS
    ones, zeros = np.ones(size), np.ones(size)
    for y, x in rows:
        (ones if y else zeros)[x] += 1
    ratio = np.log(ones / ones.sum()) - np.log(zeros / zeros.sum())
    v = np.zeros((len(rows), 61))
    for k, (_, x) in enumerate(rows):
        v[k, x], v[k, 60] = ratio[x] / np.sqrt(len(x)), 1
    y = np.array([1.0 if a else -1.0 for a, _ in rows])
    q, alpha = (v @ v.T) * np.outer(y, y), np.zeros(len(rows))
    reach = np.linalg.norm(q, 2)
    for _ in range(50_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / reach, 0, 1)
    w = v.T @ (alpha * y)
    assert model.bias == pytest.approx(w[60], abs=1e-2) and model.weights[:60] == pytest.approx(w[:60] * ratio[:60], abs=1e-2)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "good text")] * 500 + [(k, f"good text {k}" if k % 2 else f"*** {k}") for k in range(2, 60)] + [(None, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(1, 0), (3, None), (None, 1)], "doc_id long, quality int")
    seen = []
    real = quality_classifier.train
    try:
        quality_classifier.train = lambda rows: seen.append(rows) or real(rows)
        quality_classifier.fit(docs, labels)
        quality_classifier.fit(docs, labels, sample=10)
        quality_classifier.fit(docs, labels, sample_buckets=100)
    finally:
        quality_classifier.train = real
    every, ten, few = seen
    assert 40 <= len(every) <= 62 and [sum(y == side for y, _ in ten) for side in (0, 1)] == [10, 10] and 2 <= len(few) and sum(len(x) for _, x in few) <= 100


def test_classifier_stage(spark, tmp_path):
    rows = [(k, "good words in a row" if k % 2 else "bad*** words$$$", "en", "s", 3, "clash") for k in range(60)]
    docs = spark.createDataFrame([*rows, (70, None, "en", "s", 0, "clash"), rows[1], (None, rows[1][1], None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, _score string")
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = quality_classifier.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id != 70), key=repr)
    assert ids == sorted([*(k for k in range(60) if k % 2), 1, None], key=repr)
    assert quality_classifier.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_html(spark):
    model = html_extract.default_model()
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class=ad>Buy it now.</div><article><h1>Head&amp;line here</h1><p><b>First  part,\nof some length, it is.<br><p>Second part of it, a &lt; b, said they. And more.</p></article><section class='comments'><p>I liked it, really.</p></section><footer>&copy; site</footer>"
    assert model.extract(page) == "Head&line here First part, of some length, it is. Second part of it, a < b, said they. And more."
    assert [model.extract(x) for x in (None, "", "<p>", "<!-- x", "<script>a")] == [""] * 5
    df = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, "clash"), (3, "u", page, "x"), (3, "u", page, "x"), (None, None, page, None)],
        "page_id long, url string, html string, text string")
    got = html_extract.extract_text(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = model.extract(page)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", want, len(want)), (2, None, "", 0), (3, "u", want, len(want)), (3, "u", want, len(want)),
        (None, None, want, len(want))], key=repr)
    assert html_extract.extract_text(df.limit(0), model).count() == 0


def found_and_wanted(model, pages):
    """Characters of main text that were found, that are found in all, and that are wanted."""
    hit = found = wanted = 0
    for page in pages:
        blocks = html_extract.leaf_blocks(page, model.known, marked=True)
        for b, keep in zip(blocks, model.decode(blocks)):
            n = len(b.text)
            hit, found, wanted = hit + n * (keep and b.main), found + n * keep, wanted + n * b.main
    return hit, found, wanted


def precision_and_recall(model, pages):
    hit, found, wanted = found_and_wanted(model, pages)
    return hit / found, hit / wanted


def test_html_on_pages_not_trained_on():
    apart = precision_and_recall(html_extract.default_model(), html_pages.PAGES)
    print("pages written apart: precision {:.3f}, recall {:.3f}".format(*apart))
    assert min(apart) >= 0.95
    pages = html_extract.labelled_pages()
    for part in range(3):  # three of the nine frames are left out, so these pages' main elements were never seen
        frames = [k * 9 // len(pages) for k in range(len(pages))]
        model = html_extract.train([p for p, f in zip(pages, frames) if f % 3 != part], rounds=200)
        for left in range(part, 9, 3):
            got = precision_and_recall(model, [p for p, f in zip(pages, frames) if f == left])
            print("left-out frame {}: precision {:.3f}, recall {:.3f}".format(left, *got))
            assert min(got) >= 0.95


@pytest.mark.parametrize("page,want", [
    ("<main><h1>What to pack</h1><ul><li>Tent<li>Stove<li>Rope</ul><p>All of it fits in one bag.</p></main><footer>&copy; me</footer>", "What to pack Tent Stove Rope All of it fits in one bag."),
    ("<nav><a href=/>Home</a></nav><article><h1>Walks</h1><p>First words of it, and more of them.</p><p><a href=/g>Guide to y</a></p><div class='warning'>We use cookies to make this site better.</div><p>Last words.</p></article>",
     "Walks First words of it, and more of them. Guide to y Last words."),
])
def test_html_lists_links_and_notices(page, want):
    assert html_extract.default_model().extract(page) == want


def test_html_likelihood_and_slope():
    """Against the sum over all labellings, and against differences of the likelihood."""
    rng = np.random.default_rng(5)
    lengths, n_features = (4, 1, 3), 3
    x, mask = rng.integers(0, 2, (3, 4, n_features)).astype(float), np.arange(4)[None] < np.array(lengths)[:, None]
    y = rng.integers(0, 2, (3, 4)) * mask
    own, penalty = rng.normal(size=n_features + 5), 0.01

    def slow(v):
        w, trans, first = v[:n_features], v[n_features:-1].reshape(2, 2), v[-1]
        total = 0
        for i, n in enumerate(lengths):
            say = lambda z: sum(z[t] * (x[i, t] @ w) for t in range(n)) + z[0] * first + sum(trans[a, b] for a, b in zip(z, z[1:]))
            total += say(list(y[i, :n])) - np.log(sum(np.exp(say([k >> t & 1 for t in range(n)])) for k in range(1 << n)))
        return total / len(lengths) - penalty * (v @ v) / 2

    value, slope = html_extract.likelihood(x, y, mask, own[:-5], own[-5:], penalty)
    assert abs(value - slow(own)) < 1e-9
    steps = np.eye(len(own)) * 1e-5
    assert np.allclose(slope, [(slow(own + d) - slow(own - d)) / 2e-5 for d in steps], atol=1e-6)


@pytest.mark.parametrize("bad", ["<script x", '<p "', '<p ="', '<p =\'">', "<b>", "<div>a", "<td>a<b>", "</script ", "<!", "&#1111111111111111", "<i><div><b></i>", "<p class='a b c'>x"])
def test_malformed_pages_take_time_in_proportion(bad):
    model = html_extract.default_model()
    began = time.time()
    model.extract(bad * (5_000_000 // len(bad)))
    assert time.time() - began < 60


def test_markup_rules():
    text = lambda x: [b.text for b in html_extract.leaf_blocks(x)]
    assert text("foo<!--main-->bar<!--x") == ["foobar"]
    assert text("<p title='a>b' class=c>one</p> two <y") == ["one", "two <y"]
    assert text("<a href=\"x>one</a> two") == ["one two"] and text("<p it's>one<p>it's > two") == ["one", "it's > two"]
    assert text("<script>a</scriptx>b</script foo>c") == ["c"] and text("a<script>b</script") == ["a"]
    assert text("1 < 2 <3 &#65; &#x000000000000041; &#99999999999999; &amp;") == ["1 < 2 <3 A A \ufffd &"]
    assert [b.main for b in html_extract.leaf_blocks("<!--main--><p>a</p><!--/main-->b", marked=True)] == [True, False]


@pytest.mark.parametrize("svg", ['<svg class="a>b" width=1 />', "<SVG/>", "<svg><svg/><text>hidden</text></svg>", "<svg viewBox='0 0 1 1'>hidden</svg>"])
def test_empty_svg_hides_nothing(svg):
    assert [b.text.split() for b in html_extract.leaf_blocks(f"<p>one {svg} two</p><p>three</p>")] == [["one", "two"], ["three"]]


def test_viterbi_is_the_best_labelling():
    import itertools

    model = html_extract.Model({"own:p": 0.4, "links:0": -0.9, "size:4": 1.3}, [[0.3, -0.7], [-0.2, 0.8]], -0.1)
    blocks = [html_extract.Block("x" * n, l, (), "p", False) for n, l in ((3, 0), (9, 9), (12, 0), (1, 0), (10, 4))]

    def value(y):
        return sum(model.score(b) for b, k in zip(blocks, y) if k) + model.first * y[0] + sum(model.transitions[a][b] for a, b in zip(y, y[1:]))

    assert value([int(x) for x in model.decode(blocks)]) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=5))))


def test_chat(spark):
    odd = ["<|", "<<|end|>\n", "[[x", "</s>[INST] ok [/INST]", "<|turn:user|>a<|end|>\n", "<", "", None, "<|lt|>", "a|>b"]
    for x in odd:
        assert chat.unescape(chat.escape(x or "")) == (x or "")
    turns = spark.createDataFrame([(c, t, ("user", "assistant", "we|>ird")[t % 3], x, 1) for c in (1, 2) for t, x in enumerate(odd)], "conv_id long, turn long, role string, text string, piece int")
    want = [(("user", "assistant", "we|>ird")[t % 3], x or "") for t, x in enumerate(odd)]
    for size in (1, 1 << 20):
        for r in chat.read_back(chat.format_chat(chat.text_parts(turns), size)).collect():
            said = [x for a, x in want if a == "assistant"]
            assert r.n_turns == len(odd) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in want).encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
    assert chat.format_chat(chat.text_parts(turns.limit(0))).count() == chat.read_back(chat.format_chat(chat.text_parts(turns.limit(0)))).count() == 0


def test_chat_with_audio_and_null_roles(spark):
    part = lambda kind, text=None, ref=None, units=None: {"kind": kind, "text": text, "ref": ref, "units": units}
    rows = [(1, 0, None, [part("audio", ref="a1", units=3), part("text", "said [this]")]), (1, 1, "assistant", [part("text", "yes"), part("audio", ref=None, units=0)]),
        (None, 0, "user", []), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:long>>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert [(a.position, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, "audio", "a1", 77), (1, "audio", None, 27)] and got[1].expanded_tokens == 104
    assert list(chat.parse_turns(got[1].formatted)) == [("", "<|audio:0:77|>said [this]"), ("assistant", "yes<|audio:1:27|>")]
    assert [got[1].formatted[a:b] for a, b in got[1].loss_spans] == ["yes"]
    assert list(chat.parse_turns(got[None].formatted)) == [("user", ""), ("", "")]


def test_chat_parts(spark):
    parts = [{"kind": "text", "text": "a<", "ref": None, "units": None}, {"kind": "image", "text": None, "ref": "img1", "units": 2}, {"kind": "text", "text": "|b",
        "ref": None, "units": None}, {"kind": "document", "text": None, "ref": "doc", "units": None}]
    df = spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:long>>")
    row = chat.format_chat(df).first()
    assert [(a.position, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "img1", 514), (1, "document", "doc", 642)] and row.expanded_tokens == 1156
    assert list(chat.parse_turns(row.formatted)) == [("user", "a<<|image:0:514|>|b<|document:1:642|>")]
