"""Each operator on edge cases (nulls, empties, repeats, clashing columns) and against brute force."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chainloom.llm import decontaminate, exact_dedup, html_text, language_id, line_dedup, lm_scoring, packing, quality, simhash, warc_zip

SCHEMA = "doc_id long, text string, id string, n int, key string, node string, lang string"
LONG = "word " * 40_000 + "x" * 200_000
TEXTS = ["Hello World", "hello world", None, "", "HELLO WORLD", "ÀÉ straße", "àé straße", "   \t\n", LONG, LONG.upper(), "a\nb\nc"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "k", "m", "en") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def edge(spark):
    return frame(spark, TEXTS).union(frame(spark, ["Hello World", None, "dup", "dup"], [None, None, 50, 50]))


def lower(t):
    return (t or "").encode().lower().decode()


def test_exact_dedup_edges(spark):
    rows = exact_dedup.exact_dedup(edge(spark)).collect()
    assert len(rows) == len(TEXTS) + 4
    want = collections.defaultdict(list)
    for i, t in [*enumerate(TEXTS), (None, "Hello World"), (None, None), (50, "dup"), (50, "dup")]:
        want[lower(t)].append(i)
    for sha in {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}.items():
        got = [r for r in rows if r.text_sha256 == sha[0]]
        assert sorted([r.doc_id for r in got], key=str) == sorted(sha[1], key=str)
        assert {r.group_size for r in got} == {len(sha[1])} and sum(r.kept for r in got) == 1
        top = max((i for i in sha[1] if i is not None), default=None)
        assert {r.keep_id for r in got} == {top} and next(r for r in got if r.kept).doc_id == top


def test_exact_dedup_keeps_rows(spark):
    kept = exact_dedup.keep_first(edge(spark))
    assert kept.columns == edge(spark).columns
    rows = kept.collect()
    assert len({lower(r.text) for r in rows}) == len(rows) == len({lower(t) for t in [*TEXTS, "dup"]})


def test_exact_dedup_of_rows_that_differ_elsewhere(spark):
    rows = [(7, "Same", i, "k") for i in range(50)] + [(None, "same", i, "k") for i in range(5)] + [(9, "other", 1, "k"), (9, "other", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, __key string")
    got = [sorted(map(tuple, exact_dedup.keep_first(x).collect())) for x in (df, df.repartition(6), df.orderBy(F.desc("`a.b`")))]
    assert got[0] == got[1] == got[2] and [x[:2] for x in got[0]] == [(7, "Same"), (9, "other")]


def test_chunks_are_content_defined_in_other_scripts(spark):
    rng = random.Random(4)
    for alphabet in ("漢字かなまじり文。、", "слово и дело, да "):
        text = "".join(rng.choices(alphabet, k=30_000))
        a, b = (set(r.c) for r in frame(spark, [text, "新" + text]).select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
        assert len(a & b) > 0.8 * len(a) > 8


def test_chunks_rebuild_the_text(spark):
    random.seed(1)
    texts = ["".join(random.choice("abcdgkp .,\n Aé") for _ in range(n)) for n in (0, 1, 767, 768, 5000, 20000)]
    rows = frame(spark, texts).select("text", F.concat_ws("", exact_dedup.chunks(F.col("text"))).alias("back"), F.size(exact_dedup.chunks(F.col("text"))).alias("n")).collect()
    assert all(r.text == r.back for r in rows) and max(r.n for r in rows) > 5


def test_empty_tables(spark):
    none = frame(spark, []).select("doc_id", "text", "lang")
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert simhash.near_dedup(none).count() == 0
    assert packing.pack(none).count() == 0
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(edge(spark), items).count() == 0
    assert lm_scoring.lm_score(none, F.lit(True)).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert language_id.train(none).predict("abc") == ("und", 0.0)
    assert quality.train(none, spark.createDataFrame([], "doc_id long, quality int")).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


# --- line dedup


def brute_lines(docs, least=20, most=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    null = -(2**63)
    seen = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(null if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= least and len(seen[key(x)]) >= most and (null if i is None else i) != max(seen[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    random.seed(seed)
    pool = [f"line number {i} of the shared pool" for i in range(6)] + ["short", "", "  Line Number 0 of the SHARED pool\t", "é" * 20, "hot line that nearly all documents have"]
    docs = [(random.choice([None, *range(40)]), random.choice([None, "", "\n".join(random.choice(pool) for _ in range(random.randrange(1, 12)))])) for _ in range(150)]
    rows = line_dedup.line_dedup(frame(spark, [t for _, t in docs], [i for i, _ in docs])).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows], key=str) == brute_lines(docs)
    for r in rows:
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_line_dedup_sends_no_whole_text_to_python(spark):
    line = "a line that three documents have in common"
    docs = spark.createDataFrame([(1, line), (2, f"{line}\nx"), (3, line), (4, "y"), (5, None)], "doc_id long, text string")
    out = line_dedup.line_dedup(docs)
    assert re.search(r"kept\(CASE WHEN isnotnull\(keep_bitmap#\d+\) THEN text#\d+ END, keep_bitmap", out._jdf.queryExecution().optimizedPlan().toString())
    assert {r.doc_id: r.text for r in out.collect()} == {1: "", 2: "x", 3: line, 4: "y", 5: ""}


def test_line_runs_split_over_partitions(spark):
    docs = [(i, "one line that all documents share\nline of its own %05d-----" % i) for i in range(600)]
    rows = line_dedup.line_dedup(frame(spark, [t for _, t in docs]).repartition(7)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows], key=str) == brute_lines(docs)


def test_line_dedup_of_repeated_rows_and_long_texts(spark):
    """Lines of a row that is repeated over and over are dealt over partitions; a text of many lines keeps them in order."""
    long = "\n".join(f"line {i} of a text that has very many of them" for i in range(20_000))
    docs = [(None, "a line that is repeated\nand one more that is repeated")] * 400 + [(7, long), (8, long + "\nx"), (9, long), (3, "and one more that is repeated"), (4, "and one more that is repeated")]
    df = frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5).withColumn("deal", F.lit("a")).withColumn("pos", F.lit("b"))
    rows = line_dedup.line_dedup(df).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows], key=str) == brute_lines(docs)


# --- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    for (i, a), (j, b) in itertools.combinations(fps.items(), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_texts(spark):
    texts = ["One two  three four", "one\ttwo three FOUR", "a", "a b", None, "", "é è ü ñ"] + [f"w{i} and more words follow here {i}" for i in range(5)]
    rows = {r.doc_id: r for r in simhash.near_dedup(frame(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == brute_components(fps)
    assert len(simhash.near_dedup(edge(spark)).collect()) == len(TEXTS) + 4


@pytest.mark.parametrize("crowd", [2, 8, 1024])
def test_simhash_links(spark, crowd):
    rng = random.Random(crowd)
    fps = {}
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            g = f
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                g ^= 1 << b
            fps[g] = rng.randrange(10**6)
    nodes = {v: k for k, v in fps.items()}
    df = spark.createDataFrame([(n, f - (1 << 64) if f >> 63 else f) for n, f in nodes.items()], "node long, fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, 3, crowd)).collect()}
    want = brute_components(nodes)
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_gray_rank():
    order = sorted(range(16), key=lambda x: int(simhash.gray_rank(np.array([x << 60], np.uint64))[0]))
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


# --- decontamination


def levenshtein_in(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (90, 120))
        assert decontaminate.myers(decontaminate._columns(p), len(p), t)[0] == levenshtein_in(p, t)


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(15))) for i in range(6)] + [(6, None), (7, "  ")]
    docs = []
    for d in range(40):
        t = list(rng.choice(items[:6])[1])
        for _ in range(rng.choice([0, 2, 6, 12, 30])):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["z"], [t[at], "y"]])
        docs.append(" ".join([*(word() for _ in range(20)), "".join(t).upper(), *(word() for _ in range(20))]))
    docs += [None, "", "nothing here"]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_chars=200).collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, p in items[:6]:
            n = levenshtein_in(decontaminate.normal(p), decontaminate.normal(t))
            if n <= int(len(p) * decontaminate.ERROR_RATE):
                want[d, i] = n
    assert got == want and len(want) > 15
    clean = decontaminate.keep_clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_adjacent_occurrences(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    edited = item.replace("brown", "brwn").replace("lazy", "lzzy")
    docs = [" ".join([item] * 7), " ".join([edited] * 5), f"start {edited} {item} {item} x {edited} end", item, "ab" * 50]
    items = spark.createDataFrame([(1, item), (2, "ab" * 10)], "item_id long, text string")
    rows = sorted((r.doc_id, r.start, r.end, r.distance, r.item_id) for r in decontaminate.matches(frame(spark, docs), items).collect())
    by = collections.defaultdict(list)
    for doc, start, end, distance, item_id in rows:
        by[doc].append(distance)
        part, whole = decontaminate.normal(docs[doc])[start:end], {1: item, 2: "ab" * 10}[item_id]
        assert levenshtein_in(whole, part) == distance and (distance or part == whole)
    assert by == {0: [0] * 7, 1: [2] * 5, 2: [2, 0, 0, 2], 3: [0], 4: [0] * 5}
    assert all(a[2] <= b[1] for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0])


# --- packing


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted(rng.sample(range(1, 40), rng.randrange(1, 8)))
        n = [rng.randrange(1, 30) for _ in sizes]
        k = rng.randrange(1, 5)
        pad = lambda edges: sum(c * (min(e for e in edges if e >= s) - s) for s, c in zip(sizes, n, strict=True))
        best = min(pad((*c, sizes[-1])) for r in range(min(k, len(sizes))) for c in itertools.combinations(sizes[:-1], r))
        got = packing.boundaries(sizes, n, k)
        assert pad(got) == best and len(got) <= k and got == sorted(got)


def test_pack(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 99, 100, 101, 250]) for _ in range(500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(None, None)], "doc_id long, n long")
    rows = packing.pack(df, length=F.col("n"), max_len=100, buckets=4, budget=400, shard_rows=20).collect()
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_len
    assert total == {**{i: n + 1 for i, n in enumerate(sizes)}, None: 1}
    for edge_, group in itertools.groupby(sorted(rows, key=lambda r: r.bucket_len), key=lambda r: r.bucket_len):
        batches = collections.defaultdict(list)
        for r in group:
            batches[r.batch].append(r.slot)
        room = 400 // edge_
        assert all(sorted(b) == list(range(len(b))) and len(b) <= room for b in batches.values())
        assert sum(len(b) < room for b in batches.values()) <= 1 and sorted(batches) == list(range(len(batches)))


def test_pack_counts_tokens(spark):
    rows = packing.pack(edge(spark)).collect()
    n = collections.Counter()
    for r in rows:
        n[r.doc_id] += r.n_tokens
    assert n[0] == 3 and n[3] == 1 and n[8] > 40_000


# --- classifiers


def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "river", "walked", "slowly", "under", "trees."]) for _ in range(rng.randrange(20, 60))) for _ in range(150)]
    bad = [" ".join(rng.choice(["buy!!!", "$$$", "###", "CLICK"]) for _ in range(rng.randrange(20, 60))) for _ in range(150)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300) if i % 3] + [(7, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, learn=F.col("doc_id") % 2 == 0)
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert sum(i in kept for i in range(150)) >= 148 and sum(i in kept for i in range(150, 300)) <= 2
    scores = edge(spark).select(quality.scorer(model, spark)("text").alias("s")).collect()
    assert len(scores) == len(TEXTS) + 4 and all(0 <= r.s <= 1 for r in scores)
    assert len(model.pairs) and model.score(np.zeros((2, len(quality.FEATURES)))).shape == (2,)


def test_quality_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and (model.pairs[0][0], model.pairs[0][1]) == (0, 1)


def test_language(spark):
    rng = random.Random(8)
    vocab = {"en": "the and of house water with this that which".split(), "de": "der und das haus wasser mit dieser welche nicht".split(), "fr": "le et la maison avec cette que eau être".split()}
    rows = [(i, lang := rng.choice(list(vocab)), " ".join(rng.choice(vocab[lang]) for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame([(i, t, lang) for i, lang, t in rows] + [(900, None, "en"), (901, "the", None)], "doc_id long, text string, lang string")
    model = language_id.train(df, learn=F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.p for r in df.select("doc_id", language_id.predictor(model, spark)("text").alias("p")).collect()}
    assert sum(got[i].lang_pred == lang for i, lang, _ in rows) >= 297 and got[900].lang_pred == "und" and got[900].score == 0
    assert (model.weights == 0).mean() > 0.5
    assert model.predict("123 456 !?")[0] == "und" and model.predict(LONG)[0] in vocab


def test_language_rare(spark):
    rows = [(i, "the water and house of this " * 3, "en") for i in range(3000)] + [(5000 + i, "der wasser und haus nicht welche " * 3, "de") for i in range(3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train_rows=60)
    assert model.langs == ["de", "en"] and model.predict("und nicht der haus")[0] == "de" and model.predict("this house and water")[0] == "en"


def test_language_counts_in_parts(monkeypatch):
    text = "Ein langer Text, 12 mal gezählt. " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "PART", 37)
    assert all((a == b).all() for a, b in zip(whole, language_id.counts(text), strict=True))


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><p>Site header text that is long enough to be a paragraph of its own, were it not a header.</p></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, a long sentence on cookies and consent follows here for you.</div>
<div id="content"><h1>Heading &amp; more</h1><p>First   paragraph with <b>bold</b>&nbsp;text &lt;here&gt; and enough characters to make the window rise quickly.<p>Short.</p>
<div class="ad">Advert text that is fairly long and should never be in the result of the extraction at all.</div>
<p>Second&#8217;s paragraph<br>with a break, and it goes on for a while so that it counts as a real block of text.</p><form><p>Your name</p></form></div>
<section class="comments"><p>A reader's comment that is as long as a paragraph, with many words, but not wanted here.</p></section>
<footer>&copy; footer</footer></body></html>"""


def test_html():
    want = ["Heading & more", "First paragraph with bold text <here> and enough characters to make the window rise quickly.", "Short.", "Second’s paragraph with a break, and it goes on for a while so that it counts as a real block of text."]
    assert html_text.extract(PAGE) == "\n".join(want)
    inner = "".join(f"<p>{x}</p>" for x in ("One.", "Two.", "Three."))
    assert html_text.extract(f"<body><div>noise that is outside of the article but quite long for what it is, really</div><article>{inner}</article></body>") == "One.\nTwo.\nThree."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p>") == html_text.extract("<script>x</script>") == ""
    assert html_text.extract("plain words") == "plain words"
    assert len(html_text.extract("<p>" + "word " * 50_000)) == 249_999
    assert html_text.extract("<div " + "a=\"b\" " * 2000 + "<<<>>> <p>text</p")


def test_html_keeps_short_lines_of_the_article():
    article = f'<h1>Short title</h1><div class="ad">x</div><p>{"word " * 60}</p><aside>y</aside><p>Brief closing sentence.</p>'
    want = "Short title\n" + ("word " * 60).strip() + "\nBrief closing sentence."
    assert html_text.extract(f"<article>{article}</article>") == want
    assert html_text.extract(f'<body><div>Top</div><main>{article}<div><p>Note.</p></div></main><div>{"noise " * 40}</div></body>') == want + "\nNote."
    assert html_text.extract(f'<body><nav>n</nav><div id="content">{article}</div><nav>n</nav><p>Imprint</p></body>') == want


LONG_P = f"<p>{'long words of the text ' * 20}</p>"


@pytest.mark.parametrize(
    ("page", "n", "end"),
    [
        (f"<article>{LONG_P}<div><div><div></div></div></div><p>End.</p></article>", 2, "End."),
        (f"<article>{LONG_P}<section><div><div><p>Short.</p></div></div></section></article>", 2, "Short."),
        (f'<div class="search-result-article">{LONG_P}</div>', 1, "text"),
        (f'<div class="post share">{LONG_P}</div><div class="sidebar">{LONG_P}</div>', 1, "text"),
        (f'<div class="entry-footer">{LONG_P}</div><div class="page-with-sidebar has-sidebar">{LONG_P}<p>End.</p></div><div class="comment-body">{LONG_P}</div>', 2, "End."),
        (f'<main><div class="sidebar">{LONG_P}</div><article class="post comments-open">{LONG_P}<div class="ad-slot">no</div><p>End.</p></article></main>', 2, "End."),
        (f'<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>x<td>y<tr><td>z</table>{LONG_P}</article>', 8, "text"),
    ],
)
def test_html_articles(page, n, end):
    lines = html_text.extract(page).split("\n")
    assert len(lines) == n and lines[-1].endswith(end)


@pytest.mark.parametrize("unit", ["<b>", "<span><p>", "<div><li>x", "</b>", "<p><table><tr><td>", "<!--", "<a b='"])
def test_html_takes_linear_time(unit):
    import time

    def seconds(n):
        start = time.process_time()
        html_text.extract(unit * n)
        return time.process_time() - start

    few = max(0.05, min(seconds(4000) for _ in range(2)))
    assert seconds(40_000) < 40 * few


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert rows[2].text == "" and rows[2].n_chars == 0 and rows[None].text == "a" and rows[1].n_chars == len(rows[1].text)


# --- WARC in ZIP


def test_warc_round_trip(spark):
    big, small = "<p>é" + "x" * 1000, "tiny"
    pages = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "u2", small), (4, "u4", small), (6, "u", None), (7, "u7", big + "y"), (None, "u8", big), (5, "u5", big)]
    rows = warc_zip.round_trip(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, top string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next(h for i, _, h in pages if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        revisit = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert r.payload == (None if revisit else html.encode())


def zip64(name, content):
    """A stored member whose sizes and offsets are all in ZIP64 fields."""
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(content), len(content)) + content
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28 + 9, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HH5s", 99, 5, b"other") + struct.pack("<HHQQQ", 1, 24, len(content), len(content), 0)
    end = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    return local + central + end + b"PK\6\7" + struct.pack("<IQI", 0, len(local) + len(central), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"


def test_zip64_and_files(tmp_path):
    z = warc_zip.ZipArchive.of_bytes(zip64(b"a/b.txt", b"0123456789"))
    assert z.range("a/b.txt") == b"0123456789" and z.range("a/b.txt", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        z.range("a/b.txt", 5, 6)
    with pytest.raises(ValueError):
        warc_zip.ZipArchive.of_bytes(b"no archive")
    path = tmp_path / "x.zip"
    path.write_bytes(warc_zip.build_archive([(3, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None), (2, None, b"abc", hashlib.sha1(b"abc").hexdigest(), 3)]))
    first, second = warc_zip.ZipArchive.of_file(str(path)).records()
    assert first.block == b"abc" and second.block == b"" and second.headers["warc-refers-to"] == "<urn:page:3>"
    assert gzip.decompress(warc_zip.ZipArchive.of_file(str(path)).range(warc_zip.DATA)).count(b"WARC/1.1") == 2


# --- language model


def test_lm_scores(spark):
    rng = random.Random(9)
    vocab = ["ab", "cd", "the", "x" * 60, "É", "zz"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "THE  the\tunseen", "y" * 300]
    learn = lambda i: i % 3 != 0 and i < 60
    df = frame(spark, texts)
    rows = {r.doc_id: r for r in lm_scoring.lm_score(df, (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 60), bits=4.0).collect()}
    assert len(rows) == len(texts)
    words = {i: lower(t).split() for i, t in enumerate(texts)}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in enumerate(texts)}
    c = collections.Counter(x for i, w in words.items() if learn(i) for x in [*w, None])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = rows[i]
        assert r.train_tokens == n and r.held_out == (not learn(i)) and r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in [*w, None])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]))
        assert r.score < 0
    held = [r for r in rows.values() if r.held_out and r.doc_id < 60]
    assert sum(r.score for r in held) > sum(3 * r.base_score for r in held)


def test_tree_is_a_distribution_and_uses_longest_suffix():
    rng = random.Random(10)
    texts = [b" ".join(rng.choice([b"abab", b"abc", b"ca"]) for _ in range(50)) for _ in range(40)]
    grams, _ = lm_scoring.stream(texts)
    counts = lm_scoring.lower_orders(*lm_scoring.count(grams), lm_scoring.DEPTH)
    tree = lm_scoring.grow(counts, bits=4.0)
    assert sum(len(x[0]) for x in tree.orders) > 5
    for context in (b"\n\n\n\n\n\n", b" abab ", b"zzzzzz", b"b abca"):
        g = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert (10 ** tree.log10(g)).sum() == pytest.approx(1)
    some = grams[:500]
    c = collections.Counter(int(x) for x in grams)
    longest = tree.orders[lm_scoring.DEPTH - 1]
    for g in some.tolist():
        if (g >> 8) in set(longest[0].tolist()) and c[g]:
            total = sum(n for x, n in c.items() if x >> 8 == g >> 8)
            assert 10 ** tree.log10(np.array([g], np.uint64))[0] == pytest.approx(c[g] / total, rel=0.5)


def test_tree_prunes_contexts_that_add_nothing():
    rng = np.random.default_rng(0)
    text = bytes(rng.choice(np.frombuffer(b"abcd", np.uint8), 5000))
    grams, _ = lm_scoring.stream([text])
    tree = lm_scoring.grow(lm_scoring.lower_orders(*lm_scoring.count(grams), lm_scoring.DEPTH), bits=60.0)
    assert len(tree.orders[1][0]) < 8


def test_runs_pack():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**48, 1000, dtype=np.uint64))
    n = np.arange(1, len(keys) + 1)
    a, b = lm_scoring.unpack_run(lm_scoring.pack_run(keys, n))
    assert (a == keys).all() and (b == n).all()


def test_stream_matches_a_plain_loop():
    texts = [b"ab c", b"", b"d"]
    grams, size = lm_scoring.stream(texts, 3)
    want = []
    for t in texts:
        s = b"\n\n\n" + t + b"\n"
        want += [int.from_bytes(s[i - 3 : i + 1], "big") for i in range(3, len(s))]
    assert grams.tolist() == want and size.tolist() == [5, 1, 2]


@pytest.mark.parametrize("texts", [[b"ab c", b"", b"d", b"ab c ab"], [bytes(range(128, 256)) + b"abcdefghij", b"xy"], [b"a" * 3000]])
def test_text_scores(texts):
    keys, n = lm_scoring.count(lm_scoring.stream(texts * 5)[0])
    tree = lm_scoring.grow(lm_scoring.lower_orders(keys, n, lm_scoring.DEPTH), bits=1.0)
    want = [tree.log10(lm_scoring.stream([t])[0]).sum() for t in texts]
    assert lm_scoring.text_scores(keys, tree.log10(keys), texts, lm_scoring.DEPTH) == pytest.approx(want)


def brute_tree(texts, depth, least, bits, shared):
    """P(symbol | context) of a plain suffix tree in dictionaries."""
    pad = b"\n" * depth
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        s = pad + t + b"\n"
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts[s[i - k : i]][s[i]] += 1
    counts = {c: x for c, x in counts.items() if len(c) < shared or x.total() >= least}

    def smooth(c, x, keep):
        while c and c not in keep:
            c = c[1:]
        if c == b"" and c not in counts:
            return 1 / 256
        below = 1 / 256 if c == b"" else smooth(c[1:], x, keep)
        return (counts[c][x] + len(counts[c]) * below) / (counts[c].total() + len(counts[c]))

    keep = {c for c in counts if len(c) < shared}
    for c in counts:
        if len(c) >= shared and sum(n * math.log2(n / counts[c].total() / smooth(c[1:], x, counts)) for x, n in counts[c].items()) >= bits:
            keep.update(c[i:] for i in range(len(c) + 1))
    return lambda t: sum(math.log10(smooth((pad + t + b"\n")[i - depth : i], (pad + t + b"\n")[i], keep)) for i in range(depth, depth + len(t) + 1))


@pytest.mark.parametrize("depth", [3, 6, 7])
def test_lm_scores_are_those_of_a_plain_tree(spark, depth):
    rng = random.Random(depth)
    vocab = ["abab", "abc", "ca", "É", "the", "then", "there"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) for _ in range(50)] + [None, "thereabouts zz", "abab abc"]
    df = frame(spark, texts, [None if i == 7 else i for i in range(len(texts))])
    learn = F.col("doc_id") % 3 != 0
    lines = [lm_scoring.normal(t) for t in texts]
    score = brute_tree([x for i, x in enumerate(lines) if i % 3 and i != 7], depth, 2, 5.0, lm_scoring.SHARED)
    for options in ({"block_bytes": 300}, {"block_bytes": 1 << 20, "least_ranges": 3}):
        rows = lm_scoring.lm_score(df, learn, depth=depth, bits=5.0, **options).collect()
        assert {r.doc_id: r.score for r in rows} == pytest.approx({None if i == 7 else i: score(x) for i, x in enumerate(lines)}, rel=1e-5)
    assert lm_scoring.lm_score(frame(spark, ["a b", ""]), F.lit(False)).where("score > -1000").count() == 2


def test_the_tree_grows_with_the_corpus():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)).encode() for _ in range(60)]
    size = []
    for some in (texts[:15], texts, texts * 4):
        keys, n = lm_scoring.count(lm_scoring.stream(some)[0])
        orders = lm_scoring.lower_orders(keys, n, lm_scoring.DEPTH)
        tree = lm_scoring.grow({k: lm_scoring.frequent(*v, 2) for k, v in orders.items()})
        size.append(sum(len(x[0]) for x in tree.orders))
    assert size[0] * 2 < size[1] < size[2]


def coder():
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("alphabet", ["abc déf's  \n\t12 !?-'", "漢字かな。、", "кот дом!  7", "ملك بيت 12،", "a", "x7", "' s!", " \n\u00a0"])
def test_parts_count_as_the_whole_text(alphabet):
    rng, enc = random.Random(len(alphabet)), coder()
    for n, most in ((3000, 50), (3000, 1), (250_000, 100_000)):
        text = "".join(rng.choices(alphabet, k=n))
        got = list(packing.parts(text, most))
        assert "".join(got) == text and sum(len(enc.encode_ordinary(x)) for x in got) == len(enc.encode_ordinary(text))


def test_parts_of_endless_white_space():
    text = "a" + " " * 1_300_000 + "b" + "\n" * 1_100_000
    got = list(packing.parts(text))
    assert "".join(got) == text and sum(len(coder().encode_ordinary(x)) for x in got) > 10


def test_pack_repeated_ids(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -5).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 7 + 90).alias("n"))
    runs = [packing.pack(x, length=F.col("n"), max_len=64, buckets=3, budget=640, shard_rows=100).collect() for x in (df, df.repartition(5))]
    assert sorted(runs[0], key=str) == sorted(runs[1], key=str) and len(runs[0]) == 18_000
    assert collections.Counter(r.doc_id for r in runs[0])[None] == collections.Counter(r.doc_id for r in runs[0])[-5] == 6000
    assert len({(r.bucket_len, r.batch, r.slot) for r in runs[0]}) == 18_000


def test_items_in_many_blocks_need_one_scan(spark):
    items = spark.createDataFrame([(i, f"item number {i} of the long list {i * i}") for i in range(12)], "item_id long, text string")
    docs = frame(spark, [f"before ITEM number {i} of the long list {i * i} after" for i in range(12)] + [None])
    found = decontaminate.matches(docs, items, block_chars=40)
    assert {(r.doc_id, r.item_id) for r in found.collect() if not r.distance} == {(i, i) for i in range(12)}
    assert sum("Scan" in x for x in found._jdf.queryExecution().executedPlan().toString().split("\n")) <= 2
