"""The registered queries and the pipeline, over tables with nulls, empty and very long texts, repeated rows and ids, and clashing columns."""

import collections
import hashlib
import random
import zlib

import pytest

import __spark_entry__
import corpus_pipeline

COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_packing": "doc_id bigint, segment bigint, n_tokens int, bucket_len int, batch bigint, slot int",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_decontaminate": "doc_id bigint, item_id bigint, distance int, start int, end int",
    "op5_html": "page_id bigint, url string, text string, n_chars bigint",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, key string, `k.x` int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    vocab = {"en": "the river of house and water with that this walked".split(), "de": "der fluss und das haus mit dieser wasser nicht ging".split()}
    texts = [(lang := rng.choice(list(vocab)), " ".join(rng.choices(vocab[lang], k=rng.randrange(20, 60))) + ".") for _ in range(70)]
    texts += [("en", " ".join(rng.choice(["$$$", "##!", "WIN|"]) for _ in range(40)) + str(i)) for i in range(30)]
    texts += [("en", None), ("en", ""), (None, " \t"), ("en", "word " * 30_000 + "x" * 150_000), texts[3], ("de", texts[3][1].upper())]
    rows = [(i, t, lang, "s", len(t or ""), "i", "h", "k", 1) for i, (lang, t) in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6][1], "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    item = " ".join(rng.choices([w for v in vocab.values() for w in v], k=30))
    rows.append((900, f"before {item} after", "en", "s", 1, "i", "h", "k", 1))
    path, none = str(tmp_path_factory.mktemp("edge")), str(tmp_path_factory.mktemp("none"))
    pages = [(1, "u", "<p>" + "some words " * 200 + "</p>", "x"), (2, "v", "<p>" + "some words " * 200 + "</p>", "x"), (3, None, None, None), (None, "w", "", "x"), (None, "w", "", "x"), (5, "u", "<div>" * 3000, "x")]
    made = {
        "documents": (rows, DOCS),
        "labels": ([(i, int(i < 70), 0, "t") for i in range(100)] + [(None, 1, 0, "t"), (5000, 0, 0, "t"), (3, None, 0, "t")], "doc_id long, quality int, toxic int, text string"),
        "benchmark": ([(1, item, "t"), (2, None, "t"), (3, "", None)], "item_id long, text string, id string"),
        "pages": (pages, "page_id long, url string, html string, archive string"),
    }
    for name, (data, schema) in made.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{none}/{name}.parquet")
    return path, none, [r[:2] for r in rows], pages


def fold(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", COLUMNS)
def test_queries(spark, tables, name):
    path, none, docs, pages = tables
    found = __spark_entry__.queries()[name](spark, path)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) == COLUMNS[name]
    rows = found.collect()
    ids = collections.Counter(r[0] for r in rows)
    if name in ("op5_html", "op8_warc"):
        assert ids == collections.Counter(p[0] for p in pages)
    elif name == "op4_decontaminate":
        assert [(r.doc_id, r.item_id, r.distance) for r in rows] == [(900, 1, 0)]
    elif name == "op2_packing":
        assert set(ids) == {i for i, _ in docs} and ids[5] == 3 and ids[None] == 2
    else:
        assert ids == collections.Counter(i for i, _ in docs)
    for op, n, out in (("op1_quality", 5, 0), ("op3_language", 4, 2), ("op9_lm", 7, 2)):
        assert name != op or all(r.held_out == (fold(r.doc_id, n) == out) for r in rows)
    for r in rows:
        if name == "op1_quality":
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if name == "op10_exact_dedup":
            assert r.text_sha256 in {hashlib.sha256((t or "").lower().encode()).hexdigest() for i, t in docs if i == r.doc_id}
        if name == "op3_language" and r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert __spark_entry__.queries()[name](spark, none).count() == 0


def test_pipeline_stages(spark, tables):
    path, none, docs, _ = tables
    given = spark.read.parquet(f"{path}/documents.parquet")
    out, before = given, given.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store(stage(spark, out, path))
        assert out.schema.simpleString() == given.schema.simpleString(), name
        before, now = out.count(), before
        assert before <= now
    left = [r.doc_id for r in out.collect()]
    texts = dict(docs)
    assert 900 not in left and not any(texts[i] and "$$$" in texts[i] for i in left if i is not None)
    assert len(left) == len(set(left)) > 50 and len({(texts[i] or "").lower() for i in left if i is not None}) == len([i for i in left if i is not None])
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, out, path).collect()} == set(left)
    assert corpus_pipeline.run(spark, none).count() == 0
