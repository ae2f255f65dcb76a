"""The corpus pipeline, stage by stage and as a whole, on documents made so that each stage's result is known; and cases of ids and columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm import bloom_lookup, mixing, suffix_tree, toxicity, url_filter, warc
from inkveil.llm.tokens import vocabulary_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made_documents():
    """Clean texts, toxic ones, short ones, and near copies of document 0 that differ in one word; labels of some."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in ("ra", "mo", "ti", "lu", "se") for b in ("ven", "dor", "kal", "mis") for c in ("a", "en", "ol", "ir", "us")]
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    rows = {k: text(500 + k) for k in range(60)}
    rows |= {100 + k: text(200) + " you stupid idiot, worthless scum. " + text(200) for k in range(20)}
    rows |= {200 + k: text(12) for k in range(6)}
    first = rows[0].split()
    rows |= {300 + k: " ".join([*first[: 10 + k], "changed", *first[11 + k :]]) for k in range(4)} | {310: rows[1]}
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 1) for k in range(15)]
    return [(k, t, "en", "abc"[k % 3], len(t)) for k, t in rows.items()], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = made_documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline(spark, tables):
    rows, _ = made_documents()
    docs, steps = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, tables).toPandas(), DOCS)
        steps[name] = docs.collect()
    ids = {name: sorted(r.doc_id for r in found) for name, found in steps.items()}
    clean, copies = list(range(60)), [300, 301, 302, 303, 310]
    assert ids["toxicity"] == clean + list(range(200, 206)) + copies
    assert ids["quality rules"] == clean + copies
    assert ids["near-duplicates"] == clean
    size, taken = Counter(), Counter()
    for r in steps["near-duplicates"]:
        size[r.source] += len(r.text.split())
    for r in steps["mixing"]:
        taken[r.source] += len(r.text.split())
    goal = mixing.targets(np.array([size[s] for s in "abc"]), np.array([5, 2, 1]))
    assert all(abs(taken[s] - g) <= 1 for s, g in zip("abc", goal, strict=True)) and max(Counter(ids["mixing"]).values()) <= 3
    # The whole run gives the pieces of those documents, by the whole tokenizer.
    tokenizer = Tokenizer.from_str(vocabulary_file(corpus_pipeline.VOCABULARY))
    tokens = defaultdict(list)
    for r in steps["mixing"]:
        tokens[r.doc_id].append(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4"))
    pieces, by_sequence = corpus_pipeline.run(spark, tables).collect(), Counter()
    for r in pieces:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in tokens[r.doc_id])
        by_sequence[r.sequence_id] += r.length
    assert sum(by_sequence.values()) == sum(len(x) for own in tokens.values() for x in own) and max(by_sequence.values()) <= 2048


IDS = [(None, "the cat sat there", "x"), (None, "the cat sat there", "x"), (1, "the cat sat there", "x"), (1, "a dog", "x"), (1, "a dog", "x"), (2, None, "x")]


def test_null_and_repeated_ids(spark):
    """Rows of equal or null ids stay apart in scores and fingerprints."""
    df = spark.createDataFrame(IDS, "doc_id long, text string, score string").withColumn("fingerprint", F.lit(0))
    got = Counter((r.doc_id, r.n_tokens) for r in suffix_tree.score(df).collect())
    assert got == {(None, 5): 2, (1, 5): 1, (1, 3): 2, (2, 1): 1}
    prints = [(r.doc_id, r.n_chars, r.fingerprint) for r in bloom_lookup.fingerprints(df).collect()]
    assert Counter(x[:2] for x in prints) == {(None, 17): 2, (1, 17): 1, (1, 5): 2, (2, 0): 1} and len({x[2] for x in prints}) == 3


def test_empty_pages_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, host string, path string, n long, digest string, kept long, value string"
    empty = spark.createDataFrame([], schema)
    assert url_filter.judge(empty, [("block", "com/en/")]).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/en/1", "<p>", "h", "p", 9, "d", 8, "v"), (2, "http://" + "." * 3000 + "com/en/", "<p>", "h", "p", 9, "d", 8, "v")], schema)
    got = {r.page_id: r for r in url_filter.judge(df, [("block", "com/en/"), ("allow", "a.com/en/1")]).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/en/1", "a.com/en/1", "allow") and got[2].rule == "com/en/"
    records = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()}
    assert records == {1: ("revisit", 2, 3), 2: ("response", None, 3)}


def test_long_payloads_have_archives_of_their_own(spark, tmp_path):
    rows = [(k, f"http://a.example/{k}", "x" * n + str(k)) for k, n in enumerate([10, 20, 3000, 3000, 90_000, 5])]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, file_records=4, file_bytes=4000)
    found = warc.runs(spark, path).collect()
    by_file = defaultdict(list)
    for r in found:
        by_file[r.run].append(r.payload_bytes)
    assert sorted(r.page_id for r in found) == list(range(6)) and all(len(own) == 1 or sum(own) <= 4000 for own in by_file.values())


def test_contradicting_labels_count_as_toxic(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert {(r.doc_id, r.toxic) for r in toxicity.once(labels).collect()} == {(1, 1), (2, 0)}
    df = spark.createDataFrame([(1, "b text"), (1, "a text"), (2, "c")], "doc_id long, text string")
    assert Counter(r.toxic for r in toxicity.sample(df, toxicity.once(labels)).collect()) == {1: 1, 0: 1}
