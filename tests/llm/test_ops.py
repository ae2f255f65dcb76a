"""The training-data operators against brute force, on small tables with odd rows."""

import base64
import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm import bloom_lookup, mixing, near_dup, packing, quality_rules, suffix_tree, token_planes, tokens, toxicity, url_filter, warc
from inkveil.llm.common import LOWER, forget
from inkveil.llm.tokens import encoder, vocabulary_file

VOCABULARY = vocabulary_file("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
BASE = "The cat sat on the mat and looked at the old grey dog. Nobody said a word.\nThen the rain came down, slowly at first!\n" * 3
ODD = [
    (0, None, "en", None, None, 0.5, "x"), (1, "", "en", "", 0, None, None), (2, " \n\t ", "en", "b", 3, None, None), (3, "word", "en", "a", 4, None, None), (4, "word", "en", "a", 4, None, None), (4, "word", "en", "a", 4, None, None),
    (5, BASE, "en", "a", 1, None, None), (6, BASE, "en", "a", 1, None, None), (7, BASE + "One more line here, it is short.", "en", "b", 1, None, None), (8, "é日本 ünï x " * 40, "de", "é", 1, None, None),
    (9, "x" * 70_000, "en", "a", 1, None, None), (10, "a b c d e f g. " * 3000, "en", "a", 1, None, None), (11, "\n".join(["same line"] * 60), "en", "c", 1, None, None), (None, "no id here at all", "en", "a", 1, None, None),
]
EMPTY: list = []


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower_words(t):
    return (t or "").encode().translate(LOWER).split()


def ids_of(t):
    tok = Tokenizer.from_str(VOCABULARY)
    tok.encode_special_tokens = True
    return np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


# Tokens, packing, planes


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_chunks_encode_as_whole_texts(texts):
    assert encoder(VOCABULARY).encode([t.encode() for t in texts]) == [ids_of(t) for t in texts]


def test_encoders_remember_within_bounds():
    """By all they hold; a stage that needs no encoder gives it back."""
    words, sizes = encoder(VOCABULARY), []
    for k in range(0, 1_100_000, 20_000):
        words.encode([" ".join(f"q{x:x}w" for x in range(k + a, k + a + 1000)).encode() for a in range(0, 20_000, 1000)])
        held = [m for both in (words.chunks, words.parts) for m in (both.young, both.old)]
        sizes.append(sum(map(len, held)))
    assert max(sizes) <= 4 * 425_000
    size = sum(sys.getsizeof(m) + sum(map(sys.getsizeof, m)) + sum(map(sys.getsizeof, m.values())) for m in held)
    assert size < 300e6, size
    forget()
    assert encoder(VOCABULARY) is not words


def test_words_are_remembered_once():
    """Not once more for each case of their letters and marks behind them."""
    forget()
    words = encoder(VOCABULARY)
    assert words.encode(["Straße straße, STRASSE. Straße!! Übung (übung) x×y".encode()]) == [ids_of("Straße straße, STRASSE. Straße!! Übung (übung) x×y")]
    assert {x.decode() for m in (words.parts, words.chunks) for x in m.young} == {"straße", "strasse", "übung", ",", ".", "!!", "(übung)", "x×y"}


def test_words_are_looked_up_once_for_a_group(monkeypatch):
    """What is done word by word hangs on distinct words, not on all words of the texts."""
    words, asked = encoder(VOCABULARY), []
    plain = words._values
    monkeypatch.setattr(words, "_values", lambda keys: asked.extend(keys) or plain(keys))
    texts = ["Rain, rain. Sun! " * 500, "sun rain, " * 700, ""]
    rows = list(zip([None, 4, 9], words.encode([t.encode() for t in texts])))
    assert [ids for _, ids in rows] == [ids_of(t) for t in texts]
    assert sorted(asked) == [b"!", b",", b".", b"rain", b"sun"]
    data = b"".join(f + b"\n" for f in token_planes.file_frames(iter(rows), 512))
    assert list(token_planes.read_file(data)) == rows


LATIN = st.text("aZéÉßÿ×÷Ø.,'!7~\x00\x7f\u0301日 \t\n\x85\xa0", max_size=40)


@given(st.lists(LATIN, max_size=6), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_pieces_of_texts_encode_as_whole_texts(texts, most):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "GROUP_BYTES", most)
        assert encoder(VOCABULARY).encode([t.encode() for t in texts]) == [ids_of(t) for t in texts]


def plain_cuts(text, words):
    """Where a text can be cut, word by word."""
    at, p, begin = [], 0, 0
    chunks = list(re.finditer(rb"[^\x20\x09-\x0D]+", text))
    for k, m in enumerate(chunks):
        gap = text[m.end() : chunks[k + 1].start()] if k + 1 < len(chunks) else b"\n"
        p += len(words.encode([m[0]])[0]) // 4 - 1
        at.append((p, packing.AT_SENTENCE if m[0][-1:] in b".!?" or b"\n" in gap else packing.AT_WORD))
    out = {}
    for k, (p, price) in enumerate(at):
        sentence_end = next((q for q, x in at[k:] if x == packing.AT_SENTENCE), None)
        if price == packing.AT_SENTENCE:
            out.setdefault(p, price)
            begin = p
        elif p - begin >= packing.LONG_SENTENCE and p < sentence_end:
            out.setdefault(p, price)
            begin = p
    return [(p, x) for p, x in out.items() if 0 < p < at[-1][0]]


@given(st.lists(st.lists(st.sampled_from(["a ", "word, ", "end. ", "line\n", "\n", "\x85 ", "7 ", "no " * 100, "way\t" * 230]), max_size=12).map("".join), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_cuts_of_texts_together(texts):
    words, texts = encoder(VOCABULARY), [t.encode() for t in texts]
    joined = b"\n".join([*texts, b""])
    _, last, upto = words.chunk_ids(joined)
    ends = tokens.up_to_texts(texts, last, upto)
    at, penalty = packing.cut_points(np.frombuffer(joined, np.uint8), last, upto, ends)
    want = [(p + a, x) for t, a in zip(texts, [0, *ends.tolist()]) for p, x in plain_cuts(t, words)]
    assert list(zip(at.tolist(), penalty.tolist())) == want


@pytest.mark.parametrize("bits", [False, True])
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=40, deadline=None)
def test_planes_round_trip(bits, ids):
    a = np.array(ids, "<u4")
    assert (token_planes.from_planes(token_planes.to_planes(a, bits), len(a), bits) == a).all()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rows = [(None, b"\1\0\0\0"), (3, np.arange(1000, dtype="<u4").tobytes()), (3, b"\1\0\0\0"), (9, np.arange(7, dtype="<u4").tobytes())]
    data = b"".join(f + b"\n" for f in token_planes.file_frames(iter(rows), 64, bits))
    assert list(token_planes.read_file(data)) == rows


def test_token_planes(spark):
    got = token_planes.digests(docs(spark), VOCABULARY, chunk_ids=128).collect()
    start, want = 0, []
    for i, t in sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(t)
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    key = lambda r: r[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == want
    assert token_planes.digests(docs(spark, EMPTY), VOCABULARY).count() == 0


def test_packing(spark):
    got = packing.pack(docs(spark, ODD[:-1]), VOCABULARY, length=256, block_tokens=2000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    whole = {i: ids_of(t) for i, t, *_ in ODD[:-1]}
    for i, pieces in by_doc.items():
        for r in pieces:
            assert r.doc_tokens == len(whole[i]) // 4 and r.ids_crc32 == zlib.crc32(whole[i][4 * r.start : 4 * (r.start + r.length)])
        assert sum(r.length for r in pieces) == len(whole[i]) // 4 * (2 if i == 4 else 1)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and all(r.padding == (0 if at & (at - 1) == 0 else 256 - at) for r in pieces)
    tokens = sum(len(x) // 4 for x in whole.values())
    assert sum(p[0].padding for p in by_sequence.values()) < 0.05 * tokens
    assert packing.pack(docs(spark, EMPTY), VOCABULARY).count() == 0


@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 3)), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_cuts_are_the_cheapest(steps):
    length, at, penalty = 16, [0], [0]
    for gap, p in steps:
        at.append(at[-1] + gap)
        penalty.append(p * 5)
    pad = lambda n: 0 if n == length or (n & (n - 1) == 0 and n >= packing.SMALLEST) else length - n
    best = [0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + pad(at[j] - at[i]) + penalty[j] + packing.PRICE for i in range(j) if at[j] - at[i] <= length)
    cuts = packing.best_cuts(at, penalty, length)
    assert sum(pad(at[b] - at[a]) + penalty[b] + packing.PRICE for a, b in zip(cuts, cuts[1:])) == best[-1]


# Language-model scores


def test_suffix_tree(spark):
    got = {r.doc_id: r for r in suffix_tree.score(docs(spark, ODD[:4] + ODD[6:13]), min_count=4, min_gain=1.0).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = Counter(w for i, t, *_ in ODD[:4] + ODD[6:13] if not held(i) for w in [*lower_words(t), b"\n"])
    n, v = sum(train.values()), len(train)
    for i, t, *_ in ODD[:4] + ODD[6:13]:
        own = [*lower_words(t), b"\n"]
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(w in train for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert suffix_tree.score(docs(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_contexts_of_three_classes_score(spark, monkeypatch, held):
    """Against a plain tree of dicts; the third class before a word tells it, two don't."""
    monkeypatch.setattr(suffix_tree, "HELD_GRAMS", held)
    rng = np.random.default_rng(5)
    texts = ["".join(f"{a} mm nn {b} " for a, b in [("aa", "xx") if rng.random() < 0.5 else ("bb", "yy") for _ in range(12)]) + f"w{k % 4}" for k in range(120)]
    got = {r.doc_id: r for r in suffix_tree.score(docs(spark, [(k, t, *ODD[0][2:]) for k, t in enumerate(texts)])).collect()}
    streams = [suffix_tree.stream(lower_words(t)) for t in texts]
    seen, classes = defaultdict(Counter), defaultdict(Counter)
    for k, t in enumerate(streams):
        if not got[k].held_out:
            for j in range(3, len(t)):
                for d in range(4):
                    seen[t[j - d : j]][t[j]] += 1
            for w, c in zip([*lower_words(texts[k]), b"\n"], t[3:], strict=True):
                classes[c][w] += 1
    share = lambda c, s: seen[c][s] / seen[c].total()
    kept = {c for c, n in list(seen.items()) if c and n.total() >= 32 and sum(m * math.log(share(c, s) / share(c[1:], s)) for s, m in n.items()) >= 24}
    assert sum(len(c) == 3 for c in kept) >= 2
    kept |= {c[j:] for c in kept for j in range(len(c) + 1)}

    def p(c, s):
        while c not in kept:
            c = c[1:]
        n = seen[c]
        if not c:
            return (n[s] + 0.5) / (n.total() + 128)
        return max(0, n[s] - 0.5) / n.total() + 0.5 * len(n) / n.total() * p(c[1:], s)

    for k, t in enumerate(streams):
        want = 0.0
        for j, w in zip(range(3, len(t)), [*lower_words(texts[k]), b"\n"], strict=True):
            of = classes[t[j]]
            want += math.log10(p(t[j - 3 : j], t[j]) * (of[w] + 0.5) / (of.total() + 0.5 * (len(of) + 1)))
        assert math.isclose(got[k].score, want, rel_tol=1e-5), k


def test_automaton_follows_the_longest_suffix():
    rng = np.random.default_rng(1)
    texts = [suffix_tree.stream([b"%c" % c for c in rng.choice(list(b"abcd"), 40, p=[0.6, 0.2, 0.1, 0.1])]) for _ in range(30)]
    tables: dict = {}
    for t in texts:
        for k in range(suffix_tree.DEPTH, len(t)):
            for d in range(suffix_tree.DEPTH + 1):
                tables.setdefault(t[k - d : k], Counter())[t[k]] += 1
    kept = {c: dict(n) for c, n in tables.items() if len(c) < 2 or sum(n.values()) > 20}

    def p(context, s):
        while context not in kept:
            context = context[1:]
        n = kept[context]
        total = sum(n.values())
        if not context:
            return (n.get(s, 0) + suffix_tree.HALF) / (total + 256 * suffix_tree.HALF)
        return max(0, n.get(s, 0) - suffix_tree.DISCOUNT) / total + suffix_tree.DISCOUNT * len(n) / total * p(context[1:], s)

    machine = suffix_tree.Automaton(kept)
    want = [sum(math.log10(p(t[k - suffix_tree.DEPTH : k], t[k])) for k in range(suffix_tree.DEPTH, len(t))) for t in texts]
    assert np.allclose(machine.scores(texts), want, rtol=1e-5)
    width = machine.width
    assert np.allclose((10 ** machine.log.astype(float))[:, : width - 1].sum(1) + (256 - width + 1) * 10 ** machine.log[:, -1].astype(float), 1, atol=1e-4)


# Mixing


def test_targets():
    got = mixing.targets(np.array([100, 1, 100]), np.array([5, 2, 1]))
    assert got[1] == 3 and math.isclose(got.sum(), 201) and math.isclose(got[0] / got[2], 5)
    assert mixing.targets(np.array([0, 0]), np.array([1, 1])).tolist() == [0, 0]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_quotas_are_split_exactly(quotas, shards):
    out = mixing.split_quotas(np.array(quotas), shards)
    assert out.sum(0).tolist() == quotas and (out >= 0).all() and out.sum(1).max() - out.sum(1).min() <= 2


def test_mixing(spark):
    rows = [(k, f"w{k} " * (1 + k * 7 % 40), "en", "abc"[k % 3] if k % 10 else None, 1, None, None) for k in range(400)] + ODD
    got = mixing.mix(docs(spark, rows), ("doc_id", "source", "text"), block_words=16, shards=3).collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 3 * r["size"] and r.taken == sum(p.words for p in r.pieces)
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    for s in taken:
        assert abs(taken[s] - target[s]) <= 1
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert np.allclose([target[s] for s in order], mixing.targets(np.array([size[s] for s in order]), np.array([(5, 2, 1)[k % 3] for k in range(len(order))])))
    # Blocks by brute force: a source's documents by hash in blocks, whole passes, then blocks as the permutation draws them.
    hashes = {(r.doc_id, r.text): r.h for r in docs(spark, rows).withColumn("h", mixing.row_hash()).collect()}
    aims = {x["source"]: x for x in mixing.goals(dict(size), mixing.WEIGHTS, mixing.MAX_REPEATS, 16)}
    drawn = {}
    for s, x in aims.items():
        at, own = 0, []
        for r in sorted((r for r in got if r.source == s), key=lambda r: (hashes[r.doc_id, r.text] % 64, hashes[r.doc_id, r.text])):
            own.append(((at // 16 * x["step"] + x["shift"]) % x["blocks"], hashes[r.doc_id, r.text], r["size"]))
            at += r["size"]
        whole, left, want = x["take"] // max(1, x["source_size"]), 0, []
        left = x["take"] - whole * x["source_size"]
        for _, h, n in sorted(own):
            want.append((h, whole * n + min(n, max(0, left))))
            left -= n
        drawn[s] = sorted(want)
        assert drawn[s] == sorted((hashes[r.doc_id, r.text], r.taken) for r in got if r.source == s)
    # Shards: equally many blocks, and no draw twice.
    by_shard = Counter(p.shard for r in got for p in r.pieces)
    assert set(by_shard) == {0, 1, 2} and sum(by_shard.values()) == sum(len(r.pieces) for r in got)
    again = mixing.mix(docs(spark, rows).repartition(7), ("doc_id", "source", "text"), block_words=16, shards=3).collect()
    key = lambda rs: sorted((str(r.doc_id), r.taken, str(r.pieces)) for r in rs)
    assert key(got) == key(again)
    mixed = mixing.mixed_documents(docs(spark, rows))
    assert mixed.columns == docs(spark).columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    dealt = mixing.mixed_documents(docs(spark, rows), block_words=16, shards=3).withColumn("part", F.spark_partition_id()).collect()
    times = Counter((r.doc_id, r.part) for r in dealt)
    assert Counter(i for i, _ in times.elements()) == Counter(r.doc_id for r in got for _ in r.pieces) and len({r.part for r in dealt}) <= 3
    assert mixing.mix(docs(spark, EMPTY)).count() == 0


# URLs


def test_url_rules_and_parts(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    rows = [
        (1, "http://A.Example.COM/en/7x?q#f"), (2, "https://b.com/en/1"), (3, "http://www.example.net/de/81"), (4, "http://net/de/"), (5, "http://xnet/de/"), (6, None), (7, "no scheme"), (8, "://h?x/y"), (9, "http://h\n.org/es/é/" + "a" * 9000),
        (10, "http://casino-win.other/slots"), (11, "http://library.university.example/books"),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [(got[k].rule, got[k].verdict) for k in (2, 3, 4, 9)] == [("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got[5].rule is None and (got[6].host, got[6].path) == (got[7].host, got[7].path) == ("", "") and (got[8].host, got[8].path) == ("h", "")
    assert got[10].verdict == "block" and got[11].verdict == "allow" and all(r.verdict in ("allow", "block") for r in got.values())


def test_url_training_matches_plain_descent(spark):
    rows = [("http://casino.example/win", 1), ("http://bets.example/win", 1), ("http://museum.example/art", 0), ("http://school.example/art", 0)]
    df = spark.createDataFrame(rows, "url string, blocked int")
    f = [r[0] for r in df.orderBy("url", "blocked").select(url_filter.features(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))).collect()]
    y = [r[1] for r in sorted(rows)]
    w = np.zeros(url_filter.BUCKETS + 1)
    for _ in range(url_filter.STEPS):
        left = np.array([t - 1 / (1 + math.exp(-(w[-1] + w[x].sum() / math.sqrt(len(x))))) for t, x in zip(y, f)])
        slope = np.zeros_like(w)
        for e, x in zip(left, f):
            slope[x] += e / math.sqrt(len(x))
        used = sorted({b for x in f for b in x})
        w[used] += url_filter.RATE * (slope[used] / len(y) - url_filter.RIDGE * w[used])
        w[-1] += url_filter.RATE * left.mean()
    assert np.allclose(url_filter.train(df), w, atol=1e-9)
    assert url_filter.train(df.where("false"))[-1] == -1


# Fingerprints


def test_fingerprints(spark):
    rows = ODD[:4] + ODD[6:13] + [(20 + k, "\n".join(f"line {j} of {k % 5} with several words" for j in range(3 * k)), "en", "a", 1, None, None) for k in range(12)]
    got = {r.doc_id: r for r in bloom_lookup.fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])

    def pieces(t):
        return {" ".join(w[k : k + bloom_lookup.PIECE_WORDS]) for line in (t or "").split("\n") for w in [words(line)] for k in range(0, len(w), bloom_lookup.PIECE_WORDS)}

    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if " " not in t + nxt:
            assert math.isclose(got[i].near_edited, alike(pieces(t), pieces(edited))) and math.isclose(got[i].near_next, alike(pieces(t), pieces(nxt)))
    assert got[0].fingerprint == got[1].fingerprint != got[3].fingerprint
    assert bloom_lookup.fingerprints(docs(spark, EMPTY)).count() == 0


def test_next_documents_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(bloom_lookup, "RANGE_DOCS", 3)
    monkeypatch.setattr(bloom_lookup, "SIDE", 4)
    ids = [k * k * (-1) ** k for k in range(100)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    order = sorted(ids, reverse=True)
    assert {(r.doc_id, r.next_text) for r in bloom_lookup.with_next(df).collect()} == {(i, f"t{order[(k + 1) % 100]}") for k, i in enumerate(order)}


# Near-duplicates


@pytest.mark.parametrize(("n", "block"), [(2, 256), (5, 2)])
def test_near_dup(spark, monkeypatch, n, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = np.random.default_rng(n)
    rows = list(ODD)
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(3, 120)))]
        for k in range(9):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(own) // 12))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(9)}"
            rows.append((1000 + 100 * g + k, " ".join(own), "en", "a", 1, None, None))
    sets = {}
    for i, t, *_ in rows:
        w = lower_words(t)
        sets[i] = set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    got = near_dup.dedup(docs(spark, rows), n=n).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == (None if r.doc_id is None else find(r.doc_id)) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert near_dup.dedup(docs(spark, EMPTY)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (50, 75), (200, 201)]
    got = {r.id: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 50, 75: 50, 50: 50, 200: 200, 201: 200}


# WARC


def test_warc(spark):
    rows = [(1, "http://b.example/x y\n", "<p>a</p>"), (2, "http://a.example/", "<p>a</p>"), (3, None, None), (4, "http://a.example/", ""), (5, "http://a.example/", "WARC/1.1\r\n\r\nx\r\n\r\n\r\n\r\n"), (5, "http://a.example/", "WARC/1.1\r\n\r\nx\r\n\r\n\r\n\r\n"), (6, "http://é.example/", "ü" * 5000), (None, "http://n.example", "<p>a</p>")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), file_records=2).orderBy("order").collect()
    assert len(got) == len(rows)
    latest = defaultdict(lambda: -1)
    for i, _, h in rows:
        latest[h or ""] = max(latest[h or ""], i if i is not None else -1)
    by_id = {i: h or "" for i, _, h in rows}
    for r in got:
        data = by_id[r.page_id].encode()
        kept = latest[by_id[r.page_id]]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == kept else ("revisit", kept))
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    small = warc.round_trip(spark.createDataFrame(rows[:2], "page_id long, url string, html string"), min_bytes=100).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@given(st.lists(st.lists(st.integers(0, 30)).map(sorted), max_size=7))
@settings(max_examples=150, deadline=None)
def test_loser_tree(runs):
    assert list(warc.merge(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


# Quality and toxicity


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_repeated_words(own):
    windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    count = Counter(windows)
    want = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    assert quality_rules.repeated_words([w.encode() for w in own]) == len(want)


def test_quality_rules(spark):
    rows = ODD + [(50 + k, "plain words in a clean text about rivers and hills. " * 2 + " ".join(f"n{k}o{j}p" for j in range(60)), "en", "a", 1, None, None) for k in range(20)] + [(90, " ".join(f"## {j}|x{j}$$" for j in range(80)), "en", "a", 1, None, None)]
    trusted = spark.createDataFrame([(50 + k,) for k in range(20)], "doc_id long")
    for r in quality_rules.judge(docs(spark, rows), trusted, keep=("doc_id", "text")).collect():
        t = r.text or ""
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words(t)), sum(map(len, words(t))), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (50 <= (r.doc_id or 0) < 70), r.doc_id
    assert quality_rules.judge(docs(spark, EMPTY), trusted).count() == 0
    assert all(r.log_ratio == 0 for r in quality_rules.judge(docs(spark), trusted.where("false")).collect())


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(400)]
    rows, labels = list(ODD), []
    for k in range(300):
        own, bad = rng.choice(plain, 30).tolist(), k % 6 == 0
        if bad:
            own[3:6] = ["idiot", "zorvling", "zorvmatic"] if k % 12 else ["zorvix", "zorvle", "zorvo"]
        rows.append((1000 + k, " ".join(own), "en", "a", 1, None, None))
        if k < 240:
            labels.append((1000 + k, int(bad)))
    got = {r.doc_id: r for r in toxicity.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[1000 + k].predicted == (k % 6 == 0) for k in range(300)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].score == got[1].score and got[0].predicted == 0
    bare = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, [(1, "you stupid idiot", *ODD[0][2:]), (2, "hello", *ODD[0][2:])]), spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert bare == {1: 1, 2: 0}
    assert toxicity.score(docs(spark, EMPTY), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_verdicts_keep_to_the_true_share_of_toxic_texts(spark, monkeypatch):
    """One text of ten is toxic; a word that a fifth of its texts are toxic by stays under the threshold, however the classes are sampled."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join([*rng.choice([f"word{j}" for j in range(50)], 8), "clown" if k % 10 < 5 else "quiet"]), "en", "a", 1, None, None) for k in range(1200)]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1200)], "doc_id long, toxic int")
    probe = [(9000, "a clown there", *ODD[0][2:]), (9001, "a quiet day", *ODD[0][2:])]
    scores = lambda: {r.doc_id: r for r in toxicity.score(docs(spark, rows + probe), labels).collect() if r.doc_id >= 9000}
    whole = scores()
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 100)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 120)
    part = scores()
    assert whole[9000].predicted == part[9000].predicted == 0
    assert all(abs(whole[k].score - part[k].score) < 0.06 for k in (9000, 9001)), (whole, part)


def test_the_near_duplicate_stage_gives_one_row_an_id(spark):
    rows = [(1, BASE, *ODD[0][2:]), (1, BASE, *ODD[0][2:]), (1, "an other text of the same id", *ODD[0][2:]), (2, BASE, *ODD[0][2:]), (3, "x y z", *ODD[0][2:]), (None, "no id", *ODD[0][2:]), (None, "none either", *ODD[0][2:])]
    all_docs = docs(spark, rows)
    kept = {r.doc_id for r in near_dup.dedup(all_docs, n=5, percent=80).where("kept").collect()}
    hashes = {(r.doc_id, r.text): r.h for r in all_docs.withColumn("h", F.xxhash64("text")).collect()}
    got = corpus_pipeline.drop_near_duplicates(spark, all_docs, "").collect()
    assert got and got[0].asDict().keys() == set(all_docs.columns)
    want = [min((x for x in hashes if x[0] == k), key=hashes.get) for k in kept - {None}] + [x for x in hashes if x[0] is None]
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(map(repr, want))
