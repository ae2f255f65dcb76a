"""A probabilistic suffix tree over the words of texts, and a smoothed unigram model as its base.

Tokens are the words of a text (A-Z lower-cased) and one end. Each word belongs to one of `CLASSES` classes, by a
hash of its last two bytes (word endings tell languages and word kinds apart, for unknown words too); the end is a
class of its own. A text's score is the log10 probability of its tokens: that of each token's class given the
classes before it, times (c + 0.5) / (C + 0.5 (V + 1)) with the training counts c of the token, C of its class and
V of distinct tokens there.

Contexts of up to DEPTH classes are counted over all training texts; ends stand before each text. A context stays
in the tree if it's frequent and its next-class distribution diverges enough from that of the context one shorter (a
likelihood ratio test, and no other limit); all suffixes of a context that stays also stay. Distributions are smoothed by
absolute discounting towards the next shorter context, the root by adding HALF to each class. To score, the contexts of fewer
than DEPTH classes become an automaton whose states are the contexts and their prefixes, so that after each class the
state is the longest suffix among them. All texts of a batch run through it side by side. What the contexts of DEPTH
classes add is in two parts: that of a context alone, and that of an n-gram seen in training. The first has at most
256 ** DEPTH numbers and goes to the executors, as do the most frequent n-grams, at most `HELD_GRAMS`; all other n-grams stay a
table and join it, as rare words do.

The base model scores tokens by (c + 0.5) / (N + 0.5 (V + 1)) over all training tokens. The most frequent words, at
most `MAX_FREQUENT`, go to the executors; all others join the table of counts. Words are told apart by 64-bit hashes.

Cases: a null or empty text is the end token alone. Equal texts have equal scores. Without training texts the base
is uniform (N = V = 0) and so is the tree's root. An empty table gives no rows. Rows with equal or null doc_ids stay
apart. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import LOWER, bucket_of, text_of, written

DEPTH = 3
#: Classes of words; symbol 255 is the end, as a word it's END, which no text holds.
CLASSES = 250
END, END_SYMBOL = b"\n", 255
#: Least training count of a context, and least log-likelihood gain (nats) over its parent.
MIN_COUNT, MIN_GAIN = 32, 24.0
DISCOUNT, HALF = 0.5, 0.5
MAX_FREQUENT = 1 << 16
#: n-grams that go to the executors, at most; parts that a task's n-grams are dealt into, by their contexts.
HELD_GRAMS, PARTS = 1 << 21, 1024
#: Tokens that run through the automaton together, and the tokens of one run.
TOGETHER, RUN = 1 << 20, 512
#: Distinct words, and distinct n-grams of classes, that a task holds before it passes them on.
MAX_HELD, MAX_HELD_GRAMS = 1 << 19, 1 << 21


def normal(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def word_key(word: bytes) -> int:
    """A signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


class _Symbols(dict):
    """Class of each pair of last bytes."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = zlib.crc32(ending) % CLASSES
        return self[ending]


_SYMBOLS = _Symbols()


def stream(words: list[bytes]) -> bytes:
    """A byte for each token's class, behind DEPTH ends."""
    return bytes([END_SYMBOL] * DEPTH + [_SYMBOLS[w[-2:]] for w in words] + [END_SYMBOL])


def gram_codes(streams: list[bytes]) -> np.ndarray:
    """The DEPTH + 1 classes that end at each token, oldest class highest."""
    data = np.frombuffer(b"".join(streams), np.uint8).astype(np.int64)
    codes = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        codes = (codes << 8) | data[k : len(data) - DEPTH + k]
    keep = np.ones(len(data), bool)
    at = np.cumsum([0, *map(len, streams)])[:-1]
    for k in range(DEPTH):
        keep[at + k] = False
    return codes[keep[DEPTH:]]


def counts(training: DataFrame) -> DataFrame:
    """kind (a word's class), key, n over all texts."""

    def count(batches):
        words: Counter = Counter()

        def rows():
            kinds = [END_SYMBOL if w == END else _SYMBOLS[w[-2:]] for w in words]
            keys, n = [word_key(w) for w in words], list(words.values())
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(kinds[part], pa.int32()), pa.array(keys[part], pa.int64()), pa.array(n[part], pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            for text in batch.column(0):
                words.update(normal(text.as_py()))
                words[END] += 1
                if len(words) > MAX_HELD:
                    yield from rows()
                    words.clear()
        yield from rows()

    parts = training.select(text_of(F.col("text")).alias("text")).mapInArrow(count, "kind int, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _merged(codes: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their sums."""
    both, at = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([np.zeros(0), *sums]), len(both)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which compresses better."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1).astype(np.int64)


def grams(training: DataFrame) -> DataFrame:
    """key, n of all n-grams of DEPTH + 1 classes. They are shuffled in packs, by the hash of their context."""

    def count(batches):
        held: list[bytes] = []
        codes, sums, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def packs():
            part = ((codes >> 8) * 0x9E3779B1 >> 16) % PARTS
            order = np.argsort(part, kind="stable")
            own, first = np.unique(part[order], return_index=True)
            each = [x for x in np.split(order, first[1:]) if len(x)]
            keys, n = ([_planes(v[x]) for x in each] for v in (codes.astype(np.uint32), sums))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], ["part", "keys", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(stream(normal(text.as_py())))
                size += len(held[-1])
                if size >= TOGETHER:
                    new, n = np.unique(gram_codes(held), return_counts=True)
                    codes, sums = _merged([codes, new], [sums, n])
                    held, size = [], 0
                    if len(codes) > MAX_HELD_GRAMS:
                        yield from packs()
                        codes = sums = np.zeros(0, np.int64)
        if held:
            new, n = np.unique(gram_codes(held), return_counts=True)
            codes, sums = _merged([codes, new], [sums, n])
        yield from packs()

    def merge(batches):
        codes, sums, size, least = [], [], 0, 1 << 21
        for batch in batches:
            for k, n in zip(batch.column("keys"), batch.column("n"), strict=True):
                codes.append(_from_planes(k.as_py(), np.uint32))
                sums.append(_from_planes(n.as_py(), np.int64))
                size += len(codes[-1])
                if size > least:
                    codes, sums = ([x] for x in _merged(codes, sums))
                    size, least = len(codes[0]), max(least, 2 * len(codes[0]))
        keys, n = _merged(codes, sums)
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["key", "n"])

    parts = training.select(text_of(F.col("text")).alias("text")).mapInArrow(count, "part int, keys binary, n binary")
    return parts.repartition("part").mapInArrow(merge, "key long, n long")


def _columns(df: DataFrame, *kinds: type) -> list[np.ndarray]:
    """The frame's columns as arrays, in order of the first one."""
    found = df.toArrow()
    own = [c.to_numpy().astype(k) for c, k in zip(found.columns, kinds, strict=True)]
    order = np.argsort(own[0], kind="stable")
    return [x[order] for x in own]


def find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among the known ones (ascending), and whether it's there."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values.astype(known.dtype)), len(known) - 1)
    return at, known[at] == values


def retained(table: DataFrame, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> tuple[dict, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts of fewer than DEPTH classes (as bytes) that stay, each with its next symbols' counts; and codes, totals and numbers of next
    symbols of the contexts of DEPTH classes that stay; from the key and n of n-grams.

    Counts of n-grams of DEPTH classes and the contexts that stay reach the driver, at most 256 ** DEPTH each."""
    spark, mask = table.sparkSession, (1 << 8 * DEPTH) - 1
    shorter = table.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
    codes, n = _columns(shorter, np.int64, np.int64)
    levels = {}
    for d in range(DEPTH):
        own, sums = _merged([codes & ((1 << 8 * (d + 1)) - 1)], [n])
        contexts, at = np.unique(own >> 8, return_inverse=True)
        totals = np.bincount(at, sums, len(contexts))
        levels[d] = own, sums, contexts, at, totals, np.log(sums / totals[at])
    keep: list[set[int]] = [{0}]
    for d in range(1, DEPTH):
        own, sums, contexts, at, totals, log = levels[d]
        before = levels[d - 1]
        gain = np.bincount(at, sums * (log - before[-1][find(before[0], own & ((1 << 8 * d) - 1))[0]]), len(contexts)) if len(own) else totals
        keep.append(set(contexts[(totals >= min_count) & (gain >= min_gain)].tolist()))
    sent = spark.sparkContext.broadcast((levels[DEPTH - 1][0].astype(np.uint32), levels[DEPTH - 1][-1]))

    def gains(batches):
        known, log = sent.value
        for batch in batches:
            key, n = (batch.column(k).to_numpy() for k in range(2))
            contexts, at = np.unique(key >> 8, return_inverse=True)
            expected = n * log[find(known, key & mask)[0]]
            sums = [np.bincount(at, w, len(contexts)) for w in (n, n * np.log(n), expected)]
            yield pa.RecordBatch.from_arrays([pa.array(contexts), pa.array(np.bincount(at, minlength=len(contexts)).astype(np.int64)), *map(pa.array, sums)], ["context", "kinds", "total", "own", "expected"])

    each = table.select("key", "n").mapInArrow(gains, "context long, kinds long, total double, own double, expected double")
    summed = each.groupBy("context").agg(*(F.sum(x).alias(x) for x in ("total", "kinds", "own", "expected"))).where(F.col("total") >= min_count)
    passed = summed.where(F.col("own") - F.col("total") * F.log("total") - F.col("expected") >= min_gain)
    deepest = _columns(passed.select("context", "total", "kinds"), np.uint32, np.int64, np.int64)
    keep.append(set(np.unique(deepest[0] & (mask >> 8)).tolist()))
    keep[DEPTH - 1] |= keep.pop()
    for d in range(DEPTH - 1, 1, -1):
        keep[d - 1] |= {c & ((1 << 8 * (d - 1)) - 1) for c in keep[d]}
    found: dict[bytes, dict[int, int]] = {c.to_bytes(d, "big"): {} for d in range(DEPTH) for c in keep[d]}
    for d in range(DEPTH):
        own, sums = levels[d][:2]
        chosen = np.isin(own >> 8, list(keep[d]))
        for g, m in zip(own[chosen].tolist(), sums[chosen].tolist(), strict=True):
            found[(g >> 8).to_bytes(d, "big")][g & 255] = m
    return found, tuple(deepest)


def extras(table: DataFrame, machine: Automaton, codes: np.ndarray, kinds: np.ndarray) -> DataFrame:
    """key, n and value of the n-grams whose context of DEPTH classes stays: what log10 of their probability is above that of an unseen one."""
    state = np.zeros(1 << 8 * (DEPTH - 1), np.int64)
    for c, k in machine.number.items():
        if len(c) == DEPTH - 1:
            state[int.from_bytes(c, "big")] = k
    sent = table.sparkSession.sparkContext.broadcast((machine, state, codes, kinds))

    def values(batches):
        machine, state, codes, kinds = sent.value
        for batch in batches:
            key, n = (batch.column(k).to_numpy() for k in range(2))
            at, stays = find(codes, key >> 8)
            key, n, at = key[stays], n[stays], at[stays]
            p = 10 ** machine.log[state[(key >> 8) & (len(state) - 1)], machine.symbols[key & 255]].astype(float)
            value = np.log10(1 + (n - DISCOUNT) / (DISCOUNT * kinds[at] * p))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(value)], ["key", "n", "value"])

    return table.select("key", "n").mapInArrow(values, "key long, n long, value double")


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the largest n, at most so many, by a bound that is a power of two; so no rows are ordered."""
    numbers = table.agg(*(F.count(F.when(F.col("n") >= (1 << k), 1)).alias(str(k)) for k in range(48))).first()
    bound = next((k for k in range(48) if numbers[k] <= most), 48)
    return table.where(F.col("n") >= (1 << bound))


class Deep:
    """What the contexts of DEPTH classes add to texts' log10 probabilities; n-grams that aren't held are given back."""

    def __init__(self, codes: np.ndarray, alone: np.ndarray, keys: np.ndarray, values: np.ndarray):
        self.codes, self.alone, self.keys, self.values = codes, alone, keys, values

    def scores(self, streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the texts; and the number of a text, key and times of n-grams that must be looked up in the table."""
        text = np.repeat(np.arange(len(streams)), [len(s) - DEPTH for s in streams])
        codes = gram_codes(streams)
        at, stays = find(self.codes, codes >> 8)
        text, codes, log = text[stays], codes[stays], self.alone[at[stays]]
        at, held = find(self.keys, codes)
        log[held] += self.values[at[held]]
        pairs, times = np.unique(text[~held] << 32 | codes[~held], return_counts=True)
        return np.bincount(text, log, len(streams)), pairs >> 32, pairs & 0xFFFFFFFF, times


class Automaton:
    """next state and log10 probability for each state and symbol class."""

    def __init__(self, contexts: dict[bytes, dict[int, int]]):
        seen = sorted({s for nexts in contexts.values() for s in nexts})
        self.symbols = np.full(256, len(seen), np.int64)  # the last column: symbols that training texts lack
        self.symbols[seen] = np.arange(len(seen))
        states = sorted({c[:k] for c in contexts for k in range(len(c) + 1)}, key=lambda c: (len(c), c))
        self.number = number = {c: k for k, c in enumerate(states)}
        width = len(seen) + 1
        p = np.zeros((len(states), width))
        root = contexts[b""]
        total = sum(root.values())
        p[0] = (np.array([*(root.get(s, 0) for s in seen), 0]) + HALF) / (total + HALF * 256)
        self.next = np.zeros((len(states), width), np.uint32)
        for k, c in enumerate(states):
            if k:
                shorter = next(number[c[j:]] for j in range(1, len(c) + 1) if c[j:] in number)
                p[k], self.next[k] = p[shorter], self.next[shorter]
                if nexts := contexts.get(c):
                    total = sum(nexts.values())
                    p[k] *= DISCOUNT * len(nexts) / total
                    p[k, self.symbols[list(nexts)]] += (np.array(list(nexts.values())) - DISCOUNT) / total
            for s in seen:
                if (longer := number.get(c + bytes([s]))) is not None:
                    self.next[k, self.symbols[s]] = longer
        self.log = np.log10(p).astype(np.float32)
        self.width = width

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each text's classes, its end included."""
        data = self.symbols[np.frombuffer(b"".join(streams), np.uint8)]
        # Runs of equal length read DEPTH symbols first to find their state, since no context is longer.
        runs = -(-len(data) // RUN)
        padded = np.zeros(DEPTH + runs * RUN, np.int64)
        padded[DEPTH : DEPTH + len(data)] = data
        state, out = np.zeros(runs, np.int64), np.zeros((RUN, runs))
        flat_next, flat_log = self.next.reshape(-1), self.log.reshape(-1)
        for t in range(RUN + DEPTH):
            at = state * self.width + padded[t : t + (runs - 1) * RUN + 1 : RUN]
            if t >= DEPTH:
                out[t - DEPTH] = flat_log[at]
            state = flat_next[at].astype(np.int64)
        log = out.T.reshape(-1)[: len(data)]
        starts = np.cumsum([0, *map(len, streams)])[:-1]
        for k in range(DEPTH):
            log[starts + k] = 0
        return np.add.reduceat(log, starts)


def score(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of(F.col("text")).alias("text"), (bucket_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    words = written(counts(training), "suffix-counts")
    by_class = np.zeros((256, 2))
    for r in words.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        by_class[r.kind] = r.n, r.v
    tokens, distinct = (int(x) for x in by_class.sum(0))
    class_log = np.log10(by_class[:, 0] + 0.5 * (by_class[:, 1] + 1))
    frequent = words.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).collect()
    table = written(grams(training), "suffix-grams")
    contexts, (codes, totals, kinds) = retained(table, **options)
    machine = Automaton(contexts)
    tree_table = written(extras(table, machine, codes, kinds), "suffix-tree")
    deep = Deep(codes, np.log10(DISCOUNT * kinds / totals), *_columns(most_frequent(tree_table, HELD_GRAMS).select("key", "value"), np.uint32, np.float32))
    model = spark.sparkContext.broadcast((machine, deep, {r.key: math.log10(r.n + 0.5) for r in frequent}, class_log))

    def measure(batches):
        tree, deep, top, class_log = model.value
        base, number = TaskContext.get().partitionId() << 40, 0
        rare: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def flush():
            nonlocal rare, group, size
            streams = [x[-1] for x in group]
            more, text, codes, times = deep.scores(streams) if group else [np.zeros(0, np.int64)] * 4
            found = tree.scores(streams) + more if group else []
            rows = [(*x[:-1], float(s - class_log[np.frombuffer(x[-1], np.uint8)[DEPTH:]].sum())) for x, s in zip(group, found, strict=True)]
            uid, *own = zip(*rows, strict=True) if rows else [()] * 7
            r_uid, r_key, r_n = zip(*rare, strict=True) if rare else [()] * 3
            fields = [pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)]
            texts = pa.StructArray.from_arrays(fields, names)
            columns = [
                pa.concat_arrays([pa.array([*uid, *r_uid], pa.int64()), pa.array(np.array(uid, np.int64)[text])]),
                pa.concat_arrays([pa.array([*(word_key(x.to_bytes(8, "big")) for x in uid), *r_key], pa.int64()), pa.array(codes)]),
                pa.concat_arrays([pa.array([*[None] * len(rows), *r_n], pa.int64()), pa.array(times)]),
                pa.array([*[False] * (len(rows) + len(rare)), *[True] * len(codes)], pa.bool_()),
                pa.concat_arrays([texts, pa.nulls(len(rare) + len(codes), texts.type)]),
            ]
            rare, group, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["uid", "key", "times", "gram", "own"])

        for batch in batches:
            for doc_id, text, held in zip(*(batch.column(k) for k in range(3)), strict=True):
                own = normal(text.as_py())
                uid, number = base + number, number + 1
                top_sum, known = top.get(end_key, math.log10(0.5)), int(end_key in top)
                for w, m in Counter(own).items():
                    key = word_key(w)
                    if (log := top.get(key)) is None:
                        rare.append((uid, key, m))
                    else:
                        top_sum += m * log
                        known += m
                group.append((uid, doc_id.as_py(), held.as_py(), len(own) + 1, top_sum, known, stream(own)))
                size += len(group[-1][-1])
                if size >= TOGETHER or len(rare) > 1 << 17:
                    yield flush()
        if group:
            yield flush()

    # The end token is in each training text, so it's among the most frequent; if it isn't, nothing was trained on.
    end_key = word_key(END)
    names = ["doc_id", "held_out", "n_tokens", "log_sum", "known", "score"]
    parts = docs.mapInArrow(measure, "uid long, key long, times long, gram boolean, own struct<doc_id: long, held_out: boolean, n_tokens: long, log_sum: double, known: long, score: double>")
    # A text's own row has a key of its own, which spreads those rows and finds no count. n-grams that were never seen find nothing and add nothing.
    values = words.select(F.lit(False).alias("gram"), "key", F.log10(F.col("n") + 0.5).alias("value")).union(tree_table.select(F.lit(True), "key", "value"))
    values = values.withColumnsRenamed({"gram": "of_gram", "key": "of"})
    joined = parts.join(values, (parts["key"] == values["of"]) & (parts["gram"] == values["of_gram"]) & parts["times"].isNotNull(), "left")
    word = ~F.col("gram")
    log_sum = F.coalesce("own.log_sum", F.when(word, F.col("times") * F.coalesce("value", F.lit(math.log10(0.5)))))
    known = F.coalesce("own.known", F.when(word & F.col("value").isNotNull(), F.col("times")).otherwise(0))
    added = F.sum(F.when(F.col("gram"), F.col("times") * F.coalesce("value", F.lit(0.0))).otherwise(0.0))
    summed = joined.groupBy("uid").agg(*(F.max(f"own.{x}").alias(x) for x in ("doc_id", "held_out", "n_tokens", "score")), F.sum(log_sum).alias("logs"), F.sum(known).alias("n_known"), added.alias("added"))
    base = F.col("logs") - F.col("n_tokens") * math.log10(tokens + 0.5 * (distinct + 1))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.col("added") + F.col("logs")).alias("score"))
