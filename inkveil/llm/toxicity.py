"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its labels.

Voters say "toxic" or nothing about a text: words of a fixed lexicon (also with digits for letters), words and word
beginnings mined from labelled texts, and patterns. The label model gives each voter a rate of voting on toxic and
on clean texts, fitted by EM, where a text's own label is a voter of fixed accuracy too. Voters that still vote
together within a class are correlated: each counts by 1 / (1 + sum of its positive residual correlations). A logistic regression
on the votes and on how many voters vote is then fitted to the posterior labels. It scores every text.

The classifier is fitted on a bounded sample of labelled texts: at most MAX_TOXIC and MAX_CLEAN, those with the
smallest hash of their id. A sampled text of a class counts as often as that class has labelled texts for each sampled one
(scaled to 1 on average), so voters, priors and the intercept follow the shares of all labels, whatever the size of the input.

Cases: a null or empty text has no votes, its score is the intercept's. Equal texts have equal scores. Without labelled
texts the lexicon decides by prior rates. Whole texts are read. Repeated or contradicting labels of an id count as
toxic if any does. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import forget, remove_written, slices, text_of, written

MAX_TOXIC, MAX_CLEAN = 3000, 6000
THRESHOLD = 0.3
#: Lengths (in bytes) of the word beginnings that are mined; a mined voter needs so many texts, nats of evidence, and this share of toxic ones.
BEGINNINGS = (4, 5, 6)
MIN_TEXTS, MIN_NATS, MIN_PRECISION, MAX_MINED = 4, 8.0, 0.6, 800
#: Accuracy of a given label, and rates on toxic and clean texts that voters start from.
LABEL_ACCURACY, START_TOXIC, START_CLEAN = 0.98, 0.2, 0.01
#: Voters of equal votes in the sample's texts count as one voter in the correlations; residuals under this are noise.
MIN_CORRELATION = 0.2
RIDGE, STEPS = 1e-3, 300

# Insults in English, German, French and Spanish.
LEXICON = """
    arsehole asshole bastard bitch clown coward creep cretin despicable dickhead dimwit disgusting dumb dumbass filth
    fool garbage hate hateful idiot idiotic imbecile jerk liar loser lowlife moron moronic numbskull parasite pathetic
    pig psycho repulsive scum scumbag shit slut stupid swine thug trash ugly vermin vile whore worthless
    abschaum arschloch bastard dreckig dummkopf ekelhaft hurensohn idiot kotzbrocken missgeburt schlampe schwein versager wertlos
    abruti connard connasse cretin degueulasse enfoire imbecile merde minable ordure pourriture salaud salope stupide
    asqueroso basura cabron escoria estupido gilipollas idiota imbecil inutil maldito patetico payaso pendejo puta
""".split()  # fmt: skip
LEET = bytes.maketrans(b"013457@$", b"oieastas")

_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() or chr(b) in "'@$" else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    """Distinct words, lower-cased, without punctuation."""
    return set(text.lower().encode().translate(_WORD_BYTES).split())


def beginnings(words: set[bytes], n: int) -> set[bytes]:
    """Beginnings of the words that are longer than they."""
    return {w[:n] for w in words if len(w) > n}


class Voters:
    """Numbers of the voters that vote on a text, from its words."""

    def __init__(self, mined: list[tuple[int, bytes]]):
        """mined: (0, word) or (n, its first n bytes)."""
        lexicon = sorted({w.encode() for w in LEXICON})
        self.words = {w: k for k, w in enumerate(lexicon)}
        self.leet = dict(self.words)
        n = len(lexicon)
        self.patterns = n
        n += 3
        self.starts: dict[int, dict[bytes, int]] = {size: {} for size in BEGINNINGS}
        for size, s in mined:
            at = self.starts[size] if size else self.words
            if s not in at:
                at[s] = n
                n += 1
        self.count = n

    def votes(self, words: set[bytes]) -> set[int]:
        found = {self.words[w] for w in words & self.words.keys()}
        odd = {w for w in words if not w.isalpha() and w.isascii() and not w.isdigit()}
        disguised = {self.leet[v] for v in {w.translate(LEET) for w in odd} & self.leet.keys()}
        if disguised:
            found |= disguised | {self.patterns}
        lexical = len(found)
        for size, known in self.starts.items():
            if known:
                found |= {known[b] for b in beginnings(words, size) & known.keys()}
        if lexical > 1:
            found.add(self.patterns + 1)
        if {b"you", b"your", b"du", b"vous", b"tu", b"eres"} & words and lexical:
            found.add(self.patterns + 2)
        return found


def class_weights(labels: DataFrame) -> tuple[float, float]:
    """What a clean and a toxic text of the sample count for, by all labels (doc_id, toxic: once an id); 1 on average."""
    found = {int(r.toxic): r["count"] for r in labels.groupBy("toxic").count().collect()}
    numbers = [found.get(y, 0) for y in (0, 1)]
    sampled = [min(n, most) for n, most in zip(numbers, (MAX_CLEAN, MAX_TOXIC), strict=True)]
    clean, toxic = (n / m * sum(sampled) / sum(numbers) if m else 1.0 for n, m in zip(numbers, sampled, strict=True))
    return clean, toxic


def mine(sample: DataFrame, each: tuple[float, float] = (1.0, 1.0)) -> list[tuple[int, bytes]]:
    """Words and beginnings whose texts are toxic far more often than all, of a sample (words, toxic) whose clean and toxic texts weigh `each`; MAX_MINED at most."""

    def count(batches):
        both: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for joined, y in zip(batch.column("words"), batch.column("toxic").to_pylist(), strict=True):
                words = set(joined.as_py().split())
                both[y].update((0, w) for w in words)
                for n in BEGINNINGS:
                    both[y].update((n, b) for b in beginnings(words, n))
        for y in (0, 1):
            items = list(both[y].items())
            for k in range(0, len(items), 1 << 16):
                keys, n = zip(*items[k : k + (1 << 16)], strict=True)
                sizes, texts = zip(*keys, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(n if y else [0] * len(n), pa.int64()), pa.array([0] * len(n) if y else n, pa.int64())], ["size", "part", "toxic", "clean"])

    n, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == n:
        return []
    share = toxic * each[1] / (toxic * each[1] + (n - toxic) * each[0])
    found = sample.mapInArrow(count, "size int, part binary, toxic long, clean long").groupBy("size", "part").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a") * each[1], F.col("b") * each[0]
    precision = a / (a + b)
    nats = a * F.log(precision / share) + F.when(F.col("b") > 0, b * F.log((1 - precision) / (1 - share))).otherwise(0.0)
    best = found.where((F.col("a") >= MIN_TEXTS) & (precision >= max(MIN_PRECISION, share)) & (nats >= MIN_NATS)).orderBy(F.desc(nats), "size", "part").limit(MAX_MINED)
    return [(r.size, bytes(r.part)) for r in best.select(F.col("size"), "part").collect()]


def label_model(votes: np.ndarray, labels: np.ndarray, steps: int = 25, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each text (row) and weight of each voter (column) from votes of 0 and 1, the given labels, and what each text counts for (1 unless given)."""
    n, m = votes.shape
    each = np.ones(n) if each is None else each
    given = np.where(labels == 1, math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)), -math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)))
    posterior = 1 / (1 + np.exp(-given))
    weight = np.ones(m)
    for step in range(steps):
        toxic, clean = each * posterior, each * (1 - posterior)
        mass = np.array([toxic.sum(), clean.sum()])
        rates = np.stack([(toxic @ votes + START_TOXIC) / (mass[0] + 1), (clean @ votes + START_CLEAN) / (mass[1] + 1)])
        if step == 5:  # accuracies have settled: how far voters repeat each other within a class
            residual = votes - (posterior[:, None] * rates[0] + (1 - posterior)[:, None] * rates[1]).astype(np.float32)
            residual *= np.sqrt(each, dtype=np.float32)[:, None]
            norm = np.sqrt((residual**2).sum(0)) + 1e-9
            together = (residual.T @ residual) / norm[:, None] / norm
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + np.where(together > MIN_CORRELATION, together, 0).sum(0))
        on, off = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        prior = math.log((mass[0] + 1) / (mass[1] + 1))
        odds = prior + votes @ (weight * (on - off)) + (weight * off).sum() + given
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, weight


def counted(votes: np.ndarray) -> np.ndarray:
    """Three features more: at least one, two and three voters."""
    n = votes.sum(1, keepdims=True)
    return np.concatenate([votes, n >= 1, n >= 2, n >= 3], axis=1).astype(np.float32)


def fit_linear(features: np.ndarray, target: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression on soft labels, by accelerated gradient steps; each: what a text counts for (1 unless given)."""
    each = np.ones(len(features)) if each is None else each
    x = np.concatenate([features, np.ones((len(features), 1), np.float32)], axis=1)
    w = before = np.zeros(x.shape[1])
    w[-1] = before[-1] = math.log((each @ target + 0.5) / (each @ (1 - target) + 0.5))
    rate = 4 / (float((x**2).sum(1).max()) + RIDGE)
    rate = max(rate, 4 / (_norm(x, each) + RIDGE))
    for k in range(STEPS):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (each * (p - target)) / each.sum() + RIDGE * np.append(ahead[:-1], 0)
        before, w = w, ahead - rate * slope
    return w


def _norm(x: np.ndarray, each: np.ndarray) -> float:
    """The largest eigenvalue of x'x / n with rows weighed by each, by power steps."""
    v = np.ones(x.shape[1]) / math.sqrt(x.shape[1])
    value = 1.0
    for _ in range(20):
        v = x.T @ (each * (x @ v)) / each.sum()
        value = float(np.linalg.norm(v)) or 1.0
        v /= value
    return value * 1.05


def train(docs: DataFrame, labels: DataFrame) -> tuple[Voters, np.ndarray]:
    """The voters, and their weights; labels: doc_id and toxic."""
    labels = once(labels)
    texts = written(sample(docs, labels), "toxic-sample")
    by_class = class_weights(labels)
    voters = Voters(mine(texts, by_class))
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches):
        for batch in batches:
            found = [sorted(sent.value.votes(set(x.as_py().split()))) for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "votes"])

    # At most MAX_TOXIC + MAX_CLEAN lists of votes reach the driver; their order mustn't hang on the run's.
    table = texts.mapInArrow(vote, "toxic int, votes array<int>").toArrow()
    remove_written(texts)
    rows = sorted(zip(table.column("toxic").to_pylist(), table.column("votes").to_pylist(), strict=True))
    given = np.array([y for y, _ in rows], float)
    if not rows or given.min() == given.max():
        w = np.full(voters.count + 4, 0.0)
        w[: voters.count], w[-1] = math.log(START_TOXIC / START_CLEAN), -3.0
        return voters, w
    votes = np.zeros((len(rows), voters.count), np.float32)
    for k, (_, own) in enumerate(rows):
        votes[k, own] = 1
    each = np.array(by_class)[given.astype(int)]
    posterior, _ = label_model(votes, given, each=each)
    return voters, fit_linear(counted(votes), posterior, each)


def score_of(voters: Voters, weights: list[float], words: set[bytes]) -> float:
    found = voters.votes(words)
    n = min(3, len(found))
    odds = weights[-1] + sum(weights[k] for k in sorted(found)) + sum(weights[voters.count : voters.count + n])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def once(labels: DataFrame) -> DataFrame:
    """doc_id and toxic, a row an id."""
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """words (distinct, joined by spaces) and toxic of the bounded sample; labels: a row an id."""
    some = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]

    def shorten(batches):
        forget()
        for batch in slices(batches, "text"):
            words = [b" ".join(sorted(words_of(x))) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column("toxic")], ["words", "toxic"])

    # At most MAX_TOXIC + MAX_CLEAN ids are broadcast.
    found = docs.select("doc_id", text_of(F.col("text")).alias("text")).join(F.broadcast(some[0].union(some[1])), "doc_id")
    # Rows of equal ids are one text, that with the smallest hash, so the sample is bounded whatever the ids are.
    chosen = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("own")).select("own.text", "own.toxic")
    return chosen.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(shorten, "words binary, toxic int")


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, more: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, those in more, score, predicted, for each row of docs; labels holds the training rows alone."""
    voters, weights = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((voters, weights.tolist()))
    extra = more or {}
    rows = docs.select(*keep, *[c.alias(n) for n, c in extra.items()], text_of(F.col("text")).alias("_text"))

    def run(batches):
        forget()
        voters, weights = sent.value
        for batch in slices(batches, "_text"):
            found = [score_of(voters, weights, words_of(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, kinds + ", score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
