"""Quality rules: fixed heuristics, then a likelihood ratio of hashed character n-grams.

Two multinomials over hashed n-grams are estimated: one from trusted documents, one from the whole corpus.
A document's verdict is the mean over its n-grams of log(trusted / raw) against a fixed threshold.

Cases: a null or empty text has no words, fails the base rules and isn't kept. Repeated rows get equal
verdicts. Without trusted documents both multinomials are the raw one, every ratio is 0 and the base rules decide.
Columns of the input whose names clash with results are ignored; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import SPACES, slices, text_of

N_GRAM = 3
#: Bytes of a text whose n-grams are held together.
PIECE = 1 << 20
BUCKETS = 1 << 16
SYMBOLS = b"#*$%&|<>"
#: Most trusted documents that the target multinomial is fitted on; those with the smallest hash of their id.
MAX_TRUSTED = 20_000
#: Mean log ratio a document needs.
MIN_RATIO = -0.35
SMOOTHING = 1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of bytes, in pieces; runs shorter than one n-gram are padded by spaces."""
    data = data if len(data) >= N_GRAM else data.ljust(N_GRAM)
    for at in range(0, len(data) - N_GRAM + 1, PIECE):
        codes = np.frombuffer(data[at : at + PIECE + N_GRAM - 1], np.uint8).astype(np.uint32)
        n = len(codes) - N_GRAM + 1
        packed = codes[:n].copy()
        for k in range(1, N_GRAM):
            packed |= codes[k : k + n] << np.uint32(8 * k)
        yield (packed * np.uint32(2654435761)) >> np.uint32(16)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def gram_counts(docs: DataFrame, trusted_ids: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """bucket, raw, target: n-grams of all texts, and of the trusted ones.

    The trusted ids are at most max_trusted rows, so they are broadcast."""
    ids = trusted_ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    flagged = docs.select("doc_id", text_of(F.col("text")).alias("text")).join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "doc_id", "left")

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def add() -> None:
            for k, own in enumerate(held):
                if own:
                    total[k] += np.bincount(np.concatenate(own), minlength=BUCKETS)
                own.clear()

        for part in slices(batches, "text"):
            for text, own in zip(part.column("text"), part.column("trusted").fill_null(False).to_pylist(), strict=True):
                for found in grams(text.as_py().encode()):
                    held[0].append(found)
                    held[1].extend([found] * own)
                    size += len(found)
                    if size >= PIECE:
                        add()
                        size = 0
        add()
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    parts = flagged.select("text", "trusted").mapInArrow(count, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def gram_weights(counts: DataFrame) -> np.ndarray:
    """log(target / raw) for each bucket; the table has at most BUCKETS rows."""
    total = np.zeros((2, BUCKETS))
    for row in counts.toLocalIterator():
        total[:, row.bucket] = row.raw, row.target
    raw, target = total
    if not target.sum():
        return np.zeros(BUCKETS)
    odds = [np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)) for x in (raw, target)]
    return odds[1] - odds[0]


def mean_ratio(data: bytes, weights: np.ndarray) -> float:
    parts = [(float(weights[g].sum()), len(g)) for g in grams(data)]
    return sum(x for x, _ in parts) / sum(n for _, n in parts)


def judge(docs: DataFrame, trusted_ids: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_ratio: float = MIN_RATIO, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the statistics of STATS, base_failed, log_ratio and kept, for each row of docs."""
    weights = docs.sparkSession.sparkContext.broadcast(gram_weights(gram_counts(docs, trusted_ids)))
    out = docs.select(*keep, text_of(F.col("text")).alias("_text"))
    names = [x.split()[0] for x in STATS.split(", ")]

    def measure(batches):
        for batch in slices(batches, "_text"):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            stats = list(zip(*map(text_stats, texts), strict=True)) or [[]] * len(names)
            ratio = [mean_ratio(x.encode(), weights.value) for x in texts]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(x, pa.int64()) for x in stats] + [pa.array(ratio, pa.float64())], [*keep, *names, "log_ratio"])

    kept_types = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    measured = out.mapInArrow(measure, f"{kept_types}, {STATS}, log_ratio double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= min_ratio))
