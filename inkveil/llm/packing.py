"""Packing token streams into sequences by order-preserving dynamic programming.

Documents, in ascending doc_id order, form a stream that is cut into sequences of at most `length` tokens. Cuts
lie at the ends of documents, sentences and lines, and, inside sentences longer than `LONG_SENTENCE`, at ends of
words. The cuts chosen minimise padding + a fixed price of each sequence + penalties of cuts inside documents.
A sequence is padded to `length`, unless its length is a power of two. With position p and cost c, a cut j costs
penalty(j) + price + min(c(i) + length - (p(j) - p(i))) over the window p(j) - p(i) <= length: the minimum of
c(i) + p(i) there comes from a monotone queue. Cuts exactly a power of two back need no padding and are looked up.

The stream is cut into blocks of `BLOCK_TOKENS` tokens at document ends (a document is never parted by a block),
so memory is bounded by a block and the longest document.

Cases: a null or empty text is the end id alone. Repeated rows and equal doc_ids are documents of their own. An empty
table gives no pieces. Further columns are ignored. A word of more tokens than a sequence is cut at any token.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import slices, text_of
from inkveil.llm.tokens import END_ID, encoder, grouped, up_to_texts

LENGTH = 2048
#: Tokens of padding that a sequence more, a cut at a sentence's or line's end, one at a word's end and one in a word are worth.
PRICE, AT_SENTENCE, AT_WORD, IN_WORD = 12, 2, 24, 200
#: Sentences of more tokens can be cut at ends of words, as many tokens apart.
LONG_SENTENCE = 96
#: Shortest sequence that is looked for because it needs no padding.
SMALLEST = 64
BLOCK_TOKENS = 1 << 20

_NONE = np.zeros(0, np.int64)
_STOPS = np.isin(np.arange(256), list(b".!?"))

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def cut_points(data: np.ndarray, last: np.ndarray, upto: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in tokens, without the texts' bounds) where texts, a line feed behind each, can be cut, and the penalties there.

    last has the place of the last byte of each chunk, upto the tokens up to its end, ends the tokens up to each text's end."""
    if not len(last):
        return _NONE, _NONE
    stop = _STOPS[data[last]]
    feeds = np.searchsorted(last, np.flatnonzero(data == 10))  # chunks before each line feed
    stop[feeds[feeds > 0] - 1] = True
    bounds = np.flatnonzero(stop)
    at = upto[bounds]
    before = np.concatenate([[0], at[:-1]])
    penalty = np.full(len(at), AT_SENTENCE)
    if (long := np.flatnonzero(at - before >= LONG_SENTENCE)).size:
        more = []
        for k in long.tolist():
            words = upto[bounds[k - 1] + 1 if k else 0 : bounds[k]].tolist()
            p, end, j = int(before[k]), int(at[k]), 0
            while (j := bisect_left(words, p + LONG_SENTENCE, j)) < len(words) and words[j] < end:
                p = words[j]
                more.append(p)
        both = np.concatenate([at, np.array(more, np.int64)])
        order = np.argsort(both, kind="stable")
        at, penalty = both[order], np.repeat([AT_SENTENCE, AT_WORD], [len(at), len(more)])[order]
        before = np.concatenate([[0], at[:-1]])
    # Not after words without tokens, nor where the end id would stand alone behind the last sentence.
    inner = (at > before) & (ends[np.minimum(np.searchsorted(ends, at), len(ends) - 1)] != at)
    return at[inner], penalty[inner]


def exact_steps(at: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Indices (j, i), ascending with j, of positions that are a power of two apart, at least SMALLEST and less than length."""
    found = [_NONE], [_NONE]
    size = SMALLEST
    while size < length:
        i = np.searchsorted(at, at - size)
        j = np.flatnonzero(at[i] == at - size)
        found[0].append(j)
        found[1].append(i[j])
        size *= 2
    later, earlier = map(np.concatenate, found)
    order = np.lexsort((earlier, later))
    return later[order].tolist(), earlier[order].tolist()


def best_cuts(at: list[int], penalty: list[int], length: int) -> list[int]:
    """Indices of the chosen cuts among positions `at` (ascending, the first 0, the last the end; gaps of at most `length`)."""
    n = len(at)
    cost, back, key = [0] * n, [0] * n, [0] * n
    later, earlier = exact_steps(np.array(at), length)
    later.append(n)
    step, at_step = 0, later[0]
    queue: deque[int] = deque([0])
    left, pop = queue.popleft, queue.pop
    for j in range(1, n):
        p = at[j]
        i = queue[0]
        while at[i] < p - length:
            left()
            i = queue[0]
        best = key[i] + length - p
        while at_step == j:
            k = earlier[step]
            if cost[k] < best:
                best, i = cost[k], k
            step += 1
            at_step = later[step]
        best += penalty[j] + PRICE
        cost[j], back[j] = best, i
        key[j] = own = best + p
        while queue and key[queue[-1]] >= own:
            pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def pack_block(docs: list[tuple], first_sequence: int, length: int = LENGTH) -> list[tuple]:
    """Pieces (of SCHEMA) for documents of (doc_id, ids with the end id, cut positions, penalties)."""
    sizes = np.array([len(ids) // 4 for _, ids, _, _ in docs], np.int64)
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    at = np.concatenate([[0], *(x for (_, _, inner, _), a, b in zip(docs, starts, ends, strict=True) for x in (inner + a, [b]))])
    penalty = np.concatenate([[0], *(x for _, _, _, prices in docs for x in (prices, [0]))])
    at = at.tolist()
    chosen = [at[k] for k in best_cuts(at, penalty.tolist(), length)]
    pieces, doc = [], 0
    for number, (a, b) in enumerate(zip(chosen, chosen[1:], strict=False)):
        size = b - a
        padding = 0 if size & (size - 1) == 0 else length - size
        while a < b:
            doc_id, ids, _, _ = docs[doc]
            start, tokens = a - starts[doc], len(ids) // 4
            end = min(tokens, b - starts[doc])
            pieces.append((doc_id, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), tokens, first_sequence + number, a - chosen[number], padding))
            a = starts[doc] + end
            doc += end == tokens
    return pieces


def pack_stream(docs: Iterator[tuple[int | None, bytes]], vocabulary: str, first_sequence: int = 0, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> Iterator[list[tuple]]:
    """Pieces, block by block."""
    words = encoder(vocabulary)
    end = END_ID.to_bytes(4, "little")
    held, size = [], 0
    for group in grouped(docs, lambda doc: len(doc[1])):
        texts = [text for _, text in group]
        joined = b"\n".join([*texts, b""])
        ids, last, upto = words.chunk_ids(joined)
        whole, ends = ids.tobytes(), up_to_texts(texts, last, upto)
        cuts, prices = cut_points(np.frombuffer(joined, np.uint8), last, upto, ends)
        a = first = 0
        for (doc_id, _), b, to in zip(group, ends.tolist(), np.searchsorted(cuts, ends).tolist(), strict=True):
            own, inner, penalty = whole[4 * a : 4 * b] + end, cuts[first:to] - a, prices[first:to]
            if len(own) > 4 * length:
                inner, penalty = fill_gaps(inner, penalty, len(own) // 4, length)
            held.append((doc_id, own, inner, penalty))
            size += len(own) // 4
            if size >= block_tokens:
                yield (pieces := pack_block(held, first_sequence, length))
                first_sequence, held, size = pieces[-1][5] + 1, [], 0
            a, first = b, to
    if held:
        yield pack_block(held, first_sequence, length)


def fill_gaps(at: np.ndarray, penalty: np.ndarray, end: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """With positions added where two neighbours would be more than a sequence apart: inside a word of very many tokens."""
    before = np.concatenate([[0], at])
    if (np.diff(np.concatenate([before, [end]])) <= length).all():
        return at, penalty
    more = np.concatenate([np.arange(a + length, b, length) for a, b in zip(before.tolist(), [*at.tolist(), end], strict=True)])
    both, prices = np.concatenate([at, more]), np.concatenate([penalty, np.full(len(more), IN_WORD)])
    order = np.argsort(both, kind="stable")
    return both[order].astype(np.int64), prices[order]


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row of SCHEMA for each piece. Sequence ids ascend with the stream; each range of documents has 2^32 of them."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        stream = (x for part in slices(batches, "text") for x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True))
        for pieces in pack_stream(stream, sent.value, TaskContext.get().partitionId() << 32, length, block_tokens):
            for k in range(0, len(pieces), 10_000):
                columns = zip(*pieces[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in SCHEMA.split(", ")])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).cast("binary").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, SCHEMA)
