"""Mixing sources to target weights, dealt among output shards by a hypergeometric splitting tree.

A source's documents stand in the order of a hash, which makes them a stream of words in random order; blocks are
consecutive pieces of it, and a document belongs to the block that its first word lies in. Targets share all words by
weight, at most `MAX_REPEATS` times a source's size: that's some whole passes over the source and, of one more pass, as
many blocks as are needed, drawn in the order of an affine permutation without repeats. The words of the blocks drawn
meet the target: the last document of the last block is cut. All blocks drawn are the source's quota. A binary tree over the shards splits
the quotas of all sources: at each node the blocks of the left half are a multivariate hypergeometric draw from those
of the node. Each shard gets its quota of the source's draws, permuted again, so shards' draws are disjoint; within a
shard the pieces are ordered by a hash.

Blocks are so large that there are at most MAX_BLOCKS of them, so the hypergeometric draws are exact at any size.
Everything follows from ids, hashes and fixed seeds, so reruns agree.

Cases: a null source is a source of its own, the last; a null or empty text has no words and none are taken;
repeated rows and equal doc_ids are documents of their own; a table without words takes nothing. Only columns that
are asked for are kept; input columns never clash with results, as results are in one struct until the end.
The number of sources is held on the driver (`MAX_SOURCES` at most).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from inkveil.llm.common import text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words in a block at least, and words that a shard holds on average; most blocks, shards, and quotas (of a source in a shard).
BLOCK_WORDS, SHARD_WORDS, MAX_BLOCKS, MAX_SHARDS, MAX_QUOTAS = 1024, 4_000_000, 500_000_000, 1024, 1 << 24
MAX_SOURCES = 1_000_000
#: Documents in a slice of a source by hash, within which its documents are ordered, and blocks in a slice of its draws.
SLICE_DOCS, SLICE_BLOCKS = 2000, 1024
SEED = 20_240_501
#: Keeps block * step within 63 bits.
MAX_STEP = 1 << 26

_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; a run of white space ends at most one, so this counts starts of words."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, repeats: float = MAX_REPEATS) -> np.ndarray:
    """Words of each source: shares of sum(sizes) by weight, where what is above repeats * size goes to the others by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, full = np.zeros(len(sizes)), sizes == 0
    while not full.all():
        share = weights[~full] / weights[~full].sum() * (sizes.sum() - (repeats * sizes[full]).sum())
        over = share > repeats * sizes[~full]
        if not over.any():
            out[~full] = share
            break
        full[np.flatnonzero(~full)[over]] = True
    out[full] = repeats * sizes[full]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (column) in each shard (row); shards get equally many blocks, to within one."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(own: np.ndarray, first: int, last: int, node: int) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        total = int(own.sum())
        draw = total * (middle - first) // (last - first)
        left, rest, rng = np.zeros_like(own), total, np.random.default_rng([seed, node])
        for k, n in enumerate(own.tolist()):  # a multivariate hypergeometric draw, one source after the other
            left[k] = rng.hypergeometric(n, rest - n, draw) if draw and rest else 0
            rest -= n
            draw -= int(left[k])
        split(left, first, middle, 2 * node)
        split(own - left, middle, last, 2 * node + 1)

    split(np.asarray(quotas, np.int64), 0, shards, 1)
    return out


def affine(rng: np.random.Generator, n: int) -> tuple[int, int]:
    """step and shift of a permutation k -> (k * step + shift) mod n."""
    step = next(a for a in iter(lambda: int(rng.integers(1, min(n, MAX_STEP) + 1)), None) if math.gcd(a, n) == 1)
    return step, int(rng.integers(0, n))


def goals(sizes: dict, weights: tuple[float, ...], repeats: int, block_words: int) -> list[dict]:
    """For each source (by code point, null last): its size, target, words to take, blocks of a pass, and the permutation that blocks are drawn by."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    size = np.array([sizes[s] for s in names], np.int64)
    goal = targets(size, np.array([weights[k % len(weights)] for k in range(len(names))]), repeats)
    rng, out = np.random.default_rng(SEED), []
    for s, n, g in zip(names, size.tolist(), goal.tolist(), strict=True):
        blocks = max(1, -(-n // block_words))
        step, shift = affine(rng, blocks)
        out.append({"source": s, "source_size": n, "target": g, "take": min(repeats * n, round(g)), "blocks": blocks, "step": step, "shift": shift})
    return out


def deal(quotas: list[int], shards: int) -> list[dict]:
    """For each source: its quota, the permutation of its draws, and where shards' parts of them end."""
    ends = split_quotas(np.array(quotas, np.int64), shards).cumsum(0)
    rng = np.random.default_rng([SEED, 1])
    return [dict(zip(("quota", "deal_step", "deal_shift"), (n, *affine(rng, max(1, n))), strict=True)) | {"ends": ends[:, k].tolist()} for k, n in enumerate(quotas)]


def row_hash() -> Column:
    """Orders a source's documents, by id and text."""
    return F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text_of(F.col("text"))))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block_words: int | None = None, shards: int | None = None) -> DataFrame:
    """The columns in keep and: size, source_size, target, taken, and pieces, an array of (pass, shard, place, words).

    In pass p the first `words` words of the document go to `shard`, where pieces are ordered by `place`."""
    spark = docs.sparkSession
    source, text = F.col("source").cast("string"), text_of(F.col("text"))
    own = F.struct(*keep) if keep else F.struct(F.lit(0))
    slices = 1 << max(6, math.ceil(math.log2(max(1, docs.count()) / SLICE_DOCS + 1)))
    rows = docs.select(own.alias("own"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("s"), size_of(text).alias("size"), row_hash().alias("h"))
    rows = rows.withColumn("slice", F.pmod("h", F.lit(slices)))
    group, unbounded = ["no_source", "s"], W.Window.unboundedPreceding
    by_slice = written(rows.groupBy(*group, "slice").agg(F.sum("size").alias("words")), "mix-slices")
    sizes = by_slice.groupBy(*group).agg(F.sum("words").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    block_words = block_words or max(BLOCK_WORDS, -(-sum(r.n for r in sizes) // MAX_BLOCKS))
    aims = goals({None if r.no_source else r.s: r.n for r in sizes}, weights, repeats, block_words)
    names = ("source_size", "target", "take", "blocks", "step", "shift")
    known = spark.createDataFrame([(x["source"] is None, x["source"] or "", *(x[n] for n in names)) for x in aims], "no_source boolean, s string, source_size long, target double, take long, blocks long, step long, shift long")

    def before(table: DataFrame, part: list[str], by: str, words: str) -> DataFrame:
        """table with the words before each row, by sums of all earlier ones in its part."""
        return table.withColumn("before", F.coalesce(F.sum(words).over(W.Window.partitionBy(*part).orderBy(by).rowsBetween(unbounded, -1)), F.lit(0)))

    # Words before a slice, then those before a document within its slice: no source is ever ordered in one task.
    starts = before(by_slice, group, "slice", "words").drop("words").join(known, group)
    inside = before(rows, [*group, "slice"], "h", "size").withColumnRenamed("before", "inside")
    placed = inside.join(starts, [*group, "slice"]).withColumn("at", F.col("before") + F.col("inside")).drop("before", "inside", "slice")
    block = F.floor(F.col("at") / block_words)
    draw = F.pmod(block * F.col("step") + F.col("shift"), F.col("blocks"))
    placed = written(placed.withColumn("draw", draw), "mix-placed")
    # The same in the order of draws: words before a slice of draws, before a block in it, before a document in its block.
    blocks = placed.groupBy(*group, "draw").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("draw") / SLICE_BLOCKS))
    parts = before(blocks.groupBy(*group, "part").agg(F.sum("words").alias("part_words")), group, "part", "part_words").withColumnRenamed("before", "part_before").drop("part_words")
    drawn = before(blocks, [*group, "part"], "draw", "words").join(parts, [*group, "part"]).select(*group, "draw", (F.col("before") + F.col("part_before")).alias("drawn_before"), "words")
    drawn = written(drawn, "mix-blocks")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    rest = F.col("take") - whole * F.col("source_size")
    last_pass = drawn.join(known, group).groupBy(*group).agg(F.max(F.when(F.col("drawn_before") < rest, F.col("draw") + 1)).alias("end"))
    ends = {None if r.no_source else r.s: r["end"] or 0 for r in last_pass.collect()}
    quotas = [(x["take"] // x["source_size"] if x["source_size"] else 0) * x["blocks"] + ends.get(x["source"], 0) for x in aims]
    shards = shards or int(min(MAX_SHARDS, max(1, sum(x["take"] for x in aims) // SHARD_WORDS), max(1, MAX_QUOTAS // max(1, len(aims)))))
    dealt = spark.createDataFrame([(x["source"] is None, x["source"] or "", y["quota"], y["deal_step"], y["deal_shift"], y["ends"]) for x, y in zip(aims, deal(quotas, shards), strict=True)], "no_source boolean, s string, quota long, deal_step long, deal_shift long, ends array<long>")
    in_order = before(placed, [*group, "draw"], "h", "size").join(drawn.drop("words"), [*group, "draw"]).join(dealt, group)

    def piece(p: int) -> Column:
        first = F.col("drawn_before") + F.col("before") + p * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.col("take") - first, F.lit(0)))
        rank = F.pmod((F.col("draw") + p * F.col("blocks")) * F.col("deal_step") + F.col("deal_shift"), F.greatest("quota", F.lit(1)))
        shard = F.size(F.filter("ends", lambda e: e <= rank))
        return F.struct(F.lit(p).alias("pass"), shard.alias("shard"), F.xxhash64("h", F.lit(p)).alias("place"), words.alias("words"))

    pieces = F.filter(F.array(*[piece(p) for p in range(repeats)]), lambda x: x["words"] > 0)
    out = in_order.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return out.select(*[F.col(f"own.{k}").alias(k) for k in keep], "size", "source_size", "target", taken.alias("taken"), "pieces")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each piece, each shard's in one partition in the order of the shard. Of a cut document the first words remain, joined by single spaces.

    What is taken is found without the texts; they come by source and hash (rows of equal id and text in any order)."""
    columns, keys = tuple(docs.columns), ["_source", "_hash"]
    own = docs.withColumns({"_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "_hash": row_hash()})
    found = mix(own, tuple(keys), **options).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pieces", "size"))).alias("_found"))
    numbered = own.withColumn("_k", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.xxhash64(*columns))))
    chosen = numbered.join(found, keys).select(*columns, F.get("_found", F.col("_k") - 1).alias("_own")).select(*columns, F.col("_own.size").alias("_size"), F.explode("_own.pieces").alias("_piece"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORD), 0), 1, F.col("_piece.words").cast("int")), " ")
    text = F.when(F.col("_piece.words") < F.col("_size"), cut).otherwise(F.col("text"))
    dealt = chosen.repartition(F.col("_piece.shard")).sortWithinPartitions("_piece.shard", "_piece.place")
    return dealt.select(*[(text if c == "text" else F.col(c)).alias(c) for c in columns])
