"""Text fingerprints by invertible Bloom lookup sketches, in DataFrame expressions alone.

A text's paragraphs are its lines, long ones in pieces of `PIECE_WORDS` words; a sketch holds their 64-bit digests. Each
digest goes to one cell in each of three rows of four; a cell has the XOR of the digests and the sum of their shares (a large one and
a check: so it tells their number too). Sketches of two texts subtract cell by cell: what both hold cancels out. Cells left with one digest
give it away; taking it out of its other cells peels the difference, digest by digest. A fingerprint is the sketch of one block of
cells. Where it can't be peeled, a larger one is tried: digests are dealt among many blocks by their bits. A block that can't be peeled is
tried again as RETRY_BLOCKS, and what even those can't tell is compared as sets. From the size of the difference and of both sets
follows their Jaccard likeness.

The next document of each, in descending order of doc_id, comes from one shuffle of texts by ranges of doc_id: the
ranges' bounds are quantiles (at most MAX_RANGES), and the first document of a range is also sent to the one before it.

Cases: null texts are empty; an empty text has no paragraphs, two empty texts are alike (1.0), an empty and another
not at all. Equal texts have equal fingerprints. A null doc_id comes last. Among equal doc_ids the order is by the texts'
hash. A single document is its own next one. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from inkveil.llm.common import text_of

PIECE_WORDS = 32
#: Cells of a block: three rows of four. The share of one digest in a cell's sum.
CELLS, ONE = 12, 1 << 40
#: Rounds of peeling; digests on average of a group and of a block in it; blocks that one is parted into if it can't be peeled.
ROUNDS, GROUP, LOAD, RETRY_BLOCKS = 8, 24, 3, 4
RANGE_DOCS, MAX_RANGES, SIDE = 400, 4096, 64

_PIECE = "(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09\\x0B-\\x0D]*+){1,%d}" % PIECE_WORDS  # noqa: UP031


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), 0), lambda p: F.xxhash64(F.rtrim(p))))


def _check(h: Column) -> Column:
    """A digest's share of a cell's sum: ONE, so that sums tell numbers of digests, and a check of 31 bits."""
    return F.shiftright(h, 16).bitwiseAND(0x7FFFFFFF) + ONE


def _cells_of(h: Column) -> Column:
    """A digest's three cells, as bits."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1), F.shiftright(h, 2 * n).bitwiseAND(3).cast("int") + 4 * n)
    return bit(0) + bit(1) + bit(2)


def entries(keys: Column) -> Column:
    """For each digest: k, its cells m, its share s."""
    return F.transform(keys, lambda k: let(F.xxhash64(k), lambda h: F.struct(k.alias("k"), _cells_of(h).alias("m"), _check(h).alias("s"))))


def _hits(mask: Column, j: Column) -> Column:
    return F.call_function("shiftright", mask, j).bitwiseAND(1) == 1


def _cell(k: Column, s: Column) -> Column:
    return F.struct(k.alias("k"), s.alias("s"))


def sketch(own: Column) -> Column:
    """The cells of one block: XOR of digests and sum of shares."""
    empty = _cell(F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda a, e: _cell(a["k"].bitwiseXOR(e["k"]), a["s"] + e["s"])
    return F.transform(F.lit(list(range(CELLS))), lambda j: F.aggregate(own, empty, lambda a, e: F.when(_hits(e["m"], j), add(a, e)).otherwise(a)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["k"].bitwiseXOR(y["k"]), x["s"] - y["s"]))


def pure(cells: Column) -> Column:
    """What cells of a single digest hold (k, and s with its sign)."""
    return F.array_distinct(F.filter(cells, lambda x: F.abs(x["s"]) == _check(F.xxhash64(x["k"]))))


def total(cells: Column) -> Column:
    empty = _cell(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return F.aggregate(cells, empty, lambda a, x: _cell(a["k"].bitwiseXOR(x["k"]), a["s"] + x["s"]))


def peel(cells: Column) -> Column:
    """Number of digests that a difference holds, or null if they can't be told."""
    # Each digest is once in the first row of cells, so if the pure ones sum up to that, they are all.
    at_once = lambda all_cells, found: F.when(total(found) == total(F.slice(all_cells, 1, 4)), F.size(found)).otherwise(peel_by_rounds(all_cells))
    return let(cells, lambda all_cells: let(pure(all_cells), lambda found: at_once(all_cells, found)))


def peel_by_rounds(cells: Column) -> Column:
    def once(state: Column, _: Column) -> Column:
        more = let(pure(state["cells"]), lambda found: F.struct(without(state["cells"], found).alias("cells"), (state["d"] + F.size(found)).alias("d"), (F.size(found) == 0).alias("end")))
        return F.when(state["end"], state).otherwise(more)

    def without(all_cells: Column, found: Column) -> Column:
        take = lambda a, x: _cell(a["k"].bitwiseXOR(x["k"]), a["s"] - x["s"])
        placed = F.transform(found, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), _cells_of(F.xxhash64(x["k"])).alias("m")))
        return let(placed, lambda known: F.transform(all_cells, lambda cell, j: F.aggregate(known, cell, lambda a, x: F.when(_hits(x["m"], j), take(a, x)).otherwise(a))))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("d"), F.lit(False).alias("end"))
    return F.aggregate(F.lit(list(range(ROUNDS))), start, once, lambda end: F.when(F.forall(end["cells"], lambda x: (x["k"] == 0) & (x["s"] == 0)), end["d"]))


def _share(own: Column, blocks: Column, g: Column, shift: int) -> Column:
    return F.filter(own, lambda e: F.pmod(F.shiftright(e["k"], shift), blocks) == g)


def in_blocks(a: Column, b: Column, blocks: Column, shift: int, use: Callable[[Column, Column], Column]) -> Column:
    """Sum over blocks of use(a's part, b's part)."""
    one = lambda n, g: let(_share(a, n, g, shift), lambda x: let(_share(b, n, g, shift), lambda y: use(x, y)))
    return let(blocks, lambda n: F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0), lambda d, g: d + one(n, g)))


def difference(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Number of digests that one of two texts has alone; a, b: their entries, whole_a, whole_b: their fingerprints' cells."""
    exact = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    smaller = lambda x, y: F.coalesce(peel(subtract(sketch(x), sketch(y))), exact(x, y))
    block = lambda x, y: F.coalesce(peel(subtract(sketch(x), sketch(y))), in_blocks(x, y, F.lit(RETRY_BLOCKS).cast("long"), 8, smaller))
    count = lambda x, y, load: F.greatest(F.ceil((F.size(x) + F.size(y)) / load), F.lit(1))
    group = lambda x, y: in_blocks(x, y, count(x, y, LOAD), 24, block)
    return F.coalesce(peel(subtract(whole_a, whole_b)), in_blocks(a, b, count(a, b, GROUP), 40, group))


def likeness(d: Column, na: Column, nb: Column) -> Column:
    """Jaccard similarity of sets of na and nb digests that differ in d."""
    return F.when(na + nb == 0, 1.0).otherwise((na + nb - d) / (na + nb + d))


def written_out(cells: Column, n: Column) -> Column:
    """The number of digests, then 32 hex digits for each cell."""
    cell = lambda x: F.concat(F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["s"]), 16, "0"))
    return F.concat(F.hex(n), F.lit(":"), F.array_join(F.transform(cells, cell), ""))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, h, next_text, next_h: each document and the next one, in descending order of doc_id; after the last the first."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    ranges = int(min(MAX_RANGES, max(1, ids.count() // RANGE_DOCS)))
    cuts = ids.select(F.col("key").cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 1 / (8 * ranges)) if ranges > 1 else []
    cuts = sorted(set(cuts))

    def place(k: Column) -> Column:
        """Number of cuts up to k: first among every SIDE-th, then among the SIDE that follow."""
        x, every = k.cast("double"), cuts[::SIDE]
        below = lambda values: F.size(F.filter(values, lambda c: c <= x))
        if not cuts:
            return F.lit(0)
        coarse = below(F.lit(every))
        return F.when(coarse == 0, 0).otherwise((coarse - 1) * SIDE + below(F.slice(F.lit(cuts), (coarse - 1) * SIDE + 1, F.lit(SIDE))))

    tops = sorted((r.range, r.top) for r in ids.groupBy(place(F.col("key")).alias("range")).agg(F.max("key").alias("top")).collect())
    visits = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    guests = docs.sparkSession.createDataFrame(visits, "key long, visits int")  # one row for each range, MAX_RANGES at most
    own = docs.select("doc_id", key.alias("key"), "text", digests(F.col("text")).alias("h"), place(key).alias("range"))
    stay = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("visits").alias("range"), F.lit(True).alias("guest"))
    dealt = own.join(F.broadcast(guests), "key", "left").withColumn("at", F.explode(F.when(F.col("visits").isNull(), F.array(stay)).otherwise(F.array(stay, visit))))
    order = W.Window.partitionBy("at.range").orderBy("at.guest", F.desc("key"), F.xxhash64("text"), "text")
    found = dealt.select("doc_id", "text", "h", "at", F.lead("text").over(order).alias("next_text"), F.lead("h").over(order).alias("next_h"))
    return found.where(~F.col("at.guest")).drop("at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, for each row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    rows = with_next(own).withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.select("doc_id", "n", "h", "next_h", edited.alias("edited"))
    rows = rows.select("doc_id", "n", F.sha2("edited", 256).alias("sha"), *[F.array(entries(F.col(c))).alias(c) for c in ("h", "next_h")], F.array(entries(digests(F.col("edited")))).alias("edited_h"))

    def all_of(a: Column) -> Column:
        return F.struct(a.alias("e"), sketch(a).alias("cells"), F.size(a).alias("size"))

    def compared(a: Column, b: Column) -> Column:
        return likeness(difference(a["e"], b["e"], a["cells"], b["cells"]), a["size"], b["size"])

    def result(a: Column, b: Column, c: Column) -> Column:
        return F.struct(
            written_out(a["cells"], a["size"]).alias("fingerprint"), written_out(b["cells"], b["size"]).alias("edited_fingerprint"),
            compared(a, b).alias("near_edited"), compared(a, c).alias("near_next"),
        )

    sets = [F.transform(c, all_of) for c in ("h", "edited_h", "next_h")]
    made = let(sets[0], lambda a: let(sets[1], lambda b: let(sets[2], lambda c: result(F.get(a, F.lit(0)), F.get(b, F.lit(0)), F.get(c, F.lit(0))))))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.explode(F.array(made)).alias("made"))
    return out.select("doc_id", "n_chars", "edited_sha256", "made.*")
