"""Near-duplicate texts by bottom-k sketches of their word shingles.

One hash function gives each shingle a value; a text's sketch is its K smallest. Texts of equal shingle sets are one
class, represented by its smallest doc_id. An index of inverted lists holds, for each representative, the rarest values of
its sketch: those that are frequent in the whole corpus come last, as in prefix filtering, so that two sets similar
enough share REQUIRED of the indexed ones and yet a passage that many texts share makes no candidates of them.
Candidates are representatives that share so many; the sketch of their union estimates their similarity; the full
sets confirm it.

To lose no link and yet not pair up the rows of a large group, each representative first joins the group of one hub: of
the pivots of its lists (those whose lists are largest, as the original of many copies) the one that it shares most
values with. Each is compared with its hub, if their sketches allow it by their full sets. Only those that aren't linked to their hub are compared
with all of the group, block by block: a task gets the full sets of two blocks and returns only the links that join parts
of them. What is linked joins components; then only representatives of different components and groups are still
paired up. Components never reach the driver: large-star and small-star steps run over tables in the shared folder.

With similarity 0.8 and K = 96 two sketches have fewer than SHARED values in common with probability below 1e-6; sets of at most
EXACT shingles, and all that can be similar to them, are their own sketches, for which the bounds are exact.

Cases: a null or empty text has no shingles and is linked with nothing; one of fewer words than a shingle is one
shingle. Rows of an equal doc_id count as one document, so they share a component; a row without doc_id takes no
part: its component is null and it's kept. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import LOWER, joined_spread, remove_written, slices, text_of, written

K = 96
#: Common sketch values of similar sets at least, those of them that must be among the indexed ones, and the largest sets with exact bounds.
SHARED, REQUIRED, EXACT = 56, 4, 76
#: Estimated similarity (percent) from which full sets are compared.
MIN_ESTIMATE = 58
#: Sketch values whose frequency the executors know (12 bytes each); all others count as rare. It only orders values, so no link hangs on it.
MAX_FREQUENT = 1 << 21
#: Members of a block of full sets, rows of a block of a list, and pairs that get the same copy of a full set.
BLOCK, LIST_BLOCK, PART = 256, 1024, 1024
#: Most words of 64 bits in the bitmap of candidates.
MAX_BITMAP = 1 << 20


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending as signed integers."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((mixed ^ (mixed >> np.uint64(33))).view(np.int64))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n (shingles), digest of the set, sketch."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = [shingle_set(x.as_py(), n) for x in batch.column("text")]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sketch"])

    return docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def indexed(sketches: pa.Array, sizes: np.ndarray, known: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that are indexed, and the numbers of their sketches: the rarest of each, so many that similar sets share REQUIRED (small ones: 1).

    known (ascending), times: the frequent values and how many sketches hold them."""
    values, lengths = sketches.flatten().to_numpy(), sketches.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(sizes)), lengths)
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    often = np.where(known[at] == values, times[at], 0) if len(known) else np.zeros(len(values), np.int64)
    order = np.lexsort((values, often, owner))
    rank = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = np.where(sizes <= EXACT, sizes - -(-percent * sizes // 100) + 1, lengths - SHARED + REQUIRED)
    chosen = order[rank < np.repeat(np.maximum(keep, 1), lengths)]
    return values[chosen], owner[chosen]


def frequent_values(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The values that more than two sketches hold (ascending) and their numbers; those of the largest numbers if they are more than MAX_FREQUENT."""
    counted = written(nodes.select(F.explode("sketch").alias("v")).groupBy("v").count().where("count > 2"), "near-values")
    at_least = counted.agg(*(F.count(F.when(F.col("count") >= (1 << k), 1)).alias(str(k)) for k in range(1, 48))).first()
    bound = next((k for k in range(1, 48) if at_least[str(k)] <= MAX_FREQUENT), 48)
    found = counted.where(F.col("count") >= (1 << bound)).toArrow()
    remove_written(counted)
    values, times = found.column("v").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(values)
    return values[order], times[order].astype(np.int32)


def inverted_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """v (value), id, n, size of the list: rows of lists of at least two."""
    frequency = nodes.sparkSession.sparkContext.broadcast(frequent_values(nodes))

    def run(batches):
        for batch in batches:
            ids, sizes = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            values, owner = indexed(batch.column("sketch"), sizes, *frequency.value, percent)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(ids[owner]), pa.array(sizes[owner])], ["v", "id", "n"])

    rows = nodes.select("id", "n", "sketch").mapInArrow(run, "v long, id long, n long")
    shared = written(rows.groupBy("v").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("size", F.col("rows")), "near-shared")
    return written(joined_spread(rows, shared, ("v",), F.xxhash64("id")).where("size IS NOT NULL"), "near-lists")


def alike(a: str, b: str, percent: int) -> Column:
    """Do the sizes allow the similarity?"""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.col(a) > 0)


def enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb), a row for each indexed value they share, that share enough of them: with their number."""
    counted = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= F.when(F.least("na", "nb") > EXACT, REQUIRED).otherwise(1))


def hubs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): for each id b the pivot a that it shares most values with; a list's pivot is the one of the largest lists."""
    weight = lists.groupBy("id").agg(F.sum("size").alias("weight"))
    pivot = lists.join(weight, "id").groupBy("v").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n")).alias("p"), F.count("*").alias("rows"))
    rows = joined_spread(lists, pivot, ("v",), F.xxhash64("id")).where(F.col("id") != -F.col("p.minus"))
    pairs = enough(rows.select((-F.col("p.minus")).alias("a"), F.col("id").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb")).where(alike("na", "nb", percent)))
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("minus"), "na", "nb")).alias("x"))
    return best.select((-F.col("x.minus")).alias("a"), "b", F.col("x.na").alias("na"), F.col("x.nb").alias("nb"))


def spanning_links(ids: list[int], sets: list[np.ndarray], first: int, percent: int) -> list[tuple[int, int]]:
    """Links that join all of these that similar ones join. With first > 0 only pairs of one of the first ones and a later one count."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(-sizes[:first], kind="stable") if first else np.arange(len(ids))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, member = [], np.zeros(len(values), bool)
    for x in order.tolist():
        low = first or x + 1
        if low >= len(ids):
            continue
        own = codes[ends[x] - sizes[x] : ends[x]]
        member[own] = True
        start = ends[low] - sizes[low]
        common = np.add.reduceat(member[codes[start:]].astype(np.int64), ends[low:] - sizes[low:] - start)
        member[own] = False
        for y in (np.flatnonzero(100 * common >= percent * (sizes[x] + sizes[low:] - common)) + low).tolist():
            a, b = find(x), find(y)
            if a != b:
                root[b] = a
                out.append((ids[x], ids[y]))
    return out


def with_own(pairs: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the columns that table (id, ...) has for their `key`; an id in many pairs gets a copy for each PART of them."""
    salt = F.xxhash64("a", "b")
    numbers = pairs.groupBy(key).agg(F.count("*").alias("rows")).withColumn("_parts", F.ceil(F.col("rows") / PART).cast("int"))
    dealt = joined_spread(pairs, numbers, (key,), salt).withColumn("_part", F.pmod(salt, F.col("_parts")).cast("int")).drop("_parts")
    copies = numbers.join(table.withColumnRenamed("id", key), key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.join(copies.drop("rows", "_parts"), [key, "_part"]).drop("_part")


def linked_in_groups(pairs: DataFrame, left_over: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of those left over (a: the hub, b) with any of their hub's group; a task holds a block of those and one of all."""
    apart = left_over.select(F.col("a").alias("g"), F.col("b").alias("id"), F.lit(True).alias("apart"))
    near = pairs.select(F.col("a").alias("g"), F.col("b").alias("id")).join(left_over.select(F.col("a").alias("g")).distinct(), "g", "left_semi")
    members = near.union(near.select("g", F.col("g").alias("id")).distinct()).join(apart, ["g", "id"], "left")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    numbers = members.groupBy("g").agg(F.count("*").alias("rows"), blocks(F.count("*")).alias("all"), blocks(F.count("apart")).alias("some"))
    counted = joined_spread(members, numbers, ("g",), F.xxhash64("id"))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    place = lambda first, hi, lo: F.struct(F.lit(first).alias("first"), hi.alias("hi"), lo.alias("lo"))
    as_one = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda k: place(True, own(F.col("some")), k))
    as_other = F.transform(F.sequence(F.lit(0), F.col("some") - 1), lambda k: place(False, k, own(F.col("all"))))
    dealt = counted.join(sets, "id").select("g", "id", "set", F.explode(F.when(F.col("apart").isNotNull(), F.concat(as_one, as_other)).otherwise(as_other)).alias("m"))

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("first").to_pylist(), table.column("id").to_pylist(), (x.values.to_numpy() for x in table.column("set")), strict=True), key=lambda r: (not r[0], r[1]))
        first = sum(f for f, _, _ in rows)
        links = spanning_links([i for _, i, _ in rows], [x for _, _, x in rows], first, percent) if 0 < first < len(rows) else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.select("g", "id", "set", "m.first", "m.hi", "m.lo").groupBy("g", "hi", "lo").applyInArrow(compare, "a long, b long").where("a <> b")


def all_pairs(lists: DataFrame, roots: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of one list that are of different components and of different groups; long lists are paired block by block."""
    own = lists.join(roots, "id", "left").join(groups, "id", "left").withColumns({"root": F.coalesce("root", "id"), "g": F.coalesce("g", "id")})
    ends = [F.expr(f"{f}({x})").alias(f"{f}_{x}") for x in ("root", "g") for f in ("min", "max")]
    mixed = own.groupBy("v").agg(*ends, F.count("*").alias("rows")).where("min_root < max_root AND min_g < max_g")
    mixed = mixed.select("v", "rows", F.ceil(F.col("rows") / LIST_BLOCK).cast("int").alias("blocks"))
    rows = written(joined_spread(own.select("v", "id", "n", "root", "g"), mixed, ("v",), F.xxhash64("id")).where("blocks IS NOT NULL"), "near-mixed")
    left = rows.select("v", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("g").alias("ga"))
    right = rows.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("g").alias("gb"))
    found = left.join(right, ["v", "block"]).where((F.col("ra") != F.col("rb")) & (F.col("ga") != F.col("gb")) & (F.col("a") < F.col("b")) & alike("na", "nb", percent))
    return enough(found.select("a", "b", "na", "nb")).drop("shared")


def alike_sketches(sa: Column, sb: Column) -> Column:
    """Does the sketch of the union estimate enough similarity?"""
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, K)
    return 100 * F.size(F.array_intersect(F.array_intersect(sa, sb), union)) >= MIN_ESTIMATE * F.size(union)


def alike_sets(sa: Column, sb: Column, percent: int) -> Column:
    common = F.size(F.array_intersect(sa, sb))
    return 100 * common >= percent * (F.size(sa) + F.size(sb) - common)


def both_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (a, b) with what table (id, x) has for both, as xa and xb."""
    return pairs.join(table.withColumnsRenamed({"id": "a", "x": "xa"}), "a").join(table.withColumnsRenamed({"id": "b", "x": "xb"}), "b")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches are alike."""
    return both_ends(pairs.select("a", "b"), nodes.select("id", F.col("sketch").alias("x"))).where(alike_sketches(F.col("xa"), F.col("xb"))).select("a", "b")


def full_sets(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """id and set for (at least) the ids in pairs: a bitmap of their hashes passes over most other texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    words = 1024
    count = ids.count()
    while words < MAX_BITMAP and words < count // 4:
        words *= 2
    place = F.pmod(F.xxhash64("id"), F.lit(words * 64))
    # Spark's hash of an id is computed on both sides, so the driver only ORs bits: at most MAX_BITMAP words.
    bits = ids.select((place / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) AS int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(words, np.int64)
    bitmap[bits.column("w").to_numpy()] = bits.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            chosen = np.flatnonzero((sent.value[at // 64] >> (at % 64)) & 1)
            for part in slices(iter([batch.take(pa.array(chosen))]), "text"):
                sets = [shingle_set(x.as_py(), n) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), text_of(F.col("text")).alias("text")).withColumn("at", place)
    return own.mapInArrow(run, "id long, set array<long>")


def tried(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs with their hubs a: sketches, the first values of the sets, tell which sets are compared."""
    both = with_own(pairs.select("a", "b"), "a", sets.withColumnRenamed("set", "sa")).join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    near = F.when(alike_sketches(F.slice("sa", 1, K), F.slice("sb", 1, K)), alike_sets(F.col("sa"), F.col("sb"), percent)).otherwise(False)
    return both.select("a", "b", near.alias("linked"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    return both_ends(pairs, sets.withColumnRenamed("set", "x")).where(alike_sets(F.col("xa"), F.col("xb"), percent)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) for each end of an edge (a, b), by alternating large-star and small-star steps."""
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-edges")
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # Those above a vertex now hang on the least around it; then its own lesser neighbours do.
        joined = large.join(least(large), "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        older, edges = edges, written(small.where("u <> v").distinct(), "near-edges")
        remove_written(older)
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if now == before:
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
        before = now


def links(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """id and root of all representatives that are linked with another."""
    lists = inverted_lists(nodes, percent)
    pairs = written(hubs(lists, percent), "near-hubs")
    sets = written(full_sets(docs, pairs, n), "near-sets")
    compared = written(tried(pairs, sets, percent), "near-tried")
    within = linked_in_groups(pairs, compared.where("NOT linked").select("a", "b"), sets, percent)
    roots = written(components(compared.where("linked").select("a", "b").union(within)), "near-roots")
    groups = pairs.select(F.col("b").alias("id"), F.col("a").alias("g"))
    rest = written(estimated(all_pairs(lists, roots, groups, percent), nodes), "near-pairs")
    remove_written(sets)
    more = written(full_sets(docs, rest, n), "near-sets")
    return components(confirmed(rest, more, percent).union(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for each row of docs. Linked: 100 * intersection >= percent * union."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = written(sketches(docs, n).withColumn("uid", F.monotonically_increasing_id()), "near-sketches")
    some = "doc_id IS NOT NULL AND n > 0"
    classes = written(sketched.where(some).groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("least"), F.count("*").alias("rows")), "near-classes")
    nodes = written(sketched.join(classes.select(F.col("least.uid").alias("uid")), "uid", "left_semi").select(F.col("doc_id").alias("id"), "n", "sketch"), "near-nodes")
    own = written(sketched.select("doc_id", "n", "digest", "uid"), "near-own")
    remove_written(sketched)
    roots = links(docs, nodes, n, percent)
    rep = F.col("least.doc_id")
    component = classes.join(roots, rep == roots["id"], "left").select("digest", "rows", F.coalesce("root", rep).alias("component_id"))
    found = joined_spread(own.where(some), written(component, "near-components"), ("digest",), F.col("uid")).select("doc_id", "n", "component_id")
    rest = own.where(f"NOT ({some})").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.union(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
