"""Boxes on pages: from characters to padded boxes, duplicate layers, boxes on one spot. Rectangles are [x0, y0, x1, y1], y downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECT, RECTS = "array<double>", "array<array<double>>"
#: Padding in parts of the glyphs' height, and at least: along the text, and across it, where neighbouring lines are near.
ALONG, LEAST_ALONG, ACROSS, LEAST_ACROSS = 0.2, 1.0, 0.04, 0.3
#: Glyph height where no character of a span has a place.
NO_HEIGHT = 10.0
#: Parts of the smaller box's height, and of its area, that boxes on one spot share.
SAME_LINE, SAME_AREA = 0.6, 0.5
#: Height of plain text's characters.
PLAIN_HEIGHT = 12.0


def at(a: Column, k: int) -> Column:
    return F.get(a, F.lit(k))


def side(a: Column, b: Column, k: int) -> Column:
    return F.least(at(a, k + 2), at(b, k + 2)) - F.greatest(at(a, k), at(b, k))


def extent(a: Column, k: int) -> Column:
    return at(a, k + 2) - at(a, k)


def intersects(a: Column, b: Column) -> Column:
    return (side(a, b, 0) > 0) & (side(a, b, 1) > 0)


def same_spot(a: Column, b: Column) -> Column:
    """Do boxes stand on one line of text and cover each other by half?"""
    area = lambda r: extent(r, 0) * extent(r, 1)
    covered = F.when(intersects(a, b), side(a, b, 0) * side(a, b, 1) / F.greatest(F.lit(1e-6), F.least(area(a), area(b)))).otherwise(0.0)
    return (side(a, b, 1) >= SAME_LINE * F.least(extent(a, 1), extent(b, 1))) & (covered >= SAME_AREA)


def around(a: Column, b: Column) -> Column:
    return F.array(F.least(at(a, 0), at(b, 0)), F.least(at(a, 1), at(b, 1)), F.greatest(at(a, 2), at(b, 2)), F.greatest(at(a, 3), at(b, 3)))


def padded(rect: Column, height: Column, horizontal: Column) -> Column:
    along, across = F.greatest(F.lit(LEAST_ALONG), ALONG * height), F.greatest(F.lit(LEAST_ACROSS), ACROSS * height)
    x, y = F.when(horizontal, along).otherwise(across), F.when(horizontal, across).otherwise(along)
    return F.array(at(rect, 0) - x, at(rect, 1) - y, at(rect, 2) + x, at(rect, 3) + y)


def quad_bounds(quad: Column) -> Column:
    """The box around a character's corners (upper left, upper right, lower left, lower right)."""
    xs, ys = F.array(*[at(quad, k) for k in (0, 2, 4, 6)]), F.array(*[at(quad, k) for k in (1, 3, 5, 7)])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def span_bounds(quads: Column, start: Column, end: Column) -> Column:
    """The box around characters [start, end), those without a place aside; null if none has one."""
    placed = F.transform(F.filter(F.slice(quads, start + 1, F.greatest(end - start, F.lit(0))), lambda q: q.isNotNull()), quad_bounds)
    return F.aggregate(placed, F.lit(None).cast(RECT), lambda a, r: F.when(a.isNull(), r).otherwise(around(a, r)))


def _trimmed(text: Column, line: Column, start: Column, end: Column) -> Column:
    """The part of a span on a line, without white space at its ends, as (a, b)."""
    first, last = F.greatest(start, line["start"]), F.least(end, line["end"])
    s = F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))
    before, behind = (F.length(F.regexp_extract(s, p, 0)) for p in (r"^[\s\xA0]+", r"[\s\xA0]+\z"))
    return F.struct((first + before).alias("a"), F.greatest(last - behind, first + before).alias("b"))


def quad_rects(text: Column, lines: Column, quads: Column, start: Column, end: Column) -> Column:
    """A padded box on each line that a span touches, by the places of its characters (null for those without one)."""
    parts = F.filter(F.transform(F.filter(lines, lambda x: (x["start"] < end) & (x["end"] > start)), lambda x: _trimmed(text, x, start, end)), lambda p: p["a"] < p["b"])

    def box(p: Column) -> Column:
        own = F.filter(F.slice(quads, p["a"] + 1, p["b"] - p["a"]), lambda q: q.isNotNull())
        heights = F.transform(own, lambda q: F.hypot(at(q, 4) - at(q, 0), at(q, 5) - at(q, 1)))
        mean = F.when(F.size(own) > 0, F.aggregate(heights, F.lit(0.0), lambda a, h: a + h) / F.size(own)).otherwise(NO_HEIGHT)
        first = F.get(own, F.lit(0))
        horizontal = F.abs(at(first, 2) - at(first, 0)) >= F.abs(at(first, 3) - at(first, 1))
        return padded(span_bounds(quads, p["a"], p["b"]), mean, horizontal)

    return F.filter(F.transform(parts, box), lambda r: at(r, 0).isNotNull())


def text_rects(text: Column, lines: Column, start: Column, end: Column) -> Column:
    """The same for plain text, whose characters are 6 wide and 12 high, on lines 14 apart from (20, 20)."""
    parts = F.filter(lines, lambda x: (x["start"] < end) & (x["end"] > start))
    placed = F.filter(F.transform(parts, lambda x: F.struct(x["start"].alias("at"), x["y0"].alias("y"), _trimmed(text, x, start, end).alias("p"))), lambda q: q["p"]["a"] < q["p"]["b"])
    x = lambda q, k: 20.0 + 6 * (q["p"][k] - q["at"])
    return F.transform(placed, lambda q: padded(F.array(x(q, "a"), q["y"], x(q, "b"), q["y"] + PLAIN_HEIGHT), F.lit(PLAIN_HEIGHT), F.lit(True)))


GROUPS = f"array<struct<cat:string,initials:string,rects:{RECTS}>>"
BOXES = f"array<struct<rect:{RECT},initials:string>>"


def deduped(groups: Column) -> Column:
    """Groups of (cat, initials, rects) without those whose boxes all lie on boxes of an earlier kept one of the category, which takes them over."""

    def step(kept: Column, g: Column) -> Column:
        covers = lambda o: (o["cat"] == g["cat"]) & (F.size(g["rects"]) > 0) & F.forall(g["rects"], lambda r: F.exists(o["rects"], lambda q: same_spot(r, q)))
        place = F.array_position(F.transform(kept, covers), True)
        grown = lambda o, k: F.when(k + 1 == place, F.struct(o["cat"].alias("cat"), o["initials"].alias("initials"), F.concat(o["rects"], g["rects"]).alias("rects"))).otherwise(o)
        return F.when(place > 0, F.transform(kept, grown)).otherwise(F.concat(kept, F.array(g)))

    return F.aggregate(groups, F.array().cast(GROUPS), step)


def united(boxes: Column) -> Column:
    """Boxes (rect, initials) of one kind, with initials or without, that stand on one spot as one; until none do.

    A round unites one pair, the first in order, so as many rounds as boxes are enough."""

    def once(own: Column, _: Column) -> Column:
        # For each box the number of the first later one that it's united with.
        partner = lambda b, i: F.array_position(F.transform(own, lambda c, j: (j > i) & (b["initials"].isNotNull() == c["initials"].isNotNull()) & same_spot(b["rect"], c["rect"])), True) - 1
        partners = F.transform(own, partner)
        i = F.array_position(F.transform(partners, lambda j: j >= 0), True) - 1
        j = F.get(partners, i.cast("int"))
        both = F.struct(around(F.get(own, i.cast("int"))["rect"], F.get(own, j.cast("int"))["rect"]).alias("rect"), F.get(own, i.cast("int"))["initials"].alias("initials"))
        merged = F.filter(F.transform(own, lambda b, k: F.when(k == i, both).when(k == j, F.lit(None)).otherwise(b)), lambda b: b.isNotNull())
        return F.when(i >= 0, merged).otherwise(own)

    return F.aggregate(F.transform(boxes, lambda _, k: k), boxes.cast(BOXES), once)


def page_groups(found: DataFrame, keys: tuple[str, ...], layer: str | None = None) -> DataFrame:
    """keys and groups of found (keys, merged, rects: an array of boxes for each merged span), without duplicates; pages come in several
    rows if they have several layers of text."""
    group = lambda m, r: F.struct(m["cat"].alias("cat"), F.when(m["cat"] == "name", m["initials"]).alias("initials"), r.alias("rects"))
    own = found.withColumn("_groups", F.zip_with("merged", "rects", group).cast(GROUPS))
    if layer:
        page = [k for k in keys if k != layer]
        own = own.groupBy(*page).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(layer), F.col("_groups")))), lambda x: x["_groups"])).alias("_groups"))
        return own.select(*page, deduped(F.col("_groups")).alias("groups"))
    return own.select(*keys, deduped(F.col("_groups")).alias("groups"))


def page_boxes(groups: Column) -> Column:
    """The boxes to draw for a page's groups."""
    each = F.flatten(F.transform(groups, lambda g: F.transform(g["rects"], lambda r: F.struct(r.alias("rect"), F.nullif(g["initials"], F.lit("")).alias("initials")))))
    return united(each)


def outside(rects: Column, page: Column) -> Column:
    """Four boxes around a page, a point from its edges, if any character lies beyond these by half a point; else none."""
    beyond = F.exists(rects, lambda r: (at(r, 2) < at(page, 0) + 0.5) | (at(r, 0) > at(page, 2) - 0.5) | (at(r, 3) < at(page, 1) + 0.5) | (at(r, 1) > at(page, 3) - 0.5))
    far, edge = F.lit(100000.0), lambda k: at(page, k)
    frame = F.array(
        F.array(-far, -far, far, edge(1) - 1), F.array(-far, edge(3) + 1, far, far),
        F.array(-far, edge(1) - 1, edge(0) - 1, edge(3) + 1), F.array(edge(2) + 1, edge(1) - 1, far, edge(3) + 1),
    )
    return F.when(beyond, frame).otherwise(F.array().cast(RECTS))


# Initials in a box.

#: Height of capitals in parts of the font's size; parts of a box's height and width that initials may fill, and the least size.
CAPITALS, FILL_HEIGHT, FILL_WIDTH, LEAST_SIZE = 0.716, 0.85, 0.78, 0.5


def initials_layout(rect: Column, advance: Column) -> Column:
    """(size, x, y) of initials centred in a box; advance: their width at size 1."""
    wide = F.when(F.coalesce(advance, F.lit(0.0)) > 0, advance).otherwise(1.0)
    size = F.greatest(F.lit(LEAST_SIZE), F.least(FILL_HEIGHT * extent(rect, 1), FILL_WIDTH * extent(rect, 0) / wide))
    return F.struct(size.alias("size"), (at(rect, 0) + (extent(rect, 0) - wide * size) / 2).alias("x"), (at(rect, 1) + extent(rect, 1) / 2 + CAPITALS * size / 2).alias("y"))


def short_number(value: Column) -> Column:
    """At most three decimals, without zeros at the end; 0 for what's smaller than 0.0001."""
    return F.when(F.abs(value) < 1e-4, "0").otherwise(F.regexp_replace(F.format_string("%.3f", value.cast("double")), r"\.?0+$", ""))
