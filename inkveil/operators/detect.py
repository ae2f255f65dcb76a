"""All detectors over pages, each page with the profile of its subject.

All are found in Arrow batches: names and addresses by a page's words, which match under damage, and all else by its text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import dates, fixed
from inkveil.functions.addresses import address_models
from inkveil.functions.arrow import sliced
from inkveil.functions.names import name_model
from inkveil.functions.scan import Page
from inkveil.functions.words import Words
from inkveil.operators import spans

PROFILE = ("full_name", "variants", "initials", "dob", "addresses", "phones", "other_names", "other_addresses", "other_phones")
#: The order of detectors decides ties between equal spans.
DETECTORS = ("names", "other_names", "ssn", "dl", "ncic", "account", "dob", "addresses", "other_addresses", "phones", "other_phones")
#: Two-digit years after this one's are of the last century.
AS_OF_YEAR = 2026
#: A detector's hits on a page have numbers from its own multiple of this.
ORD = 1 << 20
#: Partitions for each core that pages of fewer files are spread over.
SPREAD = 4

BORN = "struct<y:int,m:int,d:int>"
HITS = "array<struct<cat:string,start:int,end:int,ord:int,initials:string>>"
MERGED = "array<struct<cat:string,start:int,end:int,initials:string>>"
_MERGED = pa.struct([("cat", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("initials", pa.string())])
_HIT = pa.struct([("cat", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ord", pa.int32()), ("initials", pa.string())])
#: Detectors that read a page's words; the others read its text.
_IN_WORDS = frozenset({"names", "other_names", "addresses", "other_addresses"})
_ORDER = {name: n for n, name in enumerate(DETECTORS)}


def with_profiles(pages: DataFrame, subjects: DataFrame, keys: tuple[str, ...], on: str | None, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """pages with the columns of PROFILE and `born`, the birth date read, as one struct `_who`; null where a page has no subject.

    Profiles too large to broadcast meet the pages in one shuffle, over more partitions than cores; a subject's pages lie in SPREAD of them at most."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    kinds = dict(subjects.dtypes)
    each = [(clean(F.col(c)) if kinds[c].startswith("array") else F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in PROFILE]
    each.append(dates.entered_date(F.trim(F.coalesce("dob", F.lit(""))), as_of_year).cast(BORN).alias("born"))
    if on:
        own = subjects.select(F.col("subject_id").alias("_subject"), F.struct(*each).alias("_who"))
        if pages.isStreaming or not _too_large(own):
            pages = spread(pages, keys, on)
            return pages.join(own, pages[on] == F.col("_subject"), "left").drop("_subject")
        spark = pages.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD * spark.sparkContext.defaultParallelism)
        places = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SPREAD)])).alias("_place_of")
        own = own.select("*", places).repartition(n, "_subject", "_place_of")
        pages = pages.withColumn("_place", _place(keys)).repartition(n, on, "_place")
        return pages.join(own, (pages[on] == F.col("_subject")) & (F.col("_place") == F.col("_place_of")), "left").drop("_subject", "_place", "_place_of")
    pages = spread(pages, keys, on)
    own = subjects.select(*each).limit(2).collect()
    if len(own) != 1:
        raise ValueError(f"all pages have one subject unless `on` tells theirs; there are {len(own) or 'none'}{' or more' if own else ''}")
    values = [F.lit(list(v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in own[0][:-1]]
    day = own[0]["born"]
    born = F.struct(*[F.lit(day[c]).cast("int").alias(c) for c in ("y", "m", "d")]) if day else F.lit(None)
    return pages.withColumn("_who", F.struct(*[v.alias(c) for v, c in zip(values, PROFILE, strict=True)], born.cast(BORN).alias("born")))


def _too_large(table: DataFrame) -> bool:
    """Is a table larger, by Spark's estimate, than what it broadcasts?"""
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > most


def _place(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SPREAD))


def spread(pages: DataFrame, keys: tuple[str, ...], on: str | None) -> DataFrame:
    """pages over enough partitions for all cores, if they come in fewer files than that; a subject's pages in a few of them."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.isStreaming or len(pages.inputFiles()) >= cores:
        return pages
    return pages.repartition(SPREAD * cores, *([F.col(on), _place(keys)] if on else map(F.col, keys)))


def _profiles(who: pa.StructArray) -> list[tuple | None]:
    """Each page's profile as the values of PROFILE and the birth date's year, month and day; None where it has none."""
    own = dict(zip(who.type.names, who.flatten(), strict=True))
    born = dict(zip(own["born"].type.names, own["born"].flatten(), strict=True))
    rows = zip(*(c.to_pylist() for c in (*(own[c] for c in PROFILE), *(born[c] for c in ("y", "m", "d")))), strict=True)
    return [row if known else None for row, known in zip(rows, who.is_valid().to_pylist(), strict=True)]


def _page_hits(text: str, who: tuple | None, only: frozenset, first_names: frozenset, everyday: frozenset) -> tuple[list[tuple], list[str]]:
    """(category, places, detector's number, initials) of the detectors that find any, and the words in names that match but not exactly."""
    full_name, variants, initials, _, addresses, phones, other_names, other_addresses, other_phones, *born = who or ("", (), "", "", (), (), (), (), (), None, None, None)
    found, close = [], []

    def add(name: str, cat: str, places: list[tuple[int, int]], initials: str | None = None) -> None:
        if places:
            found.append((cat, places, _ORDER[name], initials))

    words = Words(text) if who and not _IN_WORDS.isdisjoint(only) else None
    if words and "names" in only:
        places, close = name_model(tuple(x for x in (full_name, *variants) if x), first_names, everyday).find(words)
        add("names", "name", places, initials.upper())
    if words and "other_names" in only and other_names:
        add("other_names", "other", name_model(tuple(other_names), first_names, everyday).find(words)[0])
    for name, cat, entries in (("addresses", "address", addresses), ("other_addresses", "other", other_addresses)) if words else ():
        if name in only and entries:
            add(name, cat, [s for model in address_models(tuple(entries)) for s in model.find(words)])
    if only <= _IN_WORDS:
        return found, close
    page = Page(text)
    if "ssn" in only:
        add("ssn", "ssn", page.ssn())
    for name in ("dl", "ncic"):
        if name in only:
            add(name, name, page.labelled(name) + page.bare(name))
    if "account" in only:
        add("account", "account", page.labelled("account"))
    if "dob" in only:
        add("dob", "dob", page.births(None if None in born else tuple(born)))
    for name, cat, entries in (("phones", "phone", phones), ("other_phones", "other", other_phones)):
        if name in only and entries:
            add(name, cat, page.phones(entries))
    return found, close


def _listed(kind: pa.StructType, until: list[int], values: list[tuple]) -> pa.ListArray:
    """Lists of structs, each up to its place in all values."""
    columns = [pa.array(c, f.type) for c, f in zip(zip(*values, strict=True) if values else [()] * kind.num_fields, kind, strict=True)]
    return pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def _found(rows: DataFrame, only: tuple[str, ...], first_names: frozenset, everyday: frozenset, rewrite: bool) -> DataFrame:
    """rows with hits and close and, to rewrite, merged and redacted, without profiles."""
    kept, wanted = [c for c in rows.columns if c != "_who"], frozenset(only)

    def run(batches):
        for batch in sliced(batches, "text"):
            hits, merged, close, texts, until, merged_until = [], [], [], [], [0], [0]
            for text, who in zip(batch.column("text").to_pylist(), _profiles(batch.column("_who")), strict=True):
                found, forms = _page_hits((text or "") + "\n", who, wanted, first_names, everyday)
                own = [(cat, a, b, k, initials) for cat, places, n, initials in found for k, (a, b) in enumerate(places, n * ORD) if b > a]
                hits += own
                until.append(len(hits))
                close.append(forms)
                if rewrite:
                    whole = spans.merged_hits(own)
                    merged += whole
                    merged_until.append(len(merged))
                    texts.append(spans.redacted_text(text or "", whole))
            made = {"hits": _listed(_HIT, until, hits), "close": pa.array(close, pa.list_(pa.string()))}
            if rewrite:
                made |= {"merged": _listed(_MERGED, merged_until, merged), "redacted": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.values()], [*kept, *made])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*kept).dtypes)
    return rows.select(*kept, "_who").mapInArrow(run, f"{schema}, hits {HITS}, close array<string>{f', merged {MERGED}, redacted string' if rewrite else ''}")


def detect(
    pages: DataFrame, subjects: DataFrame, keys: tuple[str, ...], on: str | None = None, only: tuple[str, ...] = DETECTORS, as_of_year: int = AS_OF_YEAR,
    first_names: frozenset = fixed.FIRST_NAMES, everyday: frozenset = fixed.EVERYDAY, rewrite: bool = False,
) -> DataFrame:
    """keys, text, hits (an array of HIT) and close (an array of words) for each page.

    rewrite: with merged (spans.merged() of the hits) and redacted (spans.redacted() of the text) too.
    on: the column by which a page finds its subject; None: subjects has one row, for all pages. One pass over the
    pages; the profiles come along by the join, which Spark broadcasts if they are few.
    """
    own = dict.fromkeys([*keys, "text"])
    rows = with_profiles(pages.select(*(own | dict.fromkeys([on] if on else []))), subjects, keys, on, as_of_year).select(*own, "_who")
    return _found(rows, only, first_names, everyday, rewrite).select(*own, "hits", "close", *(("merged", "redacted") if rewrite else ()))
