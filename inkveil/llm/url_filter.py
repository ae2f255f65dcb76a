"""URL verdicts: rules of hosts and path beginnings, then a logistic regression on hashed character n-grams.

Everything is DataFrame expressions. The labelled URLs (at most `MAX_LABELLED`) become one row, in which gradient
steps are a fold over arrays: a step takes the residual of each URL and, by an inverted list of each bucket, that
bucket's slope. The weights, `BUCKETS` + 1 numbers, come back as a literal array that scores all URLs where they
are read, without a shuffle.

Cases: a null URL or one without "://" has an empty host and path; no rule fits it and the method judges it. Equal
URLs have equal verdicts. Long URLs are read whole. Without labelled URLs, or with labels of one kind, the weights say what
the labels say (none: allow). An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
#: Log odds from which a URL is blocked.
THRESHOLD = 0.2
MAX_LABELLED, STEPS, RATE, RIDGE = 2000, 300, 6.0, 0.0002
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A small table of labelled URLs. All hosts are made up.
BLOCKED = """
    http://ads.clickfarm.example/banner/300x250?id=9
    http://track.pixelcount.example/collect?uid=77
    https://casino-royal-bonus.example/slots/free-spins
    https://poker-win-cash.example/jackpot/today
    http://cheap-pills-online.example/viagra/order
    http://hot-singles-nearby.example/adult/chat
    http://xxx-video-free.example/porn/watch/12
    https://adult-cams-live.example/sex/room/4
    http://free-download-crack.example/keygen/serial
    http://warez-torrent.example/cracked/software.exe
    https://secure-login-verify.example/account/update/password
    https://bank-confirm-login.example/signin/verify.php
    http://win-free-iphone.example/prize/claim-now
    http://lottery-winner.example/claim/prize/88
    http://popunder.adnetwork.example/click?aff=31
    http://affiliate-offers.example/aff/redirect?offer=5
    https://payday-loans-fast.example/loan/apply-now
    https://crypto-double-fast.example/invest/bonus
    http://replica-watches-shop.example/rolex/cheap
    http://weight-loss-miracle.example/buy-now/pills
    http://spam-seo-links.example/tag/casino/page/9
    http://linkfarm.example/buy/backlinks/cheap
    http://doorway.example/search/cheap-viagra-online
    http://adserver.mediabuy.example/ad/pop/55
    https://bet365-mirror.example/sport/bets/live
    http://nude-pics.example/gallery/xxx/3
    http://escort-guide.example/adult/city/7
    http://fake-antivirus.example/download/setup.exe
    http://tracker.stats.example/pixel.gif
    http://sexshop.example/toys/adult/sale
    http://casino-club.example.com/en/2201
    https://www.lucky-casino.example.net/de/118?page=2
    http://m.bet-now.example.org/es/7121.html
    https://free-bets-daily.example.com/fr/4410
    http://ads-delivery.example.net/en/998/
    https://blog.track-clicks.example.org/en/6612#top
    http://cheap-meds.example.com/fr/3108
    https://www.pills-shop.example.org/de/5150.html
    http://adult-dating.example.net/es/812
    https://xxx-adult.example.org/en/7340?utm_source=feed
    http://spam-links.example.com/en/1290
    https://m.link-farm.example.net/fr/2894/
    http://win-casino-big.example.org/en/455
    https://free-porn.example.com/de/9031
    http://track-ads.example.net/es/6007
    https://spam-mill.example.org/fr/140.html
    http://www.cheap-viagra.example.com/en/3377
    https://bets-free.example.net/de/2712#top
    https://blog.adult-stories.example.net/en/5531
    http://blog.adult-xx.example.org/en/818
""".split()  # fmt: skip
ALLOWED = """
    https://www.university.example/physics/lectures/mechanics
    https://library.university.example/catalog/history/books
    https://encyclopedia.example/article/photosynthesis
    https://en.encyclopedia.example/article/french_revolution
    https://docs.software.example/guide/install/linux
    https://docs.software.example/reference/functions/strings
    https://news.daily.example/world/2021/elections
    https://news.daily.example/science/climate/report
    https://www.government.example/health/services/vaccines
    https://statistics.government.example/census/tables
    https://museum.example/exhibitions/renaissance/painting
    https://journal.example/articles/biology/2019/cells
    https://recipes.kitchen.example/soup/lentil
    https://blog.gardening.example/2020/05/tomatoes
    https://forum.programming.example/questions/arrays/sort
    https://school.example/grade5/math/fractions
    https://weather.example/forecast/berlin
    https://maps.example/places/rivers/danube
    https://archive.example/newspapers/1911/march
    https://hospital.example/patients/visiting/hours
    https://travel.example/guide/norway/fjords
    https://www.court.example/opinions/2018/contract
    https://dictionary.example/define/serendipity
    https://open-textbook.example/chemistry/chapter/3
    https://astronomy.example/planets/saturn/rings
    https://parliament.example/debates/education
    https://linguistics.example/grammar/verbs
    https://cycling-club.example/routes/alps
    https://orchestra.example/concerts/season
    https://standards.example/networking/protocols
    http://nordwind.example.com/en/1182
    https://www.lumera.example.net/de/220?page=3
    http://m.torandel.example.org/es/5304.html
    https://blog.sirentha.example.com/fr/4471
    http://hollerin.example.net/en/902/
    https://blog.thorvane.example.org/en/6318#top
    http://ennerton.example.com/fr/3090
    https://www.kithand.example.org/de/5177.html
    http://marrowen.example.net/es/841
    https://inlandre.example.org/en/7092?utm_source=feed
    http://ostering.example.com/en/1263
    https://m.wherhan.example.net/fr/2840/
    http://thelane.example.org/en/471
    https://blog.edmoren.example.com/de/9105
    http://santhees.example.net/es/6044
    https://tionaire.example.org/fr/129.html
    http://www.herthone.example.com/en/3351
    https://ableston.example.net/de/2750#top
""".split()  # fmt: skip


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and blocked (0 or 1)."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, blocked int")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path, each told apart, digits of the path alike; always one at least."""

    def grams(kind: str, text: Column, n: int) -> Column:
        letters = F.split(F.concat(F.lit("^^"), text, F.lit("$$")), "")
        places = F.sequence(F.lit(0), F.size(letters) - n)
        return F.transform(places, lambda k: F.crc32(F.concat(F.lit(kind), *[F.get(letters, k + j) for j in range(n)]).cast("binary")) % BUCKETS)

    return F.array_distinct(F.concat(*[grams(f"{kind}{n}", text, n) for kind, text in (("h", host), ("p", F.translate(path, "123456789", "000000000"))) for n in SIZES])).cast("array<int>")


def train(labelled: DataFrame) -> list[float]:
    """The weight of each bucket and, last, the intercept."""
    url = F.col("url")
    small = labelled.where("blocked IS NOT NULL").select("url", F.col("blocked").cast("int").alias("y")).orderBy(F.xxhash64("url"), "url", "y").limit(MAX_LABELLED)
    # At most MAX_LABELLED rows, so one window over all of them is bounded.
    rows = small.select((F.row_number().over(W.Window.orderBy("url", "y")) - 1).alias("row"), "y", features(host_of(url), path_of(url)).alias("f"))
    # Buckets that occur are numbered; the rest keep a weight of 0. As the labelled URLs, they are bounded.
    held = rows.select("row", "y", F.explode("f").alias("bucket")).withColumn("at", F.dense_rank().over(W.Window.orderBy("bucket")) - 1)
    urls = held.groupBy("row", "y").agg(F.sort_array(F.collect_list("at")).alias("f")).agg(F.sort_array(F.collect_list(F.struct("row", "y", "f"))).alias("urls"))
    lists = held.groupBy("at", "bucket").agg(F.sort_array(F.collect_list("row")).alias("rows")).agg(F.sort_array(F.collect_list(F.struct("at", "bucket", "rows"))).alias("x"))
    # Both sides are one row.
    one = urls.join(lists.select(F.col("x.rows").alias("lists"), F.col("x.bucket").alias("buckets")), F.lit(True))
    intercept = F.size("lists")

    def let(value: Column, use) -> Column:
        """use(value), with value computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def odds(w: Column, u: Column) -> Column:
        return F.get(w, intercept) + F.aggregate(u["f"], F.lit(0.0), lambda total, j: total + F.get(w, j)) / F.sqrt(F.size(u["f"]))

    def step(state: Column, _: Column) -> Column:
        return let(F.transform("urls", lambda u: u["y"] - 1 / (1 + F.exp(-odds(state, u)))), lambda left: moved(state, left))

    def moved(state: Column, left: Column) -> Column:
        slope = lambda rows: F.aggregate(rows, F.lit(0.0), lambda total, k: total + F.get(left, k) / F.sqrt(F.size(F.get(F.col("urls"), k)["f"])))
        n = F.size("urls")
        weights = F.zip_with(F.slice(state, F.lit(1), intercept), "lists", lambda w, rows: w + RATE * (slope(rows) / n - RIDGE * w))
        return F.concat(weights, F.array(F.get(state, intercept) + RATE * F.aggregate(left, F.lit(0.0), lambda total, x: total + x) / n))

    zeros = F.array_repeat(F.lit(0.0), intercept + 1)
    found = one.where(intercept > 0).select("buckets", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zeros, step).alias("w")).first()
    weights = [0.0] * BUCKETS + [found.w[-1] if found else -1.0]
    for bucket, w in zip(found.buckets if found else [], found.w if found else [], strict=False):
        weights[bucket] = w
    return weights


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; rules: (verdict, host and path)."""
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.translate(str.maketrans(UPPER, LOWER)), []).append((rule, slash + rest, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,path:string,verdict:string>")
    entry = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("path"), F.lit(r[2]).alias("verdict"))
    known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))])
    # The host's last labels, as many as rules have; a host of fewer is its own end.
    most = max(h.count(".") for h in by_host) + 1
    ends = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, most + 1)]))
    fits = F.flatten(F.transform(ends, lambda h: F.filter(F.coalesce(F.element_at(known, h), F.array().cast("array<struct<rule:string,path:string,verdict:string>>")), lambda r: F.startswith(path, r["path"]))))
    return F.get(F.sort_array(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r.alias("r"))), asc=False), F.lit(0))["r"]


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep, host, path, rule, odds (log odds of blocking) and verdict (allow or block)."""
    weights = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    url = F.col("url").cast("string")
    own = pages.select(*keep, host_of(url).alias("_host"), path_of(url).alias("_path"))
    found = own.withColumn("_rule", matched_rule(F.col("_host"), F.col("_path"), rules)).withColumn("_f", features(F.col("_host"), F.col("_path")))
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
    odds = F.lit(weights[-1]) + F.aggregate("_f", F.lit(0.0), lambda total, j: total + F.get(w, j)) / F.sqrt(F.size("_f"))
    found = found.withColumn("_odds", odds)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_odds") > threshold, "block").otherwise("allow"))
    return found.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.col("_odds").alias("odds"), verdict.alias("verdict"))
