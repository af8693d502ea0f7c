"""URL filters: rules, and logistic regression on hashed character n-grams of host and path, with DataFrame functions only.

The model is fitted by Spark's LogisticRegression on a small labelled table of urls (a parameter; LABELLED by default)
and judges every url that no rule fits. An n-gram is hashed with its part's name, so that host and path have their own
features; a feature counts a gram once for each place. Scoring is one expression over the fitted weights, no shuffle.

Cases: a null url, or one without `://`, has an empty host and path, no rule fits, and the model's intercept decides
alone. Of fitting rules the longest wins, of equally long ones the first by name. Only A-Z of the host are lower-cased.
Repeated rows give repeated rows, an empty table none. Other columns are not looked at and stay, but for those named as
what is added. Without labelled urls of both kinds all is allowed.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import fresh, literal_rows, own_columns, table

#: What judge() adds; columns of these names, in whatever case, give way.
ADDED = ("host", "path", "rule", "verdict", "block_score")

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The labelled urls: one by one, ours. Those to be blocked, and those to be allowed.
BLOCKED = """
http://ads.example.com/en/290
https://adserver.shopnet.example.net/fr/310
https://track.mailing.example.com/en/407
http://pixel.metrics.example.net/en/11
https://www.popunder.example.org/en/1702.html
http://www.adclick-exchange.example.com/redirect/882
https://banners.partner.example.net/de/72890.html
https://m.analytics-beacon.example.com/es/812
http://affiliate.deals.example.org/out/5521
https://tracking.newsletter.example.net/u/unsubscribe-confirm
http://m.casino-royal.example.com/en/18
https://www.pokerroom.example.net/de/4410
https://blog.bet365bonus.example.com/en/926
http://jackpot-city.example.org/es/5013/
https://online-bookmaker.example.net/en/3021.html
https://luckyslots.example.com/es/77
http://m.blackjack-vip.example.com/en/287
https://www.lottery-winner.example.net/fr/3348
http://xxxvideos.example.com/en/9918
https://adult-cams.example.net/de/803?page=2
http://m.hotsexchat.example.org/de/55/
https://blog.porn-gallery.example.com/fr/1288
http://www.nude-pics.example.net/es/62
https://www.escorts-tonight.example.com/en/9
http://milfdating.example.org/en/1755
https://erotic-stories.example.net/story/44
http://www.cheap-viagra.example.com/en/6204
https://pharmacy-pills.example.net/fr/4093
http://weightloss-miracle.example.org/free-trial
https://m.buy-cialis.example.com/en/71.html
http://replica-watches.example.net/fr/71.html
https://fake-handbags.example.com/de/2630
https://www.grand-casino-online.example.org/en/3107
https://payday-loans-fast.example.net/es/640/
http://quick-cash.example.com/en/5512/
https://blog.bitcoin-doubler.example.org/es/908
http://forex-signals-profit.example.net/vip
https://crypto-giveaway.example.com/en/34
http://www.make-money-fast.example.org/fr/6620
https://free-iphone-winner.example.net/survey/prize
http://secure-login-verify.example.com/account/update
https://paypa1-support.example.net/confirm-password
http://bank-alert-verify.example.org/en/1147
https://appleid-locked.example.com/unlock
http://download-crack.example.net/de/78.html
https://warez-files.example.org/de/340?page=2
http://m.torrent-movies.example.com/es/2081
https://free-streaming-hd.example.net/watch-now
http://malware-drop.example.org/de/2009
https://exploit-kit.example.com/en/640
http://virus-cleaner-pro.example.net/scan/now.exe
https://toolbar-install.example.org/setup.exe
http://stats.clickfraud.example.com/en/1?x=1
https://doubleads.example.net/frame/ad_slot_4
http://media.example.com/adframe/top-banner.html
https://www.portal.example.org/sponsored/click-here
http://news.example.net/ads/popup-offer.html
https://img.example.com/tracking/pixel.gif
http://sub.example.org/casino/free-bonus
https://home.example.net/xxx/hardcore
http://shop.example.com/viagra-cialis/discount
https://files.example.org/crack/serial-keygen.zip
http://go.example.net/redirect/affiliate/offer
https://web.example.com/poker/tournament-bonus
http://www.city.example.org/payday-loan/instant
https://info.example.net/win-prize/iphone
http://static.example.com/advert/interstitial.js
https://m.example.org/sexcam/live-girls
http://en.example.net/betting/odds/tips
https://forum.example.com/replica-watches/cheap
http://mail.example.org/phishing/verify-account
https://x.example.net/torrent/download/full-movie
http://de.example.com/gluecksspiel/kasino-bonus
https://fr.example.org/jeux-argent/casino-gratuit
http://es.example.net/apuestas/casino-gratis
https://spam-mailer.example.com/fr/15/
http://seo-backlinks.example.net/en/8204
https://blog.clickbait-viral.example.org/en/4477
http://survey-rewards.example.com/es/506
https://www.dating-singles.example.net/de/3917
""".split()
ALLOWED = """
https://www.cityherald.example.com/en/local/council-meets
http://news.rivertown.example.net/2021/05/flood-report.html
https://library.northfield.example.org/catalogue/item/2231
http://www.museum-of-glass.example.org/exhibits/current
https://docs.compilerkit.example.net/guide/getting-started
http://blog.gardenpath.example.com/tomatoes-in-spring
https://www.weather-centre.example.net/forecast/week
http://university.example.org/physics/lectures/3
https://journal.marine-biology.example.com/volume/12/article/4
http://en.encyclopedia.example.org/wiki/Volcano
https://recipes.homekitchen.example.net/soup/lentil
http://www.chess-club.example.com/rules/openings
https://parliament.example.org/debates/2019/minutes
http://school.hillside.example.net/calendar/term2
https://travelnotes.example.com/en/lisbon/tram-28
http://www.railway-history.example.org/lines/branch
https://health.cityclinic.example.net/vaccination/hours
http://forum.woodworkers.example.com/thread/8821
https://openmaps.example.org/edit/help
http://www.astronomy-society.example.net/observations/moon
https://music-archive.example.com/scores/bach
http://theatre.example.org/programme/autumn
https://www.bakery-lane.example.net/about
http://poems.example.com/de/rilke/herbst
https://farmers-market.example.org/sellers/list
http://statistics.example.net/population/2020.html
https://code.opentools.example.com/project/readme
http://www.football-league.example.org/results/week7
https://bird-watching.example.net/species/heron
http://grammar.example.com/fr/verbes/irreguliers
https://law-review.example.org/cases/summary/88
http://www.bookshop.example.net/authors/k
https://childrens-stories.example.com/en/the-lost-boat
http://mountain-rescue.example.org/training/dates
https://science-daily.example.net/plants/photosynthesis
http://gallery.watercolour.example.com/works/17
https://www.cycling-paths.example.org/routes/coast
http://radio.example.net/programmes/evening-concert
https://philosophy.example.com/essays/on-time
http://www.town-archive.example.org/records/1890
https://de.lexikon.example.net/artikel/Fluss
http://www.gemeinde.example.com/de/rathaus/termine
https://zeitung.example.org/de/kultur/5521
http://www.ecole.example.net/fr/cantine/menus
https://bibliotheque.example.com/fr/livres/nouveautes
http://www.ayuntamiento.example.org/es/noticias/412
https://revista.example.net/es/historia/siglo-xix
http://cooking.example.com/index.html
https://www.mathnotes.example.org/algebra/groups
http://help.editor.example.net/faq/saving-files
https://m.observer.example.com/en/1204
http://www.harbour.example.net/en/3391.html
https://blog.example.org/de/7720/
http://site.example.com/fr/918
https://www.example.net/en/56?page=2
http://mobile.example.org/es/4410.html
https://thehill.example.com/en/2231
http://www.stone.example.net/de/118
https://reader.example.org/en/9012/
http://blog.lantern.example.com/fr/3305
https://www.meadow.example.net/es/77
http://m.orchard.example.com/de/6120.html
https://notes.example.net/en/8
http://harvest.example.com/en/5150?ref=feed
https://www.willow.example.org/fr/2718
http://blog.pebble.example.net/de/314/
https://www.thunder.example.com/en/159.html
http://m.anchor.example.net/fr/26
https://island.example.org/es/535
http://blog.then.example.com/en/8979
https://www.other.example.net/en/3238/
http://m.nation.example.org/de/4626
https://station.example.com/en/4338.html
http://www.motion.example.net/fr/3279
https://blog.gathering.example.org/es/5028
http://m.strand.example.com/en/841
https://thistle.example.net/de/9716?page=3
http://www.under.example.org/en/9399
https://shore.example.com/es/3751/
http://letters.example.net/en/582
http://www.lantern-press.example.com/en/1180
https://m.cornfield.example.net/de/2290.html
http://blog.seaside.example.org/fr/4471/
https://winter-choir.example.com/es/618
http://www.copperkettle.example.net/en/7002?page=1
https://quiet-lake.example.org/de/33
http://m.threshold.example.com/en/9145
https://blog.northern.example.net/en/2617.html
http://thatched.example.com/fr/805
https://www.anthem.example.org/es/1294/
http://heritage.example.net/en/416
https://m.hearth.example.com/de/5837
http://reading-room.example.org/en/7719
https://www.intention.example.net/fr/2043
http://blog.ribbon.example.com/en/690.html
https://tension.example.org/de/8350
http://m.edition.example.net/es/71
https://www.stable.example.com/en/3962?ref=home
http://ensemble.example.org/fr/5508/
https://blog.noble.example.net/en/1427
http://www.hand-tools.example.com/de/264
https://m.wander.example.org/en/6081.html
http://nearby.example.com/es/3315
https://their-garden.example.net/en/948
http://blog.ounce.example.org/de/7733
https://www.trend.example.com/fr/129
http://whether.example.net/en/5270/
https://m.ringing.example.com/en/86
http://ending.example.org/es/4604
https://www.thorn.example.net/de/1951.html
http://bread-and-salt.example.com/en/38
https://blog.then-and-now.example.org/en/6427
http://m.hedgerow.example.net/fr/7180
https://www.listed.example.com/en/2336
http://outing.example.org/en/903?page=4
https://entire.example.com/de/5119
http://www.wheat.example.net/en/4082
https://blog.arose.example.com/es/2765/
http://m.stones.example.org/en/157
https://eastern.example.net/en/8846
""".split()


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled urls: url, label (1: block)."""
    return literal_rows(spark, {"url": BLOCKED + ALLOWED, "label": [1] * len(BLOCKED) + [0] * len(ALLOWED)})


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    found = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def hashed_grams(host_col: Column, path_col: Column, sizes: tuple[int, ...], features: int) -> Column:
    """Numbers of the features of all n-grams of host and path, with all digits alike."""

    def grams(name: str, text: Column, n: int) -> Column:
        framed = F.concat(F.lit("\x02"), F.translate(text, "123456789", "000000000"), F.lit("\x03"))
        places = F.when(F.char_length(framed) >= n, F.sequence(F.lit(1), F.char_length(framed) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(framed, i, n)), F.lit(features)).cast("int"))

    return F.concat(*[grams(name, text, n) for name, text in (("host", host_col), ("path", path_col)) for n in sizes])


def fit(urls: DataFrame, sizes: tuple[int, ...] = (3, 4), features: int = 4096, strength: float = 0.003, most: int = 100_000) -> tuple[list[float], float]:
    """Weights and intercept from urls (url, label). most: the largest labelled table that is taken; it is a small table by contract."""
    rows = urls.where(F.col("url").isNotNull() & F.col("label").isin(0, 1))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return [0.0] * features, -1.0
    if sum(counts.values()) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    grams = hashed_grams(host(F.col("url")), path(F.col("url")), sizes, features)
    data = rows.select(F.col("label").cast("double").alias("label"), grams.cast("array<string>").alias("grams")).coalesce(1)
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(features)], "grams", "features")
    data = counter.transform(data).cache()
    model = LogisticRegression(maxIter=60, regParam=strength, standardization=False).fit(data)
    data.unpersist()
    return [float(x) for x in model.coefficients], float(model.intercept)


def numbers(values: list[float]) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def rule_for(host_col: Column, path_col: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct (length, rule, verdict); null if none does."""
    fits = [F.when(((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(p)), F.struct(F.lit(-len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_min(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, urls: DataFrame | None = None, sizes: tuple[int, ...] = (3, 4), features: int = 4096) -> DataFrame:
    """pages with host, path, rule, verdict and block_score (the model's) behind their columns."""
    weights, intercept = fit(urls if urls is not None else labelled(pages.sparkSession), sizes, features)
    weight = numbers(weights)
    of_host, of_path, rule, score = (fresh(pages, c) for c in ("of_host", "of_path", "its_rule", "its_score"))
    out = pages.withColumns({of_host: host(F.col(url_col)), of_path: path(F.col(url_col))})
    out = out.withColumn(rule, rule_for(F.col(of_host), F.col(of_path), rules))
    total = F.aggregate(hashed_grams(F.col(of_host), F.col(of_path), sizes, features), F.lit(intercept), lambda a, i: a + F.get(weight, i))
    out = out.withColumn(score, 1 / (1 + F.exp(-total)))
    verdict = F.coalesce(F.col(rule)["verdict"], F.when(F.col(score) > 0.5, "block").otherwise("allow"))
    return out.select(*own_columns(pages, ADDED), F.col(of_host).alias("host"), F.col(of_path).alias("path"), F.col(rule)["rule"].alias("rule"), verdict.alias("verdict"), F.col(score).alias("block_score"))


def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
