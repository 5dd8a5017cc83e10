"""URL filters: rules by host and path, and a classifier for the rest, in DataFrame functions only.

The classifier is a logistic regression on hashed character n-grams of host and path, fitted by Spark ML on a small
labelled table of URLs. Rules are a short list of (verdict, host, path); the longest that fits decides.

A null URL, or one without ``://``, has an empty host and path; no rule fits it and the classifier sees two empty
strings. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)
FEATURES = 1 << 14

# the labelled table: 1 marks a URL to block
GOOD = (
    "https://www.example.com/en/about", "https://blog.example.com/fr/2021/05/notes", "https://docs.example.org/guide/start.html", "http://example.net/de/artikel/42",
    "https://m.example.net/en/742/", "https://news.example.com/world/report?id=3", "https://library.example.edu/catalog/book/17", "https://wiki.example.org/wiki/History",
    "https://museum.example.org/es/visita", "https://science.example.edu/journal/vol3/paper.pdf", "https://www.example.org/de/511#top", "http://blog.example.net/es/883?page=2",
    "https://forum.example.com/thread/88/reply", "https://recipes.example.net/fr/soupe", "https://city.example.gov/services/water", "https://school.example.edu/lessons/math",
    "https://weather.example.net/forecast/today", "https://music.example.org/artists/list", "http://garden.example.com/tips/roses", "https://travel.example.net/en/guide/coast",
    "http://ththre.example.com/fr/825?page=2&ref=x", "https://m.ththth.example.net/en/25", "https://blog.tionsh.example.net/en/27", "https://www.thernd.example.org/de/12.html",
    "http://tionsh.example.net/en/217#top", "https://blog.ththre.example.org/es/304/", "https://m.tiontion.example.com/en/99", "http://www.eronth.example.org/en/685",
    "https://ouingha.example.net/de/58", "https://m.stanre.example.org/fr/611/", "http://blog.heation.example.net/en/8.html", "https://www.orblean.example.com/de/370?utm_source=feed",
    "https://anthed.example.org/en/444", "http://m.ndreer.example.net/en/501", "https://blog.inthes.example.org/es/77", "https://erlyat.example.org/fr/930#top",
    "https://health.example.gov/advice/sleep", "https://maps.example.org/route/north", "https://code.example.com/project/readme", "https://photos.example.net/album/9",
)
BAD = (
    "http://spam-farm.example.org/en/1", "https://spam-farm.example.com/es/750?page=2", "http://spam-links.example.net/fr/9", "http://link-farm.example.org/de/buy-links",
    "http://www.spam-farm.example.net/en/88", "https://blog.spam-links.example.com/de/14", "https://m.link-farm.example.net/fr/5#top", "http://spam-pages.example.org/es/31.html",
    "https://www.farm-spam.example.net/de/405?page=2", "http://blog.spam-site.example.com/en/61/", "https://m.spam-hub.example.org/fr/17", "http://spam-farm.example.net/es/9",
    "http://casino-bonus.example.com/win/jackpot", "http://free-casino.example.net/slots", "http://cheap-pills.example.org/order/now", "http://pills-online.example.com/buy",
    "http://xxx-videos.example.net/hot", "http://adult-xxx.example.com/cam", "http://poker-bet.example.org/deposit", "http://bet-win.example.net/bonus",
    "http://fast-loan.example.com/apply/cash", "http://free-money.example.org/click/here", "http://click-ads.example.net/track?aff=1", "http://ad-tracker.example.com/popup",
    "http://crack-download.example.org/keygen.exe", "http://torrent-warez.example.net/full", "http://phish-login.example.com/verify-account", "http://malware-drop.example.org/update.exe",
    "http://seo-spam.example.net/backlinks", "http://spam-seo-farm.example.com/doorway", "http://replica-watches.example.org/cheap", "http://spam.example.net/unsubscribe",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z lower-cased, and path of a URL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def char_ngrams(host: Column, path: Column) -> Column:
    """All character n-grams of the marked host and of the path, as one array."""

    def grams(text: Column, mark: str, n: int) -> Column:
        def windows(signs: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(signs) - n, F.lit(0)))
            return F.transform(starts, lambda i: F.concat_ws("", F.lit(mark), *[F.get(signs, i + k) for k in range(n)]))

        # as a variable of the outer function the signs are split once, not for every window
        return F.get(F.transform(F.array(F.split(text, "")), windows), F.lit(0))

    marked = F.concat(F.lit("."), host, F.lit("."))
    return F.concat(*[grams(marked, "h", n) for n in SIZES], *[grams(path, "p", n) for n in SIZES])


def labelled_urls(spark: SparkSession, good: Sequence[str] = GOOD, bad: Sequence[str] = BAD) -> DataFrame:
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for y, urls in ((0.0, good), (1.0, bad)) for u in urls]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def fit(labelled: DataFrame, strength: float = 0.01, rounds: int = 60) -> PipelineModel:
    """Fit on (url, label); the table is small by contract and becomes one partition, so reruns agree."""
    host, path = parts(F.col("url"))
    rows = labelled.select("label", char_ngrams(host, path).alias("grams")).coalesce(1)
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return Pipeline(stages=[hashed, LogisticRegression(regParam=strength, maxIter=rounds)]).fit(rows)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: PipelineModel, block_from: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) per page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("grams", char_ngrams(F.col("host"), F.col("path")))
    scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    ruled = scored.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") >= block_from, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), "score", F.coalesce("found.verdict", method).alias("verdict"))
