"""URL filter: rules on hosts and paths first, then a logistic regression on hashed character n-grams.

The regression is learned from a small labelled table of URLs.  Host and path are hashed apart, so that `ads` in a host and
in a path are different features.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import map_texts, numbered_columns, read

BUCKETS = 1 << 15
SHORTEST, LONGEST = 3, 5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (url, blocked): advertising and tracking, gambling, adult and shady download sites against ordinary pages.
LABELLED = [
    ("https://ads.example.com/click?id=1", 1), ("http://adserver.shop.test/banner/728x90", 1), ("https://track.mail.test/open.gif", 1),
    ("https://m.ads-track.test/en/100", 1), ("https://pixel.tracker.test/collect", 1), ("http://www.ads-network.test/serve/ad.js", 1),
    ("https://ad.doubleserve.test/imp", 1), ("https://banner-exchange.test/show", 1), ("https://tracking.news.test/beacon", 1),
    ("http://popunder.test/ad/12", 1), ("https://best-casino.test/bonus", 1), ("https://www.casino-royal.test/slots/free-spins", 1),
    ("http://online-poker.test/bet", 1), ("https://bet365-win.test/jackpot", 1), ("http://slots.lucky.test/win-money", 1),
    ("https://xxx-videos.test/watch/1", 1), ("http://adult-cams.test/live", 1), ("https://porn.test/hd/22", 1), ("https://sex-dating.test/join", 1),
    ("http://cheap-pills.test/viagra", 1), ("http://warez-crack.test/keygen.exe", 1), ("https://free-download.test/crack/setup.exe", 1),
    ("http://torrent-movies.test/full-hd", 1), ("http://win-prize.test/claim-now", 1), ("http://phish-login.test/verify-account", 1),
    ("https://click.affiliate.test/redirect?to=x", 1), ("https://spam-offers.test/cheap/loans", 1), ("http://payday-loans.test/apply-now", 1),
    ("https://www.example.org/", 0), ("https://docs.python.test/3/library/os.html", 0), ("https://en.wiki.test/wiki/Galaxy", 0),
    ("https://blog.news.test/en/2020/01/story.html", 0), ("http://www.university.test/physics/course", 0), ("https://shop.test/books/12", 0),
    ("https://news.paper.test/world/article-99", 0), ("https://blog.someone.test/fr/4100", 0), ("http://museum.test/de/ausstellung", 0),
    ("https://m.weather.test/es/today", 0), ("https://code.host.test/project/readme", 0), ("https://forum.garden.test/thread/882", 0),
    ("https://www.city.test/council/minutes.pdf", 0), ("http://recipes.test/soup/tomato", 0), ("https://www.library.test/catalogue?q=tea", 0),
    ("https://journal.test/articles/10.1000", 0), ("https://blog.test/en/9399", 0), ("http://hospital.test/departments/heart", 0),
    ("https://school.test/timetable/#top", 0), ("https://maps.test/route/1-2", 0), ("https://music.test/album/40/", 0),
    ("https://www.train.test/timetable/north", 0), ("http://tionsh.test/en/14942/", 0), ("https://data.gov.test/tables/5.csv", 0),
    ("https://film.test/review/3", 0), ("https://www.sports.test/results/2021", 0), ("https://stories.test/fr/41389.html", 0),
    ("https://www.travel.test/de/12912?page=2", 0), ("https://m.theatre.test/en/1570", 0), ("https://m.health.test/articles/sleep", 0),
    ("https://thatch.test/roofs/old", 0), ("https://then-and-now.test/photos", 0), ("https://www.math.test/en/theorem", 0),
    ("https://earth.test/oceans/depth", 0), ("https://m.youth.test/camp", 0), ("https://other-half.test/letters", 0),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in small letters, path); both empty for a NULL or a URL without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_url`")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, SMALL)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass
class UrlModel:
    """Weight of each bucket, and the constant."""

    weights: np.ndarray
    constant: float

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        cells, lengths = _features(hosts, paths)
        sums = np.concatenate(([0.0], np.cumsum(self.weights[cells])))
        ends = np.cumsum(lengths)
        total = (sums[ends] - sums[ends - lengths]) / np.sqrt(np.maximum(lengths, 1)) + self.constant
        return np.round(1 / (1 + np.exp(-total)), 6)


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, URL after URL; how many each URL has)."""
    count = len(hosts)
    texts = [f"^{text}$" for pair in zip(hosts, paths) for text in pair]
    raws = [text.encode("utf-8", "surrogatepass") for text in texts]
    sizes = np.array([len(raw) for raw in raws])
    symbols = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(2 * count), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(symbols))
    cells, owners = [], []
    for order in range(SHORTEST, LONGEST + 1):
        good = np.flatnonzero(left >= order)
        mixed = (owner[good] % 2 + order * 2).astype(np.uint32) * np.uint32(0x9E3779B1)
        for step in range(order):
            mixed = (mixed ^ symbols[good + step]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
        cells.append((mixed >> np.uint32(7)) % np.uint32(BUCKETS))
        owners.append(owner[good] // 2)
    owners_all = np.concatenate(owners)
    sort = np.argsort(owners_all, kind="stable")
    return np.concatenate(cells)[sort].astype(np.int64), np.bincount(owners_all, minlength=count)


def split_url(url: str | None) -> tuple[str, str]:
    """`url_parts` for one string."""
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(str.maketrans(CAPITALS, SMALL)), path


def fit(labelled: list[tuple[str, int]], ridge: float = 1e-4, steps: int = 2000, rate: float = 4.0) -> UrlModel:
    """Gradient descent on the mean log loss with an L2 penalty; the table is small, so this runs where it is called."""
    pairs = [split_url(url) for url, _ in labelled]
    cells, lengths = _features([host for host, _ in pairs], [path for _, path in pairs])
    rows = np.repeat(np.arange(len(labelled)), lengths)
    scale = 1 / np.sqrt(np.maximum(lengths, 1))
    target = np.array([label for _, label in labelled], float)
    weights, constant = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        total = np.bincount(rows, weights[cells], len(labelled)) * scale + constant
        error = 1 / (1 + np.exp(-total)) - target
        weights -= rate * (np.bincount(cells, (error * scale)[rows], BUCKETS) / len(labelled) + ridge * weights)
        constant -= rate * error.mean()
    return UrlModel(weights, constant)


def parse_rule(rule: str) -> tuple[str, str]:
    """`example.org/es/` -> (`example.org`, `/es/`)."""
    host, _, path = rule.partition("/")
    return host, "/" + path


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, url: str = "url", block_from: float = 0.5
) -> DataFrame:
    """Add `host`, `path`, `rule`, `score` and `verdict`; the URL column is left out.

    A rule is (verdict, `host/path`).  It fits its host and all subdomains if the path starts with its own; the longest
    fitting rule decides and is named in `rule`.  Without one (`rule` NULL) the model's probability decides: `block`
    from `block_from` on.  A NULL or malformed URL has an empty host and path and gets the model's verdict for those.  Columns that
    already have one of the names of the results are replaced; others may have any names.
    """
    results = ["host", "path", "rule", "score", "verdict"]
    pages, own = numbered_columns(pages.select(*[name for name in pages.columns if name.lower() not in results or name == url]))
    pages = pages.withColumnRenamed(own[url], "_url")
    host, path = url_parts(F.col("_url"))
    # The longest rule comes first, so the first that fits decides; equal rules are taken in the order given.
    order = sorted(rules, key=lambda rule: -len(rule[1]))
    named, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in reversed(order):
        domain, prefix = parse_rule(rule)
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(prefix)
        named, decided = F.when(fits, rule).otherwise(named), F.when(fits, verdict).otherwise(decided)
    judged = pages.select("*", host.alias("host"), path.alias("path")).drop("_url").withColumns({"rule": named, "_decided": decided})
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> list:
        pairs = [text.split("\n", 1) for text in texts]
        return [shared.value.score([host for host, _ in pairs], [path for _, path in pairs])]

    # A host may hold a line break: it is only a separator for the model, so it is blanked there.
    both = F.concat(F.translate("host", "\n", " "), F.lit("\n"), F.col("path"))
    scored = map_texts(judged.withColumn("_both", both), "score double", work, "_both")
    verdict = F.coalesce("_decided", F.when(F.col("score") >= block_from, "block").otherwise("allow"))
    kept = [name for name in own if name != url]
    return scored.withColumn("verdict", verdict).select(*[own[name] for name in kept], *results).toDF(*kept, *results)


RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, fit(LABELLED)).select("page_id", "host", "path", "rule", "verdict", "score")
