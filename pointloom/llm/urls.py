"""URL filter: rules on host and path, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, work

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host, which fits its subdomains too, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A small table labelled by hand: (label, 1 = block; URLs).
LABELLED = (
    (1, """
http://www.lucky-casino.example.com/slots/free-spins
https://casino777.example.net/bonus
http://poker-nights.example.org/online-casino/jackpot
https://best-online-slots.example.info/casino/win-big
http://bet365-tips.example.com/betting/odds
https://sports-betting.example.net/free-bets
http://jackpot-winner.example.com/claim-prize
https://win-prize-now.example.org/claim
http://cheap-pills.example.com/viagra/order
https://online-pharma.example.net/buy-viagra-cheap
http://meds-discount.example.info/cheap-pills/no-prescription
https://weight-loss-pills.example.com/buy-now
http://replica-watches.example.net/buy-cheap-rolex
https://luxury-replica.example.com/cheap-bags/buy-now
http://payday-loans.example.org/fast-cash
https://fast-cash-loan.example.com/apply-now/payday
http://free-money.example.net/earn-cash-now
https://earn-money-fast.example.info/free-cash
http://hot-singles.example.com/xxx/chat
https://adult-video.example.net/porn/free
http://free-porn-tube.example.org/xxx-video
https://live-sex-cams.example.com/adult/chat
http://xxx-dating.example.info/hot-girls
https://adult-dating.example.net/singles/hot
http://torrent-movies.example.com/download/free-movie
https://free-torrents.example.org/warez/cracked-games
http://warez-download.example.net/crack/keygen.exe
https://software-crack.example.com/serial-keygen/download
http://keygen-free.example.info/crack.zip
https://account-verify-login.example.com/secure/update.php
http://paypa1-login.example.net/verify-account/index.php
https://bank-secure-login.example.org/account/confirm.php
http://update-your-account.example.info/signin/verify
https://free-gift-card.example.com/claim-now?id=1
http://click-here-now.example.net/redirect.php
https://ads-tracker.example.com/click/banner?id=2
http://adserver.example.org/banner/pop-under.js
https://track-clicks.example.net/pixel/ads.gif
http://seo-backlinks.example.com/buy-links/cheap
https://link-farm.example.info/cheap-backlinks
http://crypto-doubler.example.net/free-bitcoin/earn-now
https://bitcoin-giveaway.example.com/claim-free-btc
http://essay-cheap.example.org/buy-essay-now
https://miracle-cure.example.net/buy/weight-loss
http://spam-tools.example.com/bulk-mailer/download.exe
https://virus-scan-alert.example.info/download/cleaner.exe
http://free-ringtones.example.net/download-now.exe
https://you-wont-believe.example.com/clickbait/shocking
http://shocking-news-now.example.info/click/you-won
https://casino-bonus-codes.example.org/free-spins/claim"""),
    (0, """
https://www.city-library.example.org/en/opening-hours
http://library.university.example.edu/catalogue/search
https://news.example.com/world/2021/05/article-1042.html
https://www.daily-news.example.net/politics/election-report
http://weather.example.org/forecast/berlin
https://museum-of-history.example.org/exhibitions/roman-art
http://www.school.example.net/teachers/contact
https://science-journal.example.com/articles/volume-12/physics
https://physics.university.example.org/research/papers
http://garden-club.example.com/tips/roses-in-spring
https://recipes.example.net/bread/sourdough-recipe
http://cooking.example.org/recipes/vegetable-soup
https://www.travel-guide.example.com/france/paris/museums
http://train-times.example.net/stations/map
https://docs.example.org/manual/installation.html
https://wiki.example.com/articles/history_of_mathematics
http://encyclopedia.example.net/wiki/Photosynthesis
https://blog.example.com/2019/08/learning-to-read-maps
http://blog.gardener.example.org/posts/42
https://forum.example.net/threads/how-to-repair-a-bicycle
http://www.health-service.example.org/advice/sleep
https://hospital.example.com/departments/visiting-hours
http://music-school.example.net/lessons/piano
https://orchestra.example.org/concerts/season
http://theatre.example.com/programme/spring
https://sports-club.example.net/football/results
http://chess-club.example.org/lessons/openings
https://www.farming-today.example.com/articles/soil
http://ocean-research.example.org/reports/coral
https://astronomy.example.net/articles/planets
http://maths.example.org/lectures/algebra
https://language-courses.example.com/german/lessons
http://dictionary.example.net/en/words/library
https://city-council.example.org/services/recycling
http://www.town-hall.example.com/news/parking
https://archive.example.org/books/letters-1890
http://poetry.example.net/poems/autumn
https://bookshop.example.com/reviews/novels
http://film-festival.example.org/programme/documentaries
https://photography.example.net/gallery/mountains
http://hiking.example.com/routes/lake-district
https://birds.example.org/species/robin
http://trees.example.net/guide/oak
https://open-source.example.org/projects/docs/api
http://developer.example.com/docs/reference/strings.html
https://statistics.example.net/reports/population-2020
http://court.example.org/decisions/2018/114
https://parliament.example.net/debates/education
http://charity.example.org/volunteer/how-to-help
https://kindergarten.example.com/parents/menu"""),
)


def labelled_urls() -> pd.DataFrame:
    """The small labelled table (url, label 1 = block) that the filter learns from by default."""
    return pd.DataFrame([(u, label) for label, urls in LABELLED for u in urls.split()], columns=["url", "label"])


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of ``url``; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def hashed_grams(column: list[str], sizes: tuple[int, ...], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the character n-grams of each string, with ``^`` before and ``$`` after it, by hashes below ``dims``; all at once."""
    marked = "".join(f"^{x}$" for x in column).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(marked, np.uint32).astype(np.uint64)
    length = np.fromiter((len(x) + 2 for x in column), np.int64, len(column))
    row, left = np.repeat(np.arange(len(column)), length), np.arange(len(c))
    left = np.repeat(np.cumsum(length), length) - left  # characters from here to the string's end
    rows, features, h = [], [], np.full(len(c), seed, np.uint64)
    for n in range(1, max(sizes) + 1):
        h = textkit.mix(h[: len(c) - n + 1] ^ c[n - 1 :])
        if n in sizes:
            fits = np.flatnonzero(left[: len(h)] >= n)
            rows.append(row[fits])
            features.append((textkit.mix(h[fits] + np.uint64(n)) % np.uint64(dims)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def features(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature): the distinct features of each host and path."""
        dims = len(self.weights)
        both = [hashed_grams(x, self.sizes, dims, seed) for seed, x in ((1, hosts), (2, paths))]
        pairs = np.unique(np.concatenate([r * dims + f for r, f in both]))
        return pairs // dims, pairs % dims

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        row, f = self.features(hosts, paths)
        n = np.bincount(row, minlength=len(hosts))
        z = self.bias + np.bincount(row, self.weights[f], len(hosts)) / np.sqrt(np.maximum(1, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))
    return "".join(c.lower() if c in UPPER else c for c in rest[:cut]), tail[:end]


def train(labels: pd.DataFrame | None = None, dims: int = 1 << 14, sizes=(3, 4, 5), epochs: int = 60, rate: float = 0.5, l2: float = 1e-3) -> UrlModel:
    """Fit on a small table (url, label); rows with a null are left out; without rows every score is 0.5."""
    labels = (labelled_urls() if labels is None else labels).dropna(subset=["url", "label"])
    if not len(labels):
        return UrlModel(np.zeros(dims), 0.0, tuple(sizes))
    row, feature = UrlModel(np.zeros(dims), 0.0, tuple(sizes)).features(*map(list, zip(*map(_split, labels["url"]), strict=True)))
    at = np.searchsorted(row, np.arange(len(labels) + 1))
    y, w, b = labels["label"].to_numpy(float), np.zeros(dims), 0.0
    for _ in range(epochs):
        for i, t in enumerate(y):
            f = feature[at[i] : at[i + 1]]
            s = max(1.0, len(f) ** 0.5)
            g = 1 / (1 + np.exp(-np.clip(b + w[f].sum() / s, -30, 30))) - t
            w[f] -= rate * (g / s + l2 * w[f])
            b -= 0.1 * rate * g
    return UrlModel(w, b, tuple(sizes))


def judge(pages: DataFrame, labels: pd.DataFrame | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """All columns of ``pages`` but those of the result's names, plus host, path, rule, block_score, verdict.

    Null url or no ``://``: host and path empty, no rule, the model judges the empty strings. Repeated rows stay, an empty
    table gives an empty result, columns that clash with the result's are replaced, and very long urls are read whole.
    """
    model = train(labels)
    cast = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def block_score(host: pd.Series, path: pd.Series) -> pd.Series:
        m = cast.value
        return pd.Series(m.scores(host.tolist(), path.tolist()), dtype="float64")

    host, path = host_path(F.col("url").cast("string"))
    out = pages.withColumn("__host", host).withColumn("__path", path)
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    out = out.withColumn("__rule", rule).withColumn("__said", verdict)
    out = out.withColumn("block_score", F.when(F.col("__said").isNull(), block_score("__host", "__path")))
    out = out.withColumn("verdict", F.coalesce("__said", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))
    return out.withColumn("host", F.col("__host")).withColumn("path", F.col("__path")).withColumn("rule", F.col("__rule")).drop("__host", "__path", "__rule", "__said")


#: What the rules say; a verdict of the trained model is none of SQL's, so tests hold it against brute force.
RULES_SQL = """
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')) t(said, rule, h, start)),
m AS (SELECT page_id, host, path, rule, said, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start))
SELECT page_id, host, path, rule, said FROM m WHERE n = 1
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(work.read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
