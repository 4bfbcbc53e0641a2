"""URL filters: host and path rules first, a logistic regression on hashed character n-grams else.

Method.  The model reads the 3- to 5-grams of ``^host$`` and of the path, hashed to ``SLOTS`` slots
with a different seed for each, as 0/1 features scaled to length 1.  It is trained from a small
table of labelled URLs, a parameter; ``LABELLED_URLS`` is the default one.  Pages are judged in Arrow
batches by one pass over their bytes.

Rules are (verdict, host, path).  A rule fits its host and every subdomain if the path starts with
the rule's; the longest rule wins.  The rules are few and travel with the tasks.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed, as there is nothing to judge; repeated rows are judged alike; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.logistic import Logistic, fit, stacked

SLOTS = 1 << 16
GRAMS = (3, 4, 5)
BLOCK_FROM = 0.5

# The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# A small labelled table, URLs to block and URLs to keep.
BLOCKED_URLS = (
    "http://casino-win.test/play", "https://www.mega-casino.test/slots/bonus", "http://bets.test/live", "https://free-bets.test/odds/today",
    "http://poker-room.test/join", "https://sports-bet.test/football", "http://jackpot-slots.test/", "https://lucky-roulette.test/spin",
    "http://adult-x.test/", "https://xxx-videos.test/watch/1", "http://porn-tube.test/hd", "https://hot-cams.test/live-sex",
    "http://adult-dating.test/signup", "https://escort-x.test/city", "http://ads-track.test/pixel.gif", "https://ad-server.test/click?id=3",
    "https://tracker-ads.test/banner", "http://popup-ads.test/offer", "https://cheap-pills.test/viagra", "http://rx-pharm.test/buy-cialis",
    "https://payday-loans.test/apply", "http://fast-cash-loan.test/now", "https://replica-watches.test/rolex", "http://free-iphone-win.test/claim",
    "https://crypto-doubler.test/invest", "http://warez-crack.test/keygen", "https://torrent-free.test/download/full-movie", "http://click-bait-prize.test/winner",
    "https://m.casino.test/de/bonus", "http://blog.casino-bonus.test/fr/12", "https://online-bets.test/es/77.html", "http://bet-win.test/en/1#top",
    "https://blog.adult-x.test/en/330.html", "http://m.adult-x.test/de/71/", "http://m.ads-track.test/en/902.html", "https://www.ads-track.test/fr/4#top",
    "https://www.casino-win.test/de/8708", "https://blog.free-bets.test/es/54?utm_source=feed", "http://www.cheap-pills.test/es/6370?page=2&ref=x", "https://m.cheap-pills.test/en/11.html",
)
KEPT_URLS = (
    "https://en.encyclopedia.test/wiki/History_of_France", "http://news.test/2023/05/politics/article.html", "https://docs.language.test/3/library/json.html", "https://www.university.test/physics/courses/101",
    "http://blog.gardening.test/how-to-grow-tomatoes", "https://recipes.test/pasta/carbonara", "https://www.library.test/catalogue/item/5521", "http://museum.test/en/exhibitions",
    "https://weather.test/de/berlin", "http://forum.linux.test/thread/882?page=2", "https://school.test/maths/algebra.html", "https://health.test/conditions/asthma",
    "http://travel.test/fr/paris/guide", "https://www.government.test/services/passport", "https://science.test/journal/vol7/paper3.pdf", "http://music.test/lessons/piano",
    "https://books.test/es/novelas/2044", "https://m.newspaper.test/en/4033.html", "http://history.test/de/1065", "https://shop.test/en/products/42?ref=x",
    "https://cooking.test/en/12774?page=2", "http://www.nature.test/en/34431", "https://thinking.test/fr/43790?utm_source=feed", "http://nation.test/es/51097/",
    "https://blog.theatre.test/en/39680.html", "https://theory.test/en/9834/", "http://stationery.test/en/21678", "https://m.writing.test/en/281.html",
    "http://therapy.test/fr/25163?page=2", "https://housing.test/de/31162", "http://reading.test/en/7449", "https://earth.test/en/14941/#top",
    "https://blog.kitchen.test/en/352.html", "http://m.weather.test/de/70/", "http://m.teacher.test/en/917.html", "https://www.orchard.test/fr/9#top",
    "https://www.bridge.test/de/8123", "https://blog.theories.test/es/59?utm_source=feed", "http://www.harbour.test/es/6111?page=2&ref=x", "https://m.thing.test/en/15.html",
)
LABELLED_URLS = tuple((url, 1) for url in BLOCKED_URLS) + tuple((url, 0) for url in KEPT_URLS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case and path; both empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def split_url(url: str) -> tuple[str, str]:
    """The same for one text."""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def features(hosts: list[str], paths: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each URL's distinct n-grams."""
    rows = []
    for host, path in zip(hosts, paths, strict=True):
        own = [_slots(f"^{host}$", 1), _slots(path, 2)]
        slots = np.unique(np.concatenate(own))
        rows.append((slots, np.full(len(slots), 1 / np.sqrt(max(1, len(slots))))))
    return rows


def _slots(text: str, seed: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    found = [np.zeros(0, np.int64)]
    for n in GRAMS:
        if len(data) >= n:
            gram = np.full(len(data) - n + 1, seed * 7 + n, np.uint64)
            for k in range(n):
                gram = gram * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
            found.append(((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % SLOTS)
    return np.concatenate(found)


def train(labelled: Iterable[tuple[str, int]] = LABELLED_URLS, ridge: float = 3e-4) -> Logistic:
    """A model from (url, label) rows, 1 to block; the table is small and stays on the driver."""
    table = list(labelled)
    parts = [split_url(url) for url, _ in table]
    rows = stacked(features([host for host, _ in parts], [path for _, path in parts]))
    labels = np.array([label for _, label in table])
    return fit(rows, labels, SLOTS, ridge, fold=np.arange(len(table)) % 4 == 0)


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def judge(host: Column, path: Column, model: Logistic) -> Column:
    """The model's probability that a page should be blocked."""

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        rows = stacked(features(hosts.tolist(), paths.tolist()))
        return pd.Series(model.probability(rows.dot(model.weights) + model.offset))

    return score(host, path)


def filter_urls(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, labelled: Iterable[tuple[str, int]] = LABELLED_URLS, block_from: float = BLOCK_FROM
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, probability of the model."""
    host, path = host_and_path(F.col(f"`{url_column}`"))
    rows = df.select(F.col(f"`{id_column}`").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = rows.withColumn("probability", judge(F.col("host"), F.col("path"), train(labelled)))
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when((F.col("host") != "") & (F.col("probability") >= block_from), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(decision, learned).alias("verdict"), "probability")
