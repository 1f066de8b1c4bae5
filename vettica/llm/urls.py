"""URL filter: rules first, then logistic regression on hashed character n-grams.

A url's host and path are spelled between marks, cut into n-grams of 3 to 5
characters and hashed into 2^16 weights, host and path apart.  The weights are
fitted on the driver from a small labelled table (at most ``MOST_LABELLED`` urls);
judging is one map stage with a weight vector of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 16
SIZES = (3, 4, 5)
MOST_LABELLED = 10_000

#: The rules of the contract, (action, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: The labelled urls: 1 is to be blocked.
LABELLED = (
    ("http://cheap-pills.example.org/en/1", 1),
    ("https://www.cheap-pills.example.net/fr/2", 1),
    ("https://www.casino-win.example.net/de/5", 1),
    ("http://casino-win.example.org/en/310.html", 1),
    ("http://ads-track.example.org/en/31", 1),
    ("https://ads-track.example.net/pixel", 1),
    ("https://m.spam-farm.example.net/es/77", 1),
    ("http://www.cheap-meds.example.org/buy/now", 1),
    ("https://best-pills-online.example.net/order", 1),
    ("https://spam-farm.example.org/en/728", 1),
    ("http://link-farm.example.net/de/12", 1),
    ("http://spam-links.example.net/links.html", 1),
    ("http://casino-bonus.example.org/win", 1),
    ("https://free-casino.example.net/en/slots", 1),
    ("https://poker-win.example.org/bonus/free", 1),
    ("http://replica-watches.example.org/sale", 1),
    ("http://cheap-replica.example.net/shop/cheap", 1),
    ("https://adult-cams.example.net/live", 1),
    ("https://xxx-videos.example.org/free", 1),
    ("http://payday-loans.example.org/apply", 1),
    ("http://fast-cash-loans.example.net/now", 1),
    ("https://free-download-crack.example.org/keygen", 1),
    ("https://warez-torrent.example.net/crack", 1),
    ("http://win-prize-now.example.org/claim", 1),
    ("http://login-verify-account.example.net/update", 1),
    ("http://seo-spam.example.org/fr/9", 1),
    ("https://therin.example.org/en/770", 0),
    ("https://blog.tiontion.example.org/es/533/", 0),
    ("http://m.ththth.example.net/en/25", 0),
    ("https://docs.example.org/de/guide", 0),
    ("https://www.example.org/en/about", 0),
    ("https://news.example.net/de/politics/41.html", 0),
    ("http://library.example.org/fr/catalogue", 0),
    ("https://university.example.net/en/research", 0),
    ("https://museum.example.org/es/exposiciones", 0),
    ("http://forum.example.net/en/thread/18", 0),
    ("https://wiki.example.org/de/Hauptseite", 0),
    ("https://recipes.example.net/en/soup", 0),
    ("http://weather.example.org/en/today", 0),
    ("https://city.example.net/de/rathaus", 0),
    ("https://m.erand.example.org/fr/90", 0),
    ("http://blog.onthe.example.net/en/960", 0),
    ("https://thther.example.org/en/685", 0),
    ("https://travel.example.org/en/guide/rome", 0),
    ("http://code.example.net/en/manual", 0),
    ("https://www.journal.example.org/en/issue/7", 0),
)

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    found = _URL.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


class Rules:
    """The longest rule whose host is the url's or a parent domain of it, and whose
    path begins the url's; looked up by host, not rule by rule."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule, action))

    def of(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        while True:
            for start, rule, action in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
                    best = rule, action
            dot = host.find(".")
            if dot < 0:
                return best
            host = host[dot + 1 :]


def slots(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for size in SIZES:
            for at in range(len(text) - size + 1):
                found.add(zlib.crc32(f"{mark}{text[at : at + size]}".encode("utf-8", "replace")) & ((1 << BITS) - 1))
    return np.fromiter(found, np.int64, len(found))


def fit(labelled: Sequence[tuple[str, int]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset by full gradient steps; the same table gives the same."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError("the labelled table is not small")
    weights, offset = np.zeros(1 << BITS), 0.0
    rows = [slots(*parts(url)) for url, _ in labelled]
    wanted = np.array([y for _, y in labelled], float)
    if not len(rows):
        return weights, offset
    flat = np.concatenate(rows)
    number = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(number, minlength=len(rows))))
    for _ in range(rounds):
        value = np.bincount(number, weights[flat], len(rows)) * scale + offset
        miss = wanted - 1 / (1 + np.exp(-value))
        weights += rate * np.bincount(flat, (miss * scale)[number], len(weights)) - rate * decay * weights
        offset += rate * float(miss.mean())
    return weights, offset


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    Null urls and urls without ``://`` have an empty host and path and are judged by
    the model like any other; an empty path fits no rule that has one.  Repeated
    rows are judged each on their own.  Other columns are not read."""
    spark = pages.sparkSession
    weights = spark.sparkContext.broadcast(fit(labelled))
    kind = pages.schema["page_id"].dataType.simpleString()
    rules = tuple(rules)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (vector, offset) = Rules(rules), weights.value
        for batch in source:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                found = table.of(host, path)
                at = slots(host, path)
                score = float(1 / (1 + np.exp(-(vector[at].sum() / max(1, len(at)) ** 0.5 + offset))))
                verdict = found[1] if found else "block" if score >= 0.5 else "allow"
                rows.append((host, path, found and found[0], verdict, score))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, pa.float64() if n == 4 else pa.string()) for n, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *arrays], ["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
