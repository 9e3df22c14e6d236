"""URL filter: host and path rules first, boosted trees over lexical features for the rest."""

from __future__ import annotations

import functools
import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.cluster import ship
from quillon.llm.boosting import Boosted, boost

# The rules of the filter; a host and a path prefix, and what they decide.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Words of the labelled URLs, of ordinary sites and of those that sell or trick.
PLAIN_WORDS = """river garden school music paper stone window travel market health science history kitchen forest bridge
letter summer winter coffee museum village harbour photo theatre library doctor engine farmer painter writer teacher
planet ocean valley castle corner street silver golden little green north south daily weekly open public""".split()
SALES_WORDS = """bonus cheap click crypto deals discount dating earn fast fortune gift instant jackpot loans lucky meds million
money now offer pharma poker premium prize profit promo quick replica rich roulette sale sexy slim slots stream
super trial viagra vip voucher win""".split()
SUFFIXES = ("com", "net", "org", "info", "biz", "top", "edu", "gov", "io", "co.uk", "de", "fr", "es", "it")
SUBDOMAINS = ("", "", "", "www.", "www.", "shop.", "en.")
CONSONANTS, VOWELS = "bcdfghjklmnprstvw", "aeiou"

#: Labelled URLs of either class that the seed list has.
SEED_ROWS = 1500


def seed_urls(rows: int = SEED_ROWS) -> list[tuple[str, int]]:
    """(url, 1 if it is to be blocked): a list labelled by the rule that made it.

    Ordinary hosts are a word or two, or made-up names; the others string sales words together with
    hyphens and numbers, and their URLs have more parameters.
    """
    rng = random.Random(11)
    pick, out = rng.choice, []
    for _ in range(rows):
        if rng.random() < 0.5:
            name = "".join(pick(CONSONANTS) + pick(VOWELS) + pick(("", "", *"nrstl")) for _ in range(rng.randint(2, 4)))
        else:
            name = pick(("", "", "-")).join(pick(PLAIN_WORDS) for _ in range(pick((1, 2, 2))))
        sales = [pick(SALES_WORDS) for _ in range(pick((2, 2, 2, 3)))]
        if rng.random() < 0.2:
            sales[pick((0, -1))] = pick(PLAIN_WORDS)
        bad = "-".join(sales) + (str(rng.randint(1, 9999)) if rng.random() < 0.25 else "")
        for host, label in ((name, 0), (bad, 1)):
            path = "/" + "/".join(pick(PLAIN_WORDS) for _ in range(rng.randint(0, 2)))
            path += pick(("", "", f"/{rng.randint(1, 99999)}", f"-{rng.randint(1, 99)}.html", "?id=" + str(rng.randint(1, 999)), "?s=a&page=3", "#notes"))
            if label and rng.random() < 0.3:
                path += ("&" if "?" in path else "?") + "&".join(f"{pick('abcdefgh')}{i}={rng.randint(100, 10**8)}" for i in range(rng.randint(2, 6)))
            out.append((f"{pick(('http', 'https'))}://{pick(SUBDOMAINS)}{host}.{pick(SUFFIXES)}{path}", label))
    return out


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


def features(url: str | None, suffix_rate: dict[str, float]) -> list[float]:
    """Length, depth, digit ratio, entropy, parameter counts and the suffix's share of blocked URLs."""
    url = (url or "").lower()
    rest = url.partition("://")[2]
    host = rest.replace("?", "/").replace("#", "/").partition("/")[0]
    tail = rest[len(host) :]
    path, _, query = tail.partition("#")[0].partition("?")
    labels = host.split(".") if host else []
    longest = max(labels, key=len, default="")
    digits = lambda x: sum(c.isdigit() for c in x)
    return [
        len(url),
        len(host),
        len(path),
        path.count("/"),
        digits(url) / max(1, len(url)),
        digits(host) / max(1, len(host)),
        _entropy(host),
        _entropy(longest),
        query.count("=") + 0.0,
        len(query),
        len(labels),
        len(longest),
        host.count("-"),
        max((len(x) for x in longest.split("-")), default=0),
        sum(c in "aeiouy" for c in longest) / max(1, len(longest)),
        suffix_rate.get(_suffix(host), 0.5),
        float(url.startswith("https")),
    ]


class UrlModel:
    def __init__(self, trees: Boosted, suffix_rate: dict[str, float]):
        self.trees, self.suffix_rate = trees, suffix_rate

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        if not urls:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.trees.logits(np.array([features(u, self.suffix_rate) for u in urls]))))


def fit(labelled: list[tuple[str, int]] | None = None) -> UrlModel:
    """Fitted on labelled URLs: the caller's, or the seed list, once a process."""
    return _fit(labelled) if labelled else _fit_seed()


@functools.cache
def _fit_seed() -> UrlModel:
    return _fit(seed_urls())


def _fit(rows: list[tuple[str, int]]) -> UrlModel:
    n, k = Counter(_suffix(u.partition("://")[2].partition("/")[0].lower()) for u, _ in rows), Counter()
    for u, y in rows:
        k[_suffix(u.partition("://")[2].partition("/")[0].lower())] += y
    base = sum(y for _, y in rows) / len(rows)
    rate = {s: (k[s] + 20 * base) / (n[s] + 20) for s in n}
    x = np.array([features(u, rate) for u, _ in rows])
    return UrlModel(boost(x, np.array([y for _, y in rows], float), trees=60, depth=4), rate)


def host_column(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.split(after, "[/?#]", 2)[0]
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))


def path_column(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    tail = F.substring(after, F.length(F.split(after, "[/?#]", 2)[0]) + 1, F.length(after))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.split(tail, "[?#]", 2)[0]), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or above it, and whose path the URL's starts with."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _score(model: UrlModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.scores(batch.column("url").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return score


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the model's score for each row.

    Host: lower-cased (A-Z) from the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from
    there up to ``?``, ``#`` or the end. A null URL or one without ``://`` has neither. The longest
    rule that fits decides; where none does, the trees do: block from 0.5. Repeated rows are
    judged alike; empty tables give an empty result; other columns are not looked at.
    """
    ship(pages.sparkSession)
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    scored = own.mapInArrow(_score(model), "page_id long, url string, score double")
    parts = scored.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"), "score")
    judged = parts.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for rule, decides in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(decides)).otherwise(verdict)
    return judged.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "score")
