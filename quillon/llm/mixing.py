"""Mixing sources to target weights, with DataFrame and SQL functions only.

A classifier fitted on the labelled rows gives each document a membership in every
domain; projected-gradient least squares then finds nonnegative rates for the
documents such that the expected tokens of each domain meet their targets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import Table

#: Labelled rows that the classifier is fitted on, at most, and words it may know.
MAX_ROWS, MAX_WORDS = 12_000, 256
#: Labelled documents that must hold a word; how much likelier some domain must make it; its chi-square.
MIN_DOCS, MIN_LIFT, MIN_CHI = 8, 2.5, 20.0
#: Share of all tokens that each domain is to have.
TARGETS = {"good": 0.85, "poor": 0.13, "toxic": 0.02}
STEPS, TOLERANCE = 40, 1e-7
#: How much the rates' distance from 1 counts beside the missed targets.
NEARNESS = 1e-6

DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
_MARK = r"[\p{Punct}]+"
STATISTICS = ("log_chars", "marks", "digits", "word_length", "line_length")


def _with_features(docs: DataFrame) -> DataFrame:
    """Adds _n (words), _words (lower case, without marks) and the statistics of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumn("_bare", F.trim(F.regexp_replace(F.lower("_text"), r"[\p{Punct}\s]+", " ")))
    out = out.withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", " ")))
    chars, words = F.length("_text"), F.size("_words")
    some = F.greatest(chars, F.lit(1))
    out = out.withColumns({"_n": words.cast("long"), "_chars": chars, "_lines": chars - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1})
    return out.withColumns(
        {
            "_log_chars": F.log1p("_chars"),
            "_marks": (F.col("_chars") - F.length(F.regexp_replace("_text", _MARK, ""))) / some,
            "_digits": (F.col("_chars") - F.length(F.regexp_replace("_text", "[0-9]+", ""))) / some,
            "_word_length": F.col("_chars") / F.greatest(F.col("_n"), F.lit(1)),
            "_line_length": F.log(F.col("_chars") / F.col("_lines") + 1),
        }
    ).drop("_text", "_bare", "_chars", "_lines")


#: Quantiles of a statistic that part it into bins.
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)


def _bin(statistic: str, edges: list[float]) -> Column:
    """Which of the bins a statistic lies in, from 0."""
    return sum(((F.col(f"_{statistic}") > e).cast("int") for e in edges), F.lit(0))


class Classifier:
    """Naive Bayes: in which bins the statistics of a text lie, and which of a list of words it holds."""

    def __init__(self, prior: dict, edges: dict[str, list[float]], bin_gain: dict[str, dict[str, list[float]]], word_gain: dict[str, dict[str, float]]):
        self.prior, self.edges, self.bin_gain, self.word_gain = prior, edges, bin_gain, word_gain

    def posteriors(self, features: DataFrame) -> DataFrame:
        """Adds p_<domain> for each domain; drops the features but ``_n``."""
        domains = sorted(self.prior)
        out = features.withColumn("_known", F.array_intersect("_words", F.array(*[F.lit(w) for w in sorted(self.word_gain)]).cast("array<string>")))
        out = out.withColumns({f"_b_{s}": _bin(s, self.edges[s]) for s in STATISTICS})

        def logit(domain: str) -> Column:
            total = F.lit(math.log(self.prior[domain]))
            for s in STATISTICS:
                total = total + F.get(F.array(*[F.lit(g) for g in self.bin_gain[domain][s]]), F.col(f"_b_{s}"))
            if self.word_gain:
                gains = F.create_map(*[x for w, g in sorted(self.word_gain.items()) for x in (F.lit(w), F.lit(float(g[domain])))])
                total = total + F.aggregate("_known", F.lit(0.0), lambda acc, w: acc + F.element_at(gains, w))
            return total

        out = out.withColumns({f"_l_{d}": logit(d) for d in domains})
        top = F.greatest(*[F.col(f"_l_{d}") for d in domains]) if len(domains) > 1 else F.col(f"_l_{domains[0]}")
        out = out.withColumns({f"_e_{d}": F.exp(F.col(f"_l_{d}") - top) for d in domains})
        whole = sum((F.col(f"_e_{d}") for d in domains), F.lit(0.0))
        out = out.withColumns({f"p_{d}": F.col(f"_e_{d}") / whole for d in domains})
        return out.drop("_known", "_words", *[f"_{x}{s}" for x in ("", "b_") for s in STATISTICS], *[f"_{x}_{d}" for x in "le" for d in domains])


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, max_rows: int = MAX_ROWS) -> Classifier | None:
    """Fitted on at most ``max_rows`` labelled documents, those with the smallest hashes; None without any."""
    own = labels.withColumn("_domain", F.expr(domain)).select(F.col("doc_id").cast("long").alias("doc_id"), "_domain").dropna()
    own = own.groupBy("doc_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")  # max_rows rows at most
    rows = Table(_with_features(met).drop("doc_id", "text"), "labelled")
    cuts = rows.read().agg(*[F.percentile_approx(f"_{s}", list(QUANTILES), 10_000).alias(s) for s in STATISTICS]).first()
    edges = {s: sorted(set(cuts[s] or [])) for s in STATISTICS}
    n = {r["_domain"]: r["n"] for r in rows.read().groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    places = F.array(*[F.struct(F.lit(s).alias("s"), _bin(s, edges[s]).alias("b")) for s in STATISTICS])
    held = rows.read().select("_domain", F.explode(places).alias("p")).groupBy("_domain", "p.s", "p.b").agg(F.count("*").alias("n")).collect()
    counts = {(r["_domain"], r["s"], r["b"]): r["n"] for r in held}
    total = sum(n.values())
    domains = sorted(n)
    per_word = rows.read().select("_domain", F.explode(F.array_distinct("_words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.count_if(F.col("_domain") == d).alias(f"n_{d}") for d in domains])
    odd = sum((F.pow(F.col(f"n_{d}") - F.col("n") * (n[d] / total), 2) / (F.col("n") * (n[d] / total)) for d in domains), F.lit(0.0))
    lift = F.greatest(*[F.col(f"n_{d}") / (F.col("n") * (n[d] / total)) for d in domains]) if len(domains) > 1 else F.lit(1.0)
    words = per_word.withColumns({"odd": odd, "lift": lift}).filter((F.col("n") >= MIN_DOCS) & (F.col("lift") >= MIN_LIFT) & (F.col("odd") >= MIN_CHI)).orderBy(F.desc("odd"), "w").limit(MAX_WORDS).collect()
    rows.drop()
    share = {r["w"]: {d: (r[f"n_{d}"] + 0.5) / (n[d] + 1) for d in domains} for r in words}
    gain = {w: {d: math.log(p) - math.log(sum(n[x] * s[x] for x in domains) / total) for d, p in s.items()} for w, s in share.items()}
    bin_gain = {d: {s: [math.log((counts.get((d, s, i), 0) + 0.5) / (n[d] + 0.5 * (len(edges[s]) + 1))) for i in range(len(edges[s]) + 1)] for s in STATISTICS} for d in domains}
    return Classifier({d: n[d] / total for d in domains}, edges, bin_gain, gain)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float]) -> list[float]:
    """Projected gradient for min over rates >= 0 of the squared misses of the targets; returns u.

    ``members`` has _n and p_<domain>. The rates are max(0, 1 - p . u): the start, moved against the
    gradients of all steps, whose sum in the space of domains is u, and projected. A step's
    gradient is scaled by the second moments of the documents whose rates are not 0, and halved
    until the objective falls; of the rates that miss the targets least, those nearest to 1 are
    found (their distance counts with ``NEARNESS``). A step is one aggregation of a few sums, and its
    expression is as long as the first one's; the driver sees those sums alone.
    """
    names, k = [f"p_{d}" for d in domains], len(domains)
    share = np.array([targets.get(d, 0.0) for d in domains])

    def at(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        """Objective, gradient and second moments at u; None without any token."""
        rate = rate_column(names, u.tolist())
        kept = F.when(F.col("_rate") > 0, F.col("_n")).otherwise(0)
        sums = [F.sum("_n").alias("total"), F.sum(F.col("_n") * F.col("_rate") * F.col("_rate")).alias("square")]
        sums += [F.sum(F.col("_n") * F.col("_rate") * F.col(p)).alias(f"e{i}") for i, p in enumerate(names)]
        sums += [F.sum(kept * F.col(p) * F.col(q)).alias(f"m{i}_{j}") for i, p in enumerate(names) for j, q in enumerate(names) if j >= i]
        row = members.withColumn("_rate", rate).agg(*sums).first()
        if not row["total"]:
            return None
        miss = np.array([row[f"e{i}"] for i in range(k)]) / row["total"] - share
        moments = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / row["total"]
        return row["square"] / row["total"] / 2 + float(share @ u) + NEARNESS / 2 * float(u @ u), NEARNESS * u - miss, moments

    u = np.zeros(k)
    here = at(u)
    for _ in range(STEPS if here else 0):
        value, gradient, moments = here
        if np.abs(gradient).max() < TOLERANCE:
            break
        step = np.linalg.solve(moments + NEARNESS * np.eye(k), -gradient)
        slope, scale = float(gradient @ step), 1.0
        while scale > 1e-6:
            there = at(u + scale * step)
            if there[0] <= value + 1e-4 * scale * slope + 1e-15:
                break
            scale /= 2
        else:
            break
        u, here = u + scale * step, there
    return u.tolist()


def rate_column(names: list[str], u: list[float]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(p) * x for p, x in zip(names, u, strict=True)), F.lit(0.0)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = DOMAIN, keep: list[str] | None = None) -> DataFrame:
    """``docs``, all its columns or those to ``keep``, with n_tokens, p_<domain> for each domain, and rate.

    ``rate`` is the expected number of copies of a document in the mix; the sum of rate *
    n_tokens * p_<domain> is the domain's target share of all tokens, as nearly as rates
    >= 0 can meet it. A null text has no tokens. Labels that are null, or whose document is
    absent, are left out, labels in conflict count as the first domain by name; without
    any label there is one domain, "all", and every rate is 1. Repeated rows are rated alike.
    Columns of ``docs`` that are named like the new ones give way to them; empty tables give an
    empty result.
    """
    targets = TARGETS if targets is None else targets
    known = fit_classifier(docs, labels, domain)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    plain = plain.withColumn("text", F.col(f"_c{docs.columns.index('text')}"))
    domains = sorted(known.prior) if known else ["all"]
    shares = [f"p_{d}" for d in domains]
    made = {"n_tokens", "rate", *shares}
    names = [(f"_c{i}", c) for i, c in enumerate(docs.columns) if (keep is None or c in keep) and c not in made]
    features = _with_features(plain)
    back = [F.col(a).alias(b) for a, b in names]
    if known is None:
        return features.select(*back, F.col("_n").alias("n_tokens"), F.lit(1.0).alias("p_all"), F.lit(1.0).alias("rate"))
    # written once: every step of the fit, and the result, read memberships instead of texts
    members = Table(known.posteriors(features).select(*[a for a, _ in names], "_n", *shares), "members").read()
    u = fit_rates(members.select("_n", *shares), domains, targets)
    return members.select(*back, F.col("_n").alias("n_tokens"), *shares, rate_column(shares, u).alias("rate"))
