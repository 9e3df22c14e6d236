"""Toxicity scores from a linear classifier with counterfactual regularisation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.cluster import ship
from quillon.llm.storage import Table
from quillon.llm.texts import parts

#: Labelled rows of each class that a model is fitted on, at most; those with the smallest hashes.
MAX_ROWS_A_CLASS = 5000
#: Documents that must hold a feature, the z-score of its share of toxic ones, features kept.
MIN_DOCS, MIN_Z, MAX_FEATURES = 3, 3.5, 8192
RIDGE, SWAP_PENALTY, STEPS = 2e-5, 1.0, 400
PREFIXES = (4, 5, 6)

# Identity terms by group; a term is swapped for the next one of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
    ("muslime", "christen", "juden"),
)
#: Each term's partners: all others of its group.
PARTNERS = {term: tuple(t for t in group if t != term) for group in IDENTITY_GROUPS for term in group}

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words and their prefixes, which stand for inflected forms."""
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def swaps_of(text: str | None) -> list[tuple[set[str], set[str]]]:
    """The words of each sentence that has an identity term, and those with the term swapped for each of its partners."""
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        words = set(_WORD.findall(sentence))
        for term in sorted(words & PARTNERS.keys()):
            out += [(words, words - {term} | {other}) for other in PARTNERS[term]]
    return out


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, and those of its sentences' swaps, before and after."""
    join = lambda words: " ".join(sorted(words))
    for batch in (p for b in batches for p in parts(b, "text")):
        texts = batch.column("text").to_pylist()
        swaps = [swaps_of(t) for t in texts]
        sides = [pa.array([[join(s[k]) for s in x] for x in swaps], pa.list_(pa.string())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([join(words_of(t)) for t in texts], pa.string()), *sides, batch.column("toxic")], names=["words", "before", "after", "toxic"])


def held_out_column(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Distinct words and label of at most ``limit`` labelled documents of each class.

    Labels in conflict count as toxic; rows without a label or id, or held out, are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out_column()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value in (0, 1):
        some = own.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        picked = some if picked is None else picked.unionByName(some)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = text.join(F.broadcast(picked), "doc_id").select("text", "toxic")  # 2 * limit rows at most
    return met.mapInArrow(_word_lists, "words string, before array<string>, after array<string>, toxic int")


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, k = Counter(), Counter()
        for words, toxic in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = features_of(set(words.split()))
            n.update(found)
            if toxic:
                k.update(found)
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array([k[f] for f in names], pa.int64())], names=["feature", "n", "k"])


def _known_features(at: dict[str, int]):
    """Numbers of the features that each row holds, and of its swaps."""

    def pack(words: str) -> bytes:
        return np.array(sorted(at[f] for f in features_of(set(words.split())) if f in at), np.int32).tobytes()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([pack(w) for w in batch.column("words").to_pylist()], pa.binary())
            sides = [pa.array([[pack(w) for w in x] for x in batch.column(c).to_pylist()], pa.list_(pa.binary())) for c in ("before", "after")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), own, *sides], names=["toxic", "own", "before", "after"])

    return known


class Model:
    """Weights of features and a bias; ``score`` is the probability of label 1."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        known = self.weights
        words = words_of(text)
        z = self.bias + math.fsum(sorted(known[f] for f in features_of(words) if f in known)) if known else self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _solve(y: np.ndarray, own: list[bytes], before: list[bytes], after: list[bytes], d: int, swap_penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression whose loss also has the mean squared change of a sentence's score under identity swaps."""

    def matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows]), np.frombuffer(b"".join(rows), np.int32)

    n, base, has = len(y), y.mean(), len(before)
    (ri, ci), (a_r, a_c), (b_r, b_c) = matrix(own), matrix(before), matrix(after)
    w, b, m, v = np.zeros(d), math.log(base / (1 - base)), np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, STEPS + 1):  # Adam, over all rows at once
        z = b + np.bincount(ri, w[ci], n)
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grad = np.bincount(ci, err[ri], d) + RIDGE * w
        if has:
            change = (np.bincount(a_r, w[a_c], has) - np.bincount(b_r, w[b_c], has)) * (2 * swap_penalty / has)
            grad += np.bincount(a_c, change[a_r], d) - np.bincount(b_c, change[b_r], d)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS_A_CLASS, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Features are chosen by counts over all training rows; the driver gets the chosen ones alone.

    A null text is an empty one; labels that are null, or without a document, are left out; labels in
    conflict count as toxic; without rows of both classes every text has one score.
    """
    ship(docs.sparkSession)
    table = Table(_training_rows(docs, labels, limit), "toxicity")
    rows = table.read()
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        table.drop()
        return Model({}, 500.0 if toxic else -500.0)
    base = toxic / n
    counts = rows.mapInArrow(_count_features, "feature string, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    z = F.abs(F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    chosen = counts.withColumn("z", z).filter((F.col("n") >= MIN_DOCS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    names = [r.feature for r in chosen.collect()]
    names += sorted(PARTNERS.keys() - set(names))
    at = {f: i for i, f in enumerate(names)}
    got = rows.mapInArrow(_known_features(at), "toxic int, own binary, before array<binary>, after array<binary>").collect()  # 2 * limit rows at most
    table.drop()
    got.sort(key=lambda r: (r.toxic, bytes(r.own)))  # so that sums do not depend on tasks
    pairs = sorted((bytes(x), bytes(y)) for r in got for x, y in zip(r.before, r.after, strict=True))
    w, b = _solve(np.array([r.toxic for r in got], float), [bytes(r.own) for r in got], [x for x, _ in pairs], [y for _, y in pairs], len(at), swap_penalty)
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, b)


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "_toxic_text")):
            at = batch.schema.get_field_index("_toxic_text")
            scores = pa.array([model.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), scores], names=[*(batch.schema.names[i] for i in rest), "score"])

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is 0.5 or more) for each row.

    Only the text is looked at, whole; a null text is scored as an empty one. Rows that repeat
    are scored alike, empty tables give an empty result, a null doc_id is not held out.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), F.col("text").cast("string").alias("_toxic_text"))
    scored = own.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _score_column(model: Model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for i in range(0, len(texts), 500) for t in texts.slice(i, 500).to_pylist()], pa.float64())

    return score


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all its columns, without the rows whose score is 0.5 or more."""
    ship(docs.sparkSession)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = F.col(f"_c{docs.columns.index('text')}").cast("string")  # the only column that Python gets
    return plain.filter(_score_column(model)(text) < 0.5).toDF(*docs.columns)
