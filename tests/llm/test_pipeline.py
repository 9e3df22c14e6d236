"""The pipeline and its stages against plain Python, with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity

WORDS = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "lly")]


def _filler(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows) of documents with planted cases, their labels, and a benchmark."""
    rng = random.Random(21)
    bench = [_filler(rng, n) for n in (40, 55, 70)]
    shared = [_filler(rng, 9) for _ in range(4)]
    rows: list[tuple[int | None, str | None]] = []
    labels = []
    for i in range(320):
        text = "\n".join(_filler(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 4)))
        toxic = i % 6 == 0
        if toxic:
            text += f"\n{_filler(rng, 6)} {rng.choice(('vileslur', 'scumword'))} {_filler(rng, 6)}"
        if i % 7 == 1:
            text += "\n" + rng.choice(shared).upper()
        if i % 31 == 2:
            text += "\n" + rng.choice(bench)
        rows.append((i, text))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    base = _filler(rng, 150).split()
    for i in range(8):  # near copies, of which two have no id
        copy = list(base)
        copy[rng.randrange(150)] = f"other{i}"
        rows.append((400 + i if i < 6 else None, " ".join(copy)))
    rows += [(410, rows[3][1]), (3, rows[3][1]), (411, None), (412, ""), (None, None), (413, " \n\t"), (5, _filler(rng, 60)), (414, "word " * 5000)]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _dropped int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


def _plain_score(model, text):
    """The logistic score from the words and their prefixes, term by term."""
    import math

    words = {w for w in re.findall(r"\w+", (text or "").lower())}
    names = set(words)
    for w in words:
        for n in (4, 5, 6):
            if len(w) > n:
                names.add(w[:n] + "*")
    return 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(x, 0.0) for x in names))))


def _without_lines(rows):
    """Each row's text without lines that an earlier document holds; rows without an id come last."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    owner = lambda i, t: (0, i, "") if i is not None else (1, 0, t or "")
    first = {}
    for i, t in sorted(rows, key=lambda r: owner(*r)):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), owner(i, t))
    # of rows without an id any may be first: they are told apart by a hash
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == owner(i, t)]
        out.append((i, "\n".join(kept) if t else t))
    return out


def _classes(rows):
    """Rows by class of near copies; those without words are one class."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {("",)})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = {}
    for k, x in enumerate(label):
        groups.setdefault(x, []).append(rows[k])
    return list(groups.values())


def _pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def _sorted(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_stages_against_plain_python(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, _, bench = corpus
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def run(name, docs):
        stages[name](spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = run("toxicity", docs)
    assert clean.schema == docs.schema
    assert _pairs(clean) == _sorted((i, t) for i, t in _pairs(docs) if _plain_score(model, t) < 0.5)
    assert not any(w in (t or "") for _, t in _pairs(clean) for w in ("vileslur", "scumword"))

    lines = run("line_dedup", clean)
    got, want = _pairs(lines), _without_lines(_pairs(clean))
    assert [x for x in got if x[0] is not None] == _sorted(x for x in want if x[0] is not None)
    assert sum(i is None for i, _ in got) == sum(i is None for i, _ in want)

    unlike = run("near_duplicates", lines)
    groups = _classes(_pairs(lines))
    kept = _pairs(unlike)
    assert len(kept) == len(groups)
    for group in groups:  # the smallest id stays, or any row where none has one
        ids = [i for i, _ in group if i is not None]
        assert sum(x in kept and (not ids or x[0] == min(ids)) for x in set(group)) == 1

    left = run("decontamination", unlike)
    plain = lambda t: " ".join((t or "").lower().split())
    assert _pairs(left) == _sorted(x for x in _pairs(unlike) if not any(b in plain(x[1]) for b in bench))

    mixed = run("mixing", left)
    assert _pairs(mixed) == _pairs(left) and mixed.columns[: len(docs.columns)] == docs.columns
    assert mixed.filter("rate < 0 OR rate IS NULL OR abs(p_good + p_poor - 1) > 1e-9").count() == 0


def test_run_is_its_stages_in_order(spark, corpus):
    import corpus_pipeline

    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, folder)).collect(), out.schema)
    assert _pairs(corpus_pipeline.run(spark, folder)) == _pairs(docs)


def test_empty_documents(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, _, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scores_against_the_plain_formula(spark, corpus):
    folder, _, _ = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count()
    for i, t in texts:
        want = _plain_score(model, t)
        assert any(r["doc_id"] == i and abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for r in got)


def test_weights_do_not_depend_on_held_out_labels(spark, corpus):
    folder, _, _ = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out_column(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.bias == b.bias and a.weights == b.weights
