"""Text operators against brute force, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import decontamination, line_dedup, mixing, ngram_join, repeats, toxicity
from quillon.llm.substring_dedup import substring_dedup
from quillon.llm.suffix_dedup import suffix_dedup

EXTRA = ", did long, k1 int, k2 binary, score double, rate double, _text string, _c0 int, _dropped int"


def _texts(seed: int = 3, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = sentence(50), "A Common LINE of text"
    out: list[str | None] = [None, "", " \t\n ", "short", "x" * 450, "ab " * 300]
    for i in range(n):
        text = "\n".join(sentence(rng.randint(1, 40)) for _ in range(rng.randint(1, 5)))
        if i % 4 == 0:
            text += " " + passage + " " + sentence(5)
        if i % 3 == 0:
            text += "\n" + line.upper() + " \nmore " + str(i)
        out.append(text)
    base = sentence(120).split()
    for i in range(12):  # near copies
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = "zz" + str(rng.randint(0, 3))
        out.append(" ".join(copy))
    out += [out[10], out[10], out[20], sentence(4000)]
    return out


def _docs(spark, texts, ids=None):
    rows = [(i, t, None, 1, b"", 0.5, 1.0, "x", 3, 4) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA)


def _without_repeats(texts, split, join, length):
    units = [split(t or "") for t in texts]
    seen = collections.Counter(bytes(join(u[i : i + length])) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[bytes(join(u[i : i + length]))] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        out.append((len(u), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(join(kept))).hexdigest()))
    return out


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def _join_words(words):
    return " ".join(words).encode()


@pytest.mark.parametrize("whole", [384, 1])
@pytest.mark.parametrize("partitions", [2, 9])
def test_substring_and_suffix_dedup(spark, monkeypatch, whole, partitions):
    monkeypatch.setattr(repeats, "WHOLE", whole)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        texts = _texts()
        docs = _docs(spark, texts)
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup(docs).collect())
        assert got == [(i, *x) for i, x in enumerate(_without_repeats(texts, _words, _join_words, 35))]
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs).collect())
        assert got == [(i, *x) for i, x in enumerate(_without_repeats(texts, str.encode, bytes, 200))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    texts = _texts(8, 12)
    docs = _docs(spark, texts)
    own = {t: u for t, u in zip(range(len(texts)), _without_repeats(texts, _words, _join_words, 35), strict=True)}
    # the chunk is read where the functions run, so the pieces are made here
    import numpy as np
    import pyarrow as pa

    from quillon.llm.texts import buffers

    data, starts, ends = buffers(pa.array(texts, pa.string()))
    units = repeats.Words(data, starts, ends)
    assert [int(b - a) for a, b in zip(units.starts, units.ends, strict=True)] == [own[i][0] for i in own]
    spans = collections.Counter()
    for rows, lo, hi in repeats.pieces(units.starts, units.ends, 100, 34):
        piece, s0, size, _, _ = repeats.window_runs(units.codes(int(lo[0]), int(hi[-1])), lo - lo[0], hi - lo[0], 35, 10)
        for p, n in zip(rows[piece].tolist(), size.tolist(), strict=True):
            spans[p] += n
    assert spans == collections.Counter({i: x[0] - 34 for i, x in own.items() if x[0] >= 35})
    assert docs.count() == len(texts) and np.all(units.starts[1:] == units.ends[:-1])


def test_rows_with_one_id_are_texts_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = _docs(spark, [long, long, "a b", None], [7, 7, 7, None])
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect())
    assert got == [(-1, 0, 0), (7, 2, 0), (7, 60, 60), (7, 60, 60)]
    rows = [(None, long), (None, "x " + long + " y"), (7, "y " + " ".join(long.split()[:40])), (None, "only here " * 30), (7, "z")]
    docs = _docs(spark, [t for _, t in rows], [i for i, _ in rows])
    for run, split, join, length in ((substring_dedup, _words, _join_words, 35), (suffix_dedup, str.encode, bytes, 200)):
        want = sorted((i or -1, *x) for (i, _), x in zip(rows, _without_repeats([t for _, t in rows], split, join, length), strict=True))
        assert sorted((r["doc_id"] or -1, *list(r)[1:]) for r in run(docs).collect()) == want


def test_empty_tables(spark):
    docs = _docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (substring_dedup(docs), suffix_dedup(docs), line_dedup.line_dedup(docs, with_hash=True), ngram_join.ngram_classes(docs), decontamination.find_contamination(docs, bench), toxicity.score_toxicity(docs, toxicity.fit(docs, labels)), mixing.mix(docs, labels)):
        assert out.count() == 0


def test_line_dedup(spark):
    texts = _texts()
    docs = _docs(spark, texts)
    first = {}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), i)
    expected = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        expected.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    out = line_dedup.line_dedup(docs, with_hash=True).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out] == expected
    for r in out:
        assert line_dedup.bitmap_lines(bytes(r["keep"]), r["n_lines"]).sum() == r["n_lines"] - r["n_dropped"]
    after = line_dedup.without_repeated_lines(docs)
    assert after.schema == docs.schema
    assert sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in after.collect()) == [(i, h) for i, _, _, h in expected]


def test_line_dedup_of_one_document_in_several_rows(spark):
    docs = _docs(spark, ["a long enough line", "a long enough line", "a long enough line\nx", None], [4, 4, 9, None])
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(-1, 1, 0), (4, 1, 0), (4, 1, 0), (9, 2, 1)]


def test_rows_that_share_an_id_or_have_none_keep_their_own_lines(spark):
    # the two texts of document 5 have one 32-bit murmur value
    texts = ["common line abcdef", "common line abcdef\nfirst shape 1178", "own line of row 254067\ncommon line abcdef", "a line without an id\nx", "a line without an id\ny", "common line abcdef"]
    docs = _docs(spark, texts, [1, 5, 5, None, None, None])
    kept = sorted((r["doc_id"] or 99, r["text"]) for r in line_dedup.without_repeated_lines(docs).select("doc_id", "text").collect())
    assert kept[:3] == [(1, "common line abcdef"), (5, "first shape 1178"), (5, "own line of row 254067")]
    assert sorted(len(t) for _, t in kept[3:]) == [0, 1, len(texts[3])]
    got = sorted((r["doc_id"] or 99, r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(1, 1, 0), (5, 2, 1), (5, 2, 1), (99, 1, 1), (99, 2, 0), (99, 2, 1)]


def test_classes_of_rows_that_share_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, a + " more"), (9, b + " more"), (None, a + " less"), (None, c), (None, c + " again"), (None, "alone in the world"), (5, a)]
    docs = _docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_classes(docs).collect())
    assert got == collections.Counter([(5, 2, 3), (5, 2, 3), (2, 2, 3), (None, 2, 3), (5, 5, 1), (9, 5, 1), (None, None, 1), (None, None, 1), (None, None, 0)])
    kept = sorted((r["doc_id"] or 99, r["text"][:1]) for r in ngram_join.one_of_each_class(docs).select("doc_id", "text").collect())
    assert kept == [(2, "a"), (5, "b"), (99, "a"), (99, "c")]


def test_columns_of_any_name_stay_as_they_are(spark):
    names = ["_dropped", "_did", "_rid", "_c1", "k1", "part", "runs", "text", "doc_id"]
    docs = spark.createDataFrame([(*range(i, i + 7), f"one line for all of us\nand {'word ' * i}", i) for i in range(4)], ", ".join(f"{n} string" if n == "text" else f"{n} long" for n in names))
    model = toxicity.Model({"zzz": 9.0}, -3.0)
    bench = spark.createDataFrame([(1, "nothing that the documents hold in any place")], "item_id long, text string")
    for out in (line_dedup.without_repeated_lines(docs), ngram_join.one_of_each_class(docs), toxicity.without_toxic(docs, model), decontamination.without_contaminated(docs, bench)):
        assert out.schema == docs.schema
        rows = out.collect()
        assert rows and all(r["_did"] == r["doc_id"] + 1 and r["runs"] == r["doc_id"] + 6 for r in rows)
    assert substring_dedup(docs).count() == suffix_dedup(docs).count() == 4


def test_other_words_of_one_polynomial_hash_do_not_repeat(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:20], x, *words[20:]]) for x in (a, b)] + [a, b]
    assert [r["n_removed"] for r in substring_dedup(_docs(spark, texts)).collect()] == [0] * 4
    got = [r["n_removed"] for r in suffix_dedup(_docs(spark, [a, b])).orderBy("doc_id").collect()]
    assert got == [x[1] for x in _without_repeats([a, b], str.encode, bytes, 200)]


def test_matches_are_extended_by_bytes_where_codes_agree():
    import numpy as np
    import pyarrow as pa

    from quillon.llm import hashing
    from quillon.llm.substring_dedup import extend_matches
    from quillon.llm.texts import buffers

    hashing.WORD_CODES.clear()
    hashing.WORD_CODES[b"other"] = hashing.WORD_CODES[b"w7"]  # a collision
    words = [f"w{i}" for i in range(60)]
    changed = ["other" if w == "w7" else w for w in words]
    payload = pa.array([" ".join(words).encode(), " ".join(changed).encode()], pa.binary())
    units = repeats.Words(*buffers(payload))
    ah = hashing.Prefix(units.all).windows(10)[25]
    table = pa.table({"ah": np.array([ah, ah], np.uint64).view(np.int64), "open": [True, True]})
    got = extend_matches(table, units, 35, 10)
    hashing.WORD_CODES.clear()
    assert [x.tolist() for x in got] == [[0, 1], [8, 68], [60, 120]]


def test_multikey_quicksort():
    import numpy as np

    from quillon.llm.suffix_dedup import multikey_quicksort

    rng = random.Random(6)
    for length in (5, 8, 21, 200):
        data = bytes(rng.choice(b"\x00a\xff") for _ in range(40)) * 12 + bytes(rng.randrange(256) for _ in range(600))
        starts = np.arange(len(data) - length + 1)
        group = np.sort(np.array([rng.randrange(3) for _ in starts]))
        order, same = multikey_quicksort(np.frombuffer(data, np.uint8), starts, group, length)
        strings = [(int(group[i]), data[i : i + length]) for i in order.tolist()]
        assert strings == sorted(strings) and sorted(order.tolist()) == starts.tolist()
        assert same.tolist() == [bool(i) and strings[i] == strings[i - 1] for i in range(len(strings))]


def test_ranges_of_rows_between_splitters():
    import numpy as np

    from quillon.llm.ordering import range_of

    rng = random.Random(8)
    rows = [tuple(rng.randrange(4) for _ in range(3)) for _ in range(300)]
    cut = sorted(rows[:40])
    got = range_of([np.array(c) for c in zip(*rows, strict=True)], np.array(cut))
    assert got.tolist() == [sum(c < r for c in cut) for r in rows]


def _classes(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = _words(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label, links = list(range(len(texts))), [0] * len(texts)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, links


@pytest.mark.parametrize("small", [256, 3])
def test_ngram_classes(spark, small):
    texts = _texts()
    label, links = _classes(texts)
    out = ngram_join.ngram_classes(_docs(spark, texts), small=small, block=4 * small).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    if small > 100:
        assert [(r["class_id"], r["n_links"]) for r in out] == list(zip(label, links, strict=True))
    else:  # split further, runs may lose a link in ten thousand
        assert sum(r["class_id"] == x for r, x in zip(out, label, strict=True)) >= len(texts) - 1
    kept = ngram_join.one_of_each_class(_docs(spark, texts))
    bare = [i for i, t in enumerate(texts) if not _words(t or "")]
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({*label} - {*bare[1:]})


def test_recall_of_pairs_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(1)
    runs, found = ngram_join.runs_for(0.9999, 0.8), 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 180, dtype=np.uint64)
        b = np.append(a[:160], rng.integers(0, 2**63, 20, dtype=np.uint64))  # 160 of 200
        first = lambda s: {x for x, _, _ in ngram_join.paths(np.unique(s), runs)}
        found += bool(first(a) & first(b))
    assert found >= 299


@pytest.mark.parametrize(("similarity", "common", "own"), [(0.8, 160, 20), (0.5, 100, 50)])
def test_recall_of_paths_of_three_steps(similarity, common, own):
    import numpy as np

    rng = np.random.default_rng(2)
    runs, found = ngram_join.runs_for(0.99, similarity), 0
    for _ in range(1500):
        both = rng.integers(0, 2**63, common, dtype=np.uint64)
        a, b = (np.unique(np.append(both, rng.integers(0, 2**63, own, dtype=np.uint64))) for _ in range(2))
        found += bool({*ngram_join.paths(a, runs, similarity)} & {*ngram_join.paths(b, runs, similarity)})
    assert found >= 1485 - 12  # 0.99 within three standard deviations


def test_decontamination(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (12, 20, 45, 60)] + ["tiny", None, ""]
    bench = spark.createDataFrame([(10 + i, t, "x") for i, t in enumerate(items)] + [(None, items[1], "x")], "item_id long, text string, did string")
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[2].split()
    edited[20] = edited[20][:-1] + "z"
    texts = [filler(50), f"{filler(30)} {items[0]} {filler(30)}", filler(9) + "\n" + items[1].upper().replace(" ", "\n "), f"{filler(30)} {' '.join(edited)} {filler(3)}", items[3][:-40], None, "", filler(3000) + " " + items[3] + " " + filler(3000), items[0][: len(items[0]) // 2] + filler(20)]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.find_contamination(_docs(spark, texts), bench).collect()}
    assert got == {0: [], 1: [10], 2: [11, None], 3: [12], 4: [13], 5: [], 6: [], 7: [13], 8: []}
    assert sorted(r["doc_id"] for r in decontamination.without_contaminated(_docs(spark, texts), bench).collect()) == [0, 5, 6, 8]
    for blocks in (4, 1):  # several passes
        monkeypatch.setattr(decontamination, "BLOCKS_A_PASS", blocks)
        small = decontamination.with_items(_docs(spark, texts), bench, ["doc_id"], block_bytes=50)
        assert {r["doc_id"]: r["item_ids"] for r in small.collect()} == got


def _edit_distance_within(probe: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(probe, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_probes_are_found_exactly_within_their_budget():
    import numpy as np

    rng = random.Random(9)
    probe = bytes(rng.choice(b"abcdef ") for _ in range(90))
    index = decontamination.Index([(1, probe)])
    for _ in range(120):
        copy = bytearray(probe)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(copy))
            kind = rng.random()
            if kind < 0.34:
                copy[at] = rng.choice(b"xyz")
            elif kind < 0.67:
                del copy[at]
            else:
                copy.insert(at, rng.choice(b"xyz"))
        text = bytes(rng.choice(b"abcdef ") for _ in range(60)) + bytes(copy) + bytes(rng.choice(b"abcdef ") for _ in range(60))
        assert bool(index.search(np.frombuffer(text, np.uint8))) == (_edit_distance_within(probe, text) <= decontamination.budget(90))


def test_excerpts_are_found_at_every_offset():
    rng = random.Random(12)
    filler = lambda n: "".join(rng.choice("ABCDEFGHIJ ") for _ in range(n))
    for size in (95, 124, 160, 240, 394):
        item = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size)).replace(" ", "q ")[:size].strip()
        item = " ".join(item.split())
        index = decontamination.Index([(7, item.encode())], decontamination.LONG + decontamination.SHORT)
        cuts = [item[a : a + 80] for a in range(len(item) - 79)]
        texts = [" ".join((filler(50) + cut + filler(50)).upper().replace(cut.upper(), cut).split()) for cut in cuts]
        found = decontamination._found_items(index, texts)
        assert all(f == {7} for f in found), (size, [i for i, f in enumerate(found) if not f])
        shorter = [filler(50) + item[a : a + 60] + filler(50) for a in range(len(item) - 59)]
        assert not any(decontamination._found_items(index, shorter))


def test_excerpts_of_two_items_and_of_texts_without_spaces(spark):
    rng = random.Random(13)
    items = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(90)), "".join(rng.choice("abcdefgh ") for _ in range(240)), " ".join(["same"] * 50)]
    texts = ["x" * 30 + items[0][31:58] + "y" * 30, items[1][40:200] + " and " + items[0][50:80], "z " * 60, items[2][3:90]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.find_contamination(_docs(spark, texts), bench).collect()}
    assert got == {0: [0], 1: [0, 1], 2: [], 3: [2]}


def _labelled(seed=1, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(("idiot", "scummo", "scummer", "trash"))
        if i % 7 == 0:
            w.append(rng.choice(("women", "muslim", "gay")))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return rows


def test_toxicity(spark):
    import zlib

    rows = _labelled() + [(9000, None, 0), (9001, "", 1)]
    docs = _docs(spark, [t for _, t, _ in rows], [i for i, _, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [(got[i]["predicted"], y) for i, t, y in rows if got[i]["held_out"] and t]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    model = toxicity.fit(docs, labels)
    assert abs(model.score("hello women there") - model.score("hello men there")) < 0.05
    clean = toxicity.without_toxic(docs, model)
    assert clean.schema == docs.schema and clean.filter("text LIKE '%idiot%'").count() == 0


def test_identity_terms_that_go_with_labels_lose_their_weight(spark):
    rng = random.Random(2)
    rows = [(i, f"the {'women' if i % 2 else 'men'} {'idiot' if i % 2 and i % 8 else 'walk'} {rng.randint(0, 50)}", int(i % 2 and i % 8 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain, fair = toxicity.fit(docs, labels, swap_penalty=0.0), toxicity.fit(docs, labels, swap_penalty=20.0)
    gap = lambda m: abs(m.score("the women walk") - m.score("the men walk"))
    assert gap(fair) <= gap(plain) and fair.score("the men idiot") >= 0.5


def test_sentences_are_swapped_for_every_partner():
    got = toxicity.swaps_of("The women met. Nothing here!\nA gay man, too")
    women = {"the", "women", "met"}
    assert got[:3] == [(women, {"the", other, "met"}) for other in ("men", "girls", "boys")]
    assert len(got) == 3 + 4 + 3 and all(len(a ^ b) == 2 for a, b in got) and toxicity.swaps_of(None) == []


def test_mixing(spark):
    rng = random.Random(5)
    good, poor = ["lorem", "ipsum", "dolor", "sit", "amet"], ["x9", "q7", "##", "zz", "buy"]
    texts = [" ".join(rng.choice(good if i % 3 else poor) for _ in range(rng.randint(20, 60))) for i in range(240)] + [None, ""]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(150)] + [(None, 1, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels, {"good": 0.4, "poor": 0.6})
    assert out.columns == [*(c for c in docs.columns if c != "rate"), "n_tokens", "p_good", "p_poor", "rate"]
    rows = out.select("n_tokens", "p_good", "p_poor", "rate").collect()
    total = sum(r["n_tokens"] for r in rows)
    assert all(abs(r["p_good"] + r["p_poor"] - 1) < 1e-9 and r[3] >= 0 for r in rows)
    for name, share in (("p_good", 0.4), ("p_poor", 0.6)):
        assert abs(sum(r["n_tokens"] * r[name] * r[3] for r in rows) / total - share) < 1e-3
    right = [(r["p_good"] > 0.5) == bool(i % 3) for i, r in enumerate(out.orderBy("doc_id").select("p_good").limit(240).collect())]
    assert sum(right) >= 0.97 * 240


def test_rates_are_the_least_squares_solution(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 50, 200), rng.dirichlet([0.3, 0.3, 0.3], 200)
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "_n long, p_a double, p_b double, p_c double")
    targets = {"a": 0.9, "b": 0.1, "c": 0.0}
    u = mixing.fit_rates(members, ["a", "b", "c"], targets)
    rate = np.maximum(0, 1 - p @ np.array(u))
    held = members.withColumn("r", mixing.rate_column(["p_a", "p_b", "p_c"], u)).agg(F.sum(F.col("r") * F.col("_n") * F.col("p_a"))).first()[0]
    assert abs(held - (rate * n * p[:, 0]).sum()) < 1e-6
    slow = np.ones(200)
    for _ in range(30_000):  # plain projected gradient, for comparison
        miss = (slow * n) @ p / n.sum() - np.array([0.9, 0.1, 0.0])
        slow = np.maximum(0, slow - 0.3 * p @ miss)
    loss = lambda r: float((((r * n) @ p / n.sum() - np.array([0.9, 0.1, 0.0])) ** 2).sum())
    assert (rate >= 0).all() and loss(rate) <= loss(slow) + 1e-6
    met = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2})  # targets that can be met
    rate = np.maximum(0, 1 - p @ np.array(met))
    assert np.abs((rate * n) @ p / n.sum() - np.array([0.5, 0.3, 0.2])).max() < 1e-5


def test_similar_sets_in_blocks_of_any_size():
    import numpy as np

    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 400, n)) for n in (3, 40, 40, 200, 1)]
    sets = [np.unique(np.append(base[i % 5], rng.integers(0, 400, i % 3))).astype(np.uint64) for i in range(60)]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    for block, tokens in ((128, 1 << 15), (7, 1 << 15), (128, 90), (1, 1)):
        got = [(x, y) for xs, ys in ngram_join.similar(sets, 0.8, block, tokens) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
