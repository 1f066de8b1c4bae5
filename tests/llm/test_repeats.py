"""Substring deduplication, periodic runs and whitening against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vettica.llm import periodic, queries, substring, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, copy string, begin long, key string, n_words long, runs string"


def rows(*texts):
    return [(i, t, "en", "c", 1, "k", 2, "r") for i, t in enumerate(texts)]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = "word " * 30_000 + "a" * 60_000


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empties, a very long text, ties, repeats, and clashing extra columns."""
    found = rows(None, "", " \n\t", LONG, SAME, SAME, "three short words", "three short words", f"{SAME} and more {SAME}")
    return spark.createDataFrame([*found, (4, SAME, *[None] * 6), (None, SAME, *[None] * 6), (None, None, *[None] * 6)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- substring deduplication --------------------------------------------------


def removed_by_brute_force(documents, least=substring.LEAST):
    """Of (doc_id, text) rows: (doc_id, words, removed words, kept text)."""
    earliest = {}
    for doc, text in documents:
        words = split(text)
        for i in range(len(words) - least + 1):
            window = tuple(words[i : i + least])
            if doc is not None:
                earliest[window] = min(doc, earliest.get(window, doc))
    for doc, text in documents:
        words = split(text)
        gone = set()
        for i in range(len(words) - least + 1):
            if doc is not None and earliest[tuple(words[i : i + least])] < doc:
                gone.update(range(i, i + least))
        yield doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)


def ordered(found):
    return sorted(found, key=str)


def cleaned(frame):
    return ordered((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame).collect())


def check_repeats(frame):
    documents = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert cleaned(frame) == ordered(removed_by_brute_force(documents))


def test_repeats_on_edge_rows(edges, empty):
    check_repeats(edges)
    assert cleaned(empty) == []
    assert substring.find_repeats(empty).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_shared_and_altered_passages(spark, seed):
    # few words, so that anchors are common and their surroundings differ in many ways
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range((2, 3, 6, 40)[seed])]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(10, 60))] for _ in range(6)]
    documents = []
    for doc in range(80):
        text = []
        for _ in range(draw.randint(0, 4)):
            part = list(draw.choice(passages))
            for _ in range(draw.randint(0, 2)):
                part[draw.randrange(len(part))] = draw.choice(vocabulary)
            begin = draw.randrange(len(part))
            text += part[begin : begin + draw.randint(5, 50)] + [f"x{draw.randrange(50)}"] * draw.randint(0, 3)
        documents.append((draw.randint(0, 60) if doc % 7 == 0 else doc, " ".join(text)))
    check_repeats(spark.createDataFrame(documents, "doc_id long, text string").repartition(5))


def test_repeats_name_an_earlier_document_and_its_words(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: split(r.text) for r in frame.collect()}
    found = substring.find_repeats(frame).collect()
    assert found
    for r in found:
        assert r.first_id < r.doc_id and r.end - r.begin >= substring.LEAST
        assert texts[r.doc_id][r.begin : r.end] == texts[r.first_id][r.first_begin : r.first_begin + r.end - r.begin]


def test_many_documents_around_one_passage_make_rows_not_pairs(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    documents = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(600)]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    found = substring.find_repeats(frame)
    assert found.count() < 600 * 60
    assert {(r.doc_id, r.n_removed) for r in substring.remove_repeats(frame).collect()} == {(i, 60 if i else 0) for i in range(600)}


def test_repeats_query_matches_brute_force(spark):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = {(d, n, gone, sha(kept)) for d, n, gone, kept in removed_by_brute_force(documents)}
    assert {tuple(r) for r in queries.op11_substring_dedup(spark, FOLDER).collect()} == want


# --- periodic runs ------------------------------------------------------------


def runs_by_brute_force(codes):
    """Every stretch of the definition, by trying all periods at all places."""
    found, count = {}, len(codes)
    for period in range(1, count // 3 + 1):
        start = 0
        while start + period < count:
            end = start + period
            while end < count and codes[end] == codes[end - period]:
                end += 1
            if end - start >= max(24, 3 * period):
                found.setdefault((start, end), period)
            start = max(start + 1, end - period + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    draw = random.Random(seed)
    for _ in range(150):
        codes = []
        while len(codes) < draw.choice((10, 60, 250)):
            block = [draw.randrange(draw.choice((1, 2, 3, 9))) for _ in range(draw.choice((1, 2, 3, 5, 8, 13, 17, 40)))]
            codes += block * draw.choice((1, 1, 2, 3, 4, 9, 30))
            if draw.random() < 0.3 and codes:
                codes[draw.randrange(len(codes))] = 99
            if draw.random() < 0.3:  # periods of periods
                codes = codes[-draw.randint(1, len(codes)) :] * draw.choice((2, 3, 4))
            codes = codes[:900]
        assert periodic.runs(np.array(codes)) == runs_by_brute_force(codes)


def test_runs_of_fibonacci_and_constant_sequences():
    one, two = [0], [0, 1]
    while len(two) < 1500:
        one, two = two, two + one
    assert periodic.runs(np.array(two)) == runs_by_brute_force(two)
    assert periodic.runs(np.zeros(200_000, int)) == [(0, 200_000, 1)]
    assert periodic.runs(np.arange(100) // 2) == [] and periodic.runs(np.zeros(0, int)) == []
    assert periodic.runs(np.zeros(23, int)) == [] and periodic.runs(np.zeros(24, int)) == [(0, 24, 1)]


def test_runs_on_edge_rows(edges, empty):
    found = {(r.doc_id, r.n_words): (r.runs, r.collapsed) for r in periodic.find_runs(edges).collect()}
    assert found[0, 0] == ([], "") and found[1, 0] == ([], "") and found[2, 0] == ([], "") and found[None, 0] == ([], "")
    assert [tuple(r) for r in found[3, 30_001][0]] == [(0, 30_000, 1)] and found[3, 30_001][1] == "word " + "a" * 60_000
    assert found[4, 14] == ([], SAME) and len(found) == 11
    assert periodic.find_runs(edges).count() == 12 and periodic.find_runs(empty).collect() == []


def runs_digest(doc, text):
    words = split(text)
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_brute_force(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *last, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_matches_brute_force(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    texts = [r for r in texts if len(split(r.text)) < 4000]
    found = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert [found[r.doc_id] for r in texts] == [runs_digest(r.doc_id, r.text) for r in texts]
    assert len(found) >= len(texts) and any(r[1] for r in found.values())


# --- whitening ----------------------------------------------------------------


def vectors(spark, entries, kind="array<double>"):
    return spark.createDataFrame([(i, e, 0) for i, e in enumerate(entries)], f"vec_id long, v {kind}, whitened int").repartition(3)


def test_whitening_matches_eigenvectors_of_the_covariance(spark):
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(400, 6)) @ draw.normal(size=(6, 6)) * [1, 10, 1, 0.01, 1, 1] + 1e6
    model = whitening.fit(vectors(spark, rows.tolist()), "v")
    centred = rows - rows.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / 400)
    assert np.allclose(model.eigenvalues, values[::-1], rtol=1e-7)
    assert np.allclose(np.abs((axes[:, ::-1] * model.components).sum(axis=0)), 1, atol=1e-9)
    assert abs(sum(model.explained) - 1) < 1e-12
    found = whitening.whiten(vectors(spark, rows.tolist()), "v", model).orderBy("vec_id").collect()
    whitened = np.array([r.whitened for r in found])
    want = centred @ model.components / np.sqrt(model.eigenvalues)
    assert np.allclose(whitened, want, atol=1e-6)
    assert whitening.identity_error(vectors(spark, rows.tolist()), "v", model) < 1e-8


def test_whitening_of_rows_that_do_not_fill_the_space(spark):
    draw = np.random.default_rng(2)
    flat = draw.integers(-500, 500, size=(90, 3))
    rows = np.c_[flat, flat[:, 0] + flat[:, 1], np.full(90, 7), flat[:, 2]] + 1_000_000
    model = whitening.fit(vectors(spark, rows.tolist(), "array<long>"), "v")
    assert len(model.eigenvalues) == 3 and model.sums == [int(s) for s in rows.sum(axis=0)]
    assert np.allclose(model.eigenvalues, np.sort(np.linalg.eigvalsh(np.cov(rows.T, bias=True)))[::-1][:3], rtol=1e-9)
    assert whitening.identity_error(vectors(spark, rows.tolist(), "array<long>"), "v", model) < 1e-9


def test_whitening_on_edge_rows(spark):
    nothing = float("nan"), float("inf"), -float("inf"), None
    broken = [None, [], *[[1.0, 2.0, x] for x in nothing], [1.0, 2.0]]
    good = [[1.0, 2.0, 3.0], [4.0, 1.0, 1.0], [4.0, 1.0, 1.0], [0.0, 7.0, 2.0]]
    model = whitening.fit(vectors(spark, broken + good), "v")
    assert model.count == 4 and model.sums == [9, 11, 7]
    found = whitening.whiten(vectors(spark, broken + good), "v", model)
    assert found.columns == ["vec_id", "v", "whitened"]
    assert sorted(r.vec_id for r in found.collect()) == [7, 8, 9, 10]
    assert whitening.fit(vectors(spark, broken[:6]), "v") is None
    assert whitening.fit(vectors(spark, [[1.0, 1.0]] * 3), "v") is None
    assert whitening.fit(vectors(spark, [[1.0, 1.0]]).limit(0), "v") is None


def test_whitening_query_matches_eigenvectors(spark):
    raw = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = {r.vec_id: r.embedding for r in raw if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    x = {i: np.floor(64 * np.array(v, float)).astype(int) + 1_000_000 for i, v in rows.items()}
    table = np.array(list(x.values()))
    n, sums = len(table), table.sum(axis=0)
    centred = table - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    found = queries.op13_embedding_whitening(spark, FOLDER).collect()
    assert len(found) == 32 * n and {r.n for r in found} == {n}
    by_component = {}
    for r in found:
        difference = [int(v) * n - int(s) for v, s in zip(x[r.vec_id], sums, strict=True)]
        assert r.deviation == sum(d * d for d in difference)
        by_component.setdefault(r.component, {})[r.vec_id] = r
        assert abs(r.explained * values.sum() / values[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    for component, members in by_component.items():
        want = np.array([(x[i] - sums / n) @ axes[:, component - 1] for i in members]) / np.sqrt(values[component - 1])
        got = np.array([r.whitened for r in members.values()])
        assert np.abs(got - np.sign(got @ want) * want).max() < 1e-7
