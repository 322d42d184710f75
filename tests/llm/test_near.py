"""Near-duplicates of documents and of embeddings, and the components of their links."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyweave.llm import components, embeddings, minhash


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_banded_alignment(a, b, band):
    d = distance(a, b)
    assert minhash.edit_distance(a, b, band) == (d if d <= band else None)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


DOC = "doc_id long, text string, n int, digest string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], DOC)


def linked(a, b):
    """The rule, without bands or counts that come first."""
    d, n = distance(a, b), max(len(a), len(b))
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    return d <= 0.1 * n or (d <= 0.2 * n and (x & y).total() >= 0.8 * (x | y).total())


def test_the_rule():
    r = random.Random(3)
    for _ in range(300):
        a = [f"w{r.randrange(30)}" for _ in range(r.randrange(5, 40))]
        b = edited(a, r.choice([0.05, 0.1, 0.2]), r)
        if r.random() < 0.5:
            b = b + [f"v{r.randrange(30)}" for _ in range(r.randrange(0, 10))]
        assert minhash.similar(minhash.Text(" ".join(a)), minhash.Text(" ".join(b))) == linked(a, b)


def edited(words, share, r):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        out[r.randrange(len(out))] = f"n{r.randrange(10**6)}"
    return out


def test_near_copies_are_found_and_others_left(spark):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    passage = text(60)
    for g in range(40):
        base = text(r.randrange(60, 300))
        for k in range(r.choice([1, 2, 3, 6])):
            rows.append((len(rows), " ".join(base if k == 0 else edited(base, 0.015, r))))
            group[rows[-1][0]] = g
    for k in range(60):  # a passage that many documents share makes none of them a copy
        rows.append((len(rows), " ".join(text(70) + passage + text(70))))
        group[rows[-1][0]] = 1000 + k
    rows += [(len(rows), rows[0][1] + " \n"), (len(rows) + 1, rows[0][1].upper())]
    group |= {rows[-2][0]: 0, rows[-1][0]: 0}
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    first = {}
    for i, _ in rows:
        first.setdefault(group[i], i)
    assert got == {i: first[group[i]] for i, _ in rows}


def test_links_by_brute_force(spark):
    r = random.Random(12)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(80)]
        rows += [(len(rows) + k, " ".join(edited(base, s, r))) for k, s in enumerate((0.01, 0.02, 0.03, 0.05))]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    words = {i: t.split() for i, t in rows}
    parent = {i: i for i in words}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in words:
        for j in words:
            if i < j and linked(words[i], words[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in words}


def test_crowds_just_below_the_threshold_stay_apart_but_for_their_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(21)
    passage = [f"p{i}" for i in range(160)]
    rows, pairs = [], {}
    for g in range(60):  # four fifths of each text are the passage
        rows.append((len(rows), " ".join(passage + [f"w{r.randrange(9999)}" for _ in range(40)])))
        if g % 10 == 0:
            pairs[len(rows)] = len(rows) - 1
            rows.append((len(rows), " ".join(edited(rows[-1][1].split(), 0.01, r))))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: pairs.get(i, i) for i, _ in rows}


def test_documents_at_the_edge(spark):
    long = " ".join(f"v{i % 977} u{i}" for i in range(20_000))
    d = docs(spark, [(3, "a b"), (1, "A  b"), (5, None), (6, ""), (7, None), (None, "a b"), (8, long), (9, long + " more"), (8, long), (10, "a b c"), (4, "one")])
    got = sorted(((x.doc_id, x.class_id, x.kept) for x in minhash.near_duplicates(d).collect()), key=str)
    want = [(3, 1, False), (1, 1, True), (5, 5, True), (6, 6, True), (7, 7, True), (None, None, True), (8, 8, True), (9, 8, False), (8, 8, True), (10, 10, True), (4, 4, True)]
    assert got == sorted(want, key=str)
    left = minhash.first_documents(d)
    assert left.columns == d.columns and sorted(str(x.doc_id) for x in left.collect()) == sorted(["1", "5", "6", "7", "None", "8", "10", "4"])
    assert minhash.near_duplicates(d.limit(0)).count() == 0 and minhash.first_documents(d.limit(0)).count() == 0


def test_occurrences_and_order_count():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3], np.uint64)
    plain = minhash.kmers(words, 3)
    labels = minhash.labelled(plain)
    assert len(set(plain)) == 3 and len(set(labels)) == 7 and labels[0] == plain[0]
    other = np.concatenate([words[5:], words[:5]])
    assert minhash.sketch(words).shape == (minhash.ENTRIES,) and (minhash.sketch(words) == minhash.sketch(words.copy())).all()
    assert not (minhash.sketch(np.arange(50, dtype=np.uint64)) == minhash.sketch(np.arange(50, dtype=np.uint64)[::-1].copy())).any() and len(other) == 9


# embeddings --------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, node long, copies int"


def brute(rows, cosine=embeddings.COSINE):
    ok = {i: (np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    n, parent = {i: 0 for i in ok}, {i: i for i in ok}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (v, a) in ok.items():
        for j, (w, b) in ok.items():
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                n[i] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (n.get(i, 0), find(i) if i in ok else i) for i, _, _ in rows}


def clouds(seed, groups, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for size in groups:
        centre = r.normal(size=dim)
        for _ in range(size):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + r.normal(size=dim) * 0.05], int(r.integers(0, 2))))
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_links_are_those_of_all_pairs(spark, block):
    rows = clouds(1, [1] * 120 + [2, 3, 5, 40])
    rows += [(len(rows) + k, rows[130][1], rows[130][2]) for k in range(4)]  # equal vectors
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0] * 8, 1), (907, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VEC)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert got == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(None, rows[0][1], 1, 0, 0), (5, rows[0][1], 1, 0, 0)], VEC)).count() == 2


def test_cells_that_are_not_visited_hold_nothing_near():
    rows = clouds(3, [1] * 300 + [4] * 30)
    x = embeddings.unit([v for _, v, _ in rows])
    index = embeddings.MultiIndex(x[:150], embeddings.COSINE, 1.0, 8)
    places = index.places(x)
    near = x @ x.T >= embeddings.COSINE
    for i, j in zip(*np.nonzero(near)):
        assert places[j][0] in places[i][1]
    visited = np.mean([len(p[1]) for p in places])
    assert visited < 64  # of 64 cells


def test_traversal_is_in_order_of_the_bound():
    left, right = np.array([0.0, 0.3, 0.1]), np.array([0.2, 0.0])
    got = embeddings.traverse(left, right, 0.31)
    sums = [left[a] + right[b] for a, b in got]
    assert sums == sorted(sums) and set(got) == {(a, b) for a in range(3) for b in range(2) if left[a] + right[b] <= 0.31}


@pytest.mark.parametrize("cosine", [0.98, 0.9])
def test_the_target_recall_is_reached(cosine):
    rows = clouds(5, [1] * 1500 + [6] * 150, dim=32)
    x, labels = embeddings.unit([v for _, v, _ in rows]), np.array([lab for _, _, lab in rows])
    near = np.triu((x @ x.T >= cosine) & (labels[:, None] == labels[None, :]), 1)
    visits = {}
    for recall in (0.9, 0.99, embeddings.RECALL, 1.0):
        index = embeddings.MultiIndex(x[::2], cosine, recall, 16, labels[::2])
        places = index.places(x)
        met = [places[j][0] in places[i][1] if places[i][0] <= places[j][0] else places[i][0] in places[j][1] for i, j in zip(*np.nonzero(near))]
        assert len(met) > 500 and np.mean(met) >= recall - 0.02, recall
        visits[recall] = np.mean([len(p[1]) for p in places])
    assert visits[0.9] < visits[0.99] <= visits[embeddings.RECALL] < visits[1.0]


def test_turned_vectors_keep_the_cosine():
    x = embeddings.unit(np.random.default_rng(2).normal(size=(50, 8)))
    y = embeddings.turned(x, 0.98, np.random.default_rng(3))
    assert np.allclose((x * y).sum(axis=1), 0.98) and np.allclose((y * y).sum(axis=1), 1)


def test_large_and_small_components_keep_their_links(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.001e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 0.0], 1), (5, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_rows_that_repeat_a_vector_are_one(spark):
    v, w, far = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, v, 1), (1, v, 1), (2, far, 1), (3, v, 1), (4, w, 1), (4, far, 1), (1, None, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    # of 4's vectors the smaller one, [0, 0, 1], counts
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True)] * 3 + [(2, 1, 2, True), (3, 1, 1, False)] + [(4, 1, 2, False)] * 2


def test_crowded_cells_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TOGETHER", 2)
    monkeypatch.setattr(embeddings, "CROWD", 2)
    rows = clouds(7, [90, 40] + [1] * 60) + [(500 + i, [float(i % 3), 1.0, 0.0], 1) for i in range(30)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VEC)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=4).collect()} == brute(rows)


def test_groups_of_a_block():
    near = np.zeros((4, 3), bool)
    near[[0, 1, 1, 3], [0, 0, 1, 2]] = True
    left, right = embeddings.groups_of(near, np.array([9, 8, 7, 6]), np.array([5, 10, 11]))
    assert list(left) == [5, 5, 7, 6] and list(right) == [5, 5, 6]


def test_leaders_of_many_and_long_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FOLLOWERS", 4)
    monkeypatch.setattr(minhash, "BLOCK_WORDS", 300)
    r = random.Random(4)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join(edited(base, 0.01, r))) for i in range(40)]
    rows += [(100 + i, " ".join([f"p{k}" for k in range(160)] + [f"w{r.randrange(9999)}" for _ in range(40)])) for i in range(20)]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 0 if i < 40 else i for i, _ in rows}


def test_hubs_meet_their_links_without_being_gathered(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    links = [(0, i) for i in range(1, 30)] + [(i, i + 100) for i in range(1, 30)] + [(500, 501), (501, 502), (502, 503)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(30)} | {i + 100: 0 for i in range(1, 30)} | {i: 500 for i in range(500, 504)}
