"""Mixing, quality rules, license scans and chat rotation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keyweave.llm import chat, licenses, mixing, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string"


def docs(spark, *rows):
    """(doc_id, text, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, -1, "x") for i, t, s in rows], DOC)


# mixing ------------------------------------------------------------------------------


def corpus(spark, seed=1, n=400):
    r = random.Random(seed)
    sources = ["a", "b", "c", "d", None]
    return docs(spark, *[(i, " ".join(["w"] * r.randint(0, 60)), r.choices(sources, [60, 20, 2, 1, 5])[0]) for i in range(n)])


def filled(sizes, weights, cap=3):
    """Water-filling by hand: clamp and share again until nothing is above."""
    total, clamped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        share = (total - sum(cap * sizes[i] for i in clamped)) / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if share * weights[i] > cap * sizes[i]}
        if not over:
            return [cap * s if i in clamped else share * w for i, (s, w) in enumerate(zip(sizes, weights))]
        clamped |= over


def test_targets_are_water_filled_and_met(spark):
    rows = [r.asDict() for r in mixing.mix(corpus(spark)).collect()]
    source = {r.doc_id: r.source for r in corpus(spark).collect()}
    order = ["a", "b", "c", "d", None]
    sizes = [sum(r["size"] for r in rows if source[r["doc_id"]] == s) for s in order]
    want = filled(sizes, [5, 2, 1, 5, 2])
    for s, size, target in zip(order, sizes, want):
        own = [r for r in rows if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum(want) - sum(sizes)) < 1e-6


def test_mix_is_the_same_again_and_emits_the_copies(spark):
    c = corpus(spark)
    plan = {r.doc_id: r.copies for r in mixing.mix(c.repartition(7)).collect()}
    assert plan == {r.doc_id: r.copies for r in mixing.mix(c).collect()}
    out = mixing.mixed_documents(c)
    assert out.columns == c.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v}


def test_mix_edges(spark):
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    odd = docs(spark, (1, None, None), (1, None, None), (None, "a b", None), (None, "a b", "s"), (3, "", "s"), (4, "w " * 50_000, "t"))
    got = mixing.mix(odd).collect()
    assert len(got) == 6 and sorted(r.size for r in got) == [0, 0, 0, 2, 2, 50_000]
    assert mixing.mixed_documents(odd).columns == odd.columns


@pytest.mark.parametrize("digits", [1, 4])
def test_buckets_do_not_change_the_sample(spark, digits):
    c = corpus(spark, 3)
    copies = lambda **o: sorted((r.doc_id, r.copies) for r in mixing.mix(c, **o).collect())
    assert copies(digits=digits) == copies()


# quality -----------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_by_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n ", "a", "a b", "a b c", "a b c a b c", "x\n" * 9, "# | é\x0b\x85ü k", "l 1.\nl 1.\n\nl 1. "]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "#", "dd ", "\x1c"]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    got = {x.doc_id: x for x in quality.quality(docs(spark, *[(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == statistics(t), repr(t)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)


def test_lines_decide_what_stays(spark):
    r = random.Random(2)
    prose = "\n".join(" ".join(f"w{r.randint(0, 9999)}" for _ in range(12)) + "." for _ in range(10))
    menu = "\n".join("Home | News | Sport | More | About" for _ in range(3))
    d = docs(spark, (1, prose, "s"), (2, prose + "\n" + menu, "s"), (3, "\n".join(f"w{r.randint(0, 9999)} w{i}" for i in range(60)), "s"), (4, None, "s"), (5, prose, "s"), (5, prose, "s"))
    kept = quality.clean_documents(d)
    assert kept.columns == d.columns
    assert {(x.doc_id, x.text == prose) for x in kept.collect()} == {(1, True), (2, True), (5, True)} and kept.count() == 4
    assert quality.quality(d.limit(0)).count() == 0
    judged = {x.doc_id: x.kept for x in quality.quality(d).collect()}
    assert judged == {1: True, 2: True, 3: False, 4: False, 5: True}


@pytest.mark.parametrize("line, stays", [("A sentence.", True), ("A heading", False), ("He said “no.” ", True), ("Home | About | Contact.", False), ("We value your privacy policy.", False), ("## $$ %%.", False), ("", True), ("\t", True)])
def test_lines(spark, line, stays):
    assert spark.range(1).select(quality.line_passes(F.lit(line))).first()[0] is stays


# licenses ----------------------------------------------------------------------------


def test_phrases_and_passages(spark):
    mit = licenses.TEMPLATES["mit"]
    torn = mit.replace("free of charge, ", "").replace("without limitation", "with no limit")
    d = docs(
        spark,
        (1, "Released under the MIT License.", "s"),
        (2, "mit license mit license CC-BY 4.0", "s"),
        (3, "x " * 40 + mit + " tail", "s"),
        (4, torn.upper(), "s"),
        (5, None, "s"),
        (6, "", "s"),
        (7, " ".join(mit.split()[:12]), "s"),
        (8, "GNU General Public lice", "s"),
        (9, "Under the Apache License; and the gnu general public license", "s"),
        (1, "Released under the MIT License.", "s"),
        (10, "mitÉ license", "s"),
    )
    got = [tuple(r) for r in licenses.scan(d).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 11
    assert by[1] == (5, 1, 3, 3, "mit", "mit", 1.0)
    assert by[2][1:6] == (3, 0, 4, "cc-by,mit", "cc-by,mit")
    assert by[3][1] == 0 and by[3][5] == "mit" and by[3][6] == 1.0
    assert by[4][5] == "mit" and 0.6 <= by[4][6] < 1
    assert by[5] == by[6] == (0, 0, None, None, "", "", 0.0)
    assert by[7][5] == "" and by[8][1] == 0 and by[10][1] == 0
    assert by[9][4] == "apache,gpl" and by[9][1] == 2
    assert licenses.scan(d.limit(0)).count() == 0


# chat --------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, start string, block long"


def turns(spark, *rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], TURN)


def test_every_speaker_has_a_view(spark):
    t = turns(spark, (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 4, None, "?"))
    got = chat.rotate(t).collect()
    views = {}
    for r in sorted(got, key=lambda r: r.start):
        views.setdefault(r.perspective, []).append(r)
    assert set(views) == {"ann", "bob", "unknown"}
    for who, rows in views.items():
        text = "".join(r.rendered for r in rows)
        assert len(rows) == 5 and text.startswith("<|system|>\nBe kind.\n")
        assert all(text[r.start : r.end] == r.rendered for r in rows)
        assert all(r.mask == (r.name == who) == (r.role == "assistant") for r in rows)
    assert views["ann"][2].rendered == "<|user name=bob|>\nHello\n" and views["ann"][1].rendered == "<|assistant|>\nHi\n"


def test_long_conversations_ties_and_edges(spark):
    long = turns(spark, *[(7, i, "ab"[i % 2], "t" * (i % 5)) for i in range(300)], (7, 5, "a", "tie"), (7, 5, "a", "tie"))
    rows = sorted((r for r in chat.rotate(long, block=16).collect() if r.perspective == "a"), key=lambda r: r.start)
    assert len(rows) == 302 and all(x.end == y.start for x, y in zip(rows, rows[1:])) and rows[0].start == 0
    assert sorted(map(tuple, chat.rotate(long, block=16).collect())) == sorted(map(tuple, chat.rotate(long).collect()))
    assert chat.rotate(long.limit(0)).count() == 0
    assert chat.rotate(turns(spark, (1, 0, "system", "x"))).count() == 0
    assert chat.rotate(turns(spark, (None, None, "a", "x"), (None, 1, "b", "y"))).count() == 4
