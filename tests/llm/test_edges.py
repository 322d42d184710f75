"""Columns whose names operators might use, long texts and lists, rules and sources beyond a task's."""

import random
import time

import pytest
from pyspark.sql import functions as F

from keyweave.llm import bpe, chat, licenses, mixing, quality, urls
from keyweave.llm.queries import tokenizer
from keyweave.llm.stage import drop_staged, numbered, scratch, staged, written
from tests.llm.test_native import docs, filled, turns

CLASHES = ("__n_words", "__kept", "__lines", "__key", "__source", "__words", "__n", "row", "clean", "kept", "copies", "last_key", "target")


def test_columns_of_any_name_pass_through(spark):
    prose = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) + "." for i in range(8))
    d = docs(spark, (1, prose, "s"), (2, prose + " More.", None)).drop("copies").withColumns({c: F.lit(c + "!") for c in CLASHES})
    for out in (quality.clean_documents(d), mixing.mixed_documents(d)):
        rows = out.collect()
        assert out.columns == d.columns and rows and all(r[c] == c + "!" for r in rows for c in CLASHES)
    assert {r.kept for r in quality.quality(d).collect()} == {True}
    assert mixing.mix(d).count() == 2 and licenses.scan(d).count() == 2
    assert bpe.digest(d, *tokenizer()).count() == 2


@pytest.mark.parametrize(
    "line, stays",
    [
        (" ".join(["word"] * 80) + " about our cookie policy " + " ".join(["word"] * 80), True),
        ("Read our cookie policy and the privacy policy and the terms of use, all rights reserved, here and now.", False),
        ("Please read our cookie policy.", False),
        ("All words of a line of prose that is long enough and ends.", True),
    ],
)
def test_phrases_are_weighed_by_the_line(spark, line, stays):
    assert spark.range(1).select(quality.line_passes(F.lit(line))).first()[0] is stays


def test_long_texts_are_judged_and_scanned_whole(spark):
    r = random.Random(3)
    text = "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(14)) + "." for _ in range(9000))
    d = docs(spark, (1, text + " Under the MIT License", "s"), (2, text.replace("\n", " "), "s"))
    got = {x.doc_id: x for x in quality.quality(d).collect()}
    assert got[1].n_words == 9000 * 14 + 4 and got[2].n_words == 9000 * 14 and got[1].kept and got[2].kept
    assert {x.doc_id: x.base_labels for x in licenses.scan(d).collect()} == {1: "mit", 2: ""}


def test_spans_are_verified_by_their_words(spark, monkeypatch):
    mit = licenses.TEMPLATES["mit"].split()
    opening, shuffled = " ".join(mit[:60]), list(mit)
    random.Random(1).shuffle(shuffled)
    d = docs(spark, (1, opening, "s"), (2, " ".join(shuffled), "s"), (3, " ".join(mit), "s"))
    got = {x.doc_id: x for x in licenses.scan(d).collect()}
    assert got[1].labels == "mit" and got[1].score < 0.6  # a passage of a whole license
    assert got[2].labels == "" and got[3].score == 1.0
    # grams with the same hashes but other words do not count
    known = licenses.template_grams
    monkeypatch.setattr(licenses, "template_grams", lambda *a: known(*a).withColumn("last", F.lit("other")))
    assert {x.labels for x in licenses.scan(d).collect()} == {""}


def test_many_sources_are_filled_in_one_pass(spark):
    r = random.Random(6)
    sizes = [r.choice([1, 2, 5, 100, 3000]) for _ in range(300)]
    weights = [r.choice([5.0, 2.0, 1.0]) for _ in sizes]
    table = spark.createDataFrame([(f"s{i:03}", n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
    got = [x.target for x in mixing.water_fill(table).orderBy("source").collect()]
    assert got == pytest.approx(filled(sizes, weights))
    most = [x.target for x in mixing.water_fill(table, total=10.0**9).orderBy("source").collect()]
    assert most == pytest.approx([3.0 * n for n in sizes])
    assert mixing.water_fill(table.limit(0)).count() == 0


def test_rules_beyond_what_travels_are_joined(spark):
    r = random.Random(2)
    rules = urls.DEFAULT + tuple(urls.Rule("block", rf"(^|[./-])bad{i}[./-]") for i in range(40)) + (urls.Rule("block", "evil+"), urls.Rule("block", "/no+pe"), urls.Rule("allow", "evil"))
    parts = ["a.com/en/7", "example.com/en/7", "x.example.net/de/8", "bad7.org", "q.test/bad11/x", "q.test/eviiil", "q.test/evillll", "q.test/nooope", "casino.test/", "y.org/es/1"]
    rows = [(i, f"http://{r.choice(['', 'www.'])}{r.choice(parts)}") for i in range(60)] + [(60, None), (61, "none"), (0, "http://bad7.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    one = sorted(map(tuple, urls.judge(pages, rules).collect()), key=str)
    assert sorted(map(tuple, urls.judge(pages, rules, travel=2).collect()), key=str) == one
    assert {x[4] for x in one} == {"block", "allow"} and urls.judge(pages.limit(0), rules, travel=2).count() == 0
    assert sorted(map(tuple, urls.judge(pages, (), travel=0).collect()), key=str) == sorted(map(tuple, urls.judge(pages, ()).collect()), key=str)


def test_long_lists_of_patterns_are_compiled_once():
    rules = [urls.Rule("block", rf"(^|[./-])bad{i}[./-]") for i in range(2000)]
    urls.fitting("q.test/x", rules)
    started = time.process_time()
    for _ in range(20):
        urls.fitting("q.test/x", rules)
    assert time.process_time() - started < 2


def test_cutting_a_text_is_linear(spark):
    text = "word and another, " * 40_000
    d = docs(spark, (1, text, "s"))
    got = bpe.digest(d, *tokenizer(), chunk=2048).first()
    assert got.n_tokens == len(bpe.encode_text(text, *tokenizer()))


def test_turns_meet_their_speakers_in_blocks(spark):
    rows = [(1, i, "abc"[i % 3] if i > 40 else "a", f"t{i}") for i in range(100)]
    got = chat.rotate(turns(spark, *rows), block=8)
    assert got.count() == 300 and {(x.perspective, x["count"]) for x in got.groupBy("perspective").count().collect()} == {("a", 100), ("b", 100), ("c", 100)}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chat.rotate(turns(spark, *rows)).collect()))


def test_staged_tables_go(spark):
    import os
    from urllib.parse import urlparse

    with scratch():
        one = staged(spark.range(3), "one")
        folder = urlparse(one.inputFiles()[0].rsplit("/", 1)[0]).path
        assert os.path.isdir(folder)
        two = written(lambda: staged(spark.range(5), "inner").union(one), "two")
        assert two.count() == 8
    assert not os.path.isdir(folder)
    three = staged(spark.range(2), "three")
    folder = urlparse(three.inputFiles()[0].rsplit("/", 1)[0]).path
    drop_staged(three)
    assert not os.path.isdir(folder)


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.x == r.at for r in numbered(df, [F.col("x")], "at").collect())


def test_every_phrase_holds_a_stem():
    assert all(any(stem in phrase for stem in quality.STEMS) for phrase in quality.BOILERPLATE)
