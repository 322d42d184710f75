"""Evidence fusion against plain Python; labels train and are no evidence; any number of languages."""

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyweave.llm import langid, queries
from tests.llm.test_texts import WORDS, docs, prose

SMALL = "/root/testdata/sf0.001"


def by_hand(rows, model):
    """(language, probability) of (text, declared, address, host): the product of the four, normalised."""
    numbers, scores, known = langid._judged(pa.array([r[0] or "" for r in rows]), model)
    names, n = model.languages, len(model.languages)

    def suffix(address):
        host = (address or "").lower().split("://")[-1]
        for stop in "/?#:":
            host = host.split(stop)[0]
        return host.rsplit(".", 1)[1] if "." in host else ""

    shares = [[math.exp(s) / sum(math.exp(x) for x in row) for s in row] for row in scores]
    counted = [i for i in range(len(rows)) if known[i] and numbers[i]]
    whole = [(sum(shares[i][k] for i in counted) + 1) / (len(counted) + n) for k in range(n)]

    def of_suffix(s):
        own = [i for i in counted if suffix(rows[i][2]) == s]
        return [(sum(shares[i][k] for i in own) + langid.SUFFIX_SMOOTHING * whole[k]) / (len(own) + langid.SUFFIX_SMOOTHING) for k in range(n)]

    def of_host(h):
        own = [i for i in counted if (rows[i][3] or "") == h]
        if not own:
            return whole
        base = of_suffix(min(suffix(rows[i][2]) for i in own))
        return [(sum(shares[i][k] for i in own) + langid.HOST_SMOOTHING * base[k]) / (len(own) + langid.HOST_SMOOTHING) for k in range(n)]

    out = []
    for i, (_, declared, address, host) in enumerate(rows):
        if not known[i]:
            out.append(("und", 0.0))
            continue
        logs = [scores[i][k] + math.log(of_host(host or "")[k]) for k in range(n)]
        for k, name in enumerate(names):
            if declared in names:
                logs[k] += math.log(langid.DECLARED_RIGHT if declared == name else (1 - langid.DECLARED_RIGHT) / (n - 1))
            meant = langid.SUFFIXES.get(suffix(address))
            if meant in names:
                logs[k] += math.log(langid.SUFFIX_RIGHT if meant == name else (1 - langid.SUFFIX_RIGHT) / (n - 1))
        best = max(logs)
        out.append((names[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)))
    return out


def test_fusion_by_brute_force(spark):
    r = random.Random(13)
    model = langid.train(docs(spark, *[(i, prose(x, 40, r), x, None) for i, x in enumerate(r.choices(list(WORDS), k=150))]))
    hosts = ["https://a.example.de/x", "b.example.fr", "c.example.org:80", "d.uk", None, ""]
    rows = []
    for _ in range(120):
        language = r.choice(list(WORDS))
        text = r.choice([prose(language, r.randint(1, 4), r), prose(language, 30, r), "", None, "123", "zzqx vvkj qqwx jjzz xkqv zzqx"])
        rows.append((text, r.choice([None, "de", "fr", "en", "xx", ""]), r.choice(hosts), r.choice(["h1", "h2", "h3", None])))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, said string, url string, site string")
    got = {x.doc_id: (x.lang, x.probability) for x in langid.identify(df, model, declared="said", address="url", host="site").collect()}
    # hosts' suffixes here vary by row: the smallest of a host's counts, in both
    for i, (language, probability) in enumerate(by_hand(rows, model)):
        assert got[i][0] == language or abs(got[i][1] - probability) < 1e-9
        assert got[i][1] == pytest.approx(probability, abs=1e-6), rows[i]


def test_labels_are_no_evidence(spark):
    r = random.Random(2)
    texts = [(i, prose(x, r.randint(1, 30), r), x, "src") for i, x in enumerate(r.choices(list(WORDS), k=120))]
    labelled = docs(spark, *texts)
    model = langid.train(labelled)
    shown = ["doc_id", "lang", "probability", "kept"]
    with_labels = sorted(map(tuple, langid.identify(labelled, model).select(*shown).collect()))
    without = sorted(map(tuple, langid.identify(labelled.withColumn("lang", F.lit("fr")), model).select(*shown).collect()))
    assert with_labels == without


def test_every_label_is_a_language(spark):
    r = random.Random(5)
    letters = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    rows = [(k * 100 + j, " ".join(f"{x}{r.randrange(9)} {x}o" for _ in range(12)), f"l{k}", None) for k, x in enumerate(letters) for j in range(4)]
    labelled = docs(spark, *rows)
    model = langid.train(labelled, sample=3)
    assert model.languages == tuple(sorted(f"l{k}" for k in range(70)))
    assert labelled.count() == 280 and langid.training_rows(labelled, "text", "lang", "doc_id", 3).groupBy("label").count().filter("count <> 3").count() == 0
    assert langid.train(labelled.limit(0)).languages == ("und",)


@pytest.mark.parametrize(
    "text, language",
    [
        ("<!DOCTYPE html><html class=x lang='de-AT'><body>", "de"),
        ("<html xml:lang=fr>", "fr"),
        ('<meta http-equiv="Content-Language" content="es">', "es"),
        ("<html data-lang=x>", None),
        ("html lang=de, without markup", None),
        ("", None),
        (None, None),
    ],
)
def test_markup_declares(spark, text, language):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(langid.declared_in(F.col("text"))).first()[0] == language


def test_columns_of_any_name_pass_through(spark):
    r = random.Random(1)
    d = docs(spark, *[(i, prose(x, 30, r), x, "s") for i, x in enumerate(r.choices(list(WORDS), k=60))])
    model = langid.train(d)
    odd = d.withColumns({"__host": F.lit("mine"), "__scores": F.lit(1), "row": F.lit("r"), "__lang": F.lit("x")})
    kept = langid.identified_documents(odd, model)
    assert kept.columns == odd.columns and {(x["__host"], x["__scores"], x.row, x["__lang"]) for x in kept.collect()} == {("mine", 1, "r", "x")}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_pages_are_in_the_language_their_text_is_in(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {x.page_id: x for x in queries.page_language_id(spark, SMALL).collect()}
    assert len(got) == pages.count() and sum(x.kept for x in got.values()) >= 0.9 * len(got)
    declared = {x.page_id: x.d for x in pages.select("page_id", langid.declared_in(F.col("html")).alias("d")).collect()}
    agree = [x.lang == declared[i] for i, x in got.items() if declared[i] and x.lang != "und"]
    assert sum(agree) >= 0.9 * len(agree)
    text = [x.lang == x.text_lang for x in got.values()]
    assert sum(text) >= 0.9 * len(text)
