"""BPE, language ID, HTML extraction and URL filters."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyweave.llm import bpe, html, langid, urls
from keyweave.llm.queries import tokenizer

RANKS, PATTERN = tokenizer()
DOC = "doc_id long, text string, lang string, source string, n_tokens long, uid long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, s, -1, -1) for i, t, lang, s in rows], DOC)


def hard_texts(n=30, seed=4):
    r = random.Random(seed)
    parts = ["hello", " world", "'ll", "'s", "  ", "\n\n ", "123", "é", "日本", "😀", "!!", "  ", "don't", "\t"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 900))) for _ in range(n)]


def wanted(text):
    ids = bpe.encoding(RANKS, PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_chunks_is_that_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(bpe, "OVERLAP", 24)
    texts = [*hard_texts(), None, "", "a" * 1000, " " * 700 + "x", "ab" * 40 + " " + "c" * 300 + " d" * 60]
    d = docs(spark, *[(i, t, None, None) for i, t in enumerate(texts)], (0, texts[0], None, None))
    got = bpe.digest(d, RANKS, PATTERN, chunk=64).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:] == wanted(texts[r.doc_id]), texts[r.doc_id]
    assert bpe.digest(d.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_round_trip(spark):
    texts = [t for t in hard_texts(12, 9)] + ["x" * 70_000 + " end"]
    d = docs(spark, *[(i, t, None, None) for i, t in enumerate(texts)])
    raw = {}
    for r in sorted(bpe.decode(bpe.encode(d, RANKS, PATTERN), RANKS, PATTERN).collect(), key=lambda r: (r.doc_id, r.piece)):
        raw[r.doc_id] = raw.get(r.doc_id, b"") + bytes(r.raw)
    assert [raw[i].decode() for i in range(len(texts))] == texts


# languages ---------------------------------------------------------------------------

WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
}


def prose(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows = [(i, prose(lang, r.randint(10, 60), r), lang, f"{lang}.example.com") for i, lang in enumerate(r.choices(list(WORDS), k=300))]
    return docs(spark, *rows)


def test_languages_are_told_apart_on_held_out_texts(spark, labelled):
    model = langid.train(labelled.filter("doc_id < 200"))
    held = labelled.filter("doc_id >= 200")
    got = langid.identify(held.withColumn("lang", F.lit(None).cast("string")), model)
    truth = {r.doc_id: r.lang for r in held.collect()}
    rows = got.collect()
    assert len(rows) == 100 and sum(r.lang == truth[r.doc_id] for r in rows) >= 97 and all(r.kept for r in rows)


def test_evidence_is_fused(spark, labelled):
    model = langid.train(labelled)
    r = random.Random(3)
    host = [(i, prose("de", 40, r), None, "blog.example") for i in range(50)]
    d = docs(spark, *host, (100, "in", None, "blog.example"), (101, "in", None, "other.example"), (102, "<html lang=fr>in", None, "x.example"), (103, prose("en", 30, r), "de", "y.de"), (104, None, "en", None), (105, "12 !? 3", None, None), (106, "in", None, "z.fr"))
    got = {x.doc_id: x for x in langid.identify(d, model).collect()}
    assert got[100].lang == "de"  # the host's prior decides a word of two languages
    assert got[103].lang == "en"  # a text of some length outweighs its declaration
    assert got[104].lang == got[105].lang == "und" and not got[104].kept and not got[105].kept
    assert got[102].probability > 0 and len(got) == d.count()
    assert langid.identify(d.limit(0), model).count() == 0
    kept = langid.identified_documents(d, model)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.kept}


def test_priors_are_smoothed(spark):
    scored = spark.createDataFrame([("h1", "com", 9, [0.0, -50.0]), ("h2", "com", 9, [-50.0, 0.0]), ("h2", "com", 9, [-50.0, 0.0])], "__host string, __suffix string, __letters long, __scores array<double>")
    priors, whole = langid.host_priors(scored, ("a", "b"))
    got = {r["__host"]: np.exp(r["__prior"]) for r in priors.collect()}
    assert np.allclose(np.exp(whole), [2 / 5, 3 / 5])
    com = (np.array([1, 2]) + langid.SUFFIX_SMOOTHING * np.exp(whole)) / (3 + langid.SUFFIX_SMOOTHING)
    assert np.allclose(got["h1"], (np.array([1, 0]) + langid.HOST_SMOOTHING * com) / (1 + langid.HOST_SMOOTHING))


def test_scores_of_slices_and_odd_texts():
    model = langid.TextModel(("a", "b"), np.zeros((langid.BUCKETS, 2), np.float32))
    numbers, scores = langid.text_scores(pa.array(["abc", None, "", "ab c", "é" * 5]).slice(0, 4), model)
    assert list(numbers) == [3, 0, 0, 2] and scores.shape == (4, 2)


# html --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        ("<article><h1>T</h1><p><b>One\n two.<br><p>Be.</p></article><footer>f</footer>", "T\nOne two.\nBe."),
        ("<article><p>a &amp; b&nbsp;&lt;c&gt;<script>var t='</p>'</script> d<p>e</article>", "a & b <c> d\ne"),
        ("<main><header><h1>Title</h1><p>By someone</p></header><p>Text of it.</p></main>", "Title\nText of it."),
        ("<div class='ad'>Buy</div><div id=content><p>Long enough a text to be the content of a page.</p><p>Short.</p></div><div class='sidebar'><p>Another text that is long enough, but aside.</p></div>", "Long enough a text to be the content of a page.\nShort."),
        ("<article><p>Body of the article.</p><section class='comments'><p>A long comment by a reader, as they are.</p></section><form>Name</form></article>", "Body of the article."),
        ("<article><p>Seen.</p><p hidden>Not.</p><p style='display: none'>Nor.</p><p aria-hidden=true>Nor this.</p></article>", "Seen."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(3000)) + "</article>"
    p = spark.createDataFrame([(1, "u", long, 5), (1, "u", long, 5), (2, None, None, 5), (3, "v", "<<>&#0;<p", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(html.extract(p).collect(), key=lambda r: r.page_id)
    assert got[0] == got[1] and got[0].text.count("\n") == 2999 and got[0].n_chars == len(got[0].text)
    assert (got[2].text, got[2].n_chars) == ("", 0)
    assert html.extract(p.limit(0)).count() == 0


def test_smoothing_keeps_means():
    assert html.smoothed([3.0, 3.0, 3.0]) == pytest.approx([3.0] * 3)
    assert html.smoothed([0.0, 9.0, 0.0])[0] > 0


# urls --------------------------------------------------------------------------------


def test_places_and_patterns(spark):
    cases = [
        ("http://a.com/en/1", "com/en/", "block"),
        ("https://www.Example.COM/en/7x?y", "example.com/en/7", "allow"),
        ("https://example.com/en/8", "com/en/", "block"),
        ("http://x.example.net/de/81#t", "example.net/de/8", "block"),
        ("http://x.example.net/de/7", "net/de/", "allow"),
        ("http://notexample.net/de/8", "net/de/", "allow"),
        ("http://a.org/es/", "org/es/", "block"),
        ("http://a.com/EN/1", None, "allow"),
        ("http://www.cheap-pills.test/x", None, "block"),
        ("http://cheap-pillsx.test/x", None, "allow"),
        ("no scheme", None, "allow"),
        (None, None, "allow"),
        ("http://com?/en/", None, "allow"),
    ]
    p = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(p).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(cases)}
    assert urls.judge(p.limit(0)).count() == 0
    places = {r.page_id: (r.host, r.path) for r in urls.judge(p).collect()}
    assert places[1] == ("www.example.com", "/en/7x") and places[10] == places[11] == ("", "")


def test_index_finds_what_all_rules_find():
    r = random.Random(6)
    index, rest = urls.build_index(urls.DEFAULT, {"com": 9, "en": 3})
    assert any(urls.literal_tokens(x.pattern) for x in urls.DEFAULT)
    labels = ["spam-farm", "casino", "com", "example", "net", "a", "en", "xcasino", "org"]
    for _ in range(3000):
        host = ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
        path = "/" + "/".join(r.choice([*labels, "7", "8", "de", "es", "ads", "wp-login.php"]) for _ in range(r.randint(0, 3))) + r.choice(["", "/"])
        assert urls.judge_place(host, path, index, rest) == urls.judge_place(host, path, {}, list(urls.DEFAULT)), (host, path)


def test_tokens_are_whole():
    assert urls.literal_tokens(r"(^|[.-])spam-farm[./-]") == {"spam", "farm"}
    assert urls.literal_tokens(r"/ab+c/x/") == {"x"} or "c" not in urls.literal_tokens(r"/ab+c/x/")
    assert urls.literal_tokens(r"foo") == set() and re.escape("a") == "a"
