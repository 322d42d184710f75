"""Texts that are in none of the languages are rejected."""

import random
import string

from keyweave.llm import langid
from tests.llm.test_texts import WORDS, prose

DOC = "doc_id long, text string, lang string, source string"


def test_noise_and_other_scripts_are_rejected_and_clean_texts_stay(spark):
    r = random.Random(11)
    rows = [(i, prose(lang, r.randint(10, 60), r), lang, f"{lang}.example.com") for i, lang in enumerate(r.choices(list(WORDS), k=300))]
    noise = [(1000 + i, " ".join("".join(r.choices(string.ascii_lowercase, k=7)) for _ in range(40)), "en", "en.example.com") for i in range(20)]
    other = [(2000, "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом", "de", "de.example.com")]
    model = langid.train(spark.createDataFrame(rows, DOC))
    docs = spark.createDataFrame(rows + noise + other, DOC)
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert all(got[x[0]].kept for x in rows)
    assert all(got[x[0]].lang == "und" and not got[x[0]].kept for x in noise + other)
    assert {x.doc_id for x in langid.identified_documents(docs, model).collect()} == {x[0] for x in rows}
