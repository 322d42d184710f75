"""The whole pipeline on a small table against a plain version of every stage."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from keyweave.llm import bpe, langid, mixing, quality
from keyweave.llm.queries import tokenizer
from tests.llm.test_langid_fusion import by_hand as languages_by_hand
from tests.llm.test_native import filled, statistics
from tests.llm.test_near import edited, linked

WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
}


def corpus(seed=17):
    """Sentences of two languages with a few rare words each; copies, near copies, noise, menus and short texts."""
    r = random.Random(seed)

    def text(language, lines):
        out = []
        for _ in range(lines):
            words = [r.choice(WORDS[language]) if r.random() < 0.6 else f"{r.choice(WORDS[language])}{r.choice(WORDS[language])}" for _ in range(r.randint(8, 20))]
            out.append(" ".join(words) + ".")
        return "\n".join(out)

    rows = []
    for _ in range(70):
        language = r.choice(list(WORDS))
        rows.append((text(language, r.randint(6, 14)), language))
    for i in range(0, 30, 2):
        base, language = rows[i]
        rows.append((base if i % 4 else " ".join(edited(base.split(" "), 0.01, r)), language))
    rows += [("\n".join("Home | News | About" for _ in range(30)), "en"), ("short text.", "de"), (None, "en"), ("", None), (rows[3][0] + "\nHome | News | About", rows[3][1])]
    rows += [(" ".join("".join(r.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(90)) + ".", "en") for _ in range(3)]
    r.shuffle(rows)
    return [(i, t, language, r.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for i, (t, language) in enumerate(rows)]


def line_stays(line):
    words = line.split()
    if not words:
        return True
    marks, menus = len(re.findall(r"[#*$%&|<>]", line)), len(re.findall(r"[|•·›»>][\x20\x09-\x0D]", line))
    phrases = len(re.findall("|".join(quality.BOILERPLATE), line.lower()))
    ended = re.search(r"[.!?…。！？:;;][\"'”’»)\]]*[\x20\x09-\x0D]*\Z", line) or len(words) >= quality.LONG
    return bool(ended) and marks <= len(words) and not (menus and menus * 3 >= len(words)) and not (phrases and (len(words) < quality.LONG or phrases * quality.WORDS_OF_PHRASE >= len(words)))


def by_hand(rows, model):
    found = languages_by_hand([(t, None, s, s) for _, t, _, s, _ in rows], model)
    docs = [(i, t, s) for (i, t, _, s, _), (language, p) in zip(rows, found) if language != "und" and p >= langid.LEAST]
    cleaned = []
    for i, t, s in docs:
        n, _, _, _, repeats = statistics(t)
        good = [x for x in t.split("\n") if line_stays(x)]
        if n >= 50 and 100 * repeats <= 50 * n and n - sum(len(x.split()) for x in good) <= quality.MAX_LOST * n:
            cleaned.append((i, "\n".join(good), s))
    parent = {i: i for i, _, _ in cleaned}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    split = {i: t.lower().split() for i, t, _ in cleaned}
    bags = {i: Counter(w) for i, w in split.items()}
    for i in split:
        for j in split:
            n = max(len(split[i]), len(split[j]))
            if i < j and (bags[i] & bags[j]).total() >= 0.8 * n and linked(split[i], split[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    first = [(i, t, s) for i, t, s in cleaned if find(i) == i]
    order = sorted({s for _, _, s in first if s is not None}) + [None] * any(s is None for _, _, s in first)
    size = {i: len(t.split()) for i, t, _ in first}
    sizes = [sum(size[i] for i, _, s in first if s == x) for x in order]
    targets = filled(sizes, [[5, 2, 1][k % 3] for k in range(len(order))])
    out = Counter()
    for source, n, target in zip(order, sizes, targets):
        whole = min(3, int(target // n))
        rest, upto = target - whole * n, 0
        for key, i in sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, _, s in first if s == source):
            upto += size[i]
            out[i] += whole + (rest > 0 and upto - size[i] / 2 <= rest)
    ranks, pattern = tokenizer()
    told = []
    for i, t, _ in first:
        ids = np.array(bpe.encoding(ranks, pattern).encode_ordinary(t), "<u4")
        told += [(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * out[i]
    return sorted(told)


def test_the_pipeline_by_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = by_hand(rows, langid.train(docs))
    assert got == want and 40 < len({x[0] for x in got}) < len(rows) - 20


def test_an_empty_table_passes_through(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.mixed_documents(docs).count() == 0
