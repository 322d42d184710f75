"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each document: how likely its letters are
in a language (trigrams of bytes, trained here), the language its markup declares,
the one its address's country suffix speaks for, and a prior of its host.  A host's
prior is its documents' text evidence, smoothed towards that of its suffix, which is
smoothed towards that of the whole corpus; the counts are grouped aggregations over
all documents.

Labels only train the text model; they are no evidence for the document they are on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

from .stage import as_row, staged, unpacked

#: Documents of each language the text model is trained on (those of smallest hash), and their length in characters.
SAMPLE, SAMPLE_CHARS = 1_000, 20_000
#: A language with fewer of them says nothing about how unlike its language a text can be.
ENOUGH = 20
BUCKETS = 1 << 16
#: Trigrams a text counts for at most: those of a text are not independent.
WEIGHT = 60
#: How often a declaration and a suffix are right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Documents that a suffix's (a corpus's) distribution counts for in a host's (a suffix's).
HOST_SMOOTHING, SUFFIX_SMOOTHING = 20.0, 100.0
#: Documents whose best language is less probable are rejected, like those without letters or in no language.
LEAST = 0.5
#: The share of texts in none of the languages, before they are read.
NONE = 0.01

# Country suffixes and the language most of their pages are in.
SUFFIXES = {
    "at": "de", "ar": "es", "au": "en", "br": "pt", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr",
    "gb": "en", "ie": "en", "it": "it", "mx": "es", "nl": "nl", "nz": "en", "pl": "pl", "pt": "pt", "uk": "en", "us": "en",
}

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    #: log P(trigram | language), a row for each hash bucket.
    logs: np.ndarray
    #: Likelihood of a trigram in none of the languages.
    none: float = float("-inf")


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letters and the number of the text it is in."""
    space = pa.scalar(" ", pa.large_string())  # around each text, so that short words count
    texts = pc.binary_join_element_wise(space, pc.utf8_lower(texts.cast(pa.large_string())), space, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(raw) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    letters = _LETTERS[raw]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    gap = letters == 32
    spaces = gap[:-2].astype(np.int8) + gap[1:-1] + gap[2:]
    good = (owner[:-2] == owner[2:]) & (spaces < 2) & ~gap[1:-1]
    wide = letters.astype(np.uint32)
    code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[good] * np.uint32(2654435761) >> np.uint32(16)
    return code, owner[:-2][good]


def training_rows(labelled: DataFrame, text: str, label: str, key: str, sample: int) -> DataFrame:
    """label, text: at most ``sample`` rows of each label, those of smallest hash.

    A share of each label's rows is drawn first, by its count over all rows, so that no
    task orders all rows of a label.
    """
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.lit(7), F.col(key)).alias("h"))
    usable = rows.filter(F.col("label").isNotNull() & (F.length("text") >= 20) & (F.length("text") <= SAMPLE_CHARS))
    counts = usable.groupBy("label").count().collect()  # a row for each language
    if not counts:
        return usable.select("label", "text").limit(0)
    shares = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, (2 * sample + 100) / r["count"])))])
    drawn = usable.filter(F.pmod("h", F.lit(1 << 30)) < F.coalesce(F.try_element_at(shares, F.col("label")), F.lit(0.0)) * (1 << 30))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text"))
    return drawn.withColumn("place", place).filter(F.col("place") <= sample).select("label", "text")


def train(labelled: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """A model of the texts by language, for every label there is.

    At most ``sample`` rows of each language, of at most SAMPLE_CHARS characters, come to
    the driver; labels without a text of 20 characters or more have no language.
    """
    rows = training_rows(labelled, text, label, key, sample).collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r["label"], []).append(r["text"])
    languages = tuple(sorted(texts)) or ("und",)
    counts = np.zeros((BUCKETS, len(languages)), np.float32)
    reached, few = [], []
    for i, language in enumerate(languages):
        code, owner = _trigrams(pa.array(texts.get(language, []), pa.string()))
        counts[:, i] = np.bincount(code, minlength=BUCKETS)
        (reached if len(texts.get(language, ())) >= ENOUGH else few).append(_left_out(code, owner, counts[:, i].astype(np.float64)))
    counts += 0.1
    logs = np.log(counts / counts.sum(axis=0, dtype=np.float64)).astype(np.float32)
    seen = np.concatenate(reached or few)
    none = (np.quantile(seen, 0.001) + _at_random(logs)) / 2 if len(seen) else -np.inf
    return TextModel(languages, logs, float(none))


def _left_out(code: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean log likelihood of each text's trigrams by the other texts of its language."""
    pairs, own = np.unique(owner << 16 | code, return_counts=True)
    text, bucket = pairs >> 16, pairs & (BUCKETS - 1)
    n = np.bincount(text, weights=own)
    rest = counts.sum() - n[text] + 0.1 * BUCKETS
    sums = np.bincount(text, weights=own * np.log((counts[bucket] - own + 0.1) / rest))
    return (sums / np.maximum(n, 1))[n > 0]


def _at_random(logs: np.ndarray) -> float:
    """Mean log likelihood of trigrams drawn at random from a to z, in the language where it is highest."""
    a = np.arange(ord("a"), ord("z") + 1, dtype=np.uint32)
    code = (a[:, None, None] << 16 | a[None, :, None] << 8 | a).ravel() * np.uint32(2654435761) >> np.uint32(16)
    return float(logs[code].mean(axis=0).max())


def text_scores(texts: pa.Array, model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of trigrams, and a row of tempered log likelihoods."""
    return _judged(texts, model)[:2]


def _judged(texts: pa.Array, model: TextModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text scores, and whether one of the languages is likelier than none of them."""
    numbers, scores = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)))
    code, owner = _trigrams(pc.fill_null(texts, ""))
    if len(code):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        who = owner[starts]
        numbers[who] = np.diff(np.append(starts, len(code)))
        for i in range(len(model.languages)):
            scores[who, i] = np.add.reduceat(model.logs[:, i][code].astype(np.float64), starts)
        scores[who] *= (np.minimum(numbers[who], WEIGHT) / numbers[who])[:, None]
    best = scores.max(axis=1, keepdims=True)
    odds = float(np.log(NONE / (1 - NONE)))
    # nothing to read is likely in none, and infinity times 0 is no number
    known = best[:, 0] > np.where(numbers > 0, np.minimum(np.maximum(numbers, 1), WEIGHT) * model.none + odds, np.inf)
    return numbers, scores - best, known


#: Texts are scored in slices of about this many bytes.
SLICE = 4 << 20


def _score(model: TextModel, text: str):
    def run(batches):
        for batch in batches:
            column = batch.column(text)
            step = max(1, int(len(column) * SLICE / max(1, column.nbytes)))
            parts = [_judged(column.slice(i, step), model) for i in range(0, len(column), step)]
            numbers = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
            scores = np.concatenate([p[1] for p in parts]) if parts else np.empty((0, len(model.languages)))
            known = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, bool)
            # a text of any length is scored; the rest of its row passes through
            keep = [n for n in batch.schema.names if n != "__scored"]
            lists = pa.array(list(scores), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(numbers), lists, pa.array(known)], names=[*keep, "__letters", "__scores", "__known"])

    return run


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` with __letters, __scores and __known for its column __scored, which goes."""
    kept = [f for f in rows.schema.fields if f.name != "__scored"]
    new = StructType().add("__letters", LongType()).add("__scores", ArrayType(DoubleType())).add("__known", BooleanType())
    return rows.mapInArrow(_score(model, "__scored"), StructType(kept + new.fields))


def declared_in(text: Column) -> Column:
    """The language that markup in a text declares, by an element's ``lang`` or a ``content-language``; else null."""
    attribute = F.regexp_extract(text, r"(?i)<(?:html|body|article|main)\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,8})\b", 1)
    header = F.regexp_extract(text, r"(?i)<meta\b[^>]*?content-language[\"']?\s+content\s*=\s*[\"']?([a-z]{2,8})\b", 1)
    return F.when(text.contains("<"), F.nullif(F.coalesce(F.nullif(attribute, F.lit("")), header), F.lit("")))


def without_tags(text: Column) -> Column:
    """The text between tags: the letters of markup are in no language."""
    return F.when(text.contains("<"), F.regexp_replace(text, r"<[!/a-zA-Z][^<>]*>", " ")).otherwise(text)


def _evidence(text: Column, declared: Column, address: Column, host: Column) -> dict[str, Column]:
    primary = F.regexp_extract(F.lower(F.coalesce(declared, F.lit(""))), "^[a-z]+", 0)
    bare = F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1)
    return {
        "__scored": F.coalesce(text, F.lit("")),
        "__declared": primary,
        "__suffix": F.regexp_extract(bare, r"\.([a-z0-9-]+)$", 1),
        "__host": F.coalesce(host, F.lit("")),
    }


def host_priors(scored: DataFrame, languages: tuple[str, ...]) -> tuple[DataFrame, list[float]]:
    """(__host, __prior) as log probabilities, hosts smoothed to suffixes and those to the corpus; the corpus's own."""
    share = F.transform("__scores", F.exp)
    total = F.aggregate(share, F.lit(0.0), lambda a, x: a + x)
    rows = scored.filter("__letters > 0").select("__host", "__suffix", share.alias("p"), total.alias("t"))
    n = range(len(languages))
    hosts = rows.groupBy("__host", "__suffix").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("p", F.lit(i)) / F.col("t")).alias(f"c{i}") for i in n])
    # all documents with letters, in one row for the whole corpus and one for each suffix
    corpus = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in n]).first()
    whole = [((corpus[f"c{i}"] or 0.0) + 1) / ((corpus["n"] or 0) + len(languages)) for i in n]
    suffix = hosts.groupBy("__suffix").agg(F.sum("n").alias("sn"), *[F.sum(f"c{i}").alias(f"s{i}") for i in n])
    suffix = suffix.select("__suffix", *[((F.col(f"s{i}") + SUFFIX_SMOOTHING * whole[i]) / (F.col("sn") + SUFFIX_SMOOTHING)).alias(f"s{i}") for i in n])
    by_host = hosts.groupBy("__host").agg(F.min("__suffix").alias("__suffix"), F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in n])
    joined = by_host.join(suffix, "__suffix")
    prior = F.array(*[F.log((F.col(f"c{i}") + HOST_SMOOTHING * F.col(f"s{i}")) / (F.col("n") + HOST_SMOOTHING)) for i in n])
    return joined.select("__host", prior.alias("__prior")), [float(np.log(w)) for w in whole]


def _fuse(scored: DataFrame, priors: DataFrame, whole: list[float], languages: tuple[str, ...]) -> DataFrame:
    """Adds __lang, __probability, __text_lang: what the evidence says together, and the text alone."""
    others = max(1, len(languages) - 1)

    def said(column: str, language: str, right: float, means: dict[str, str] | None = None) -> Column:
        names = [language] if means is None else sorted(s for s, m in means.items() if m == language)
        known = list(languages) if means is None else sorted(s for s, m in means.items() if m in languages)
        by = F.when(F.col(column).isin(names), float(np.log(right))) if names else F.when(F.lit(False), 0.0)
        return by.when(F.col(column).isin(known), float(np.log((1 - right) / others))).otherwise(0.0) if known else F.lit(0.0)

    joined = scored.join(priors, "__host", "left").withColumn("__prior", F.coalesce("__prior", F.array(*[F.lit(w) for w in whole])))
    logs = F.array(
        *[
            F.get("__scores", F.lit(i)) + F.get("__prior", F.lit(i)) + said("__declared", x, DECLARED_RIGHT) + said("__suffix", x, SUFFIX_RIGHT, SUFFIXES)
            for i, x in enumerate(languages)
        ]
    )
    joined = joined.withColumn("__logs", logs).withColumn("__best", F.array_max("__logs"))
    names = F.array(*[F.lit(x) for x in languages])
    weight = F.aggregate(F.transform("__logs", lambda x: F.exp(x - F.col("__best"))), F.lit(0.0), lambda a, x: a + x)
    letters = F.col("__known")
    at = lambda values, best: F.get(names, (F.array_position(values, best) - 1).cast("int"))
    found = F.struct(
        F.when(letters, at(F.col("__logs"), F.col("__best"))).otherwise("und").alias("__lang"),
        F.when(letters, 1 / weight).otherwise(0.0).alias("__probability"),
        F.when(letters, at(F.col("__scores"), F.array_max("__scores"))).otherwise("und").alias("__text_lang"),
    )
    # given out by a generator, so that filters on them are not pushed below and evaluated anew
    return joined.select("*", F.inline(F.array(found)))


def _kept(allowed: tuple[str, ...] | None) -> Column:
    good = F.col("__known") & (F.col("__probability") >= LEAST)
    return good & F.col("__lang").isin(list(allowed)) if allowed else good


def _judged_rows(docs: DataFrame, carried: Column, model: TextModel, text: str, declared: Column | None, address: str, host: str) -> DataFrame:
    """``carried`` as ``row``, with all that is found about each document.

    The texts are scored once: the scores are written with their rows, then counted for
    the priors and fused.
    """
    read = F.col(text)
    said = declared_in(read) if declared is None else declared
    evidence = _evidence(without_tags(read) if declared is None else read, said, F.col(address), F.col(host))
    scored = staged(_scored(docs.select(carried.alias("row"), *[c.alias(n) for n, c in evidence.items()]), model), "scores")
    priors, whole = host_priors(scored.filter("__known"), model.languages)
    return _fuse(scored, staged(priors, "priors"), whole, model.languages)


def identify(docs: DataFrame, model: TextModel, *, key: str = "doc_id", text: str = "text", declared: str | None = None, address: str = "source", host: str = "source", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each document: its key, lang, probability, text_lang, declared, letters, kept.

    ``declared``, ``address`` and ``host`` name columns (without ``declared`` what markup in
    the text declares counts, and only what stands between its tags is read); null or
    unknown values of them are no evidence, and a null host is a host of its own.  A null or empty text, or one
    without letters or whose letters speak for none of the languages, is "und" and not kept.  Rows are judged one by one (equal rows
    alike), but all count for the priors.  Other columns are ignored.  An empty table gives no rows.
    """
    fused = _judged_rows(docs, F.struct(F.col(key).alias("key")), model, text, None if declared is None else F.col(declared), address, host)
    return fused.select(
        F.col("row.key").alias(key), F.col("__lang").alias("lang"), F.col("__probability").alias("probability"), F.col("__text_lang").alias("text_lang"), F.col("__declared").alias("declared"), F.col("__letters").alias("letters"), _kept(allowed).alias("kept")
    )


def identified_documents(docs: DataFrame, model: TextModel, *, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The documents that are kept, all columns; ``lang`` becomes the language found.

    Needs text and source (and doc_id, lang for ``train``); any other columns pass
    through whatever their names.  Nulls, empty texts, repeats and empty tables are
    treated as by ``identify``: equal rows all stay or all go.
    """
    kept = _judged_rows(docs, as_row(docs), model, "text", None, "source", "source").filter(_kept(allowed))
    return unpacked(kept, docs.columns, {"lang": F.col("__lang")})
