"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Texts are word sequences (split at white space, lower case), cut into 5-word k-mers
that carry their occurrence number.  A sketch entry is, for one hash function, the
two k-mers of smallest hash in the order the text has them, so that texts agree on
an entry about as often as their edit similarity suggests.

1. Equal word sequences are one class; only a class's first document is sketched on.
2. The leader of an entry is the smallest document that has it.  Every document is
   aligned with the smallest of its leaders, then with those leaders that are not in
   its component yet: at most as many pairs as entries, whatever the size of a group.
3. Wherever a band (two entries) still holds documents of several components, all its
   documents of different components are compared, block against block, so that no
   link is missed for having been compared with leaders alone.  Only links come out.
4. The components of all links are the groups of near-duplicates.

Two texts are linked if a banded alignment finds an edit distance of at most 0.1 of
the longer one's words, or of at most 0.2 where their 5-word shingles (occurrences
told apart) have a Jaccard similarity of 0.8.  So scattered edits and passages put in
or cut off both count, and texts that merely share a long passage don't.  No bucket,
group or number of partners is capped.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stage import drop_staged, staged

K = 5
#: Of shingles, and (1 less twice this distance) of words.
SIMILARITY = 0.8
#: Documents of a band that are compared at once, fewer where they have more words than these together.
BLOCK, BLOCK_WORDS = 128, 200_000
#: Followers of a leader that are aligned with it in one task.
FOLLOWERS = 256
#: Sketch entries; two make a band.
ENTRIES = 32
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 500_000
SEED = 20_240_607


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=8)
def _functions(entries: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 2**64, entries, np.uint64), random.integers(0, 2**64, entries, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in order; a shorter text is one k-mer."""
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return out


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell the occurrences of equal k-mers apart, the first unchanged."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if first.all():
        return hashes
    starts = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    number = np.empty(len(hashes), np.uint64)
    number[order] = (np.arange(len(ranked)) - starts).astype(np.uint64)
    return np.where(number == 0, hashes, _mix(hashes + number * np.uint64(0xA0761D6478BD642F)))


def sketch(words: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """One 64-bit key for each hash function: its two smallest k-mers in text order."""
    plain = kmers(words)
    ids = labelled(plain)
    add, times = _functions(entries)
    out = np.empty(entries, np.uint64)
    step = max(1, min(entries, 2_000_000 // max(1, len(ids))))
    for f in range(0, entries, step):
        values = (ids[None, :] ^ add[f : f + step, None]) * times[f : f + step, None]
        values ^= values >> np.uint64(32)
        if len(ids) < 2:
            places = np.zeros((len(values), 2), int)
        else:
            places = np.sort(np.argpartition(values, 1, axis=1)[:, :2], axis=1)
        pair = _mix(plain[places[:, 0]]) * np.uint64(3) + plain[places[:, 1]]
        out[f : f + step] = _mix(pair + np.arange(f, f + len(pair), dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    return out


def _sketches(entries: int):
    def run(batches):
        known = _Words()
        for batch in batches:
            digests, counts, rows = [], [], []
            for text in batch.column("__text"):
                words = text.as_py().split()
                counts.append(len(words))
                digests.append(xxhash.xxh128_hexdigest(" ".join(words)) if words else None)
                rows.append(sketch(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), entries).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.string()), pa.array(counts, pa.int32()), pa.array(rows, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n", "entries"],
            )

    return run


def edit_distance(a: list, b: list, band: int) -> int | None:
    """Edit distance of two sequences if it is at most ``band``, else None.

    Cells within ``band`` of the diagonal only, a column at a time: bit t of a column's
    vectors is the cell t - band below the diagonal, and holds by how much the
    distance differs from that of the cell above it.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > band:
        return None
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    longer = len(a) - len(b)
    if not b:
        return longer
    band = min(band, len(a))
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * band + 1
    full = (1 << width) - 1
    top, middle = 1 << (width - 1), 1 << band
    up, down, distance = (full >> (band + 1)) << (band + 1), 0, 0
    for j, y in enumerate(b, 1):
        up, down = up >> 1 | top, down >> 1  # the window moves on by one row
        equal = where.get(y, 0)
        shift = j - band - 1
        equal = (equal >> shift if shift >= 0 else equal << -shift) & full
        still = (((equal & up) + up) ^ up | equal | down) & full  # same as diagonally before
        more, less = down | ~(still | up) & full, up & still
        if not still & middle:
            distance += 1
            if distance - longer > band:
                return None
        more = (more << 1 | 1) & full
        up, down = (less << 1 | ~(still | more)) & full, more & still
    below = ((1 << longer) - 1) << (band + 1)
    distance += (up & below).bit_count() - (down & below).bit_count()
    return distance if distance <= band else None


class Text:
    """A text as words, with what comparing it takes, counted once."""

    def __init__(self, text: str) -> None:
        self.words = text.split()
        self.bag = Counter(self.words)
        self._shingles: Counter | None = None

    @property
    def shingles(self) -> Counter:
        if self._shingles is None:
            w, k = self.words, min(K, len(self.words))
            self._shingles = Counter(zip(*[w[j:] for j in range(k)]))
        return self._shingles


def _common(a: Counter, b: Counter) -> int:
    if len(b) < len(a):
        a, b = b, a
    return sum(min(n, b[x]) for x, n in a.items() if x in b)


def similar(a: Text, b: Text, similarity: float = SIMILARITY) -> bool:
    """The link between two texts; the alignment comes last, where counts leave it open."""
    longer = max(len(a.words), len(b.words))
    wide = int((1 - similarity) * longer + 1e-9)
    narrow = wide // 2
    alike = _common(a.bag, b.bag)
    if alike >= longer - narrow and edit_distance(a.words, b.words, narrow) is not None:
        return True
    if alike < longer - wide:
        return False
    shared = _common(a.shingles, b.shingles)
    union = a.shingles.total() + b.shingles.total() - shared
    return shared >= similarity * union - 1e-9 and edit_distance(a.words, b.words, wide) is not None


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            last, text, good = None, None, []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                if x.as_py() != last:  # a leader's rows mostly follow one another
                    last = x.as_py()
                    text = Text(last)
                good.append(similar(text, Text(y.as_py()), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verify_blocks(similarity: float):
    """Links within a block (``other`` null) or between two blocks of a band's documents.

    A pair of documents is compared in the first band they share, if their components
    differ; of the links that join the same documents twice only the first is told.
    """

    def run(batches):
        for batch in batches:
            found = []
            for band, one, other in zip(*[batch.column(c).to_pylist() for c in ("band", "members", "other")]):
                left = [m | {"text": Text(m["text"]), "bands": np.array(m["entries"]).reshape(-1, 2)} for m in one]
                right = left if other is None else [m | {"text": Text(m["text"]), "bands": np.array(m["entries"]).reshape(-1, 2)} for m in other]
                root: dict = {}

                def find(k):
                    while root.setdefault(k, k) != k:
                        root[k] = k = root[root[k]]
                    return k

                for i, x in enumerate(left):
                    for y in right[:i] if other is None else right:
                        p, q = find(x["component"]), find(y["component"])
                        if p == q or min(x["n"], y["n"]) < (similarity - 1e-9) * max(x["n"], y["n"]):
                            continue
                        if (x["bands"] == y["bands"]).all(axis=1).argmax() != band:
                            continue
                        if similar(x["text"], y["text"], similarity):
                            root[max(p, q)] = min(p, q)
                            found.append(sorted((x["node"], y["node"])))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of ``nodes`` (doc_id), which are moved once and then read from a table.

    Always a merge join: the nodes grow with the documents, so no size of theirs is a
    bound, and the plan should not depend on it.
    """
    needed = nodes.distinct().hint("merge")
    found = docs.join(needed, "doc_id", "left_semi")
    return staged(found.groupBy("doc_id").agg(F.min("__text").alias("__text")), "texts")


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts align.

    A leader of many has its text sent to as many tasks as its followers fill, so that
    none of them gathers a large group's texts.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("__text").alias("text_a")), texts.select(F.col("doc_id").alias("b"), F.col("__text").alias("text_b"))
    leaders = staged(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts")), "parts")
    dealt = pairs.join(leaders, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    left = left.join(leaders, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(_verify(similarity), f"a {kind}, b {kind}"), "linked")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components."""
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"__{side}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.filter(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b")


def _alike(n: str, m: str, similarity: float):
    """Lengths that the similarity allows."""
    return F.least(n, m) >= F.lit(similarity - 1e-9) * F.greatest(n, m)


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, entries: int = ENTRIES) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest doc_id of its group), kept.

    Needs doc_id and text; other columns are ignored.  Equal word sequences are always
    one group.  A null or empty text, or one of white space, is alone in its group; a
    row without doc_id has no class and is kept.  Rows that repeat a doc_id are one
    document; if their texts differ, the smallest is aligned.  An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("__text"))
    rows = staged(texts.mapInArrow(_sketches(entries), f"doc_id {kind}, digest string, n int, entries array<long>"), "sketches")
    compared = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = compared.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "entries")).alias("f"))
    classes = staged(first.select("digest", F.col("f.doc_id").alias("node"), F.col("f.n").alias("n"), F.col("f.entries").alias("entries")), "classes")

    # every document beside the smallest that shares an entry with it
    each = classes.select("node", "n", F.explode("entries").alias("key"))
    lead = each.groupBy("key").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    lead = staged(lead.select("key", "a", "m"), "leaders")
    pairs = each.join(lead, "key").filter(F.col("node") != F.col("a")).filter(_alike("n", "m", similarity))
    pairs = staged(pairs.select("a", F.col("node").alias("b")).distinct(), "pairs")
    near = _texts_of(texts, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    # with the smallest of those first: it joins most of a large group at once
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _linked(first, near, similarity)
    groups = staged(components(links), "groups")
    # then with those of other components, beside which the first said nothing
    rest = _apart(pairs.join(first, ["a", "b"], "left_anti"), groups)
    links = staged(links.unionByName(_linked(staged(rest, "apart"), near, similarity)), "links")
    groups = staged(components(links), "groups")

    # where a band still holds several components, all documents of different ones
    named = classes.join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), "entries")
    bands = F.transform(F.sequence(F.lit(0), F.lit(entries // 2 - 1)), lambda i: F.xxhash64(i, F.get("entries", 2 * i), F.get("entries", 2 * i + 1)))
    banded = named.select("node", "n", "component", "entries", F.posexplode(bands).alias("band", "key"))
    mixed = banded.select("key", "component", "n").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"), F.sum("n").alias("words"))
    parts = F.ceil(F.greatest(F.col("many") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    mixed = staged(mixed.filter("low < high").select("key", parts.alias("parts")), "mixed")
    members = banded.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = staged(members.select("key", "band", "part", "parts", "node", "n", "component", "entries"), "members")
    unread = staged(members.select(F.col("node").alias("doc_id")).distinct().join(near, "doc_id", "left_anti"), "unread")
    if unread.limit(1).count():  # in no pair so far: the lengths of all its leaders were too different
        near = near.unionByName(_texts_of(texts, unread))
    told = members.join(near.select(F.col("doc_id").alias("node"), F.col("__text").alias("text")), "node")
    member = F.struct(F.col("node").cast("long").alias("node"), "n", F.col("component").cast("long").alias("component"), "entries", "text")
    # a part holds about BLOCK documents, however many its band has, and fewer if they are long
    blocks = staged(told.groupBy("key", "band", "part", "parts").agg(F.collect_list(member).alias("members")), "blocks")
    # each part goes to those after it, each of which meets those before it in a task of its own
    later = F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("after")
    x = blocks.filter(F.col("part") + 1 < F.col("parts")).select("key", "band", "members", later)
    y = blocks.select("key", F.col("part").alias("after"), F.col("members").alias("other"))
    between = x.join(y, ["key", "after"]).select("band", "members", "other")
    within = blocks.select("band", "members", F.lit(None).cast(blocks.schema["members"].dataType).alias("other"))
    more = staged(within.unionByName(between).mapInArrow(_verify_blocks(similarity), "a long, b long"), "linked")
    groups = staged(components(links.unionByName(more.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")))), "groups")
    drop_staged(lead, pairs, members, blocks)

    group = classes.join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    out = rows.select("doc_id", "digest").join(staged(group, "group"), "digest", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def first_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each group, the one of smallest doc_id.

    Needs doc_id and text; other columns pass through, whatever their names.  Of rows that
    repeat a doc_id one stays; rows without doc_id, and texts that are null or empty, all
    stay.  An empty table stays empty.
    """
    found = staged(near_duplicates(docs, **options), "near")
    lost = staged(found.filter("NOT kept").select("doc_id").distinct(), "lost")
    # a merge join at every size: what is lost grows with the documents
    left = docs.join(lost.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeats = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeats:  # rows that repeat a doc_id: only here must whole rows be moved
        named = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        left = named.unionByName(left.filter("doc_id IS NULL"))
    return left
