"""Near-duplicate embeddings by an inverted multi-index.

The halves of the vectors have codebooks of their own, whose products are the cells
of a grid; every vector is filed under the cell nearest to it.  A vector then visits
cells in the order of a multi-sequence traversal: both halves' centroids sorted by a
lower bound of the distance to anything filed there, the best pair of them next.
It stops where the share of linked pairs met so far reaches the target recall.  That
place is measured on a sample: on its own linked pairs, and on its vectors turned by
just the angle that the wanted cosine allows.  A recall of 1 goes on to the distance
that the cosine allows, beyond which no link can be.  What is met is verified by the
cosine in double precision, block against block.

Equal vectors are one with a multiplicity.  Links are never listed: a pair of blocks
returns each vector's number of links and one edge to its group within the pair.  The
blocks of a crowded cell are dealt to as many tasks as it has blocks for.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stage import drop_staged, staged

COSINE = 0.98
#: Linked pairs that the traversal is to meet.
RECALL = 0.9999
#: Vectors the codebooks are fitted on (at least, and for each centroid), rounds of fitting.
SAMPLE, FOR_EACH, ROUNDS = 8_192, 8, 8
#: Vectors of an average cell, and turned vectors the recall is measured on.
CELL_SIZE, TRIALS = 800, 32_768
#: Vectors in a block, those whose cells a task holds at once, and blocks that a block is compared with in one task.
BLOCK, SLICE, TOGETHER = 256, 512, 16
#: Vectors of the sample in a cell from which on its vectors are dealt to several tasks.
CROWD = 8
SEED = 11


def fit_codebook(points: np.ndarray, size: int) -> np.ndarray:
    """k-means from a seeded start; empty centroids stay where they are."""
    random = np.random.default_rng(SEED)
    book = points[random.permutation(len(points))[: min(size, len(points))]].copy()
    for _ in range(ROUNDS):
        near = distances(points, book).argmin(axis=1)
        for i in range(len(book)):
            if (near == i).any():
                book[i] = points[near == i].mean(axis=0)
    return book


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances."""
    out = (points**2).sum(axis=1)[:, None] - 2 * points @ book.T + (book**2).sum(axis=1)[None, :]
    return np.maximum(out, 0)


def bounds(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and for each centroid the least squared distance to points nearest to it.

    Whatever is nearest to another centroid lies beyond the plane halfway to it.
    """
    square = distances(points, book)
    own = square.argmin(axis=1)
    apart = np.sqrt(distances(book, book))[own]
    reach = (square - square[np.arange(len(points)), own][:, None]) / np.where(apart > 0, 2 * apart, 1)
    return own, np.where(apart > 0, np.maximum(reach - 1e-9, 0) ** 2, 0)


def traverse(left: np.ndarray, right: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells in the order of their bound (the sum of the halves'), up to ``most``."""
    a, b = np.flatnonzero(left <= most), np.flatnonzero(right <= most)
    if not len(a) or not len(b):
        return []
    a, b = a[np.argsort(left[a], kind="stable")], b[np.argsort(right[b], kind="stable")]
    heap, seen, out = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > most:
            break
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return out


def unit(vectors) -> np.ndarray:
    """Vectors of length 1. The largest component is divided out first, so that no square overflows or vanishes."""
    out = np.asarray(vectors, np.float64)
    if out.shape[1]:
        out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def turned(vectors: np.ndarray, cosine: float, random: np.random.Generator) -> np.ndarray:
    """Each vector turned in a random direction by the angle of the cosine."""
    away = random.normal(size=vectors.shape)
    away -= (away * vectors).sum(axis=1, keepdims=True) * vectors
    away /= np.maximum(np.sqrt((away**2).sum(axis=1, keepdims=True)), 1e-300)
    return cosine * vectors + math.sqrt(1 - cosine**2) * away


class MultiIndex:
    """Codebooks of both halves, and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, cosine: float, recall: float, cells: int, labels: np.ndarray | None = None) -> None:
        self.half = max(1, sample.shape[1] // 2)
        self.books = [fit_codebook(sample[:, : self.half], cells), fit_codebook(sample[:, self.half :], cells)]
        self.most = 2 - 2 * cosine + 1e-9
        if recall < 1:
            needed = np.concatenate([self._needed_by_turned(sample, cosine), self._needed_by_pairs(sample, cosine, labels)])
            self.most = min(self.most, float(np.quantile(needed, recall, method="higher")) + 1e-9)

    def bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [bounds(vectors[:, : self.half], self.books[0]), bounds(vectors[:, self.half :], self.books[1])]

    def _needed(self, visitors: np.ndarray, filed: np.ndarray) -> np.ndarray:
        """How far each visitor must go to meet the vector filed beside it."""
        at = np.arange(len(visitors))
        (_, left), (_, right) = self.bounds(visitors)
        (own_a, _), (own_b, _) = self.bounds(filed)
        return left[at, own_a] + right[at, own_b]

    def _needed_by_turned(self, sample: np.ndarray, cosine: float) -> np.ndarray:
        random, out = np.random.default_rng(SEED), []
        for start in range(0, TRIALS, 2_048):
            drawn = sample[np.arange(start, start + 2_048) % len(sample)]
            out.append(self._needed(drawn, turned(drawn, cosine, random)))
        return np.concatenate(out)

    def _needed_by_pairs(self, sample: np.ndarray, cosine: float, labels: np.ndarray | None) -> np.ndarray:
        out = [np.empty(0)]
        for start in range(0, len(sample), 512):
            near = sample[start : start + 512] @ sample.T >= cosine
            if labels is not None:
                near &= labels[start : start + 512, None] == labels[None, :]
            i, j = np.nonzero(near)
            i, j = (i + start)[i + start != j], j[i + start != j]
            for k in range(0, len(i), 4_096):
                out.append(self._needed(sample[i[k : k + 4_096]], sample[j[k : k + 4_096]]))
        return np.concatenate(out)

    def places(self, vectors: np.ndarray) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
        """Each vector's own cell and the cells it visits."""
        (own_a, left), (own_b, right) = self.bounds(vectors)
        return [((int(a), int(b)), traverse(x, y, self.most)) for a, b, x, y in zip(own_a, own_b, left, right)]


def placed(indexes: dict[int, MultiIndex], vectors: np.ndarray) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Places by the index of the vectors' length; of a length the sample lacks all share a cell."""
    index = indexes.get(vectors.shape[1])
    return index.places(vectors) if index else [((0, 0), [(0, 0)])] * len(vectors)


CELL = "label {label}, size int, a int, b int"
#: What a vector is in a cell: filed there, visiting its own cell, or visiting another.
FILED, HOME, VISITOR = 0, 1, 2


def _file(indexes: dict[int, MultiIndex], spread: dict):
    """A row for the cell each vector is filed under, and for those it visits, from its own cell on."""

    def run(batches):
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            out = {n: [] for n in ("label", "size", "a", "b", "role", "salt", "node", "copies", "vector")}
            labels, nodes, copies, vectors = (batch.column(n).to_pylist() for n in ("label", "node", "copies", "embedding"))
            kind = np.float64 if batch.schema.field("embedding").type.value_type == pa.float64() else np.float32
            for size in sorted({len(v) for v in vectors}):
                rows = [i for i, v in enumerate(vectors) if len(v) == size]
                raw = np.array([vectors[i] for i in rows], kind)
                for i, bits, (own, visited) in zip(rows, raw, placed(indexes, unit(raw))):
                    # a pair meets once: where the one with the smaller cell visits the other's
                    for cell, role in [(own, FILED), (own, HOME)] + [(c, VISITOR) for c in visited if c > own]:
                        salt = hash(nodes[i]) * 0x9E3779B1 % (1 << 32) % spread.get((labels[i], size, *cell), 1)
                        for k, v in zip(out, (labels[i], size, *cell, role, salt, nodes[i], copies[i], bits.tobytes())):
                            out[k].append(v)
            types = {"label": batch.schema.field("label").type, "size": pa.int32(), "a": pa.int32(), "b": pa.int32(), "role": pa.int32(), "salt": pa.int64(), "node": pa.int64(), "copies": pa.int64(), "vector": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in types.items()], names=list(types))

    return run


def _pack(block: int):
    """Rows sorted by cell become blocks of at most ``block`` vectors of one cell."""
    key = ("label", "size", "a", "b", "role")

    def run(batches):
        open_key, nodes, copies, vectors, kind = None, [], [], [], None

        def emit():
            values = [*open_key, np.array(nodes, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), b"".join(vectors)]
            types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[*key, "nodes", "copies", "vectors"])

        for batch in batches:
            kind = batch.schema.field("label").type
            for row in zip(*[batch.column(n).to_pylist() for n in (*key, "node", "copies", "vector")]):
                if nodes and (row[:5] != open_key or len(nodes) >= block):
                    yield emit()
                    nodes, copies, vectors = [], [], []
                open_key = row[:5]
                nodes.append(row[5])
                copies.append(row[6])
                vectors.append(row[7])
        if nodes:
            yield emit()

    return run


def groups_of(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and each column reaches by links; their own where they have none."""
    most = np.iinfo(np.int64).max
    left, right = x.copy(), y.copy()
    while True:
        right_new = np.minimum(right, np.where(near, left[:, None], most).min(axis=0))
        left_new = np.minimum(left, np.where(near, right_new[None, :], most).min(axis=1))
        if (left_new == left).all() and (right_new == right).all():
            return left, right
        left, right = left_new, right_new


def _compare(cosine: float, double: bool):
    """Blocks of visitors against blocks of what is filed: links of each node, and an edge to its group."""

    def block(size: int, vectors: bytes) -> np.ndarray:
        return unit(np.frombuffer(vectors, np.float64 if double else np.float32).reshape(-1, size))

    def run(batches):
        for batch in batches:
            found = [np.empty((3, 0), np.int64)]
            for size, role, n, c, v, m, d, w in zip(*[batch.column(x).to_pylist() for x in ("size", "role", "nodes", "copies", "vectors", "nodes_f", "copies_f", "vectors_f")]):
                x, y = np.frombuffer(n, np.int64), np.frombuffer(m, np.int64)
                near = block(size, v) @ block(size, w).T >= cosine
                if role == HOME:  # all of the cell meet all: the smaller one counts
                    near &= x[:, None] < y[None, :]
                if not near.any():
                    continue
                left, right = groups_of(near, x, y)
                for nodes, links, group in ((x, near @ np.frombuffer(d, np.int64), left), (y, near.T @ np.frombuffer(c, np.int64), right)):
                    there = links > 0
                    found.append(np.stack([nodes[there], links[there], group[there]]))
            columns = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["node", "links", "toward"])

    return run


def fitted(classes: DataFrame, many: int, cosine: float, recall: float, block: int) -> tuple[dict[int, MultiIndex], dict]:
    """An index for each length of vectors, and how many tasks the vectors of a crowded cell are dealt to.

    Only the sample comes to the driver: FOR_EACH vectors for each centroid, SAMPLE at least.
    """
    cells = max(4, round(math.sqrt(many / CELL_SIZE)))
    size = max(SAMPLE, FOR_EACH * cells)
    order = F.xxhash64(F.lit(5), F.col("node"))
    drawn = classes.select("label", "embedding", order.alias("h")).orderBy("h").limit(size).collect() if many else []
    indexes, spread = {}, {}
    for length in {len(r["embedding"]) for r in drawn}:
        own = [r for r in drawn if len(r["embedding"]) == length]
        vectors, labels = unit([r["embedding"] for r in own]), np.array([r["label"] for r in own], object)
        _, codes = np.unique(labels.astype(str), return_inverse=True)
        indexes[length] = MultiIndex(vectors, cosine, recall, cells, codes)
        for label, (cell, _) in zip(labels, indexes[length].places(vectors)):
            spread[(label, length, *cell)] = spread.get((label, length, *cell), 0) + 1
    return indexes, {k: math.ceil(v * many / len(drawn) / block) for k, v in spread.items() if v >= CROWD}


def near_duplicates(rows: DataFrame, *, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Needs vec_id, embedding, label; other columns are ignored.  Vectors are compared
    if their labels are equal and not null and they are equally long.  Those that are
    null, empty or zero, or hold null or non-finite components, link with nothing, and
    so do rows without vec_id, whose component is null and which are kept.  Rows that
    repeat a vec_id are one vector, told for each of the rows; if they differ, the
    smallest label and vector count.  An empty table gives no rows.
    """
    double = "double" in rows.schema["embedding"].dataType.simpleString()
    label = rows.schema["label"].dataType.simpleString()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    marks = [F.xxhash64(F.lit(s), F.col("embedding")) for s in (1, 2)]
    good = rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    vectors = good.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("f")).select("vec_id", "f.label", "f.embedding")
    vectors = staged(vectors.select("vec_id", "label", "embedding", marks[0].alias("m1"), marks[1].alias("m2")), "vectors")
    same = ["label", "m1", "m2"]
    classes = vectors.groupBy(*same).agg(F.min(F.struct(F.col("vec_id").alias("node"), "embedding")).alias("f"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.select(*same, F.col("f.node").alias("node"), F.col("f.embedding").alias("embedding"), "copies"), "classes")

    indexes, spread = fitted(classes, classes.count(), cosine, recall, block)
    cell = CELL.format(label=label)
    filed = classes.select("label", "node", "copies", "embedding").mapInArrow(_file(indexes, spread), f"{cell}, role int, salt long, node long, copies long, vector binary")
    dealt = filed.repartition("label", "size", "a", "b", "salt").sortWithinPartitions("label", "size", "a", "b", "role")
    blocks = staged(dealt.mapInArrow(_pack(block), f"{cell}, role int, nodes binary, copies binary, vectors binary"), "blocks")
    key = ["label", "size", "a", "b"]
    home = blocks.filter(F.col("role") == FILED).select(*key, *[F.col(n).alias(f"{n}_f") for n in ("nodes", "copies", "vectors")])
    # a crowded cell: every visiting block meets each part of what is filed in a task of its own
    crowded = home.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts")).filter("parts > 1")
    crowded = staged(crowded, "crowded")
    parts = F.coalesce("parts", F.lit(1))
    home = home.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("nodes_f"), parts).cast("int")).drop("parts")
    guests = blocks.filter(F.col("role") != FILED).join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    pairs = guests.join(home, [*key, "part"])
    links = staged(pairs.drop("label", "a", "b", "part").mapInArrow(_compare(cosine, double), "node long, links long, toward long"), "links")
    drop_staged(blocks, crowded)
    groups = components(links, "node", "toward")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.select(*same, "node", "copies").join(degree, "node", "left").join(groups, "node", "left")
    n = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    found = found.select(*same, n.alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    told = staged(vectors.select("vec_id", *same).join(found, same).select(F.col("vec_id").alias("__id"), "n_links", "component_id"), "told")
    drop_staged(vectors, classes, links)
    out = rows.select("vec_id").join(told, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), kept.alias("kept"))
