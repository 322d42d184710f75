"""Byte-level BPE by overlapping chunk encoding.

A text longer than a chunk is cut into overlapping chunks, which tasks pre-tokenise
independently.  A chunk that starts in the middle of a pre-token gets its first
boundaries wrong, but the pattern only looks ahead: from the first boundary that two
neighbouring chunks share (after no white space), both go on alike.  The text is cut at those places, the
pieces between are encoded in parallel, and the ids are put together in order.
Where an overlap holds no shared boundary (one pre-token longer than it), the
chunks on both sides are encoded as one piece, so results are always those of the
whole text: a pre-token can't be cut, and one longer than a chunk is a task's.
Texts no longer than a chunk are a single piece.  Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stage import staged

#: Characters of a chunk and of what it shares with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: No alternative of the pattern looks further beyond the end of a match than this.
LOOKAHEAD = 4

DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """A tiktoken encoding without special tokens; loaded once in each worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    return np.array(encoding(ranks_path, pattern).encode_ordinary(text), dtype="<u4")


def decode_ids(ids, ranks_path: str, pattern: str) -> bytes:
    return encoding(ranks_path, pattern).decode_bytes(list(map(int, ids)))


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Where pre-tokens of ``text`` start; without those that what follows could still change."""
    import regex

    sure = len(text) if last else len(text) - LOOKAHEAD
    return [m.start() for m in regex.finditer(pattern, text) if m.start() <= sure]


def cuts(text: str, pattern: str, last: bool) -> list[int]:
    """Boundaries at which a text can be cut.

    Not those after white space: how a run of it is divided depends on what follows.
    """
    import regex

    return [b for b in boundaries(text, pattern, last) if b and not regex.match(r"\s", text[b - 1])]


def _digest_short(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(ranks_path, pattern)
        for batch in batches:
            counts, ids_hex, raw_hex = [], [], []
            for text in batch.column("__text"):
                ids = code.encode_ordinary(text.as_py())
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                raw_hex.append(hashlib.sha256(code.decode_bytes(ids)).hexdigest())
            rest = [batch.column(n) for n in batch.schema.names if n != "__text"]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(raw_hex, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _edges(pattern: str, chunk: int):
    """Where each chunk can be cut in the overlaps at its start and end, as places in the text."""

    def run(batches):
        for batch in batches:
            heads, tails = [], []
            for i, n, text in zip(batch.column("i").to_pylist(), batch.column("n").to_pylist(), batch.column("part")):
                text = text.as_py()
                found = cuts(text, pattern, i == n - 1)
                over = len(text) - chunk
                heads.append([i * chunk + b for b in found if 0 < i and b <= OVERLAP])
                tails.append([i * chunk + b for b in found if i < n - 1 and b >= chunk and over > 0])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("i"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["uid", "i", "heads", "tails"])

    return run


def _encode_runs(ranks_path: str, pattern: str, chunk: int):
    """Each run of chunks between two cuts, given in order, becomes ids and raw bytes."""

    def run(batches):
        code = encoding(ranks_path, pattern)
        open_run, text = None, []

        def flush():
            ids = code.encode_ordinary("".join(text))
            return {"uid": open_run[0], "run": open_run[1], "n_tokens": len(ids), "ids": np.array(ids, dtype="<u4").tobytes(), "raw": code.decode_bytes(ids)}

        schema = pa.schema([("uid", pa.int64()), ("run", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("raw", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = (row["uid"], row["run"])
                if key != open_run:
                    if open_run:
                        out.append(flush())
                    open_run, text = key, []
                start, end = row["start"] - row["i"] * chunk, row["end"] - row["i"] * chunk
                text.append(row["part"][start:end])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if open_run:
            yield pa.RecordBatch.from_pylist([flush()], schema=schema)

    return run


def _digest_runs(batches):
    """Hashes the ids and bytes of each text, given run by run in order."""
    schema = pa.schema([("uid", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    uid, count, ids, raw = None, 0, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["uid"] != uid:
                if uid is not None:
                    out.append({"uid": uid, "n_tokens": count, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()})
                uid, count, ids, raw = row["uid"], 0, hashlib.sha256(), hashlib.sha256()
            count += row["n_tokens"]
            ids.update(row["ids"])
            raw.update(row["raw"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if uid is not None:
        yield pa.RecordBatch.from_pylist([{"uid": uid, "n_tokens": count, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()}], schema=schema)


def encoded_runs(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Texts longer than a chunk: (uid, doc_id) and their runs (uid, run, n_tokens, ids, raw)."""
    long = docs.select("doc_id", "text", F.length("text").alias("size")).filter(F.col("size") > chunk)
    # one pass cuts a text into pieces, whose rows carry no more than themselves and the next one's beginning
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    long = long.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "size", pieces.alias("pieces"))
    whole = F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.substring(F.get("pieces", i + 1), 1, OVERLAP), F.lit(""))))
    each = long.select("uid", "doc_id", "size", F.size("pieces").alias("n"), F.posexplode(whole).alias("i", "part"))
    # the written table fixes uid, however often it is read
    parts = staged(each, "chunks")
    edges = parts.select("uid", "i", "n", "part").mapInArrow(_edges(pattern, chunk), "uid long, i int, heads array<long>, tails array<long>")
    order = W.partitionBy("uid").orderBy("i")
    cut = F.array_min(F.array_intersect("tails", F.lead("heads").over(order)))
    cuts = edges.select("uid", "i", cut.alias("cut"))
    before = F.lag("cut").over(order)
    cuts = cuts.select("uid", "i", "cut", before.alias("before"), (F.sum(before.isNotNull().cast("long")).over(order)).alias("run"))
    placed = parts.join(cuts, ["uid", "i"])
    own = (F.col("i") * chunk).cast("long")
    # without a cut a chunk hands over to the next exactly where that one starts
    start = F.coalesce("before", own)
    end = F.coalesce("cut", F.when(F.col("i") == F.col("n") - 1, F.col("size").cast("long")).otherwise(own + chunk))
    runs = placed.select("uid", "run", "i", start.alias("start"), end.alias("end"), "part")
    runs = runs.repartition("uid", "run").sortWithinPartitions("uid", "run", "i")
    runs = runs.mapInArrow(_encode_runs(ranks_path, pattern, chunk), "uid long, run long, n_tokens long, ids binary, raw binary")
    return parts.filter("i = 0").select("uid", "doc_id"), runs


def digest(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Needs doc_id and text; other columns are ignored.  A null text counts as empty: no
    tokens, the hashes of nothing.  Equal rows give equal rows; an empty table none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.select("doc_id", text.alias("__text")).filter(F.length("__text") <= chunk)
    short = short.mapInArrow(_digest_short(ranks_path, pattern), f"{_type(docs)}, {DIGEST}")
    names, runs = encoded_runs(docs, ranks_path, pattern, chunk=chunk)
    whole = runs.repartition("uid").sortWithinPartitions("uid", "run").mapInArrow(_digest_runs, f"uid long, {DIGEST}")
    long = names.join(whole, "uid").drop("uid")
    return short.unionByName(long)


def _encode_batches(ranks_path: str, pattern: str):
    def run(batches):
        code = encoding(ranks_path, pattern)
        for batch in batches:
            ids = [np.array(code.encode_ordinary(t.as_py()), dtype=np.int32) for t in batch.column("__text")]
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(ids, pa.list_(pa.int32()))], names=[*rest, "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK) -> DataFrame:
    """doc_id, piece, ids: the ids of every text, in pieces to be read in order.

    Needs doc_id and text; other columns are ignored.  A null or empty text is one piece
    without ids, repeated rows give repeated pieces, an empty table none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.select("doc_id", F.lit(0).cast("long").alias("piece"), text.alias("__text")).filter(F.length("__text") <= chunk)
    short = short.mapInArrow(_encode_batches(ranks_path, pattern), f"{_type(docs)}, piece long, ids array<int>")
    names, runs = encoded_runs(docs, ranks_path, pattern, chunk=chunk)

    def unpack(batches):
        for batch in batches:
            ids = [np.frombuffer(b.as_py(), dtype="<u4").astype(np.int32) for b in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("run"), pa.array(ids, pa.list_(pa.int32()))], names=["uid", "piece", "ids"])

    long = runs.select("uid", "run", "ids").mapInArrow(unpack, "uid long, piece long, ids array<int>")
    return short.unionByName(names.join(long, "uid").drop("uid"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, piece, raw: the bytes of every piece; a text is its pieces' bytes in order.

    Needs doc_id, piece, ids; other columns are ignored.  Null or empty ids are no bytes;
    repeated rows give repeated rows, an empty table none.
    """

    def run(batches):
        code = encoding(ranks_path, pattern)
        for batch in batches:
            raw = [code.decode_bytes(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), pa.array(raw, pa.binary())], names=["doc_id", "piece", "raw"])

    return encoded.select("doc_id", "piece", "ids").mapInArrow(run, f"{_type(encoded)}, piece long, raw binary")


def _type(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"
