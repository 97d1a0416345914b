"""Dropping lines that many documents share: two Bloom filters find suspected repeats, an exact count confirms them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Only keys of at least ``MIN_CHARS``
code points count.

1. Every task gathers the keys of its texts into two bit sets, *seen once* and *seen twice*.  The bit sets are cut into segments, which are
   merged where they meet; a bit that two tasks have seen once is seen twice.
2. The texts are read again.  A key whose bits are all in *seen twice* is a suspected repeat; only these leave their task, as a 128-bit
   digest and the document's id.  A key of two documents is always suspected.
3. The suspects are counted exactly, per key and document.  A key of at least ``MIN_DOCS`` documents stays in the one with the largest id.

The filters have ``BITS_A_LINE`` bits for each line, up to ``max_bits``, which bounds what is broadcast.  Beyond that they fill up: more
keys are suspected and shuffled, up to all of them, and the result stays the same.

Nulls and odd rows: a null or empty text is one empty line.  All rows of a null id are one document, before all others.  Rows of one id are
one document: their lines count once, and all of them keep or lose a key.  Texts of any length are taken whole.  Ties can't occur, as the
largest id is unique.  An empty table gives no rows.  Other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scangrove.llm.tokens import picked
from scangrove.operators.ordering import heavy_keys
from scangrove.session import stored

MIN_CHARS, MIN_DOCS = 20, 3
BITS_A_LINE = 16
#: A segment of a filter: 128 KB.
SEGMENT = 1 << 20
MAX_BITS = 1 << 30
#: Keys a task holds before it hands on what it has gathered.
GATHERED = 1 << 20
#: Up to so many bits of a segment are handed on as numbers, more as the whole segment.
FEW = 1 << 14


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, or none if the key is too short; bytes.strip and bytes.lower know ASCII only, as is asked for."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return blake2b(key, digest_size=16).digest()


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    return {key for line in (text or "").encode().split(b"\n") if len(line) >= min_chars and (key := line_key(line, min_chars))}


def bit_places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the filter for each digest (two 64-bit halves), both in the same segment."""
    segment = (digests[:, 0] >> np.uint64(40)) % np.uint64(max(1, bits // SEGMENT))
    low = np.uint64(min(bits, SEGMENT) - 1)
    return (segment * np.uint64(SEGMENT))[:, None] + np.stack([digests[:, 1] & low, (digests[:, 1] >> np.uint64(32)) & low], axis=1)


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _packed(places: np.ndarray) -> bytes:
    """Bits of one segment: few as numbers, many as the segment itself."""
    if len(places) <= FEW:
        return places.astype(np.uint32).tobytes()
    bits = np.zeros(SEGMENT, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(SEGMENT, bool)
    bits[np.frombuffer(data, np.uint32)] = True
    return np.packbits(bits, bitorder="little")


def _gather(bits: int, min_chars: int):
    """The filters of a task's texts, a row a segment."""
    names = ["segment", "once", "twice"]

    def rows(digests: list[bytes]) -> pa.RecordBatch:
        keys, counts = np.unique(_halves(digests), axis=0, return_counts=True)
        once = np.unique(bit_places(keys, bits))
        twice = np.unique(bit_places(keys[counts > 1], bits))
        segments = np.unique(once // np.uint64(SEGMENT))
        edges = [np.searchsorted(x, np.append(segments, segments[-1:] + np.uint64(1)) * np.uint64(SEGMENT)) for x in (once, twice)]
        parts = [[_packed(x[e[i]:e[i + 1]] % np.uint64(SEGMENT)) for i in range(len(segments))] for x, e in zip((once, twice), edges)]
        return pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for text in batch.column("text"):
                held.extend(keys_of(text.as_py(), min_chars))
                if len(held) >= GATHERED:
                    yield rows(held)
                    held = []
        if held:
            yield rows(held)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each segment that holds repeats: the bits seen twice.  Rows of a segment are merged as they stream by."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            new_once, new_twice = _unpacked(once), _unpacked(twice)
            if segment in held:
                old_once, old_twice = held[segment]
                held[segment] = [old_once | new_once, old_twice | new_twice | (old_once & new_once)]
            else:
                held[segment] = [new_once, new_twice]
    for segment, (_, twice) in held.items():
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])


def seen_twice(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The filter of keys seen at least twice, ``bits`` bits as bytes; its size does not depend on the texts."""
    gathered = docs.select("text").mapInArrow(_gather(bits, min_chars), "segment int, once binary, twice binary")
    merged = gathered.repartition("segment").mapInArrow(_merge, "segment int, twice binary")
    whole = np.zeros(max(bits, SEGMENT) // 8, np.uint8)
    for batch in merged.toArrow().to_batches():
        for segment, data in zip(*(c.to_pylist() for c in batch.columns)):
            whole[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = np.frombuffer(data, np.uint8)
    return whole


def _suspects(filter_: Broadcast, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = filter_.value
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column("text")):
                found = keys_of(text.as_py(), min_chars)
                keys.extend(found)
                rows.extend([i] * len(found))
            if not keys:
                continue
            places = bit_places(_halves(keys), bits)
            hit = ((twice[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            ids = batch.column("doc_id").take(pa.array(np.array(rows)[hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([k for k, h in zip(keys, hit) if h], pa.binary())], ["doc_id", "key"])
    return run


def repeated_keys(suspects: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, docs, keeper: the keys of at least ``min_docs`` documents, exactly, and the largest id that holds each."""
    return (
        suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    )


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keys: for every document that loses lines the digests of their keys."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(max_bits, max(SEGMENT, 1 << (BITS_A_LINE * lines - 1).bit_length() if lines else 0))
    twice = spark.sparkContext.broadcast(seen_twice(docs, bits, min_chars))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary"
    suspects = stored(docs.mapInArrow(_suspects(twice, bits, min_chars), kinds), "suspected-lines")
    repeated = stored(repeated_keys(suspects, min_docs), "repeated-lines")
    # Keys of very many documents are few, and their rows stay where they are; the others meet their few rows in a shuffle.
    popular = heavy_keys(suspects, ["key"]).select("key").join(repeated, "key")
    rest = suspects.join(F.broadcast(popular.select("key")), "key", "left_anti").join(repeated, "key")
    dropped = suspects.join(F.broadcast(popular), "key").unionByName(rest).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return dropped.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _without(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if keys:
                    gone = set(keys)
                    parts = [p for p in parts if len(p) < min_chars or line_key(p.encode(), min_chars) not in gone]
                kept.append("\n".join(parts))
                dropped.append(lines[-1] - len(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"])
    return run


def without_repeated_lines(
    documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """doc_id, text without the repeated lines, n_lines before, n_dropped; a row for each row of ``documents``."""
    docs = picked(documents, doc_id="doc_id", text="text")
    drop = lines_to_drop(docs, min_chars, min_docs, max_bits).withColumnRenamed("doc_id", "_id")
    both = docs.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "keys")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_without(min_chars), f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")


def line_dedup_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the lines that stay."""
    return without_repeated_lines(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
