"""Long exact spans shared between records (problem 10).

A gear rolling hash runs over every text; among the `least` - 63 hashes of any window of `least`
characters the least one is the window's anchor, so equal windows have equal anchors at equal places,
wherever they lie. The windows of one anchor cover a chunk: a content-defined, variable and overlapping
stretch of text which insertions elsewhere don't touch. Chunks are deduplicated by digest. A chunk held by
two documents is shared in full. Chunks held by one document whose anchor also occurs elsewhere are the
edges of shared spans: only for those, one text per distinct chunk, are the single windows compared.
Nothing is paired; every step is an aggregation by digest, combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Characters that a 64-bit gear hash sees.
REACH = 64
_SLICE = 1 << 20
_PLACE_BITS = 26

#: Chosen chunks are broadcast to the texts up to this many (about 32 MB), and joined by shuffle beyond.
BROADCAST_CHUNKS = 500_000
#: Before that shuffle, texts without a chosen chunk are left out by a broadcast of ids, up to this many (32 MB).
BROADCAST_IDS = 4_000_000

_CHUNK = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("chunk", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
_CHUNK_DDL = "doc_id bigint, anchor bigint, chunk bigint, start int, windows int"
_WINDOW = pa.schema([("anchor", pa.int64()), ("chunk", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("at", pa.int32()), ("window", pa.int64())])
_WINDOW_DDL = "anchor bigint, chunk bigint, low bigint, high bigint, at int, window bigint"


def _signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, np.uint64).view(np.int64)


def _gear(code: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number per character (the gear table as a function, so any alphabet fits)."""
    x = code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _gear(np.arange(1 << 16))


def gear_hashes(code: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear(c[i - j]) << j for j < 64, for each i >= 63: the rolling hash, by doubling."""
    h = _TABLE[code] if not len(code) or code.max() < len(_TABLE) else _gear(code)
    width = 1
    while width < REACH:
        h = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    return h


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of its least one, the first among equals."""
    n = len(hashes) - width + 1
    # One key holds hash and place; the low bits lost decide nothing but which of two places wins.
    key = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _anchored(code: np.ndarray, least: int):
    """Windows of a text by their anchor: (first window, number of windows, place of the anchor's hash, hash)."""
    width = least - REACH + 1
    for lo in range(0, len(code) - least + 1, _SLICE):
        part = code[lo : lo + _SLICE + least - 1]
        hashes = gear_hashes(part)
        place = window_anchors(hashes, width)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        yield lo + first, count, lo + place[first], hashes[place[first]]


def _chunks(least: int):
    digest = xxhash.xxh3_64_intdigest

    def chunks(batches):
        for batch in batches:
            docs, anchors, digests, starts, counts = [], [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text is None or len(text) < least:
                    continue
                raw = text.encode("utf-32-le", "surrogatepass")
                view = memoryview(raw)
                for first, count, _, hashes in _anchored(np.frombuffer(raw, np.uint32), least):
                    docs += [doc] * len(first)
                    anchors.append(hashes.view(np.int64))
                    starts.append(first)
                    counts.append(count)
                    digests += [digest(view[4 * s : 4 * (s + n + least - 1)]) for s, n in zip(first.tolist(), count.tolist(), strict=True)]
            if docs:
                join = lambda a, t: pa.array(np.concatenate(a), t)
                columns = [pa.array(docs, pa.int64()), join(anchors, pa.int64()), pa.array(_signed(digests)), join(starts, pa.int32()), join(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=_CHUNK)

    return chunks


def _windows(least: int):
    """The single windows of chosen chunks; `wanted` is an array of (anchor, chunk, low, high, start, windows)."""
    digest = xxhash.xxh3_64_intdigest

    def windows(batches):
        for batch in batches:
            wide: list[list[int]] = [[], [], [], []]
            at, found = [], []
            for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                view = memoryview(text.encode("utf-32-le", "surrogatepass"))
                for w in wanted:
                    n, s = w["windows"], w["start"]
                    # Should an id have several texts, only the one that holds the chunk counts.
                    if digest(view[4 * s : 4 * (s + n + least - 1)]) != w["chunk"] & 0xFFFFFFFFFFFFFFFF:
                        continue
                    for column, name in zip(wide, ("anchor", "chunk", "low", "high"), strict=True):
                        column += [w[name]] * n
                    at += range(n)
                    found += [digest(view[4 * i : 4 * (i + least)]) for i in range(s, s + n)]
            columns = [*(pa.array(c, pa.int64()) for c in wide), pa.array(at, pa.int32()), pa.array(_signed(found))]
            yield pa.RecordBatch.from_arrays(columns, schema=_WINDOW)

    return windows


def shared_spans(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 320) -> DataFrame:
    """(doc_id, start, stop): the stretches of each document, in characters, that lie in a span of at least
    `least` characters that another document also has. Stretches of one document may overlap.

    `least` is at least 128. Characters are code points and are compared exactly. Documents without id are
    left out, null and short texts share nothing, rows with one id are one document as far as sharing
    goes (a span repeated inside one document isn't shared). Equality is that of two 64-bit digests, the anchor's and the chunk's or window's.
    """
    if least < 2 * REACH:
        raise ValueError(f"least must be {2 * REACH} or more")
    corpus = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text")).where("doc_id is not null").where(F.length("text") >= least)
    everything = cut(corpus.mapInArrow(_chunks(least), _CHUNK_DDL))
    # Anchors that two documents have; windows of others can't be shared.
    common = everything.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("anchor")
    chunks = cut(everything.join(common, "anchor", "left_semi"))
    distinct = chunks.groupBy("anchor", "chunk").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("windows").alias("windows"))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")

    whole = distinct.where("low <> high").select("anchor", "chunk", F.lit(0).alias("at"), (F.col("windows") - 1).alias("last"))
    edges = distinct.join(several, "anchor", "left_semi")
    places = chunks.select("anchor", "chunk", F.col("doc_id").alias("low"), "start").join(edges, ["anchor", "chunk", "low"]).groupBy("anchor", "chunk", "low", "high", "windows").agg(F.min("start").alias("start"))
    wanted = cut(places.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "chunk", "low", "high", "start", "windows")).alias("wanted")))
    holders, some = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    if some <= BROADCAST_CHUNKS:
        chosen = corpus.join(F.broadcast(wanted), "doc_id")
    else:
        # One text per distinct chunk is asked for, so most texts stay where they are.
        asked = corpus.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi") if holders <= BROADCAST_IDS else corpus
        chosen = asked.join(wanted, "doc_id")
    windows = chosen.select("text", "wanted").mapInArrow(_windows(least), _WINDOW_DDL)
    held = windows.groupBy("anchor", "window").agg(F.min("low").alias("a"), F.max("high").alias("z")).where("a <> z").select("anchor", "window")
    single = windows.where("low = high").select("anchor", "chunk", "at", "window").join(held, ["anchor", "window"], "left_semi").select("anchor", "chunk", "at", F.col("at").alias("last"))
    parts = whole.unionByName(single).groupBy("anchor", "chunk").agg(F.collect_list(F.struct("at", "last")).alias("parts"))
    return (
        chunks.join(parts, ["anchor", "chunk"])
        .select("doc_id", "start", F.explode("parts").alias("p"))
        .select("doc_id", (F.col("start") + F.col("p.at")).alias("start"), (F.col("start") + F.col("p.last") + least).alias("stop"))
    )


def shared_chars(spans: DataFrame) -> DataFrame:
    """(doc_id, shared_chars): characters of each document that lie in any of its spans, each once."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("until"))

    def add(acc, span):
        return F.struct((acc["total"] + F.greatest(span["stop"] - F.greatest(span["start"], acc["until"]), F.lit(0))).cast("bigint").alias("total"), F.greatest(acc["until"], span["stop"]).alias("until"))

    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return lists.select("doc_id", F.aggregate("spans", zero, add, lambda acc: acc["total"]).alias("shared_chars"))
