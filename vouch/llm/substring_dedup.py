"""Substring dedup: an FM-index per shard, searched backwards through a wavelet matrix.

Windows of words are routed so that equal ones meet: each window goes by the smallest
hash among its word n-grams, its anchor.  Runs of windows with one anchor form a
segment; segments whose anchor one document alone has cannot repeat and stay out.  The
others are folded by their words and indexed, a shard of anchors at a time, and every
segment is streamed through the index of its shard.  All decisions are made on words;
hashes only route.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import documents, map_batches, materialise, text_or_empty
from workload.registry import query

WINDOW = 50
ANCHOR = 6
# Words indexed in one task, and segments of one anchor beyond which it is split by window.
SHARD_WORDS = 200_000
HOT_SEGMENTS = 2_000
NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(11)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACE_VALUE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
GRAM_VALUE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: bytes) -> np.ndarray:
    """A hash of each of the words that single spaces part."""
    data = np.frombuffer(words + b" ", np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(data == 32)[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return mixed(np.add.reduceat(BYTE_VALUE[data] * PLACE_VALUE[place & 63], starts))


def anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The smallest hash among the n-grams of each window of words; empty if there is no window."""
    size = len(hashes) - anchor + 1
    width = window - anchor + 1
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    low = np.zeros(size, np.uint64)
    for j in range(anchor):
        low += hashes[j:j + size] * GRAM_VALUE[j]
    low = mixed(low)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:len(low) - (width - span)], low[width - span:]) if width > span else low


def runs(found: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of one anchor, cut at ``longest`` windows."""
    change = np.flatnonzero(np.diff(found) != 0) + 1
    first = np.concatenate(([0], change))
    sizes = np.diff(np.append(first, len(found)))
    parts = -(-sizes // longest)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + inside * longest
    return first, np.append(first[1:], len(found)) - 1


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the pair (id, text_hash) that tells rows apart; a null id counts as larger than any other."""
    doc_id, text = F.col("doc_id").cast("long"), text_or_empty()
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def document_anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, text_hash, anchor): each document's distinct anchors."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = b" ".join(text.split())
            found.append(np.unique(anchors(word_hashes(words), window, anchor)) if words else np.zeros(0, np.uint64))
        sizes = [len(f) for f in found]
        each = np.repeat(np.arange(len(found)), sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(pa.array(each)) for c in ("id", "text_hash")] + [pa.array(np.concatenate(found).view(np.int64))], ["id", "text_hash", "anchor"])

    return map_batches(rows.select("id", "text_hash", "text"), work, "id long, text_hash long, anchor long")


def cut_segments(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, text_hash, anchor, first, segment, n_words): the segments of a document whose anchors are in its ``shared``."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        each: list[int] = []
        for i, (text, shared) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("shared").to_pylist())):
            words = text.split()
            whole = b" ".join(words)
            found = anchors(word_hashes(whole), window, anchor)
            first, last = runs(found, window - anchor + 1)
            keep = np.isin(found[first].view(np.int64), np.array(shared, np.int64))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            for a, b, v in zip(first[keep].tolist(), last[keep].tolist(), found[first[keep]].view(np.int64).tolist()):
                begin = int(ends[a - 1]) + 1 if a else 0
                out.append((v, a, whole[begin:int(ends[b + window - 1])], b + window - a))
                each.append(i)
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(pa.array(each, pa.int64())) for c in ("id", "text_hash")]
            + [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64())],
            ["id", "text_hash", "anchor", "first", "segment", "n_words"])

    return map_batches(rows.select("id", "text_hash", "shared", "text"), work,
                       "id long, text_hash long, anchor long, first long, segment string, n_words long")


# -- the index ------------------------------------------------------------------------------

class Bits:
    """A bit vector with rank: packed words and one count per word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols by bit planes, the highest first; each plane is stably parted by its bit."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.planes: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.planes.append((shift, Bits(bit), int((bit == 0).sum())))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.begin = self.place(np.arange(size), np.zeros(size, np.int64))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.planes:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self.place(symbol, at) - self.begin[symbol]


class FMIndex:
    """Of segments (lists of word numbers from 1): intervals of all windows, and the smallest owner in each.

    Suffixes are ordered by at least ``window`` words, which is all that a search for
    patterns of that length needs; a segment's end is symbol 0.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, size: int, window: int) -> None:
        n = len(text)
        self.window, self.n = window, n
        ranks, depth = text.astype(np.int64), 1
        part, part_depth = ranks, 1
        while depth < window:
            if depth <= window - 1:
                part, part_depth = ranks, depth
            tail = np.concatenate((ranks[depth:], np.full(min(depth, n), -1)))[:n]
            ranks = np.unique(ranks * (n + size + 2) + tail + 1, return_inverse=True)[1]
            depth *= 2
        order = np.argsort(ranks, kind="stable")

        def same(length: int) -> np.ndarray:
            """Whether a suffix shares its first words with the one before, from two overlapping parts."""
            shifted = np.concatenate((part[length - part_depth:], np.full(length - part_depth, -1)))[:n]
            return (part[order[1:]] == part[order[:-1]]) & (shifted[order[1:]] == shifted[order[:-1]])

        # intervals of the patterns one word shorter than a window, around each suffix
        starts = np.concatenate(([0], np.flatnonzero(~same(window - 1)) + 1)) if window > 1 else np.zeros(1, np.int64)
        sizes = np.diff(np.append(starts, n))
        self.left, self.right = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        self.smallest = np.zeros(n, np.int64)
        if part_depth * 2 >= window:
            full = np.concatenate(([0], np.flatnonzero(~same(window)) + 1))
            self.smallest = np.repeat(np.minimum.reduceat(owner[order], full), np.diff(np.append(full, n)))
        before = text[order - 1]  # the first suffix is preceded by the last symbol, an end
        self.symbols = WaveletMatrix(before.astype(np.int64), size)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))[:-1]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals of the patterns with ``symbol`` put before."""
        return self.first[symbol] + self.symbols.rank(symbol, low), self.first[symbol] + self.symbols.rank(symbol, high)

    def stream(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of segments, all read backwards in step, one word at a time.

        Returns (place, low, high): of each place where a match reaches the window's
        length, the interval of the suffixes that begin with that window.
        """
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = (starts + sizes)[order], sizes[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        matched = np.zeros(len(order), np.int64)
        found = []
        for t in range(1, int(sizes.max(initial=0)) + 1):
            m = int(np.searchsorted(-sizes, -t, side="right"))
            full = np.flatnonzero(matched[:m] == self.window)
            # a match of full length gives up its last word before it grows to the left
            low[full], high[full] = self.left[low[full]], self.right[high[full] - 1]
            matched[full] -= 1
            low[:m], high[:m] = self.extend(text[ends[:m] - t], low[:m], high[:m])
            matched[:m] += 1
            lost = np.flatnonzero(low[:m] >= high[:m])
            low[lost], high[lost], matched[lost] = 0, self.n, 0
            hit = np.flatnonzero(matched[:m] == self.window)
            found.append((ends[hit] - t, low[hit], high[hit]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def search_shard(segments: list[str], owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, smallest owner of an equal window), one row per window of every segment."""
    numbers: dict[str, int] = {}
    parts = [[numbers.setdefault(w, len(numbers) + 1) for w in s.split(" ")] for s in segments]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.fromiter((w for p in parts for w in p), np.int64, int(sizes.sum()))
    which = np.repeat(np.arange(len(parts)), sizes + 1)
    index = FMIndex(text, owners[which], len(numbers) + 1, window)
    place, low, _ = index.stream(text, starts, sizes)
    order = np.argsort(place)
    place, low = place[order], low[order]
    return which[place], place - starts[which[place]], index.smallest[low]


def search(units: DataFrame, shards: int, window: int) -> DataFrame:
    """(unit, a, b, smallest): windows a to b of a unit begin in ``smallest``, where that is less than the unit's largest id."""
    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit", ignore_index=True)
        which, offset, smallest = search_shard(group["segment"].tolist(), group["low_id"].to_numpy(np.int64), window)
        keep = smallest < group["high_id"].to_numpy(np.int64)[which]
        which, offset, smallest = which[keep], offset[keep], smallest[keep]
        new = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1) | (np.diff(smallest, prepend=-1) != 0))
        last = np.append(new[1:], len(which)) - 1 if len(which) else new
        return pd.DataFrame({"unit": group["unit"].to_numpy()[which[new]], "a": offset[new], "b": offset[last], "smallest": smallest[new]})

    sharded = units.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(work, "unit string, a long, b long, smallest long")


def fold(units: DataFrame) -> DataFrame:
    """Equal units are one, with the smallest and largest id of the documents that have them."""
    return units.groupBy("route", "segment").agg(F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id")).withColumn("unit", F.md5("segment"))


def covered_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(id, text_hash, a, b): windows a to b of a document also begin in one with a smaller id."""
    if not 1 <= anchor < window:
        raise ValueError("an anchor is shorter than a window")
    rows = with_keys(docs)
    held = materialise(document_anchors(rows, window, anchor), "anchors")
    shared = held.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor")
    shared = materialise(shared, "shared-anchors")
    sets = held.join(shared, "anchor").groupBy("id", "text_hash").agg(F.collect_set("anchor").alias("shared"))
    segments = materialise(cut_segments(rows.join(sets, ["id", "text_hash"]), window, anchor), "segments", "zstd")
    made = segments.select(F.col("anchor").alias("route"), "segment", F.col("id").alias("low_id"), F.col("id").alias("high_id"))
    units = materialise(fold(made).withColumn("n_words", F.size(F.split("segment", " "))), "segment-units", "zstd")
    counts = units.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"))
    hot = materialise(counts.filter(F.col("n") > hot_segments).select("route"), "hot-anchors")
    total = units.agg(F.sum("n_words")).first()[0] or 0
    shards = 1 + total // shard_words
    cold_found = search(units.join(hot, "route", "left_anti"), shards, window)
    # An anchor with very many segments, as of a passage in much of the corpus, is split:
    # its windows go each by their own words, and fold again.
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - window),
        lambda i: F.struct(i.cast("long").alias("offset"), F.array_join(F.slice("words", i + 1, F.lit(window)), " ").alias("segment")))
    cut = units.join(hot, "route", "left_semi").withColumn("words", F.split("segment", " "))
    cut = cut.select(F.col("unit").alias("parent"), "low_id", "high_id", F.explode(pieces).alias("w")).select("parent", "low_id", "high_id", "w.offset", "w.segment")
    windows = fold(cut.select(F.xxhash64("segment").alias("route"), "segment", "low_id", "high_id"))
    window_found = materialise(search(windows, shards, window), "hot-windows")
    hot_found = cut.select("parent", "offset", F.md5("segment").alias("unit")).join(window_found.select("unit", "smallest"), "unit")
    found = materialise(
        cold_found.unionByName(hot_found.select(F.col("parent").alias("unit"), F.col("offset").alias("a"), F.col("offset").alias("b"), "smallest")), "repeats")
    places = segments.select("id", "text_hash", "first", F.md5("segment").alias("unit"))
    return places.join(found, "unit").filter("smallest < id").select(
        "id", "text_hash", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def kept_words(words: list, spans: list[dict], window: int) -> list:
    """The words that no covered window holds."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["a"]] += 1
        gone[s["b"] + window] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    A word goes if it lies in a window of ``window`` words whose words also begin in a
    document with a smaller id, judged on the input as it is.  kept_text joins the kept
    words by single spaces.  Null, empty and blank texts have no words, shorter ones no
    window.  A null id is larger than any other, so such documents lose what others have
    but not what they share among themselves; equal ids take nothing from each other.
    Repeated rows give repeated rows, an empty table gives no rows, columns other than
    doc_id and text are not read.
    """
    spans = covered_windows(docs, window, **options).groupBy("id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = with_keys(docs).join(spans, ["id", "text_hash"], "left").select("doc_id", "text", "spans")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = text.split()
            keep = kept_words(words, spans, window) if spans else words
            out.append((len(words), len(words) - len(keep), b" ".join(keep)))
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"])

    return map_batches(rows, work, "doc_id long, n_words long, n_removed long, kept_text string")


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
