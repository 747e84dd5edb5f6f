"""LM scoring by masked pseudo-likelihood: a two-sided window network, trained in numpy across the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import documents, id_text, map_batches, materialise
from workload.registry import query

# The network predicts a word's bucket as digits of sixteen, and the counts of the corpus share a bucket
# out among its words; the last bucket is the text's edge.  The number of digits follows the number
# of distinct words: three up to WORDS_PER_BUCKET * 16**3 of them, then one more for each factor of 16.
DIGIT, DIGITS = 16, 3
BUCKETS = DIGIT ** DIGITS
WORDS_PER_BUCKET = 1024
LEVELS = ("first", "second", "third", "fourth", "fifth", "sixth")
OFFSETS = (-2, -1, 1, 2)
WIDTH = 16
# Every document is trained on in one of ROUNDS rounds, and all its words then.
MASK_EVERY = 1
BATCH = 4096
ROUNDS = 2
RATE = 0.1
BLOCK = 4096
# Words of a shard, which trains a network of its own in a round, for three digits; more in proportion to the buckets.
SHARD_WORDS = 1 << 20
# At most so many of the most frequent words are looked up in arrays; all others are joined.
FREQUENT = 1 << 18


def shapes(digits: int = DIGITS) -> dict[str, tuple[int, ...]]:
    return {"embed": (len(OFFSETS), DIGIT ** digits + 1, WIDTH), "bias": (WIDTH,), "out": (WIDTH, digits * DIGIT),
            **{LEVELS[k]: (DIGIT ** k, DIGIT) for k in range(digits)}}


def size_of(digits: int = DIGITS) -> int:
    return sum(int(np.prod(s)) for s in shapes(digits).values())


SHAPES, SIZE = shapes(), size_of()


def digits_for(distinct: int) -> int:
    """Digits of a bucket for a corpus with so many distinct words."""
    digits = DIGITS
    while digits < len(LEVELS) and distinct > WORDS_PER_BUCKET * DIGIT ** digits:
        digits += 1
    return digits


def unpacked(flat: np.ndarray, digits: int = DIGITS) -> dict[str, np.ndarray]:
    """Views of the parameters inside one flat vector."""
    out, at = {}, 0
    for name, shape in shapes(digits).items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def initial(seed: int = 7, digits: int = DIGITS) -> np.ndarray:
    flat = np.zeros(size_of(digits), np.float32)
    rng, views = np.random.default_rng(seed), unpacked(flat, digits)
    views["embed"][:] = rng.normal(0, 0.1, views["embed"].shape)
    views["out"][:] = rng.normal(0, 0.1, views["out"].shape)
    return flat


_rng = np.random.default_rng(20)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUE[ord("A"):ord("Z") + 1] = BYTE_VALUE[ord("a"):ord("z") + 1]
PLACE_VALUE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of several UTF-8 texts (A-Z folded), and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = BYTE_VALUE[data[inside]] * PLACE_VALUE[place & 63]
    mixed = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9), counts


def bucket_of(hashes: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - 4 * digits)).astype(np.int64)


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of several texts, and the number of words of each text."""
    hashes, counts = word_hashes(texts)
    return bucket_of(hashes), counts


def contexts(words: np.ndarray, counts: np.ndarray, chosen: np.ndarray | None = None, edge: int = BUCKETS) -> np.ndarray:
    """(word, offset): the buckets around each word, or each of the ``chosen`` ones, never across the edge of its text."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    after = np.repeat(counts, counts) - place
    at = np.arange(len(words))
    if chosen is not None:
        place, after, at = place[chosen], after[chosen], chosen
    out = np.full((len(at), len(OFFSETS)), edge, np.int64)
    for j, offset in enumerate(OFFSETS):
        ok = np.flatnonzero((place + offset >= 0) & (offset < after))
        out[ok, j] = words[at[ok] + offset]
    return out


def forward(p: dict[str, np.ndarray], around: np.ndarray, words: np.ndarray, shares: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hidden state, probabilities of all digits (unscaled without ``shares``), digits and log-probability of each word."""
    digits = p["out"].shape[1] // DIGIT
    hidden = p["embed"][0][around[:, 0]]
    for j in range(1, len(OFFSETS)):
        hidden += p["embed"][j][around[:, j]]
    hidden += p["bias"]
    np.tanh(hidden, out=hidden)
    own = np.stack([words >> 4 * (digits - 1 - k) & 15 for k in range(digits)], axis=1)
    logits = (hidden @ p["out"]).reshape(-1, digits, DIGIT)
    for k in range(digits):
        logits[:, k] += p[LEVELS[k]][words >> 4 * (digits - k)] if k else p[LEVELS[0]][0]
    np.clip(logits, -60, 60, out=logits)  # so that sums of exponentials stay within range
    chosen = logits.reshape(-1)[np.arange(own.size) * DIGIT + own.reshape(-1)].reshape(own.shape)
    np.exp(logits, out=logits)
    total = (logits.reshape(-1, DIGIT) @ np.ones(DIGIT, np.float32)).reshape(-1, digits, 1)
    if shares:
        logits /= total
    return hidden, logits, own, (chosen - np.log(total[:, :, 0])).sum(axis=1)


def summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and the sum of the rows of each."""
    if index.max(initial=0) < 1 << 16:
        index = index.astype(np.uint16)  # these are sorted by radix
    order = np.argsort(index, kind="stable")
    ordered = index[order].astype(np.int64)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def masked_places(words: np.ndarray, counts: np.ndarray, number: int, mask_every: int) -> np.ndarray:
    """The words that round ``number`` trains on, by a hash of word and place in its text: each once in ``mask_every`` rounds."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.flatnonzero(((place * 2654435761 + words * 40503) >> 7) % mask_every == number % mask_every)


def step(flat: np.ndarray, squares: np.ndarray, around: np.ndarray, words: np.ndarray, rate: float, digits: int = DIGITS) -> float:
    """One step of Adagrad on a batch of masked words; the mean log-probability before it."""
    p, s = unpacked(flat, digits), unpacked(squares, digits)
    hidden, error, own, score = forward(p, around, words)
    error.reshape(-1)[np.arange(own.size) * DIGIT + own.reshape(-1)] -= 1
    error /= len(words)
    flat_error = error.reshape(len(words), -1)
    back = (flat_error @ p["out"].T) * (1 - hidden ** 2)
    dense = {"out": hidden.T @ flat_error, "bias": back.sum(axis=0), LEVELS[0]: error[:, 0].sum(axis=0, keepdims=True)}
    for name, grad in dense.items():
        s[name] += grad ** 2
        p[name] -= rate * grad / (np.sqrt(s[name]) + 1e-6)
    rows = [(s["embed"][j], p["embed"][j], around[:, j], back) for j in range(len(OFFSETS))]
    rows += [(s[LEVELS[k]], p[LEVELS[k]], words >> 4 * (digits - k), error[:, k]) for k in range(1, digits)]
    for square, value, index, grads in rows:  # only the rows of words nearby and of the words themselves change
        at, grad = summed(index, grads)
        new = square[at] + grad ** 2
        square[at] = new
        value[at] -= rate * grad / (np.sqrt(new) + 1e-6)
    return float(score.mean())


def corpus_words(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, key, n_tokens, top, middle, low): the words of every whole text as parts of their hashes, written once.

    ``top`` holds the first 16 bits, all that up to four digits need, ``middle`` the next 16 and ``low`` the last 32.  Counts, training and scores all read this table, so texts are split and hashed once.  ``key``
    depends on the row alone, not on where it lies.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, counts = word_hashes(batch.column("text").cast(pa.binary()).to_pylist())
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        packed = [pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * np.dtype(kind).itemsize).tobytes()), pa.py_buffer(part.astype(kind).tobytes())])
                  for part, kind in ((hashes >> np.uint64(48), np.uint16), (hashes >> np.uint64(32) & np.uint64(0xFFFF), np.uint16), (hashes & np.uint64(0xFFFFFFFF), np.uint32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), *packed], ["doc_id", "key", "n_tokens", *PARTS])

    rows = id_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = map_batches(rows, work, "doc_id long, key long, n_tokens long, top binary, middle binary, low binary")
    return materialise(rows.withColumn("row_no", F.monotonically_increasing_id()), "lm-texts", "zstd")


PARTS = ("top", "middle", "low")


def whole_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of all words of a batch of ``corpus_words``."""
    top, middle, low = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).astype(np.uint64) for c, kind in zip(PARTS, (np.uint16, np.uint16, np.uint32)))
    return top << np.uint64(48) | middle << np.uint64(32) | low


def train_round(words: DataFrame, flat: np.ndarray, number: int, shards: int, mask_every: int = MASK_EVERY, rate: float = RATE, digits: int = DIGITS) -> np.ndarray:
    """Each shard trains on its documents from the same parameters; these are averaged, weighted by words.

    A shard is a share of the documents by hash, in order of hash, so the outcome does not depend on
    how the table is partitioned.  Averages are formed in two levels of at most 256 vectors each.
    """
    blocks = range(0, len(flat), BLOCK)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "n_tokens"], kind="stable")
        counts = group["n_tokens"].to_numpy(np.int64)
        own, squares = flat.copy(), np.full(len(flat), 1e-8, np.float32)
        buckets = np.frombuffer(b"".join(group["top"]), np.uint16).astype(np.int64)
        if digits > 4:
            buckets = buckets << 16 | np.frombuffer(b"".join(group["middle"]), np.uint16)
        buckets >>= (32 if digits > 4 else 16) - 4 * digits
        masked = masked_places(buckets, counts, number, mask_every) if mask_every > 1 else np.arange(len(buckets))
        for k in range(0, len(masked), PART):
            near = contexts(buckets, counts, masked[k:k + PART], DIGIT ** digits)
            target = buckets[masked[k:k + PART]]
            for at in range(0, len(target), BATCH):
                step(own, squares, near[at:at + BATCH], target[at:at + BATCH], rate, digits)
        return pd.DataFrame({
            "shard": np.int32(group["shard"].iloc[0]), "block": np.arange(len(blocks), dtype=np.int32),
            "values": [own[b:b + BLOCK].tobytes() for b in blocks], "weight": float(len(masked))})

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")  # sums in one order, whatever came first
        weight = group["weight"].to_numpy()
        total = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(weight, group["values"]))
        return pd.DataFrame({"shard": [group["shard"].iloc[0] // 256], "block": [group["block"].iloc[0]],
                             "values": [(total / max(weight.sum(), 1)).astype(np.float32).tobytes()], "weight": [weight.sum()]})

    schema = "shard int, block int, values binary, weight double"
    chosen = words.filter("n_tokens > 0").select("key", "n_tokens", *PARTS[:1 if digits <= 4 else 2], F.pmod(F.shiftright("key", 8), F.lit(shards)).cast("int").alias("shard"))
    parts = chosen.groupBy("shard").applyInPandas(work, schema)
    while shards > 1:
        parts = parts.groupBy(F.floor(F.col("shard") / 256).alias("chunk"), "block").applyInPandas(average, schema)
        shards = -(-shards // 256)
    out = flat.copy()
    for row in parts.collect():  # the parameters once
        out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["values"], np.float32)
    return out


# Words of a shard whose surroundings are laid out at a time.
PART = 1 << 18


def train_words(words: DataFrame, total: int, rounds: int = ROUNDS, mask_every: int = MASK_EVERY, rate: float = RATE, digits: int = DIGITS) -> np.ndarray:
    """Parameters after ``rounds`` rounds over a table of ``corpus_words`` with ``total`` words.

    Without masking by place each round has a share of the documents, by hash, so that each word is
    trained on once.  The number of shards follows the number of words.
    """
    flat = initial(digits=digits)
    each = total if mask_every > 1 else total / rounds
    shards = max(1, round(each / (SHARD_WORDS * DIGIT ** (digits - DIGITS))))
    for number in range(rounds):
        part = words if mask_every > 1 else words.filter(F.pmod("key", F.lit(rounds)) == number)
        flat = train_round(part, flat, number, shards, mask_every, rate, digits)
    return flat


def train(docs: DataFrame, rounds: int = ROUNDS, mask_every: int = MASK_EVERY, rate: float = RATE) -> np.ndarray:
    """``train_words`` of texts."""
    words = corpus_words(docs)
    return train_words(words, words.agg(F.sum("n_tokens")).first()[0] or 0, rounds, mask_every, rate)


@dataclass
class Vocabulary:
    """All words of a corpus by hash, with their counts; the words of a bucket share its probability by count."""

    counts: DataFrame     # word, n: as many rows as there are distinct words
    totals: np.ndarray    # by bucket: occurrences of all its words
    words: np.ndarray     # the most frequent words, ascending
    numbers: np.ndarray   # and their counts
    digits: int           # of a bucket
    total: int            # occurrences of all words


def vocabulary(docs: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Counts of all words of all texts."""
    return count_words(corpus_words(docs), frequent)


def count_words(texts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Counts of all words of a table of ``corpus_words``, folded in each batch, then summed by word."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, n = np.unique(whole_hashes(batch).view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

    counts = map_batches(texts.select(*PARTS), work, "word long, n long", WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lm-words")
    extent = counts.agg(F.count("n").alias("distinct"), F.sum("n").alias("total")).first()
    digits = digits_for(extent["distinct"])
    totals = np.zeros(DIGIT ** digits, np.int64)
    for row in counts.groupBy(F.shiftrightunsigned("word", 64 - 4 * digits).alias("bucket")).agg(F.sum("n").alias("n")).collect():  # a row per bucket
        totals[row["bucket"]] = row["n"]
    # the least power of two that at most ``frequent`` words reach; all those come to the driver
    sizes = {row["size"]: row["words"] for row in counts.groupBy(F.length(F.bin("n")).alias("size")).agg(F.count("n").alias("words")).collect()}
    least = 64
    while least > 0 and sum(words for size, words in sizes.items() if size >= least) <= frequent:
        least -= 1
    top = counts.filter(F.length(F.bin("n")) > least).toPandas().sort_values("word")
    return Vocabulary(counts, totals, top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64), digits, extent["total"] or 0)


def score_words(docs: DataFrame, flat: np.ndarray, known: Vocabulary) -> DataFrame:
    """Like ``score``, for words: the log-probability of a word's bucket and of the word among its bucket's words.

    Over all words of ``known`` the probabilities at a place add up to one, save those of
    buckets without a word.  A word that ``known`` lacks counts as one occurrence.
    """
    return score_texts(corpus_words(docs), flat, known)


def score_texts(texts: DataFrame, flat: np.ndarray, known: Vocabulary) -> DataFrame:
    """``score_words`` of a table of ``corpus_words``."""
    totals, words, numbers, digits = np.log(np.maximum(known.totals, 1)), known.words, np.log(np.maximum(known.numbers, 1)), known.digits

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = unpacked(flat, digits)
        hashes, counts = whole_hashes(batch), np.asarray(batch.column("n_tokens"), np.int64)
        buckets, signed = bucket_of(hashes, digits), hashes.view(np.int64)
        around = contexts(buckets, counts, edge=DIGIT ** digits)
        scores = [forward(p, around[k:k + BATCH], buckets[k:k + BATCH], shares=False)[3] for k in range(0, len(buckets), BATCH)]
        each = (np.concatenate(scores) if scores else np.zeros(0)) - totals[buckets]
        at = np.minimum(np.searchsorted(words, signed), max(len(words) - 1, 0))
        found = words[at] == signed if len(words) else np.zeros(len(signed), bool)
        each[found] += numbers[at[found]]
        sums, rare = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64))), np.concatenate(([0], np.cumsum(~found)))
        ends = np.cumsum(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, rare[ends]), pa.int32()), pa.array(signed[~found]))
        yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums[ends] - sums[ends - counts]), lists],
                                         ["row_no", "doc_id", "n_tokens", "part", "rare"])

    rows = map_batches(texts.select("row_no", "doc_id", "n_tokens", *PARTS), work, "row_no long, doc_id long, n_tokens long, part double, rare array<long>", WORD_BYTES)
    rows = materialise(rows, "lm-scores")
    rest = rows.select("row_no", F.explode("rare").alias("word")).join(known.counts, "word", "left")
    rest = rest.groupBy("row_no").agg(F.sum(F.log(F.coalesce("n", F.lit(1)))).alias("rest"))
    out = rows.drop("rare").join(rest, "row_no", "left").withColumn("log_prob", F.col("part") + F.coalesce("rest", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


# Bytes of word hashes worked off at a time.
WORD_BYTES = 8 << 20


def score(docs: DataFrame, flat: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_prob, mean_log_prob.

    log_prob sums, over all words of the whole text, the log-probability (natural log) of
    the word's bucket given the two words on either side; ``score_words`` goes on to the
    words themselves.  Null, empty and blank texts
    have no tokens, log_prob 0 and a null mean.  Repeated rows give repeated rows, a null
    id stays null, an empty table gives no rows, other columns are not read.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = unpacked(flat)
        words, counts = word_buckets(batch.column("text").cast(pa.binary()).to_pylist())
        around = contexts(words, counts)
        scores = [forward(p, around[k:k + 16384], words[k:k + 16384])[3] for k in range(0, len(words), 16384)]
        sums = np.concatenate(([0.0], np.cumsum(np.concatenate(scores) if scores else np.zeros(0), dtype=np.float64)))
        ends = np.cumsum(counts)
        total = sums[ends] - sums[ends - counts]
        mean = pa.array(np.divide(total, counts, where=counts > 0, out=np.zeros(len(counts))), mask=counts == 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(total), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return map_batches(id_text(docs), work, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    texts = corpus_words(documents(spark, folder))
    known = count_words(texts)
    return score_texts(texts, train_words(texts, known.total, digits=known.digits), known)
