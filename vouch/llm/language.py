"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import documents, give_back, map_batches, text_or_empty
from workload.registry import query

BUCKETS = 1 << 16
# Bytes of text labelled at a time: a word takes some hundred bytes of scores.
SLICE = 1 << 20
# Log-likelihood that a change of language inside a text costs.
SWITCH = 25.0
# A language is a candidate for a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.1
UNKNOWN = "und"

# First code points of the ranges of scripts, as in the Unicode block list; 0 is any other script.
SCRIPT_STARTS = {
    0x0000: 1, 0x0370: 2, 0x0400: 3, 0x0530: 4, 0x0590: 5, 0x0600: 6, 0x0700: 0, 0x0900: 7, 0x0980: 8, 0x0A00: 9,
    0x0A80: 10, 0x0B00: 11, 0x0B80: 12, 0x0C00: 13, 0x0C80: 14, 0x0D00: 15, 0x0D80: 16, 0x0E00: 17, 0x0E80: 18,
    0x0F00: 19, 0x1000: 20, 0x10A0: 21, 0x1100: 22, 0x1200: 23, 0x13A0: 0, 0x1780: 24, 0x1800: 25, 0x18B0: 0,
    0x1C80: 3, 0x1C90: 21, 0x1CC0: 0, 0x1D00: 1, 0x1F00: 2, 0x2000: 0, 0x2C60: 1, 0x2C80: 0, 0x3040: 26, 0x3100: 27,
    0x3130: 22, 0x3190: 0, 0x3400: 28, 0xA000: 0, 0xA640: 3, 0xA6A0: 0, 0xA720: 1, 0xA800: 0, 0xAB30: 1, 0xAC00: 22,
    0xD800: 0, 0xF900: 28, 0xFB00: 1, 0xFB1D: 5, 0xFB50: 6, 0xFE00: 0, 0xFF21: 1, 0xFF66: 26, 0xFFA0: 22, 0xFFE0: 0,
    0x20000: 28, 0x30000: 28, 0x40000: 0,
}
SCRIPTS = 1 + max(SCRIPT_STARTS.values())


class Alphabet:
    """Tables over code points: letter, mark, lower case and script."""

    def __init__(self) -> None:
        plane = [chr(c) for c in range(0x10000)]
        self.letter = np.array([c.isalpha() for c in plane])
        self.mark = np.array([unicodedata.category(c)[0] == "M" for c in plane])
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in plane], np.uint32)
        starts = np.array(list(SCRIPT_STARTS))
        self.script = np.array(list(SCRIPT_STARTS.values()), np.int8)[np.searchsorted(starts, np.arange(0x10000), side="right") - 1]
        self.starts, self.values = starts, np.array(list(SCRIPT_STARTS.values()), np.int8)

    def read(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is letter, is part of a word, lower case) of each code point."""
        low = codes & 0xFFFF
        letter, part, lower = self.letter[low], self.mark[low], self.lower[low]
        for c in np.unique(codes[codes > 0xFFFF]).tolist():
            at = codes == c
            letter[at], part[at] = chr(c).isalpha(), unicodedata.category(chr(c))[0] == "M"
            lower[at] = ord(x) if len(x := chr(c).lower()) == 1 else c
        return letter, letter | part, lower

    def scripts(self, codes: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.starts, codes, side="right") - 1]


@dataclass
class Words:
    """The words of several texts, one after the other."""

    first: np.ndarray      # index of each word's first character in ``features``
    start: np.ndarray      # code point offset in its text
    end: np.ndarray
    letters: np.ndarray    # letters in the word
    script: np.ndarray
    text: np.ndarray       # which text it is in
    features: np.ndarray   # bucket of the character trigram around each character of a word


def words_of(texts: list[str], alphabet: Alphabet) -> Words:
    """Words are runs of letters and marks; a character's trigram has word ends as a character of their own."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    letter, inside, lower = alphabet.read(codes)
    shown = np.where(inside, lower, 0).astype(np.uint32)
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    padded = np.concatenate(([0], shown, [0])).astype(np.uint32)
    mixed = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    features = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16))[inside]
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    counted = np.concatenate(([0], np.cumsum(letter)))
    text = np.searchsorted(begins, starts, side="right") - 1
    return Words(first, starts - begins[text], ends - begins[text], counted[ends] - counted[starts],
                 alphabet.scripts(codes[starts]), text, features)


def count_features(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over all labelled documents: trigram buckets, then one feature per script, by letters."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, totals = Alphabet(), {}
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    w = words_of(texts, alphabet)
                    total = totals.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                    total[:BUCKETS] += np.bincount(w.features, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(w.script, weights=w.letters, minlength=SCRIPTS).astype(np.int64)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], ["lang", "feature", "n"])
        give_back()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).filter("lang is not null")
    return rows.mapInArrow(work, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages, log-probabilities (bucket, language) and which languages write a script (script, language)."""

    languages: list[str]
    scores: np.ndarray
    writes: np.ndarray


def train(docs: DataFrame) -> Model:
    """Counts over all of ``docs`` (text, lang).  The model has ``BUCKETS`` numbers per language, whatever the input."""
    rows = count_features(docs).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + SCRIPTS, len(languages)))
    counts[rows["feature"].to_numpy(np.int64), np.searchsorted(languages, rows["lang"].to_numpy(str)) if languages else []] = rows["n"].to_numpy(float)
    grams, scripts = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Of each word and language: log-likelihood, far below all others where the language does not write the script."""
    sums = np.add.reduceat(model.scores[w.features], w.first, axis=0).astype(np.float64)
    allowed = model.writes[w.script]
    none = ~allowed.any(axis=1)
    sums[~allowed & ~none[:, None]] -= 1000.0
    sums[none] = 0.0  # a script of no known language says nothing
    return sums - sums.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, for several texts at once; a text's words stand together."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    path = np.zeros(len(scores), np.int64)
    kind = np.min_scalar_type(scores.shape[1])  # wide enough for every language number
    came = np.zeros(scores.shape, kind)
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    value = scores[starts[: active[0]]].copy() if len(active) else scores[:0]
    own = np.arange(scores.shape[1], dtype=kind)
    for t in range(1, len(active)):
        m = active[t]
        now = value[:m]
        best = now.argmax(axis=1)
        jump = now[np.arange(m), best] - switch
        moved = jump[:, None] > now
        rows = starts[:m] + t
        came[rows] = np.where(moved, best[:, None], own)
        value[:m] = np.where(moved, jump[:, None], now) + scores[rows]
    at = value.argmax(axis=1) if len(value) else np.zeros(0, np.int64)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows = starts[:m] + t
        path[rows] = at[:m]
        at[:m] = came[rows, at[:m]] if t else at[:m]
    return path


def label_words(w: Words, model: Model, switch: float = SWITCH) -> np.ndarray:
    """The language number of each word.

    A text stays in its best language, and needs no search, if no stretch of words gains
    more than half a switch in any other language: each stretch in another language
    comes with at least half a switch.
    """
    scores = word_scores(w, model)
    heads = np.flatnonzero(np.diff(w.text, prepend=-1))
    lengths = np.diff(np.append(heads, len(w.text)))
    best = np.add.reduceat(scores, heads, axis=0).argmax(axis=1)
    path = np.repeat(best, lengths)
    number = np.repeat(np.arange(len(heads)), lengths)
    gain = scores - scores[np.arange(len(scores)), path][:, None]
    run = np.cumsum(gain, axis=0)
    run -= np.repeat(np.vstack((np.zeros(run.shape[1]), run[heads[1:] - 1])), lengths, axis=0)
    apart = 1.0 + 2 * np.abs(run).max()
    before = np.minimum.accumulate(np.where((np.arange(len(run)) == heads[number])[:, None], 0.0, np.roll(run, 1, axis=0)) - number[:, None] * apart, axis=0)
    rise = np.maximum.reduceat((run - before - number[:, None] * apart).max(axis=1), heads)
    mixed = np.flatnonzero(rise > switch / 2)
    if len(mixed):
        rows = np.concatenate([np.arange(heads[i], heads[i] + lengths[i]) for i in mixed.tolist()])
        sizes = lengths[mixed]
        path[rows] = viterbi(scores[rows], np.cumsum(sizes) - sizes, sizes, switch)
    return path


def label_spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row per document: lang_pred, score and the spans of one language each.

    Columns: doc_id, lang_pred, score, spans (array of start, end, lang; code points, end
    exclusive).  lang_pred has most letters in its spans and score is their share of all
    letters.  A text without a letter (null and empty ones too) is ``und`` with score 0
    and no spans; so is every text if nothing could be learned.  Repeated rows give
    repeated rows, an empty table gives no rows, other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Alphabet())
        n = batch.num_rows
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names, scores, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
        w = words_of(texts, kept[0])
        if len(w.text) and model.languages:
            path = label_words(w, model, switch)
            letters = np.zeros((n, len(model.languages)))
            np.add.at(letters, (w.text, path), w.letters)
            totals, best = letters.sum(axis=1), letters.argmax(axis=1)
            cut = np.flatnonzero((np.diff(w.text, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
            last = np.append(cut[1:], len(path)) - 1
            for i, a, b, k in zip(w.text[cut].tolist(), w.start[cut].tolist(), w.end[last].tolist(), path[cut].tolist()):
                spans[i].append({"start": a, "end": b, "lang": model.languages[k]})
            for i in np.flatnonzero(totals > 0).tolist():
                names[i], scores[i] = model.languages[best[i]], letters[i, best[i]] / totals[i]
            for i in np.flatnonzero(totals == 0).tolist():
                spans[i] = []
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names), pa.array(scores), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    kept: list[Alphabet] = []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows, work, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>", SLICE, kept)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, switch: float = SWITCH) -> DataFrame:
    """The documents with a language: not ``und``, and ``least`` of their letters in it or more; all columns stay."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Alphabet())
        w = words_of([t or "" for t in batch.column(at).to_pylist()], kept[0])
        if len(w.text) and model.languages:
            letters = np.zeros((batch.num_rows, len(model.languages)))
            np.add.at(letters, (w.text, label_words(w, model, switch)), w.letters)
            total = letters.sum(axis=1)
            yield batch.filter(pa.array((total > 0) & (letters.max(axis=1) >= least * total)))

    kept: list[Alphabet] = []
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return map_batches(rows, work, rows.schema, SLICE, kept)


def held_out():
    """Whether a document is kept from training, by its id alone; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = train(docs.filter(~held_out()))
    return label_spans(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
