"""What Python workers hold: bounded slices, and memory that goes back after each of them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from vouch.llm import bpe, common, language


class Caught:
    """Takes the function that ``mapInArrow`` is given."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def held() -> int:
    """MB of this process that no file backs."""
    with open("/proc/self/status") as file:
        return int(re.search(r"RssAnon:\s+(\d+)", file.read())[1]) >> 10


def batch(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def test_freed_memory_goes_back():
    """A task leaves nothing behind, although a small block of its own keeps the heap from shrinking."""
    pins, kept = [], []

    def work(part):
        kept.append([bytes(600) for _ in range(300_000)])
        pins.append(bytes(600))
        yield part

    run = common.map_batches(Caught(), work, "doc_id long, text string", kept=kept).run
    before = held()
    assert [b.num_rows for b in run(iter([batch(["a"])]))] == [1]
    assert kept == [] and held() - before < 60


def test_new_words_are_learned_in_blocks(monkeypatch):
    encoder, sizes = bpe.Encoder(bpe.vocabulary_path()), []
    learn = encoder.learn_plain
    monkeypatch.setattr(encoder, "learn_plain", lambda words: (sizes.append(len(words)), learn(words)))
    monkeypatch.setattr(bpe, "BLOCK", 7)
    texts = [" ".join(f"Word{i}" for i in range(20)), "café 7 days", None]
    want = [np.array(encoder.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_texts(texts) == want
    assert max(sizes) <= 7 and sum(sizes) == 23


def test_language_slices_are_bounded(spark, monkeypatch):
    """A word has a score for each language, so fewer bytes are labelled at a time than elsewhere."""
    sizes, words_of = [], language.words_of
    monkeypatch.setattr(language, "words_of", lambda texts, alphabet: (sizes.append(sum(map(len, texts))), words_of(texts, alphabet))[1])
    monkeypatch.setattr(language, "map_batches", lambda rows, *args: common.map_batches(Caught(), *args))
    model = language.Model(["en"], np.zeros((language.BUCKETS, 1), np.float32), np.ones((language.SCRIPTS, 1), bool))
    docs = spark.createDataFrame([], "doc_id long, text string")
    texts = ["some words " * 10_000] * 30
    out = list(language.label_spans(docs, model).run(iter([batch(texts)])))
    assert sum(b.num_rows for b in out) == 30 and max(sizes) <= 1 << 20
