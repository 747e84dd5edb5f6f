"""The registered queries: against SQL where there is some, and the pipeline against a plain run of its rules."""

from __future__ import annotations

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from vouch.llm import bpe, language, pii, quality
from vouch.llm.common import documents

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
NAMES = sorted(n for n, f in queries().items() if f.__module__.startswith(("vouch.llm", "corpus_pipeline")))


def test_all_operators_and_the_pipeline_are_registered():
    assert [re.match(r"op(\d+)_|pipeline", n).group(1) for n in sorted(NAMES, key=lambda n: int(re.sub(r"\D", "", n.split("_")[0]) or 99))] == [*map(str, range(1, 14)), None]


@pytest.mark.parametrize("name", [n for n in NAMES if n in oracle_sql()])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    wanted = [dict(zip([d[0] for d in want.description], row)) for row in want.fetchall()]
    got = [r.asDict() for r in queries()[name](spark, FOLDER).collect()]
    assert sorted(got[0]) == columns
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str([r[c] for c in columns]) for r in wanted)


def shingle_mark(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    hashes = [xxhash.xxh64(" ".join(words[k:k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_follows_its_rules(spark):
    docs = documents(spark, FOLDER)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language.train(docs)
    found = {r["doc_id"]: r for r in language.label_spans(docs, model).collect()}
    kept = {i: t for i, t in texts.items() if found[i]["lang_pred"] != "und" and found[i]["score"] >= 0.3}
    last: dict = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    marks, group = {i: shingle_mark(t) for i, t in kept.items()}, {i: i for i in kept}
    for a in kept:
        for b in kept:
            if a < b and group[a] != group[b] and (marks[a] ^ marks[b]).bit_count() <= 4:
                new, old = sorted((group[a], group[b]))
                group = {k: new if g == old else g for k, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    # what the rules find is gone from the text, and the rest is packed whole and gapless
    encoder = bpe.Encoder(bpe.vocabulary_path())
    pieces: dict = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, parts in pieces.items():
        if not pii.TRIGGER.search(kept[i]):
            ids = [*encoder.whole.encode(kept[i], add_special_tokens=False).ids, 0]
            assert [(r["start"], r["length"], r["ids_crc32"]) for r in parts] == [
                (a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    filled: dict = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in sorted(p)[:k]) == a for p in filled.values() for k, (a, _) in enumerate(sorted(p)))
    assert len(filled) <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark, FOLDER).limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
    clean = corpus_pipeline.redact_personal_data(spark, docs, FOLDER)
    assert not any(pii.base_spans(r["text"]) for r in clean.collect())


def test_bands_reject_labelled_junk_and_keep_clean_documents(spark):
    """Words with marks after them are too easy to predict, tables of rare words too hard."""
    folder = FOLDER.replace("sf0.001", "sf0.01")
    docs = documents(spark, folder)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    marked = {r["doc_id"] for r in docs.collect() if len(re.findall(r"[#*$%&]{3}(?= |$)", r["text"] or "")) > 20}
    judged = [r for r in quality.quality(docs).collect() if not r["base_failed"] and r["doc_id"] in labels]
    junk, clean = ([r for r in judged if labels[r["doc_id"]] == k] for k in (0, 1))
    assert len(junk) > 20 and len(clean) > 300
    assert len([r for r in junk if r["doc_id"] in marked]) > 10 and sum(r["kept"] for r in junk if r["doc_id"] in marked) <= 1
    assert sum(not r["kept"] for r in junk) >= 0.75 * len(junk)
    assert all(r["kept"] for r in clean)
