"""Periodic runs, page text and token alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.llm import alignment, html_text, periodic_runs


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- periodic runs

def plain_runs(words):
    out: dict = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repeating(rnd, most, letters):
    words: list = []
    while len(words) < most:
        unit = [rnd.choice(letters) for _ in range(rnd.randint(1, 25))]
        words += unit * rnd.choice([1, 1, 2, rnd.randint(3, 9)])
    return words


def test_runs_match_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        texts = [repeating(rnd, rnd.randint(0, 250), range(rnd.choice([2, 3, 6]))) for _ in range(rnd.randint(0, 5))]
        texts += texts[:1]
        found = list(zip(*[x.tolist() for x in periodic_runs.find_runs([np.array(t, np.int64) for t in texts])]))
        assert found == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_cover_index_extends_like_plain_comparison():
    rnd = random.Random(3)
    words = np.array([-9, *repeating(rnd, 600, range(2)), -8, *[1] * 200, -7], np.int64)
    index = periodic_runs.CoverIndex(words)
    for _ in range(3000):
        i, j = rnd.sample(index.positions.tolist(), 2)
        k = 0
        while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        assert index.extension(np.array([i]), np.array([j]))[0] == k


def test_grid_in_small_blocks_finds_the_same(monkeypatch):
    texts = [np.array(repeating(random.Random(5), 900, range(3)), np.int64)]
    whole = [x.tolist() for x in periodic_runs.find_runs(texts)]
    monkeypatch.setattr(periodic_runs, "POINTS", 50)
    assert [x.tolist() for x in periodic_runs.find_runs(texts)] == whole and len(whole[0]) > 3


def test_collapsed_texts_match_the_contract(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(repeating(rnd, rnd.randint(0, 120), ["a", "b", "né", "x\x1cy", "c\xa0d"]))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, " \n"), (None, "a " * 9), (3, rows[3][1]), (3, rows[3][1]), (93, "w " * 20000), (-7, "one two")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, start string, runs int").repartition(3)
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        n, mark = len(words), zlib.crc32(str(i).encode())
        if i is not None and mark % 10 == 0 and n:
            g = mark // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = plain_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    got = periodic_runs.collapse_runs(docs, plant=True)
    assert plain(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == sorted(want, key=str)
    assert sum(w[1] for w in want) > 50
    first = got.filter("doc_id = 93").first()
    assert [tuple(r) for r in first["runs"]] == [(0, 20000, 1)] and first["collapsed"] == "w"
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


# -- page text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="content-sidebar has-ads">
<div class="site-header"><a href=x>Home</a> <a>About us</a></div><nav><ul><li>Menu<li>of links</ul></nav>
<div id="cookie-banner">We use cookies on this site, please accept them all right now and forever.</div>
<div class="content"><h1>Title &amp; more</h1><script>var t="</p><p>no";</script>
<p>First paragraph with enough words in it to be
   taken as text, really&nbsp;long.<p>Short.</p><div class="ad">Buy this</div><!-- <p>no</p> -->
<p>Second <b>para</b>graph <a href=y>with link</a> and a < b.<br>Next line</p><ul><li>one</li><li>two</ul>
<p style="display: none">unseen</p><p class='notice'>Mind this</p></div>
<aside>Side text long enough to be taken as something, if it were not in an aside element.</aside>
<div class="left sidebar">Side text long enough to be taken as something, if it were not at the side.</div>
<section id="comments"><article class="comment"><p>Great post! I like this one very much, thank you for writing it.</p></article></section>
<form><label>Email</label><input><button>Send</button></form><footer>Copyright text that goes on and on for quite a while.</footer>"""


PAGE_TEXT = ["Title & more", "First paragraph with enough words in it to be taken as text, really long.", "Short.",
             "Second paragraph with link and a < b. Next line", "one", "two"]


def test_page_without_article_element():
    assert html_text.main_text(PAGE).split("\n") == PAGE_TEXT


def test_page_with_article_element():
    page = ("<body><header><h1>Site</h1></header><p>Lead-in outside that is quite long, longer than the article even, really.</p>"
            "<article><header><p>By me</p><h1>On <i>this</i></h1></header><p>Be.</p><aside>x</aside><p>&lt;i&gt; &#233;<p><a>linked</a>"
            "<div class='share-buttons'>Share</div><section class='comments'><p>First!</p></section></article><footer>c</footer></body>")
    assert html_text.main_text(page) == "On this\nBe.\n<i> é\nlinked"


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain text", ""), ("<p>plain text", "plain text"), ("<ul><li><a>Home</a><li><a>b</a></ul>", ""), ("<script>a", ""),
    ("<p>x <a \"b <!-- c", "x"), ("<article></article>", ""), ("<main><p>Only this</p></main><p>Not that, even if it is by far the longer text of the two here.</p>", "Only this"),
    ("<p>&amp;amp; &copy;</p>", "&amp; ©"), ("</div></p><p>a</p></article>", "a"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_windows_part_at_empty_stretches():
    assert html_text.stretches([0, 5, 0, 0, 7, 0, 0, 0, 1]) == [(1, 5, 7), (8, 9, 1)]
    assert html_text.stretches([]) == [] and html_text.stretches([0, 0]) == []


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>é wort</p>" * 30000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    got = html_text.extract_text(pages)
    assert plain(got, "page_id", "url", "n_chars") == sorted([(1, "u", len("\n".join(PAGE_TEXT)))] * 2 + [(2, None, 0), (None, "v", 0), (3, "w", 30000 * 7 - 1)], key=str)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and html_text.extract_text(pages.limit(0)).count() == 0


# -- token alignment

BITS = ["the", "hello", " ", "  ", "\n", "\n\n", "'s", "don't", "12", "é", "Ünïcode", "日本語", "，。", "😀", "\xa0", "　", "\t", "▁",
        "<|endoftext|>", "<s>", "aaaa", "ab", "!!", "'", "x=", "\x1c", " ", "ﬁ", "\x00", " a", "co-op", "Straße", "ing", "."]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(alignment.vocabulary_path(alignment.BYTE_VOCABULARY))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.vocabulary_path(alignment.PIECE_VOCABULARY))
    back = {c: b for b, c in alignment.byte_symbols().items()}
    texts, documents = [], Counter()
    for _, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in one.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [two.id_to_piece(x)]]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            texts.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([x for x, e in zip(a, ends_a) if low < e <= high], [x for x, e in zip(b, ends_b) if low < e <= high]) for low, high in zip([0, *cuts], cuts)]
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        documents.update(links.keys())
        texts.append((len(a), len(b), groups, links))
    best: dict = {}
    for (x, _), n in documents.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), found in zip(rows, texts):
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, n_a, n_b, len(groups), links.total(), sum(n for k, n in links.items() if documents[k] == best[k[0]]),
                    sum(n * documents[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def mixed_rows():
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(BITS[:rnd.randint(3, len(BITS))]) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    rows = [(i, t if i % 4 == 0 else t.replace("▁", "")) for i, t in rows]
    return rows + [(None, "no id"), (5, None), (6, ""), (7, " "), (8, "x" + "ab" * 600), (9, "日本語" * 200), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("chunk,frequent", [(1 << 30, 10**6), (64, 10**6), (300, 40)])
def test_alignment_matches_brute_force(spark, mixed_rows, chunk, frequent):
    docs = spark.createDataFrame([(*r, "x", 1) for r in mixed_rows], "doc_id long, text string, row string, pairs int").repartition(3)
    got = alignment.align_tokenizers(docs, chunk, frequent)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert plain(got, *columns) == sorted(plain_alignment(mixed_rows), key=str)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert plain(alignment.align_tokenizers(docs), "doc_id", "n_links", "groups_sha256") == [(1, 0, "")]
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0


def test_fragments_compose_in_any_order():
    rnd = random.Random(9)
    for _ in range(200):
        total = rnd.randint(1, 60)
        ends = [np.array(sorted({*rnd.sample(range(1, total + 1), rnd.randint(0, total - 1)), total})) for _ in range(2)]
        whole = alignment.Tokens(ends[0].astype(np.uint32), ends[0], ends[1].astype(np.uint32) + 100, ends[1])
        # each tokenizer is cut at places of its own
        marks = [sorted(rnd.randint(0, total) for _ in range(4)) for _ in range(2)]
        bounds = [np.searchsorted(e, m, "right").tolist() for e, m in zip(ends, marks)]
        cuts = list(zip([0, *bounds[0]], [*bounds[0], None], [0, *bounds[1]], [*bounds[1], None]))
        if any(max(marks[0][k], marks[1][k]) > min(marks[0][k + 1], marks[1][k + 1]) for k in range(3)):
            continue  # ranges follow each other
        parts = [alignment.fragment(whole.part(*c)) for c in cuts]
        one = parts[0]
        for part in parts[1:]:
            one = alignment.compose(one, part)
        two = parts[-1]
        for part in parts[-2::-1]:
            two = alignment.compose(part, two)
        texts = []
        for root in (alignment.fragment(whole), one, two):
            groups = alignment.whole_groups(root)
            texts.append(alignment.group_texts(groups, np.arange(len(groups.n_a) + 1)))
        assert texts[0] == texts[1] == texts[2] and texts[0][0] == "" and len(texts[0]) > 1


def test_queries_return_a_row_for_every_document(spark):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.001"
    for name, source in (("op11_periodic_runs", "documents"), ("op12_html_text", "pages"), ("op13_token_alignment", "documents")):
        assert queries()[name](spark, folder).count() == spark.read.parquet(f"{folder}/{source}.parquet").count()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = queries()["op13_token_alignment"](spark, folder)
    assert plain(got, *got.columns) == sorted(plain_alignment(rows), key=str)
    assert got.select(F.sum("n_best")).first()[0] > 0


def test_bpe_looks_up_a_word_once():
    """Words that the texts of a slice repeat are looked up once and copied as arrays."""
    from vouch.llm.bpe import Encoder, vocabulary_path

    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    encoder = Encoder(vocabulary_path())
    encoder.words = Counted()
    texts = ["Some words, café and don't\x00 again <|endoftext|>"] * 500 + [None, "", " a\x1cb\n", "漢字 İx"]
    want = [np.array(encoder.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode_texts(texts[:-2]) == want[:-2]  # no separators, split by the compute library
    assert encoder.encode_texts(texts) == want
    assert Counted.asked < 100
