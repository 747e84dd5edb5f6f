"""Alignment of the tokens of two public tokenizers: groups between common ends, links inside groups, counts of linked ids.

A text is the byte sequence of a space and the text.  Stretches of it become *fragments*:
an open head up to the first byte offset where tokens of both tokenizers end, closed groups,
and an open tail after the last such offset.  Fragments compose associatively: the tail of
the left and the head of the right are searched for common ends together.

Texts of up to ``CHUNK`` bytes are one fragment each, made from remembered words.  Longer ones
are cut into byte ranges; each tokenizer starts at its own first safe offset from there,
so no task encodes more than its range and the ends of the ranges stay open until
a tree of tasks composes them.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.bpe import byte_symbols, vocabulary_path
from vouch.llm.common import documents, id_text, map_batches, materialise, partitions
from workload.registry import query

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of a range of a long text, and fragments that one task composes in a round.
CHUNK, FAN = 32 << 10, 8
# Words remembered per task, an upper bound on memory and no limit on the text.
KEPT = 250_000
# Bytes of text aligned at a time, and bytes of new words encoded at a time.
SLICE, JOINED = 512 << 10, 64 << 10
# Pairs of a group that are written out before they are counted; larger groups are counted by distinct ids.
PAIRS_OUT = 4096
# Rows of the most frequent pairs that are broadcast; the others are joined by shuffle.
FREQUENT_PAIRS = 500_000

# A space after a character that is not white space: no token of the byte tokenizer crosses it.
# Two-byte characters with lead byte C2 and three-byte ones with E1 to E3 are left out, since
# all white space beyond ASCII is among them.
SAFE_SPACE = re.compile(rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})(?= )")
WORD_START = re.compile(r"(?<=\S)(?= )")
SPACES = re.compile(r"\s ")
NO_PREFIX = b"\x1a\x02\x18\x00"  # normalizer_spec { add_dummy_prefix: false }, merged into the model

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


class Tokens(NamedTuple):
    """Ids of both tokenizers with the byte offsets where they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def part(self, a0: int | None, a1: int | None, b0: int | None, b1: int | None) -> Tokens:
        return Tokens(self.a[a0:a1], self.a_end[a0:a1], self.b[b0:b1], self.b_end[b0:b1])


class Groups(NamedTuple):
    """Closed groups: ids of both tokenizers and how many of each a group holds."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


class Fragment(NamedTuple):
    """Element of the monoid; ``cut`` tells whether a common end is known, without one all tokens are in ``head``."""

    head: Tokens
    groups: Groups
    tail: Tokens
    cut: bool


NO_IDS, NO_ENDS = np.zeros(0, np.uint32), np.zeros(0, np.int64)
NO_TOKENS, NO_GROUPS = Tokens(NO_IDS, NO_ENDS, NO_IDS, NO_ENDS), Groups(NO_IDS, NO_IDS, NO_ENDS, NO_ENDS)
EMPTY = Fragment(NO_TOKENS, NO_GROUPS, NO_TOKENS, False)


def join_tokens(one: Tokens, two: Tokens) -> Tokens:
    return Tokens(*[np.concatenate(p) for p in zip(one, two)])


def fragment(tokens: Tokens) -> Fragment:
    """The fragment of a stretch of which the tokens ending in it are given."""
    common = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=True)
    if not len(common):
        return Fragment(tokens, NO_GROUPS, NO_TOKENS, False)
    ia, ib = np.searchsorted(tokens.a_end, common) + 1, np.searchsorted(tokens.b_end, common) + 1
    groups = Groups(tokens.a[ia[0]:ia[-1]], tokens.b[ib[0]:ib[-1]], np.diff(ia), np.diff(ib))
    return Fragment(tokens.part(0, ia[0], 0, ib[0]), groups, tokens.part(ia[-1], None, ib[-1], None), True)


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two adjacent stretches: only their open ends are searched again."""
    middle = fragment(join_tokens(left.tail if left.cut else left.head, right.head))
    if not left.cut and not right.cut:
        return middle
    if not right.cut:
        if not middle.cut:
            return Fragment(left.head, left.groups, middle.head, True)
        return Fragment(left.head, closed(left.groups, middle), middle.tail, True)
    # the right one has a common end, and the middle ends with it
    if not left.cut:
        return Fragment(middle.head, join_groups(middle.groups, right.groups), right.tail, True)
    return Fragment(left.head, join_groups(closed(left.groups, middle), right.groups), right.tail, True)


def join_groups(one: Groups, two: Groups) -> Groups:
    return Groups(*[np.concatenate(p) for p in zip(one, two)])


def closed(groups: Groups, follower: Fragment) -> Groups:
    """``groups`` with those of a follower whose head begins at a common end."""
    first = Groups(follower.head.a, follower.head.b, np.array([len(follower.head.a)]), np.array([len(follower.head.b)]))
    return Groups(*[np.concatenate(p) for p in zip(groups, first, follower.groups)])


def whole_groups(root: Fragment) -> Groups:
    """All groups of a whole text: it begins and ends with a common end."""
    return closed(NO_GROUPS, root) if root.cut else NO_GROUPS


# Each id with the sign that follows it: another id of its kind, the other kind, or the end of the group.
SIGNS = ",|;"
SHOWN: list[str] = []


def shown(code: int) -> list[str]:
    """``id`` and sign for all codes id * 3 + sign up to ``code``."""
    while len(SHOWN) <= code:
        SHOWN.extend([f"{len(SHOWN) // 3}{sign}" for sign in SIGNS])
    return SHOWN


def group_texts(groups: Groups, ends: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` for the groups up to each of ``ends``, numbers of groups in ascending order."""
    n_a, n_b = np.cumsum(groups.n_a), np.cumsum(groups.n_b)
    codes = np.empty(len(groups.a) + len(groups.b), np.int64)
    at_a = np.arange(len(groups.a)) + np.repeat(n_b - groups.n_b, groups.n_a)
    at_b = np.arange(len(groups.b)) + np.repeat(n_a, groups.n_b)
    codes[at_a], codes[at_b] = groups.a.astype(np.int64) * 3, groups.b.astype(np.int64) * 3
    codes[at_a[n_a - 1]] += 1
    codes[at_b[n_b - 1]] += 2
    pieces = list(map(shown(int(codes.max(initial=0))).__getitem__, codes.tolist()))
    # where the groups up to each end stop among the pieces
    stops = np.where(ends > 0, (n_a + n_b)[np.maximum(ends, 1) - 1], 0).tolist() if len(n_a) else [0] * len(ends)
    return ["".join(pieces[low:high])[:-1] for low, high in zip([0, *stops], stops)]


def group_links(groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the group, pair of ids as a * 2**32 + b, links), repeats among those of one group possible."""
    n_a, n_b = groups.n_a, groups.n_b
    sizes = n_a * n_b
    a0, b0 = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    small = np.flatnonzero(sizes <= PAIRS_OUT)
    size = sizes[small]
    of = np.repeat(np.arange(len(small)), size)
    k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    width = n_b[small][of]
    codes = groups.a[a0[small][of] + k // np.maximum(width, 1)].astype(np.int64) << 32 | groups.b[b0[small][of] + k % np.maximum(width, 1)]
    owners, weights = [small[of]], [np.ones(len(of), np.int64)]
    found = [codes]
    for g in np.flatnonzero(sizes > PAIRS_OUT).tolist():
        ids_a, times_a = np.unique(groups.a[a0[g]:a0[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(groups.b[b0[g]:b0[g] + n_b[g]], return_counts=True)
        found.append((ids_a.astype(np.int64)[:, None] << 32 | ids_b.astype(np.int64)).ravel())
        weights.append((times_a[:, None] * times_b).ravel())
        owners.append(np.full(len(found[-1]), g))
    return np.concatenate(owners), np.concatenate(found), np.concatenate(weights)


def summed(owner: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) with the sum of their weights, in order of owner, then code."""
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))))[:len(owner)]
    return owner[first], code[first], np.add.reduceat(weight, first) if len(first) else weight


class Aligner:
    """Encodes with both tokenizers and remembers the closed groups of words."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.bytewise = Tokenizer.from_file(vocabulary_path(byte_vocabulary))
        self.bytewise.no_truncation()
        self.bytewise.no_padding()
        self.bytewise.encode_special_tokens = True
        back = {c: b for b, c in byte_symbols().items()}
        names = self.bytewise.get_vocab(with_added_tokens=True)
        self.a_len = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.a_len[i] = len(name) if all(c in back for c in name) else 0
        with open(vocabulary_path(piece_vocabulary), "rb") as file:
            self.piecewise = sentencepiece.SentencePieceProcessor(model_proto=file.read() + NO_PREFIX)
        pieces = [self.piecewise.id_to_piece(i) for i in range(self.piecewise.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.piecewise.is_byte(i) else b"" if self.piecewise.is_control(i) or self.piecewise.is_unknown(i)
            else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(b) for b in self.b_bytes], np.int64)
        # Two neighbours that no piece holds in this order are never merged.
        shown = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.piecewise.is_byte(i)]
        self.joined = {p[k:k + 2] for p in shown for k in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = [array("q") for _ in range(4)]  # tokens of both, groups, links
        self.first = array("q", [0])  # where the pairs of a word begin
        self.pairs, self.weights = array("q"), array("q")
        self.numbers: dict[int, int] = {}  # of pairs
        self.codes = array("q")
        self.broken: set[int] = set()

    def encode(self, data: str) -> tuple[np.ndarray, np.ndarray]:
        a = self.bytewise.encode_batch_fast([data], add_special_tokens=False)[0].ids
        return np.array(a, np.uint32), np.array(self.piecewise.encode(data), np.uint32)

    def same_bytes(self, data: str, b: np.ndarray) -> bool:
        """Whether the pieces are the text; the byte tokenizer always is."""
        return b"".join(map(self.b_bytes.__getitem__, b.tolist())) == data.encode()

    def tokens(self, data: str, start: int = 0) -> tuple[Tokens, bool]:
        a, b = self.encode(data)
        return Tokens(a, start + np.cumsum(self.a_len[a]), b, start + np.cumsum(self.b_len[b])), self.same_bytes(data, b)

    def learn(self, new: list[str]) -> None:
        """Encode words no earlier text had, many at a time: no token crosses the space before a word."""
        block: list[str] = []
        size = 0
        for word in new:
            if word[-1:].isspace() or not word:  # white space at its end could join that of the next word
                self.learn_block([word])
                continue
            block.append(word)
            size += len(word) + 1
            if size > JOINED:
                self.learn_block(block)
                block, size = [], 0
        if block:
            self.learn_block(block)

    def learn_block(self, block: list[str]) -> None:
        data = " " + " ".join(block)
        tokens, fits = self.tokens(data)
        if not fits:
            if len(block) > 1:
                for word in block:
                    self.learn_block([word])
                return
            self.broken.add(len(self.texts))
            tokens = NO_TOKENS
        groups = whole_groups(fragment(tokens))
        ends = np.cumsum([len(w.encode()) + 1 for w in block])
        owner, code, weight = group_links(groups)
        a_at, b_at = np.searchsorted(tokens.a_end, ends, "right"), np.searchsorted(tokens.b_end, ends, "right")
        g_at = np.searchsorted(np.cumsum(groups.n_a), a_at, "right")
        self.words.update(zip(block, range(len(self.texts), len(self.texts) + len(block))))
        self.texts += group_texts(groups, g_at)
        word_of = np.searchsorted(g_at, owner, "right")
        links = np.zeros(len(block), np.int64)
        np.add.at(links, word_of, weight)
        for kept, values in zip(self.counts, (np.diff(a_at, prepend=0), np.diff(b_at, prepend=0), np.diff(g_at, prepend=0), links)):
            kept.frombytes(values.astype(np.int64).tobytes())
        word_of, code, weight = summed(word_of, code, weight)
        distinct, back = np.unique(code, return_inverse=True)
        numbers = [self.numbers.setdefault(c, len(self.numbers)) for c in distinct.tolist()]
        if len(self.numbers) > len(self.codes):
            fresh = np.zeros(len(self.numbers) - len(self.codes), np.int64)
            places = np.array(numbers, np.int64) - len(self.codes)
            fresh[places[places >= 0]] = distinct[places >= 0]
            self.codes.frombytes(fresh.tobytes())
        self.pairs.frombytes(np.array(numbers, np.int64)[back].tobytes() if len(distinct) else b"")
        self.weights.frombytes(weight.tobytes())
        starts = self.first[-1] + np.searchsorted(word_of, np.arange(len(block)), "right")
        self.first.frombytes(starts.astype(np.int64).tobytes())

    def split(self, text: str) -> list[str]:
        """Words of a text, each without the space before it; white space that could join a token stays inside."""
        if SPACES.search(text) or text[:1].isspace():
            return [w[1:] for w in WORD_START.split(" " + text)]
        return text.split(" ")

    def align(self, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """Rows of ``SCHEMA`` for whole texts."""
        if len(self.words) > KEPT:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.words)))
        words = [list(map(self.words.__getitem__, s)) for s in split]
        if self.broken:
            words = [[] if not self.broken.isdisjoint(w) else w for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.array([i for w in words for i in w], np.int64)
        doc = np.repeat(np.arange(len(words)), lengths)
        counts = [np.bincount(doc, weights=view(c)[flat], minlength=len(words)).astype(np.int64) for c in self.counts]
        digests = [hashlib.sha256(";".join(map(self.texts.__getitem__, w)).encode()).hexdigest() if w else "" for w in words]
        # distinct words of a text, then their pairs
        key, times = np.unique(doc * len(self.texts) + flat, return_counts=True)
        doc, word = np.divmod(key, max(len(self.texts), 1))
        first = view(self.first)
        size = first[word + 1] - first[word]
        at = np.repeat(first[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        n = max(len(self.codes), 1)
        pair = np.repeat(doc, size) * n + view(self.pairs)[at]
        weight = view(self.weights)[at] * np.repeat(times, size)
        order = np.argsort(pair, kind="stable")
        pair, weight = pair[order], weight[order]
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))[:len(pair)]
        doc, number = np.divmod(pair[starts], n)
        offsets = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
        codes = view(self.codes)[number]
        weight = np.add.reduceat(weight, starts) if len(starts) else weight
        return rows(ids, counts, digests, offsets, codes, weight)


def view(values: array) -> np.ndarray:
    return np.frombuffer(values, np.int64) if len(values) else NO_ENDS


def rows(ids: pa.Array, counts: list[np.ndarray], digests: list[str], offsets: np.ndarray, codes: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int64())) for v in (codes, links)]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), *lists],
                                      ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])


# -- long texts

def piece_cut(aligner: Aligner, data: bytes, low: int) -> int:
    """First offset from ``low`` on between two characters that no piece joins, or the end."""
    while low < len(data) and data[low] & 0xC0 == 0x80:
        low += 1
    if low == 0 or low >= len(data):
        return min(low, len(data))
    back = low - 1
    while data[back] & 0xC0 == 0x80:
        back -= 1
    width = 256
    while True:
        end = min(len(data), low + width)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        text = data[back:end].decode()
        at = back
        for k in range(1, len(text)):
            at += len(text[k - 1].encode())
            if text[k - 1:k + 1] not in aligner.joined:
                return at
        if end == len(data):
            return end
        width *= 8


def byte_cut(data: bytes, low: int) -> int:
    """First offset from ``low`` on at a space no token crosses, or the end."""
    found = SAFE_SPACE.search(data, max(0, low - 4))
    while found and found.end() < low:
        found = SAFE_SPACE.search(data, found.end())
    return found.end() if found else len(data)


def ranges(aligner: Aligner, data: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """Per byte range the stretch of each tokenizer: from its first safe offset in the range to that of the next range."""
    a0 = b0 = 0
    for high in range(chunk, len(data) + chunk, chunk):
        a1 = max(a0, byte_cut(data, high)) if high < len(data) else len(data)
        b1 = max(b0, piece_cut(aligner, data, high)) if high < len(data) else len(data)
        yield a0, a1, b0, b1
        a0, b0 = a1, b1


PARTS = [f"{p}_{f}" for p in ("head", "tail") for f in Tokens._fields] + [f"groups_{f}" for f in Groups._fields]
FRAGMENT_SCHEMA = "row long, doc_id long, chunk long, fits boolean, cut boolean, " + ", ".join(f"{p} binary" for p in PARTS)


def packed(part: Fragment) -> list[bytes]:
    return [x.astype(np.uint32 if f in ("a", "b") else np.int64).tobytes() for p in (part.head, part.tail, part.groups) for f, x in zip(p._fields, p)]


def unpacked(values: list[bytes], cut: bool) -> Fragment:
    arrays = [np.frombuffer(v, np.uint32 if p.rsplit("_", 1)[1] in ("a", "b") and not p.startswith("groups_n") else np.int64) for p, v in zip(PARTS, values)]
    return Fragment(Tokens(*arrays[:4]), Groups(*arrays[8:]), Tokens(*arrays[4:8]), cut)


def long_texts(docs: DataFrame, chunk: int, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """Rows of ``SCHEMA`` with ``row`` for texts of more than ``chunk`` bytes: ranges, fragments, a tree of compositions."""
    spark = docs.sparkSession
    kept: list[Aligner] = []

    def aligner() -> Aligner:
        if not kept:
            kept.append(Aligner(byte_vocabulary, piece_vocabulary))
        return kept[0]

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
            data = b" " + text.encode()
            for k, (a0, a1, b0, b1) in enumerate(ranges(aligner(), data, chunk)):
                low, high = min(a0, b0), max(a1, b1)
                yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "chunk": k, "data": data[low:high], "low": low,
                                                  "a0": a0, "a1": a1, "b0": b0, "b1": b1}], made)

    offsets = ("low", "a0", "a1", "b0", "b1")
    made = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), *[(c, pa.int64()) for c in offsets]])
    cuts = map_batches(docs.withColumn("row", F.monotonically_increasing_id()), cut,
                       "row long, doc_id long, chunk long, data binary, " + ", ".join(f"{c} long" for c in offsets), kept=kept)
    cuts = materialise(cuts, "alignment-ranges", "zstd")
    last = cuts.agg(F.max("chunk")).first()[0]

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            own = aligner()
            a_text, b_text = r["data"][r["a0"] - r["low"]:r["a1"] - r["low"]].decode(), r["data"][r["b0"] - r["low"]:r["b1"] - r["low"]].decode()
            a = np.array(own.bytewise.encode_batch_fast([a_text], add_special_tokens=False)[0].ids if a_text else [], np.uint32)
            b = np.array(own.piecewise.encode(b_text) if b_text else [], np.uint32)
            part = fragment(Tokens(a, r["a0"] + np.cumsum(own.a_len[a]), b, r["b0"] + np.cumsum(own.b_len[b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((r["row"], pa.int64()), (r["doc_id"], pa.int64()), (r["chunk"], pa.int64()),
                                               (own.same_bytes(b_text, b), pa.bool_()), (part.cut, pa.bool_()))]
                + [pa.array([v], pa.binary()) for v in packed(part)],
                ["row", "doc_id", "chunk", "fits", "cut", *PARTS])

    parts = map_batches(cuts.repartition(partitions(spark), "row", "chunk"), encode, FRAGMENT_SCHEMA, kept=kept)

    def fold(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("chunk")
        out = EMPTY
        for k, r in enumerate(found.itertuples(index=False)):
            part = unpacked([getattr(r, p) for p in PARTS], r.cut)
            out = part if k == 0 else compose(out, part)
        head = found.iloc[:1]
        return pd.DataFrame({"row": head["row"].values, "doc_id": head["doc_id"].values, "chunk": head["chunk"].values // FAN, "fits": [bool(found["fits"].all())],
                             "cut": [out.cut], **{p: [v] for p, v in zip(PARTS, packed(out))}})

    while last:
        parts = parts.groupBy("row", F.floor(F.col("chunk") / FAN).alias("block")).applyInPandas(fold, FRAGMENT_SCHEMA)
        last //= FAN

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            groups = whole_groups(unpacked([r[p] for p in PARTS], r["cut"])) if r["fits"] else NO_GROUPS
            owner, code, weight = group_links(groups)
            _, code, weight = summed(np.zeros_like(owner), code, weight)
            text = group_texts(groups, np.array([len(groups.n_a)]))[0]
            digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
            made = rows(pa.array([r["doc_id"]], pa.int64()), [np.array([v]) for v in (len(groups.a), len(groups.b), len(groups.n_a), weight.sum())],
                        [digest], np.array([0, len(code)]), code, weight)
            yield pa.RecordBatch.from_arrays([pa.array([r["row"]], pa.int64()), *made.columns], ["row", *made.schema.names])

    return map_batches(parts, finish, f"row long, {SCHEMA}")


def aligned(docs: DataFrame, chunk: int = CHUNK, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of every text, as a written table.

    ``pairs`` are the distinct linked ids as a * 2**32 + b, ``links`` how often each is linked.
    """
    kept: list[Aligner] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Aligner(byte_vocabulary, piece_vocabulary))
        yield kept[0].align(batch.column("doc_id"), batch.column("text").to_pylist())

    texts = id_text(docs)
    is_long = F.octet_length("text") >= chunk
    short = map_batches(texts.filter(~is_long), work, SCHEMA, SLICE, kept).withColumn("row", F.monotonically_increasing_id() * 2)
    longer = long_texts(texts.filter(is_long), chunk, byte_vocabulary, piece_vocabulary).withColumn("row", F.col("row") * 2 + 1)
    return materialise(short.unionByName(longer), "alignment", "zstd")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents a pair is linked, and whether no pair of its first id is in more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = materialise(counts, "alignment-counts", "zstd")
    # one row per id of the first vocabulary
    highest = counts.groupBy(F.shiftright("pair", 32).alias("first")).agg(F.max("documents").alias("highest"))
    return counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("first")).select(
        "pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def frequent_from(counts: DataFrame, limit: int) -> int:
    """Smallest power of two such that at most ``limit`` pairs are in as many documents."""
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2(F.col("documents"))).alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    total, power = 0, 64
    while power > 0 and total + sizes.get(power - 1, 0) <= limit:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << min(power, 62)


def align_tokenizers(docs: DataFrame, chunk: int = CHUNK, frequent: int = FREQUENT_PAIRS,
                     byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, with corpus-wide counts of the linked ids.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row
    per row of ``docs``; a repeated row counts as a further document.  Null and empty texts
    and texts that the second tokenizer does not reproduce have zeros and an empty digest.  A
    null id stays null, an empty table gives no rows, other columns are not read.
    """
    found = aligned(docs, chunk, byte_vocabulary, piece_vocabulary)
    counts = materialise(pair_counts(found), "alignment-best", "zstd")
    least = frequent_from(counts, frequent)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.links").alias("n"))
    looked = links.join(F.broadcast(counts.filter(F.col("documents") >= least)), "pair", "left")

    def sums(df: DataFrame) -> DataFrame:
        zero: Column = F.lit(0).cast("long")
        return df.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(zero)).alias("n_best"),
            F.sum(F.coalesce(F.col("n") * F.col("documents"), zero)).alias("count_sum"))

    out = sums(looked)
    if least > 1 and not counts.filter(F.col("documents") < least).isEmpty():
        rare = looked.filter(F.col("documents").isNull()).drop("documents", "best")
        rare = sums(rare.join(counts.filter(F.col("documents") < least), "pair"))
        out = out.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(out, "row", "left")
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")],
                       "groups_sha256")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokenizers(documents(spark, folder))
