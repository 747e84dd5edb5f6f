"""BPE encoding and decoding of whole texts with a public vocabulary file.

Texts are taken apart where no token can cross (white space, then the vocabulary's own
pre-tokens), every distinct piece is encoded once per task, and pieces too long for that
are encoded as a tree: halves on their own, then growing windows around each join until
both sides agree.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vouch.llm.common import documents, id_text, map_batches
from workload.registry import query

VOCABULARY = "word_bpe_49k.json"
# Pre-tokens of more characters are encoded as a tree, with leaves of at most LEAF.
LONG, LEAF = 256, 128
# Distinct pieces kept per task, an upper bound on memory and no limit on the text.
KEPT = 600_000
# Bytes of text split into words at a time, and new words taken apart at a time.
SLICE, BLOCK = 2 << 20, 50_000

# Below U+0250 the letters, numbers and case pairs are the same in every Unicode version
# and no combining mark occurs, so pre-tokens can be found without the library.  U+0130
# is left out for its lower case of two characters.
PLAIN = re.compile("[\0-įı-ɏ]*")
_LETTERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed values of the vocabulary's pattern
PRE_TOKEN = re.compile(f"{CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# The same over many words at once, one a line.
PRE_TOKENS = re.compile(f"\n|{CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\n{_LETTERS}{_NUMBERS}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the pattern
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


def texts_of(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def gathered(found: list[bytes], at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of ``found[i]`` for every i of ``at``, side by side, and where each begins, with the end."""
    ids = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    firsts, taken = np.cumsum(sizes) - sizes, sizes[at]
    stops = np.concatenate(([0], np.cumsum(taken)))
    return ids[np.arange(stops[-1]) + np.repeat(firsts[at] - stops[:-1], taken)].tobytes(), stops


class Encoder:
    """Encodes texts exactly as the tokenizers library does with the same file, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bare = {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": [], "truncation": None, "padding": None}
        self.bare = Tokenizer.from_str(json.dumps(spec | bare))
        self.vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        tokens = self.vocab | self.special
        self.names = [""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.names[i] = token
        self.closes = np.array([n.endswith(self.suffix) for n in self.names])  # tokens that end a piece
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @property
    def whole(self):
        """The library's own encoder; most texts need no more of it than ``bare``."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.no_truncation()
            self._whole.no_padding()
        return self._whole

    def split(self, text: str) -> list[str]:
        return [w for w in WHITE.split(text) if w] if SEPARATORS.search(text) else text.split()

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Encode the words that no earlier text had."""
        if len(self.words) > KEPT:
            self.words.clear()
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        new = set().union(*texts).difference(self.words)
        plain = [word for word in new if (word.isascii() or PLAIN.fullmatch(word)) and not ("<" in word and self.special)]
        for start in range(0, len(plain), BLOCK):
            self.learn_plain(plain[start:start + BLOCK])
        if len(plain) == len(new):
            return
        taken = {word: self.pre_tokens(word) for word in new.difference(plain)}
        missing = {p for parts in taken.values() for p in parts if isinstance(p, str)}.difference(self.pieces)
        self.encode_pieces(missing)
        pieces = self.pieces
        for word, parts in taken.items():
            if len(parts) == 1 and isinstance(parts[0], str):
                self.words[word] = pieces[parts[0]]
            else:
                self.words[word] = b"".join([pieces[p] if isinstance(p, str) else np.uint32(p).tobytes() for p in parts])

    def learn_plain(self, words: list[str]) -> None:
        """``learn`` for words that need no library to be taken apart: they are, all together."""
        parts = pa.array(PRE_TOKENS.findall("\n".join([*words, ""]).lower()), pa.large_string()).dictionary_encode()
        distinct, at = texts_of(parts.dictionary), np.asarray(parts.indices)
        end = distinct.index("\n")
        ends = np.flatnonzero(at == end)
        # Printable ASCII characters stand for themselves.
        distinct = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.symbols) for p in distinct]
        self.encode_pieces(set(distinct[:end] + distinct[end + 1:]).difference(self.pieces))
        data, stops = gathered([b"" if i == end else self.pieces[p] for i, p in enumerate(distinct)], at)
        cuts = (4 * stops[ends]).tolist()
        self.words.update(zip(words, [data[a:b] for a, b in zip([0, *cuts], cuts)]))

    def pre_tokens(self, word: str) -> list[str | int]:
        """Pre-tokens of a word in byte symbols, and ids of special tokens written out in it."""
        if self.special_pattern is not None and "<" in word and self.special_pattern.search(word):
            out: list[str | int] = []
            for part in self.special_pattern.split(word):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out.extend(self.pre_tokens(part))
            return out
        if word.isascii():
            return [p.translate(self.symbols) for p in PRE_TOKEN.findall(word.lower())]
        if PLAIN.fullmatch(word):
            return [p.encode().decode("latin-1").translate(self.symbols) for p in PRE_TOKEN.findall(word.lower())]
        normal = self.whole.normalizer.normalize_str(word)
        return [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_pieces(self, missing: set[str]) -> None:
        short = [p for p in missing if len(p) <= LONG]
        if short:
            joined = " ".join(short)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.concatenate(([0], np.flatnonzero(self.closes[ids]) + 1))
            if len(cuts) != len(short) + 1:  # a piece without a closing token: ask which word each token is of
                found = self.bare.encode(joined, add_special_tokens=False)
                cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(short) + 1))
            data = ids.tobytes()
            for piece, start, end in zip(short, cuts[:-1].tolist(), cuts[1:].tolist()):
                self.pieces[piece] = data[4 * start:4 * end]
        for piece in missing:
            if len(piece) > LONG:
                self.pieces[piece] = self.encode_long(piece)

    def encode_long(self, piece: str) -> bytes:
        symbols = [*piece[:-1], piece[-1] + self.suffix]
        cuts = self.tree(symbols, 0, len(symbols))
        tokens = ["".join(symbols[a:b]) for a, b in zip(cuts, cuts[1:])]
        return np.array([self.vocab[t] for t in tokens if t in self.vocab], np.uint32).tobytes()

    def tree(self, symbols: list[str], start: int, end: int) -> list[int]:
        """Token boundaries of a stretch of symbols, ``start`` and ``end`` included."""
        if end - start <= LEAF:
            return self.merge(symbols, start, end)
        middle = (start + end) // 2
        left, right = self.tree(symbols, start, middle), self.tree(symbols, middle, end)
        width = 4
        while True:
            a, b = max(0, len(left) - 1 - width), min(width, len(right) - 1)
            window = self.merge(symbols, left[a], right[b])
            # A sequence is the encoding of its text if each two neighbours are that of
            # theirs; if the outer tokens of the window stay, so do their other neighbours.
            if (a == 0 or window[1] == left[a + 1]) and (b == len(right) - 1 or window[-2] == right[b - 1]):
                return left[:a] + window + right[b + 1:]
            width *= 2

    def merge(self, symbols: list[str], start: int, end: int) -> list[int]:
        """Boundaries after all merges, lowest rank first and leftmost among equals."""
        n = end - start
        part = symbols[start:end]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [(rank, i, part[i], part[i + 1]) for i in range(n - 1) if (rank := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, one, two = heapq.heappop(heap)
            j = after[i] if part[i] is not None else -1
            if j < 0 or part[i] != one or part[j] != two:
                continue
            part[i], part[j] = one + two, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (rank := ranks.get((part[i], part[after[i]]))) is not None:
                    heapq.heappush(heap, (rank, i, part[i], part[after[i]]))
            if before[i] >= 0 and (rank := ranks.get((part[before[i]], part[i]))) is not None:
                heapq.heappush(heap, (rank, before[i], part[before[i]], part[i]))
        return [start + i for i in range(n) if part[i] is not None] + [end]

    def encode(self, words: list[str]) -> bytes:
        """Ids of a text whose words were learned, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, words))

    def encode_texts(self, texts: pa.Array | Iterable[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty.  A word is looked up once, however often the texts have it."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        gc.disable()  # many small objects and no cycles: collections would only walk them again and again
        try:
            # The compute library splits where str.split does, so separators that are no white space here go another way.
            if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
                split = pa.array([self.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
            else:
                split = pc.utf8_split_whitespace(texts)
            flat = split.flatten().dictionary_encode()
            ends = np.asarray(split.offsets)
            words = texts_of(flat.dictionary)
            if "" in words:  # at the ends of a text
                self.words[""] = b""
            self.learn([words])
            data, stops = gathered([self.words[w] for w in words], np.asarray(flat.indices))
            cuts = (4 * stops[ends - ends[0]]).tolist()
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]
        finally:
            gc.enable()

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space: this vocabulary has no decoder of its own."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): token ids of every whole text as packed unsigned 32-bit integers, and their decoding.

    Null counts as empty; an empty or blank text has no ids and decodes to the empty
    string.  Repeated rows give repeated rows, a null id stays null, an empty table gives
    no rows, and columns other than ``doc_id`` and ``text`` are not read.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Encoder(vocabulary_path(vocabulary)))
        ids = kept[0].encode_texts(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([kept[0].decode(i) for i in ids], pa.string())],
            ["doc_id", "ids", "decoded"])

    kept: list[Encoder] = []  # one for each task
    return map_batches(id_text(docs), work, "doc_id long, ids binary, decoded string", SLICE, kept)


def encoded_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The digests of ``encode_documents``, made where the ids are so that these do not travel."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Encoder(vocabulary_path(vocabulary)))
        ids = kept[0].encode_texts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(kept[0].decode(i).encode()).hexdigest() for i in ids]),
        ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept: list[Encoder] = []
    return map_batches(id_text(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", SLICE, kept)


@query("op3_bpe")
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_digests(documents(spark, folder))
