"""Periodic runs of words: maximal stretches that repeat a period at least four times.

For every period ``q`` the words at grid points three periods apart are compared with those
``q`` further on (harmonically many points), and matches are extended both ways.  How
far two positions agree comes from a difference cover: a few words are compared up to positions
that both belong to the cover, whose suffixes alone are sorted; a sparse table over their common
prefixes answers the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vouch.llm.common import documents, id_text, map_batches
from workload.registry import query

# A perfect difference set: any two positions reach the cover together within COVER - 1 steps.
COVER, RESIDUES = 21, (0, 1, 4, 14, 16)
LEAST_WORDS, LEAST_REPEATS = 6, 4
# Grid points compared at a time.
POINTS = 1 << 21


def sync_steps() -> np.ndarray:
    """Steps from residue ``i`` until ``i`` and ``i + r`` are both in the cover, by (i, r)."""
    steps = np.zeros((COVER, COVER), np.int64)
    for r in range(COVER):
        first = next(d for d in RESIDUES if (d + r) % COVER in RESIDUES)
        steps[:, r] = (first - np.arange(COVER)) % COVER
    return steps


STEPS = sync_steps()


def agree(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, way: int = 1) -> np.ndarray:
    """How many words from ``i`` and ``j`` on agree, compared one by one up to ``limit``."""
    out = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(limit > 0)
    k = 0
    while len(alive):
        alive = alive[words[i[alive] + way * k] == words[j[alive] + way * k]]
        k += 1
        out[alive] = k
        alive = alive[limit[alive] > k]
    return out


class CoverIndex:
    """Longest common extensions over a sequence in which every text ends with a value of its own."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        classes = [np.arange(r, n, COVER) for r in RESIDUES]
        self.positions = np.concatenate(classes)
        m = len(self.positions)
        self.number = np.full(n, -1, np.int64)
        self.number[self.positions] = np.arange(m)
        last = np.cumsum([len(c) for c in classes])
        ends = np.repeat(last, [len(c) for c in classes])  # where the class of a sample ends
        # rank of the next COVER words, several packed into one number
        shifted = words - words.min() + 1
        bits = max(1, int(shifted.max()).bit_length())
        per = max(1, 62 // bits)
        padded = np.concatenate((shifted, np.zeros(COVER + per, np.int64)))
        keys = []
        for k in range(0, COVER, per):
            key = np.zeros(m, np.int64)
            for x in range(k, min(k + per, COVER)):
                key = key << bits | padded[self.positions + x]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        levels, reach = [rank], 1
        while int(rank.max(initial=0)) < m - 1:
            ahead = np.arange(m) + reach
            follow = np.where(ahead < ends, rank[np.minimum(ahead, m - 1)] + 1, 0)
            key = rank * (m + 1) + follow
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
            levels.append(rank)
            reach *= 2
        self.rank = rank
        # common prefixes of neighbours in sorted order: equal blocks from the longest down, then single words
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(m - 1 if m else 0, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            live = np.flatnonzero((a < m) & (b < m))
            same = live[levels[level][a[live]] == levels[level][b[live]]]
            common[same] += COVER << level
            for x in (a, b):
                moved = x[same] + (1 << level)
                x[same] = np.where(moved < ends[x[same]], moved, m)
        at, to = self.positions[order[:-1]] + common, self.positions[order[1:]] + common
        padded = np.concatenate((words, -1 - np.arange(2 * COVER, dtype=np.int64) + words.min()))
        common += agree(padded, at, to, np.full(len(at), COVER))
        self.table = [common]
        while (1 << len(self.table)) <= len(common):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Agreeing words from two different positions of the cover on."""
        one, two = self.rank[self.number[i]], self.rank[self.number[j]]
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def extend(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(agreeing words found one by one, whether they end at positions of the cover) from ``i`` and ``j`` on."""
    steps = STEPS[i % COVER, (j - i) % COVER]
    found = agree(words, i, j, steps)
    return found, found == steps


def grid_points(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all grid points of texts at ``starts``, in blocks: each run holds one at least."""
    texts = np.flatnonzero(lengths >= LEAST_WORDS)
    periods = lengths[texts] // LEAST_REPEATS
    text = np.repeat(texts, periods)
    q = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    # in a run of period q and least length, so many neighbouring words equal those q further on
    step = np.where(q == 1, LEAST_WORDS - 1, (LEAST_REPEATS - 1) * q)
    points = -(-(lengths[text] - q) // step)
    upto = np.cumsum(points)
    low = 0
    while low < len(q):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + POINTS, "right")))
        n = points[low:high]
        of = np.repeat(np.arange(low, high), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield starts[text[of]] + k * step[of], q[of]
        low = high


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, ordered by text, start, period; words are numbers from 0."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths  # a value of its own before each text and at the end
    words = np.full(int((lengths + 1).sum()) + 1, -1, np.int64)
    words[starts - 1] = -2 - np.arange(len(texts))
    for text, start in zip(texts, starts.tolist()):
        words[start:start + len(text)] = text
    found: list[np.ndarray] = []
    for at, q in grid_points(starts, lengths):
        hit = np.flatnonzero(words[at] == words[at + q])
        found.append(np.stack((at[hit], q[hit])))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, q = np.concatenate(found, axis=1)
    back_words, n = words[::-1].copy(), len(words)
    forth, forth_on = extend(words, at, at + q)
    back, back_on = extend(back_words, n - at, n - at - q)
    # Few matches reach the cover; only the texts they are in are sorted.
    open_ends = np.flatnonzero(forth_on | back_on)
    if len(open_ends):
        owner = np.searchsorted(starts, at[open_ends], "right") - 1
        chosen = np.unique(owner)
        size = lengths[chosen] + 1
        begin = np.cumsum(size) - size + 1  # where the chosen texts are in the part that is indexed
        part = np.concatenate([words[[0]] - n] + [words[starts[c]:starts[c] + lengths[c] + 1] for c in chosen.tolist()])
        i = at[open_ends] - starts[owner] + begin[np.searchsorted(chosen, owner)]
        j = i + q[open_ends]
        for index, a, b, got, on, mirrored in ((part, i, j, forth, forth_on, False), (part[::-1].copy(), len(part) - i, len(part) - j, back, back_on, True)):
            live = np.flatnonzero(on[open_ends])
            if not len(live):
                continue
            # the part has other residues than the whole: go to its own cover
            more, reached = extend(index, a[live], b[live])
            cover = CoverIndex(index) if reached.any() else None
            if cover is not None:
                more[reached] += cover.extension(a[live][reached] + more[reached], b[live][reached] + more[reached])
            got[open_ends[live]] = more
    start, length = at - back, forth + back + q
    keep = length >= np.maximum(LEAST_WORDS, LEAST_REPEATS * q)
    start, length, q = start[keep], length[keep], q[keep]
    # a stretch found with several periods has the smallest; others are multiples of it
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[:len(start)]
    start, length, q = start[first], length[first], q[first]
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    text = np.searchsorted(starts, start, "right") - 1
    return text, start - starts[text], length, q


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the stretch that a text of every tenth hash value repeats, by contract of the query."""
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 or not n:
        return None
    g = mark // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
MADE = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")],
                  ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def collapse_runs(docs: DataFrame, plant: bool = False, texts: bool = True) -> DataFrame:
    """All periodic runs of every whole text, and the text with each run reduced to its first period.

    Returns ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, runs, collapsed``; the four numbers are those of the run with the greatest
    exponent (ties: smallest start, then period) and null without a run.  Null, empty
    and blank texts have no words, no runs and the digests of the empty text; repeated rows give
    repeated rows, a null id stays null, an empty table gives no rows, other columns are
    not read.  With ``plant`` some texts get a repeated stretch first, by a hash of their
    ids (none for a null id).  Without ``texts`` the last two columns are null.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_pylist()
        split = [t.encode().split() for t in batch.column("text").to_pylist()]  # bytes: ASCII white space alone
        lengths = [len(s) for s in split]
        flat = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
        numbers = np.asarray(flat.indices, np.int64) if len(flat) else np.zeros(0, np.int64)
        codes = np.split(numbers, np.cumsum(lengths)[:-1]) if lengths else []
        if plant:
            for k, (i, n) in enumerate(zip(ids, lengths)):
                if (stretch := planted(i, n)) is not None:
                    a, p = stretch
                    place = np.arange(n)
                    place[a:] = a + (place[a:] - a) % p
                    codes[k] = codes[k][place]
                    split[k] = list(map(split[k].__getitem__, place.tolist()))
        text, start, length, period = find_runs(codes)
        bounds = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
        found = list(zip(start.tolist(), length.tolist(), period.tolist()))
        made = []
        for k, doc_id in enumerate(ids):
            runs, words = found[bounds[k]:bounds[k + 1]], split[k]
            best = None
            if runs:
                best = runs[0]
                edge = np.zeros(len(words) + 1, np.int64)
                for s, n, p in runs:
                    if n * best[2] > best[1] * p:
                        best = (s, n, p)
                    edge[s + p] += 1
                    edge[s + n] -= 1
                words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            kept = b" ".join(words)
            made.append((doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                         hashlib.sha256("".join([f"{s},{n},{p}\n" for s, n, p in runs]).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                         [dict(zip(("start", "length", "period"), r)) for r in runs] if texts else None, kept.decode() if texts else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), MADE)], schema=MADE)

    return map_batches(id_text(docs), work, SCHEMA)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_runs(documents(spark, folder), plant=True, texts=False).drop("runs", "collapsed")
