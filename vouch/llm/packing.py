"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Only the histogram reaches the driver, one row per length.  The program's columns are
configurations, multisets of lengths that fit in one sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.llm.bpe import SLICE, VOCABULARY, Encoder, vocabulary_path
from vouch.llm.common import documents, id_text, map_batches, materialise
from workload.registry import query

SEQUENCE = 2048
# Pieces of one length are ranked in buckets of about so many rows, however many they are.
BUCKET_ROWS = 2_000


def pieces(docs: DataFrame, capacity: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): whole texts as token ids and ``end_id``, longer ones cut."""
    return _pieces(docs, capacity, vocabulary, end_id, True)


def _pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, with_ids: bool) -> DataFrame:
    end = np.uint32(end_id).tobytes()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Encoder(vocabulary_path(vocabulary)))
        rows: list[tuple] = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), kept[0].encode_texts(batch.column("text"))):
            ids += end
            for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part), part))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        take = 6 if with_ids else 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:take], kinds)], names[:take])

    kept: list[Encoder] = []
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_batches(id_text(docs), work, schema, SLICE, kept)


def price(values: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack by dynamic programming: the best value of a multiset of lengths, for every capacity."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (values[1:c + 1] + best[c - 1::-1]).max())
    return best


def configuration_program(demand: np.ndarray, rounds: int = 60, epsilon: float = 0.02, step: float = 0.5) -> dict[tuple[int, ...], float]:
    """A fractional solution of: cover ``demand[l]`` pieces of each length l by as few configurations as possible.

    Multiplicative weights: a length's weight falls with the share of its demand that is
    covered so far; each round prices configurations by the weights with the knapsack and
    adds such as reach ``1 - epsilon`` of the best and share no length, the largest
    length first: those have the fewest partners.  ``demand`` has index 0 to the capacity.
    """
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    covered = np.zeros(capacity + 1)
    solution: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        share = covered[lengths] / demand[lengths]
        if share.size == 0 or share.min() >= 1:
            break
        values = np.full(capacity + 1, -1e18)
        values[lengths] = lengths * np.exp(-share)
        best = price(values, capacity)
        open_values = values.copy()  # of lengths that no configuration of this round has
        for length in lengths[np.lexsort((-lengths, share > 0.999))].tolist():
            if open_values[length] < 0:
                continue
            config, left, worth = [length], capacity - length, values[length]
            while left > 0:
                offers = open_values[1:left + 1] + best[left - 1::-1]
                at = int(offers.argmax())
                if open_values[at + 1] < 0:
                    break
                config.append(at + 1)
                left, worth = left - at - 1, worth + values[at + 1]
            if worth < (1 - epsilon) * best[capacity]:
                continue
            open_values[config] = -1e18
            number, times = np.unique(config, return_counts=True)
            amount = step * float((demand[number] / times).min())
            solution[tuple(sorted(config, reverse=True))] += amount
            covered[number] += amount * times
    return solution


def rounded(demand: np.ndarray, solution: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, how often), covering the demand exactly: the program rounded down, the rest by best fit."""
    left = demand.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    capacity = len(demand) - 1
    fullest = max(map(sum, solution), default=0)  # a token left free is lost as often as its configuration is used
    for config, amount in sorted(solution.items(), key=lambda x: (x[1], x[0]), reverse=True):
        number, times = np.unique(config, return_counts=True)
        often = min(int((left[number] // times).min()), max(1, int(amount)))
        if often > 0 and sum(config) == fullest:
            out.append((config, often))
            left[number] -= often * times
    open_at: dict[int, list[list]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            fits = np.flatnonzero(spaces[length:])
            if fits.size:
                space = length + int(fits[0])
                config, often = open_at[space].pop()
                if not open_at[space]:
                    spaces[space] = False
                n = min(often, rest)
                if often > n:
                    open_at[space].append([config, often - n])
                    spaces[space] = True
                made, rest = [(config + (length,), n)], rest - n
            else:
                each = capacity // length
                made = [((length,) * each, rest // each), ((length,) * (rest % each), 1)]
                rest = 0
            for config, n in made:
                if n and config:
                    space = capacity - sum(config)
                    open_at[space].append([config, n])
                    spaces[space] = True
    out += [(tuple(config), n) for groups in open_at.values() for config, n in groups]
    return out


def best_packing(demand: np.ndarray, rounds: int = 60) -> list[tuple[tuple[int, ...], int]]:
    """The rounded program, or the rounding that uses none of it if that takes fewer sequences."""
    both = [rounded(demand, configuration_program(demand, rounds)), rounded(demand, {})]
    return min(both, key=lambda packed: sum(n for _, n in packed))


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): where the pieces of that length go, by rank."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for config, often in packed:
        offset = 0
        for length in config:
            found[length].append((rank[length], sequence, offset))
            rank[length] += often
            offset += length
        sequence += often
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(docs: DataFrame, capacity: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = 0, rounds: int = 60) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only documents longer than ``capacity``
    are cut.  Null and empty texts are the end id alone.  Repeated rows and ids are packed
    each on their own; a null id stays null; an empty table gives no rows; columns other
    than ``doc_id`` and ``text`` are not read.  The driver gets the histogram, at most
    ``capacity`` rows.
    """
    made = materialise(_pieces(docs, capacity, vocabulary, end_id, False), "pieces")
    return place(made, capacity, rounds)


def place(made: DataFrame, capacity: int = SEQUENCE, rounds: int = 60) -> DataFrame:
    """Pieces with their sequence and offset; any table with doc_id, piece and a length from 1 to ``capacity``."""
    demand = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():
        demand[row["length"]] = row["count"]
    where = slots(best_packing(demand, rounds))
    # ranks within a length: counts by bucket, then row numbers inside a bucket
    buckets = F.array(*[F.lit(1 + n // BUCKET_ROWS) for n in demand.tolist()])
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.element_at(buckets, F.col("length").cast("int") + 1)))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("rank_inside", inside).join(firsts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first_rank") + F.col("rank_inside")).drop("bucket", "first_rank", "rank_inside")
    columns = [c for c in made.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    table = where[int(length[rows[0]])]
                    slot = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                    sequence[rows], offset[rows] = slot[:, 1] + rank[rows] - slot[:, 0], slot[:, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    return ranked.select(*columns, "rank").mapInArrow(work, f"{kinds}, sequence_id long, offset long")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder))
