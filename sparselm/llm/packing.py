"""Best-fit packing of token pieces into fixed-length sequences (operator 4).

Documents are tokenised once; only documents longer than a sequence are cut.
Packing depends on the pieces' lengths alone, so it is planned on the length
histogram (at most ``capacity`` entries, whatever the number of documents):

1. Configuration linear program: minimise the number of sequences over all
   ways to fill one, covering the histogram.  Multiplicative weights keep a
   price per length; a knapsack dynamic program over the capacity finds the
   configurations of highest price, covered lengths get cheaper.
2. Rounding: configurations are used a whole number of times, never beyond the
   histogram; what remains is packed best-fit decreasing on the histogram.
3. The plan, (length, rank) -> (sequence, offset), has a few rows per
   configuration and is sent to every task; pieces of a length are ranked by
   counts per (length, salt) and row numbers inside each, so a length that a
   third of the pieces share is not ranked in one task.

A null or empty text is one piece of just the end id.  Repeated rows are packed
as often as they occur; a null id is carried along.  An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm.tables import saved
from sparselm.llm.textblock import text_slices
from sparselm.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 0
ROUNDS = 200                # pricing rounds of the linear program
_RANK_GROUP = 50_000        # pieces of one length ranked together
_SLACK = 1e-3               # configurations within this of the best price are used


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = n % capacity or capacity
    first = min(first, n)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _piece_pass(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in text_slices(whole, "text"):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                tokens, off = enc.encode(b.column("text"))
                tokens = tokens.astype("<u4").tobytes()
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    raw = tokens[4 * lo:4 * hi] + end
                    for k, (s, n) in enumerate(_cut(len(raw) // 4, capacity)):
                        part = raw[4 * s:4 * (s + n)]
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                cols = [b.column("id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, tokenizer: str | None = None,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [src.schema["id"], T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return src.mapInArrow(_piece_pass(tokenizer or default_tokenizer(), capacity, end_id,
                                      with_ids), T.StructType(fields))


# ---------------------------------------------------------------- planning

def _price(value: np.ndarray, capacity: int):
    """Unbounded knapsack: best[c] = highest price of lengths that sum to at
    most c, choice[c] = a length to take there (0: leave one place free)."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        total = value[1:c + 1] + best[c - 1::-1]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], choice[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def _configuration(first: int, choice: np.ndarray, capacity: int) -> dict[int, int]:
    out = {first: 1}
    c = capacity - first
    while c > 0:
        k = int(choice[c])
        if k == 0:
            c -= 1
            continue
        out[k] = out.get(k, 0) + 1
        c -= k
    return out


def solve_configurations(demand: np.ndarray, capacity: int,
                         rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Fractional uses of configurations by multiplicative weights.

    ``demand[l]`` pieces of length l (index 0 unused).  Prices start at the
    dual-feasible l / capacity; a round takes the configurations whose price is
    within ``_SLACK`` of the best, one step each, and cheapens their lengths
    in proportion to the share of the demand that the step covers.
    """
    need = demand.astype(float)
    lengths = np.flatnonzero(demand)
    if len(lengths) == 0:
        return []
    base = np.arange(capacity + 1) / capacity
    covered = np.zeros(capacity + 1)
    uses: dict[tuple, float] = {}
    step_share = 4.0 / rounds
    for _ in range(rounds):
        value = np.zeros(capacity + 1)
        value[lengths] = base[lengths] * np.exp(-0.5 * covered[lengths])
        best, choice = _price(value, capacity)
        total = value[lengths] + best[capacity - lengths]
        near = lengths[total >= best[capacity] * (1 - _SLACK)]
        for first in near:
            conf = _configuration(int(first), choice, capacity)
            step = step_share * min(need[k] / n for k, n in conf.items())
            key = tuple(sorted(conf.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + step
            for k, n in conf.items():
                covered[k] += step * n / need[k]
        if covered[lengths].min() >= 1:
            break
    # uses that hold the tokens of the whole histogram; rounding clips the
    # lengths that they cover more than once
    filled = sum(v * sum(k * n for k, n in conf) for conf, v in uses.items())
    scale = filled / float((need * np.arange(capacity + 1)).sum())
    return [(dict(k), v / scale) for k, v in uses.items()]


def best_fit_decreasing(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit on a histogram: (configuration, times) with equal bins kept
    together; at most a few groups per length."""
    groups: list[list[list]] = [[] for _ in range(capacity + 1)]    # by free places
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        free = size
        while n and free <= capacity:
            waiting, groups[free] = groups[free], []
            q = free // size
            for conf, times in waiting:
                if n == 0:
                    groups[free].append([conf, times])
                    continue
                full = min(times, n // q)
                if full:
                    groups[free - q * size].append([{**conf, size: q}, full])
                    n -= full * q
                    times -= full
                if times and 0 < n < q:
                    groups[free - n * size].append([{**conf, size: n}, 1])
                    n = 0
                    times -= 1
                if times:
                    groups[free].append([conf, times])
            free += 1
        if n:
            q = capacity // size
            if n // q:
                groups[capacity - q * size].append([{size: q}, n // q])
            if n % q:
                groups[capacity - n % q * size].append([{size: n % q}, 1])
    return [(conf, times) for g in groups for conf, times in g]


def plan_packing(demand: np.ndarray, capacity: int = CAPACITY,
                 rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) that packs the histogram exactly."""
    exact = demand.copy()
    plan: list[tuple[dict[int, int], int]] = []
    if exact[capacity]:
        plan.append(({capacity: 1}, int(exact[capacity])))
        exact[capacity] = 0
    fractional = solve_configurations(exact, capacity, rounds)
    best = None
    for share in (1.0, 0.9, 0.75, 0.5, 0.25):         # of the fractional solution
        left = exact.copy()
        part = []
        for conf, uses in sorted(fractional, key=lambda x: -x[1]):
            times = min([int(share * uses)] + [int(left[k]) // n for k, n in conf.items()])
            if times > 0:
                for k, n in conf.items():
                    left[k] -= times * n
                part.append((conf, times))
        part += best_fit_decreasing(left, capacity)
        if best is None or sum(t for _, t in part) < sum(t for _, t in best):
            best = part
    return plan + best


def _plan_rows(plan: list[tuple[dict[int, int], int]]):
    """Runs of ranks: (length, first rank, first sequence, offset), sorted."""
    rows, used, seq = [], {}, 0
    for conf, times in plan:
        offset = 0
        for size, n in sorted(conf.items(), reverse=True):
            for _ in range(n):
                at = used.get(size, 0)
                rows.append((size, at, seq, offset))
                used[size] = at + times
                offset += size
        seq += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
         text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None,
         end_id: int = END_ID, with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with their place: id, piece, start, length, ids_crc32, (ids,)
    sequence_id, offset.  Offsets of a sequence are gapless from 0."""
    pieces = saved(spark, token_pieces(docs, id_col, text_col, capacity, tokenizer, end_id,
                                       with_ids), "pack-pieces")
    hist = pieces.groupBy("length").count().collect()       # at most `capacity` rows
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for r in hist:
        demand[r["length"]] = r["count"]
    runs = _plan_rows(plan_packing(demand, capacity, rounds))

    salts = int(demand.max()) // _RANK_GROUP + 1
    order = ["id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    # at most capacity * salts rows
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt"))
                           - F.col("n")).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn(
        "rank", F.col("r") + F.col("before"))

    key = runs[:, 0] * (1 << 44) + runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        want = length.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(np.int64)
        at = np.searchsorted(key, want, side="right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 2] + rank.to_numpy(np.int64) - runs[at, 1],
                             "offset": runs[at, 3]})

    out = ranked.withColumn("place", place("length", "rank"))
    return out.select("id", "piece", "start", "length", "ids_crc32",
                      *(["ids"] if with_ids else []), "place.sequence_id", "place.offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(spark, docs).withColumnRenamed("id", "doc_id")
