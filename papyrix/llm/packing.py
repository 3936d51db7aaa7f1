"""Best-fit packing by a configuration linear program over the length histogram.

``pieces`` cuts documents into runs of at most ``capacity`` ids, ``plan`` decides on the driver from the histogram alone
(at most ``capacity`` numbers, however many pieces there are), ``assign`` gives every piece its place. The program is solved
by multiplicative weights with a bounded knapsack as its pricing, rounded, and solved again for what rounding leaves; the
few pieces after the last rounding (fewer than a thousandth on the tables here) go by best fit.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are packed one by one;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
ROUNDS = 1000  # pricing rounds of the linear program, at most; it ends when every length is covered
RATE = 1.0  # how fast a length's weight falls with its covered share
STEP = 0.34  # of a configuration's scarcest demand that one round covers
WASTE = 0.05  # how far below the best price a configuration may be
SALTS = 4096  # parts that the pieces of one length are numbered in, at most: the driver holds capacity * SALTS counts
SALT_ROWS = 4_000_000  # pieces of one length such a part should hold


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. The ids themselves stay in the worker."""
    path = tokenizer_path or tokens.default_path()

    def run(batches):
        import pyarrow as pa

        encode, width, end = tokens.tokenizer(path).encode, 4 * capacity, array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    common.arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def items(left: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and numbers of copies that a bounded knapsack chooses from: 1, 2, 4, ... copies and the rest of each length,
    together no more than there are or than fit."""
    out = []
    for n in sorted(left, reverse=True):
        most, copies = min(left[n], capacity // n), 1
        while most > 0:
            out.append((n, min(copies, most)))
            most -= min(copies, most)
            copies *= 2
    lengths, copies = np.array(out, np.int64).reshape(-1, 2).T
    return lengths, copies


def knapsack(lengths: np.ndarray, copies: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounded knapsack by dynamic programming: of each capacity the highest price, and the table to read the choice from.

    price[n] is that of a length n. Row k + 1 of the table has, for each capacity, the last of the first k + 1 items taken.
    """
    value, last = np.zeros(capacity + 1), np.full((len(lengths) + 1, capacity + 1), -1, np.int16)
    better = np.empty(capacity + 1, bool)
    for k, (w, worth) in enumerate(zip((lengths * copies).tolist(), (price[lengths] * copies).tolist())):
        last[k + 1] = last[k]
        got, here = value[: capacity + 1 - w] + worth, better[w:]
        np.greater(got, value[w:], out=here)
        np.copyto(last[k + 1, w:], np.int16(k), where=here)
        np.maximum(got, value[w:], out=value[w:])
    return value, last


def configuration(last: np.ndarray, lengths: np.ndarray, copies: np.ndarray, c: int) -> dict[int, int]:
    """The lengths, and how often each, behind a knapsack's value at capacity c."""
    out: dict[int, int] = {}
    k = int(last[-1, c])
    while k >= 0:
        n, a = int(lengths[k]), int(copies[k])
        out[n] = out.get(n, 0) + a
        c -= n * a
        k = int(last[k, c])
    return out


def fractional(left: dict[int, int], capacity: int, seed: int = 0, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights for min sum x, A x >= left, x >= 0: configurations with their amounts, and a lower bound of the sum.

    A length's price is its size times a weight that falls exponentially as its covered share rises above the least
    covered one's. Each round prices configurations by one knapsack. With every length put in beforehand, those within
    WASTE of the best price are taken, least covered lengths first, each as often as STEP of the scarcest demand in it;
    a length that has had its step in a round waits for the next. A length is done at its whole demand, so the amounts
    cover each demand exactly. Whatever the prices are, left * price over the best configuration's price is a lower bound.
    """
    r = np.random.default_rng(seed)
    demand = np.zeros(capacity + 1)
    for n, c in left.items():
        demand[n] = c
    covered, full = np.where(demand > 0, 0.0, 1.0), 1 - 1e-9
    amounts: dict[tuple, float] = {}
    bound = 0.0
    there = np.flatnonzero(demand)
    for prices in (there.astype(float), 1.0 / (capacity // there)):  # two starts that are good where small, or only large, lengths are many
        price = np.zeros(capacity + 1)
        price[there] = prices
        bound = max(bound, float(demand @ price) / knapsack(*items(left, capacity), price, capacity)[0][-1])
    for _ in range(rounds):
        there = np.flatnonzero(covered < full)
        if not len(there):
            break
        price = np.zeros(capacity + 1)  # the small random part lets equal configurations take turns
        price[there] = there * np.exp(-RATE * (covered[there] - covered[there].min())) * (1 + 1e-4 * r.random(len(there)))
        lengths, copies = items({n: left[n] for n in there.tolist()}, capacity)
        value, last = knapsack(lengths, copies, price, capacity)
        bound = max(bound, float(demand @ price) / value[-1])
        gain = price[there] + value[capacity - there]
        good = there[gain >= (1 - WASTE) * value[-1]]
        upto = np.minimum(covered + STEP, full)
        for n in good[np.lexsort((-good, covered[good]))].tolist():
            if covered[n] >= upto[n]:
                continue
            found = configuration(last, lengths, copies, capacity - n)
            found[n] = min(found.get(n, 0) + 1, left[n])
            if any(covered[m] >= upto[m] for m in found) or sum(price[m] * a for m, a in found.items()) < (1 - WASTE) * value[-1]:
                continue
            amount = min(min(STEP, 1 - covered[m]) * left[m] / a for m, a in found.items())
            for m, a in found.items():
                covered[m] += a * amount / left[m]
            key = tuple(sorted(found.items()))
            amounts[key] = amounts.get(key, 0.0) + amount
    return amounts, bound


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins are looked up by their free room."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)
    bins = []
    for n in sorted(lengths, reverse=True):
        at = n + int(open_rooms[n:].argmax())
        if open_rooms[at]:
            b = room[at].pop()
            open_rooms[at] = bool(room[at])
        else:
            at, b = capacity, []
            bins.append(b)
        b.append(n)
        room[at - n].append(b)
        open_rooms[at - n] = True
    return bins


@dataclass
class Plan:
    """For length n, the k-th piece (k from 0) lies in the row of ``rows[n]`` with the last ``first`` <= k."""

    rows: dict[int, np.ndarray]  # first, sequence, a sequence's pieces of this length, offset of the first of them
    sequences: int
    bound: float  # no packing has fewer sequences
    by_program: int  # pieces that the rounded program places
    by_best_fit: int  # and those left after it


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations, how often each is used, and the intervals of pieces that go to each.

    The program's amounts are rounded down, then up in the order of their fractions where all pieces are still there; the
    program is solved anew for what is left, until a rounding places nothing. Only then best fit takes the rest.
    """
    if bad := [n for n in histogram if not 0 < n <= capacity]:
        raise ValueError(f"lengths must be from 1 to {capacity}, not {bad[:3]}")
    left = {n: c for n, c in histogram.items() if c > 0}
    used: list[tuple[dict[int, int], int]] = []

    def use(config: dict[int, int], times: int) -> int:
        times = min(times, *(left.get(n, 0) // a for n, a in config.items()))
        if times > 0:
            used.append((config, times))
            for n, a in config.items():
                left[n] -= a * times
                if not left[n]:
                    del left[n]
        return max(times, 0)

    bound, solved = 0.0, 0
    if whole := left.get(capacity, 0):
        use({capacity: 1}, whole)
    placed = True
    while left and placed:
        amounts, low = fractional(left, capacity, seed=solved)
        bound = bound if solved else whole + low
        solved += 1
        order = sorted(amounts.items(), key=lambda x: (-x[1], x[0]))
        placed = sum([use(dict(c), int(x)) for c, x in order])
        placed += sum([use(dict(c), 1) for c, x in sorted(order, key=lambda x: (-(x[1] % 1), x[0])) if x % 1])
    by_program = sum(sum(c.values()) * t for c, t in used)
    bound = max(bound, float(whole))
    rest = Counter(tuple(b) for b in best_fit([n for n, c in left.items() for _ in range(c)], capacity))
    by_best_fit = sum(left.values())
    for b, times in sorted(rest.items(), reverse=True):
        use(dict(Counter(b)), times)
    rows: dict[int, list] = {}
    given: Counter = Counter()
    sequence = 0
    for config, times in used:
        offset = 0
        for n in sorted(config, reverse=True):
            rows.setdefault(n, []).append((given[n], sequence, config[n], offset))
            given[n] += config[n] * times
            offset += n * config[n]
        sequence += times
    return Plan({n: np.array(x, np.int64) for n, x in rows.items()}, sequence, bound, by_program, by_best_fit)


def assign(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to a table with a ``length`` column, which is read twice: stage it before.

    Pieces of one length are numbered in salted parts, so a length that a third of the pieces have is no hot key; the
    driver gets a count for each (length, salt), at most capacity * SALTS. Numbering streams over a part's sorted rows, so
    beyond SALTS * SALT_ROWS pieces of one length parts grow, but none has to fit in memory.
    """
    total = pieces.count()
    salts = int(min(SALTS, max(16, -(-total // SALT_ROWS))))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = np.zeros((capacity + 1, salts), np.int64)
    for row in salted.groupBy("length", "_salt").count().toLocalIterator():
        counts[row["length"], row["_salt"]] = row["count"]
    before = np.cumsum(counts, axis=1) - counts
    made = plan({n: int(c) for n, c in enumerate(counts.sum(axis=1)) if c}, capacity)
    names = pieces.columns

    def run(frames):
        for f in frames:
            k = before[f["length"], f["_salt"]] + f["_k"] - 1
            n = f["length"].to_numpy()
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for one in np.unique(n):
                here, rows = n == one, made.rows[one]
                at = rows[np.searchsorted(rows[:, 0], k[here], "right") - 1]
                within = k[here] - at[:, 0]
                sequence[here] = at[:, 1] + within // at[:, 2]
                offset[here] = at[:, 3] + within % at[:, 2] * one
            yield f[names].assign(sequence_id=sequence, offset=offset)

    numbered = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    cut, _ = common.stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return assign(cut, capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
