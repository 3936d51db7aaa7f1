"""Approximate nearest neighbours: cells, score-aware four-bit codes, table scans, exact reranking.

The index is fitted on a bounded sample: cell centres by k-means, and for each pair of components 16 codewords under the
anisotropic loss, which weighs the part of a quantisation error parallel to its vector more than the part across, since
that part shifts inner products. Every row is then coded: one cell, half a byte for each pair, its squared norm. A query
scans the codes of the nearest cells by table look-up: the distance to a code, less that of the code from its row, is a
lower bound of the row's distance. Rows whose bound does not exceed the k-th distance known so far are measured exactly, in
double precision, on the original vectors: within the cells scanned nothing is left out. Where most rows of a block
remain (a tight group), a matrix product with its rounding error rules out first what it can.

How many cells a query scans is measured in each search: the TESTED queries of the smallest hashes are compared with
every row, and the least number of cells that holds a share RECALL of their neighbours is taken. Two rounds follow: the
nearest cells of each query give it a k-th distance, and the rest of its cells are scanned under that bound.

Rows meet queries in blocks: a cell's rows are dealt to blocks of a bounded size by a hash, so a cell that holds a third
of all rows is many blocks. Rows and queries of a block come to one task in this order and stream through it: a block
of rows is held, its queries pass in packs. Blocks grow with the table up to BLOCK rows, since each query is sent once
to every block of its cells.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; a query has as many neighbours as there are candidates, if those are fewer than k; ties go to the smaller vec_id; a
row repeated exactly counts once; rows of a null vec_id are no queries and no candidates; an empty table, or one without
usable vectors, gives an empty result; other columns of the table may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 10_000  # vectors that the index is fitted on, or 40 a cell if that is more: those of the smallest hashes of id and vector
CELL_ROWS = 200  # rows a cell should hold
CELLS = 512  # cells at most
PROBES = 30  # cells a query scans at least
RECALL = 0.95  # share of the neighbours of tested queries that the cells scanned must hold
TESTED = 256
NEAR = 8  # the first round scans one in NEAR of the cells
BLOCK = 65_536  # rows of a block, or twice the mean of a cell if that is less
QUERIES = 512
CHUNK = 128  # queries that go through a block together
TILE = 2048  # rows scanned before the k-th distances are brought up to date
FIRST = 32  # rows measured for a first k-th distance
DENSE = 0.05  # share of a tile from which the matrix product comes before exact distances
PARALLEL = 4.0  # weight of the parallel error against the orthogonal one
PAIR = 2


class Index:
    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books  # (cells, d); (parts, 16, PAIR)

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 1) -> Index:
        r = np.random.default_rng(seed)
        centres = x[r.choice(len(x), min(cells, len(x)), replace=False)].copy()
        for _ in range(8):
            near = nearest(x, centres)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            n = np.bincount(near, minlength=len(centres))
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        y = padded(x)
        parts = y.reshape(len(y), -1, PAIR)
        unit = parts / np.linalg.norm(y, axis=1)[:, None, None]
        books = np.empty((parts.shape[1], 16, PAIR))
        codes = np.empty(parts.shape[:2], np.int64)
        for m in range(parts.shape[1]):  # start: plain k-means of each part
            book = parts[r.choice(len(x), 16, replace=len(x) < 16), m]
            for _ in range(6):
                codes[:, m] = ((book**2).sum(1) - 2 * (parts[:, m] @ book.T)).argmin(1)
                for c in range(16):
                    if (here := codes[:, m] == c).any():
                        book[c] = parts[here, m].mean(0)
            books[m] = book
        out = cls(centres, books)
        for _ in range(2):  # then codes and codewords in turn under the anisotropic loss
            codes = out._assign(parts, unit, codes)
            for m in range(len(books)):
                along = ((parts - out.books[np.arange(len(books)), codes]) * unit).sum((1, 2))
                rest = along - ((parts[:, m] - out.books[m][codes[:, m]]) * unit[:, m]).sum(1)
                u, p = unit[:, m], parts[:, m]
                for c in range(16):
                    if (here := codes[:, m] == c).any():
                        a = here.sum() * np.eye(PAIR) + (PARALLEL - 1) * u[here].T @ u[here] + 1e-9 * np.eye(PAIR)
                        b = p[here].sum(0) + (PARALLEL - 1) * ((rest[here] + (p[here] * u[here]).sum(1))[:, None] * u[here]).sum(0)
                        out.books[m, c] = np.linalg.solve(a, b)
        return out

    def _assign(self, parts, unit, codes):
        """Coordinate descent: each part in turn takes the codeword of the least loss, given the other parts."""
        along = ((parts - self.books[np.arange(len(self.books)), codes]) * unit).sum((1, 2))
        for m in range(parts.shape[1]):
            x, y = (parts[:, m, i, None] - self.books[m, :, i] for i in range(PAIR))
            own = x * unit[:, m, :1] + y * unit[:, m, 1:]
            rest = along - own[np.arange(len(codes)), codes[:, m]]
            whole = rest[:, None] + own
            codes[:, m] = (x * x + y * y + (PARALLEL - 1) * (whole * whole)).argmin(1)
            along = rest + own[np.arange(len(codes)), codes[:, m]]
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, parts / 2) bytes: two four-bit codes each."""
        y = padded(x)
        parts = y.reshape(len(y), -1, PAIR)
        unit = parts / np.linalg.norm(y, axis=1)[:, None, None]
        codes = np.stack([((self.books[m] ** 2).sum(1) - 2 * (parts[:, m] @ self.books[m].T)).argmin(1) for m in range(parts.shape[1])], 1)
        codes = self._assign(parts, unit, codes).astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The padded vectors that codes stand for."""
        each = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)
        return self.books[np.arange(len(self.books)), each].reshape(len(codes), -1)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(bytes of a code, 256, queries): -2 * inner product of each pair of codewords with the query, in whole steps
        rounded down, above a base for each query; the bases; the step."""
        parts = np.ascontiguousarray(padded(q).reshape(len(q), -1, PAIR).transpose(1, 2, 0).astype(np.float32))
        one = self.books.astype(np.float32) @ (-2 * parts)
        least = one.min(1, keepdims=True)
        one -= least
        step = max(float(one.max()) / 127, 1e-30)
        one = (one / np.float32(step)).astype(np.uint16)
        return (one[0::2, None] + one[1::2, :, None]).reshape(-1, 256, len(q)), least.sum((0, 1), dtype=np.float64), step


def padded(x: np.ndarray) -> np.ndarray:
    """Zero components up to a multiple of two pairs."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * PAIR))))


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    x, centres = x.astype(np.float32), centres.astype(np.float32)
    for at in range(0, len(x), 4096):
        far = (centres**2).sum(1) - 2 * x[at : at + 4096] @ centres.T
        out.append(np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(1)[:, None])
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def plain(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that have both."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())


def usable(column) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow column hold finite components only and one that is not zero; all lengths."""
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null components turn into NaN
    bad, some = (np.concatenate([[0], np.cumsum(y)])[ends] for y in (~np.isfinite(x), x != 0))
    return (np.diff(bad) == 0) & (np.diff(some) > 0), np.diff(ends)


def lengths(rows: DataFrame) -> tuple[int, int]:
    """The length of most usable vectors, the smaller one on a tie, and how many have it."""

    def count(batches):
        import pyarrow as pa

        for b in batches:
            good, size = usable(b.column(0))
            d, n = np.unique(size[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(n.astype(np.int64))], ["d", "n"])

    found = rows.select("embedding").mapInArrow(count, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    return (found.d, found.n) if found else (0, 0)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _packed(column, kind: str) -> np.ndarray:
    """The rows of a binary column, each of the same number of values."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _top(of: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's k nearest, by query, distance and id; the rank of each."""
    order = np.lexsort((ids, far, of))
    at = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    return order[at < k], at[at < k]


def once(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows, in order of id, without exact repeats and, of equal vectors, without all but the k + 1 smallest
    ids: those are as near and come first, whichever of them is the query itself."""
    words = np.ascontiguousarray(vectors).view(np.uint32)
    mixed = (words.astype(np.uint64) * np.random.default_rng(1).integers(1, 1 << 63, words.shape[1], np.uint64)[None]).sum(1)
    order = np.lexsort((ids, mixed))
    h, i, w = mixed[order], ids[order], words[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]).any(1)])  # equal hashes of other vectors only keep more rows
    fresh = new | np.concatenate([[True], i[1:] != i[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    seen = np.cumsum(fresh)
    return np.sort(order[fresh & (seen - seen[start] <= k)])


def scan(index: Index, block: dict, queries: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, row ids, exact distances: of each query, the k nearest among a block's rows, or those of them that are
    not beyond its distance in ``queries["bounds"]``."""
    ids, vectors, codes = block["ids"], block["vectors"], block["codes"]
    if "norms" not in block:  # once for all packs of queries
        made = index.decode(codes)
        gaps = np.linalg.norm(padded(vectors.astype(np.float64)) - made, axis=1)
        order = np.argsort(gaps)  # so that one gap stands for a tile
        ids, vectors, codes, made = (x[order] for x in (ids, vectors, codes, made))
        block |= {"ids": ids, "vectors": vectors, "codes": codes, "gaps": gaps[order], "norms": (made * made).sum(1)}
        block["middle"] = vectors.mean(0, dtype=np.float64)
        block["moved"] = (vectors - block["middle"]).astype(np.float32)
        block["lengths"] = (block["moved"] ** 2).sum(1)
        block["by_byte"] = np.ascontiguousarray(codes.T)
    norms, gaps, moved, lengths, by_byte = (block[x] for x in ("norms", "gaps", "moved", "lengths", "by_byte"))
    ids, vectors = block["ids"], block["vectors"]
    bounds = queries.get("bounds", np.full(len(queries["ids"]), np.inf))
    out: list[list] = [[], [], []]
    for at in range(0, len(queries["ids"]), CHUNK):
        q, names = queries["vectors"][at : at + CHUNK].astype(np.float64), queries["ids"][at : at + CHUNK]
        known = bounds[at : at + CHUNK]
        kth = known.copy()
        tables, base, step = index.tables(q)
        size = (q * q).sum(1)
        shifted = (q - block["middle"]).astype(np.float32)
        away = (shifted.astype(np.float64) ** 2).sum(1)
        whole = not norms.max() + size.max() < 1e30  # beyond single precision: every row is measured
        parts = norms - gaps * gaps
        least = parts.min()
        parts = np.zeros(len(ids), np.uint16) if whole else np.minimum((parts - least) / step, 30_000).astype(np.uint16)
        of, rows, far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

        def measure(new_of, new_rows):
            nonlocal of, rows, far
            kept = names[new_of] != ids[new_rows]
            new_of, new_rows = new_of[kept], new_rows[kept]
            new = [np.sqrt(((vectors[new_rows[x : x + 4096]] - q[new_of[x : x + 4096]]) ** 2).sum(1)) for x in range(0, len(new_of), 4096)]
            if new:
                new = np.concatenate(new)
                near = ~(new > kth[new_of])
                new_of, new_rows, new = new_of[near], new_rows[near], new[near]
            if len(new):
                of, rows, far = np.concatenate([of, new_of]), np.concatenate([rows, new_rows]), np.concatenate([far, new])
                best, rank = _top(of, far, ids[rows], k)
                of, rows, far = of[best], rows[best], far[best]
                last = rank == k - 1
                kth[of[last]] = np.minimum(kth[of[last]], far[last])

        for low in range(0, len(ids), TILE):
            here = slice(low, min(low + TILE, len(ids)))
            n = here.stop - low
            if whole:
                measure(*(x.reshape(-1) for x in np.meshgrid(np.arange(len(q)), np.arange(low, here.stop), indexing="ij")))
                continue
            score = np.repeat(parts[here, None], len(q), 1)
            part = np.empty_like(score)
            for m in range(len(by_byte)):
                np.take(tables[m], by_byte[m, here], axis=0, out=part, mode="clip")
                score += part
            first = np.empty((len(q), 0), np.int64)
            if not np.isfinite(kth).all():
                first = np.argpartition(score, FIRST - 1, axis=0)[:FIRST].T if n > FIRST else np.tile(np.arange(n), (len(q), 1))
                measure(np.repeat(np.arange(len(q)), first.shape[1]), low + first.reshape(-1))
            # squared distance to the code, less what single precision may have added, against the k-th distance and the code's own
            room = (kth + 2 * gaps[here.stop - 1]) * kth * (1 + 1e-6) - size - base - least + (len(by_byte) + 8) * 2.0**-21 * (norms[here].max() + size)
            open_ = score < np.clip(np.nan_to_num(room / step + 1.01, nan=np.inf), 0, 65_535).astype(np.uint16)
            np.put_along_axis(open_, first.T, False, 0)
            count = np.count_nonzero(open_)
            if count > DENSE * open_.size:
                some = low + np.flatnonzero(open_.any(1))
                slack = (moved.shape[1] + 8) * 2.0**-22 * (lengths[some].max() + away)
                square = (lengths[some][:, None] + away.astype(np.float32) - 2 * (moved[some] @ shifted.T)).T
                beyond = (kth * (1 + 1e-6)) ** 2 + slack
                if len(some) > k and np.count_nonzero(~(square > beyond[:, None].astype(np.float32))) > 4 * k * len(q):
                    square[names[:, None] == ids[some]] = np.inf
                    beyond = np.fmin(beyond, np.partition(square, k - 1, axis=1)[:, k - 1] + 2 * slack)
                beyond = np.nextafter(beyond.astype(np.float32), np.float32(np.inf))
                open_ = ~(square > beyond[:, None]) & open_[some - low].T
                new_of, new_rows = np.divmod(np.flatnonzero(open_), len(some))
                measure(new_of, some[new_rows])
            elif count:
                new_rows, new_of = np.divmod(np.flatnonzero(open_), len(q))
                new_rows += low
                for x in range(0, len(new_of), 8192):
                    i, j = new_of[x : x + 8192], new_rows[x : x + 8192]
                    square = lengths[j] + away[i] - 2 * np.einsum("ij,ij->i", moved[j], shifted[i])
                    maybe = ~(square > (kth[i] * (1 + 1e-6)) ** 2 + (moved.shape[1] + 8) * 2.0**-22 * (lengths[j] + away[i]))
                    measure(i[maybe], j[maybe])
        fits = ~(far > known[of])
        out[0].append(names[of[fits]])
        out[1].append(ids[rows[fits]])
        out[2].append(far[fits])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def _cells_for_recall(table: DataFrame, asked: DataFrame, index: Index, kind: str, k: int) -> int:
    """The least number of nearest cells that holds a share RECALL of the true neighbours of the tested queries."""
    rows = asked.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(TESTED).collect()  # TESTED rows at most
    if not rows:
        return 0
    names = np.array([r.vec_id for r in rows])
    q = np.stack([np.frombuffer(r.vec, kind) for r in rows]).astype(np.float64)

    def nearest_rows(batches):
        import pyarrow as pa

        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]  # query, distance, id, cell

        def add(held):
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            x = np.concatenate([_packed(b.column(1), kind) for b in held]).astype(np.float64)
            cells = np.concatenate([b.column(2).to_numpy() for b in held])
            far = (x * x).sum(1) - 2 * q @ x.T + (q * q).sum(1)[:, None]
            far[names[:, None] == ids] = np.inf
            n = min(k, len(ids))
            near = np.argpartition(far, n - 1, axis=1)[:, :n]
            new = np.repeat(np.arange(len(q)), n), np.take_along_axis(far, near, 1).reshape(-1), ids[near].reshape(-1), cells[near].reshape(-1)
            both = [np.concatenate(x) for x in zip(best, new)]
            top, _ = _top(both[0], both[1], both[2], k)
            best[:] = [x[top] for x in both]

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= 8192:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array(best[3].astype(np.int32))], ["of", "far", "vec_id", "cell"])

    rank = F.row_number().over(Window.partitionBy("of").orderBy("far", "vec_id"))
    found = table.select("vec_id", "vec", "cell").mapInArrow(nearest_rows, "of long, far double, vec_id long, cell int").where("far < double('inf')").withColumn("rank", rank).where(F.col("rank") <= k).collect()
    place = np.argsort(nearest(q, index.centres, len(index.centres)), axis=1)
    need = np.sort([place[r.of, r.cell] for r in found])
    return int(need[int(np.ceil(RECALL * len(need))) - 1]) + 1 if len(need) else 0


def _units(batches, index: Index, kind: str, k: int):
    """What ``scan`` finds in a stream of rows (kind 0) and queries (kind 1) in order of cell, block and kind."""
    key, block, rows, asked, held = None, None, [], [], 0

    def flush():
        nonlocal block, asked, held
        if not asked:
            return None
        if block is None and rows:
            ids, vectors = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            codes, kept = np.concatenate([r[2] for r in rows]), once(ids, vectors, k)
            block = {"ids": ids[kept], "vectors": vectors[kept], "codes": codes[kept]}
        queries = {x: np.concatenate([a[i] for a in asked]) for i, x in enumerate(("ids", "vectors", "bounds"))}
        asked, held = [], 0
        return scan(index, block, queries, k) if block else None

    for b in batches:
        cell, number, side = (b.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(side) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if hi == lo:
                continue
            if key != (cell[lo], number[lo]):
                if found := flush():
                    yield found
                key, block, rows = (cell[lo], number[lo]), None, []
            ids, vectors = b.column(3).slice(lo, hi - lo).to_numpy(), _packed(b.column(4).slice(lo, hi - lo), kind)
            if side[lo] == 0:
                rows.append((ids, vectors, _packed(b.column(5).slice(lo, hi - lo), "u1")))
            else:
                asked.append((ids, vectors, b.column(6).slice(lo, hi - lo).to_numpy()))
                held += hi - lo
                if held >= QUERIES and (found := flush()):
                    yield found
    if found := flush():
        yield found


def search(vectors: DataFrame, is_query, k: int = 10, probe: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by Euclidean distance of each row that ``is_query`` selects.

    ``probe``: share of the cells a query scans, PROBES at least; unset, it is measured for a recall of RECALL.
    """
    spark = vectors.sparkSession
    common.arrow_batches(spark)
    rows = plain(vectors)
    d, n = lengths(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def good(batches):
        import pyarrow as pa

        for b in batches:
            fine, size = usable(b.column(1))
            yield b.filter(pa.array(fine & (size == d)))

    cells = int(min(CELLS, max(1, n // CELL_ROWS)))
    size = max(SAMPLE, 40 * cells)
    named = F.xxhash64("vec_id", "embedding")
    share = int(min(1.0, 1.5 * size / n) * (1 << 30)) + 1
    kept = "vec_id long, embedding array<double>"
    sample = rows.where(F.pmod(named, F.lit(1 << 30)) < share).mapInArrow(good, kept).orderBy(named, "vec_id").limit(size).toPandas()
    if not len(sample):
        sample = rows.mapInArrow(good, kept).orderBy(named, "vec_id").limit(size).toPandas()
    index = Index.fit(np.array(sample["embedding"].tolist()), cells)
    cells = len(index.centres)

    def coded(batches):
        import pyarrow as pa

        for b in good(batches):
            x = _matrix(b.column(1))
            if len(x):
                codes = index.encode(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(nearest(x, index.centres)[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "vec", "cell", "code"])

    table, _ = common.stage(rows.mapInArrow(coded, "vec_id long, vec binary, cell int, code binary"), "codes")
    sizes = np.zeros(cells, np.int64)
    for r in table.groupBy("cell").count().collect():  # CELLS rows at most
        sizes[r.cell] = r["count"]
    block = min(BLOCK, max(256, 2 * n // cells))
    blocks = np.maximum(1, -(-sizes // block))
    asked = table.where(is_query(F.col("vec_id"))).select("vec_id", "vec").distinct()
    if cells <= PROBES:
        probes = cells
    else:
        probes = min(cells, max(PROBES, _cells_for_recall(table, asked, index, kind, k) if probe is None else int(np.ceil(probe * cells))))
    first = max(1, probes // NEAR)

    def probing(start: int, stop: int):
        """Each query once for every block of its cells from place ``start`` to ``stop``; the first cells hold k rows at least besides the query."""

        def send(batches):
            import pyarrow as pa

            for b in batches:
                for at in range(0, b.num_rows, CHUNK):
                    part = b.slice(at, CHUNK)
                    near = nearest(_packed(part.column(1), kind).astype(np.float64), index.centres, cells)
                    enough = [int(np.searchsorted(np.cumsum(sizes[o]), k + 1)) + 1 for o in near]
                    to = [o[max(start, e) if start else 0 : max(stop, e)] for o, e in zip(near, enough)]
                    which = np.concatenate(to)
                    of = np.repeat(np.arange(len(to)), [len(t) for t in to])
                    of, cell = np.repeat(of, blocks[which]), np.repeat(which, blocks[which])
                    number = np.arange(len(cell)) - np.repeat(np.cumsum(blocks[which]) - blocks[which], blocks[which])
                    for x in range(0, len(of), 8192):
                        here = slice(x, x + 8192)
                        take = pa.array(of[here])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[here].astype(np.int32)), pa.array(number[here].astype(np.int32)), pa.array(np.ones(len(take), np.int32)), part.column(0).take(take), part.column(1).take(take), pa.nulls(len(take), pa.binary()), part.column(2).take(take)], ["cell", "block", "side", "id", "vec", "code", "bound"])

        return send

    count = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), F.col("cell") + 1)
    dealt = table.select("cell", F.pmod(F.xxhash64("vec_id"), count).cast("int").alias("block"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "vec", "code", F.lit(None).cast("double").alias("bound"))

    def scanned(batches):
        import pyarrow as pa

        for a, c, d in _units(batches, index, kind, k):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    def met(queries: DataFrame, start: int, stop: int) -> DataFrame:
        sent = queries.mapInArrow(probing(start, stop), "cell int, block int, side int, id long, vec binary, code binary, bound double")
        units = dealt.unionByName(sent).repartition("cell", "block").sortWithinPartitions("cell", "block", "side", "id")
        return units.mapInArrow(scanned, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near, _ = common.stage(ranked(met(asked.withColumn("bound", F.lit(float("inf"))), 0, first)), "near")
    if first >= probes:
        return near
    last = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = asked.join(last, "vec_id", "left").select("vec_id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return ranked(near.drop("rank").unionByName(met(bounded, first, probes)))


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)
