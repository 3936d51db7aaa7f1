"""N-gram Jaccard join with signature trees.

A document's set is the hashes (64 bits) of its distinct k-word shingles. Equal sets are one class, joined by one
aggregation, and only each class's smallest doc_id goes on. Two sets that reach the threshold share one of their first
n - ceil(threshold * n) + 1 elements in any common order; here frequent shingles come last, found by counts over all
documents, so long shared passages rarely lead documents together. Classes that share such an element meet in a group,
named by its smallest member; a group is cut into blocks of bounded size, and every pair of blocks is one unit of work.

In a key's rows, those without a neighbour of a fitting size go first. In a unit, signature trees are joined: leaves hold a few documents' token bitmaps, nodes the OR of theirs and their range of
sizes. A pair of nodes is dropped when no pair of sizes or the largest possible overlap (what both bitmaps have, and
what one bitmap can hide in shared bits) reaches the threshold. What is left is verified on the sets, but for pairs that
are linked already through others. Links go to a distributed connected-components loop.

Defined results: a null text, or one without words, has an empty set and links with nothing; fewer than k words are one
shingle; rows that repeat a doc_id are one node of the graph (``keep_one`` tells them apart); a null doc_id has no component
id but its class's; an empty table gives an empty result; other columns of documents may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS_CACHE = 500_000
FREQUENT = 100_000  # shingles, the most frequent, that come last in the order
LOCAL, LOCAL_DOCS = 5, 2000  # a shingle is counted where it is in LOCAL of LOCAL_DOCS neighbouring documents
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 1_500_000  # of a block, about, at most
LEAF, FAN = 8, 8


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_CACHE and len(word) < 64:
            self[word] = h
        return h


_words = _Words()
_multiplier = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The ascending hashes of a text's distinct k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # lowers A-Z, splits at \x20\x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _multiplier + h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _texts(batch):
    return [x.as_py() for x in batch.column(1)]


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that come last in the order, ascending. Counted over all documents; which they are changes no result."""

    def run(batches):
        import pyarrow as pa

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(n[keep])], ["key", "n"])

        common.claim("words", _words.clear)
        held: list = []
        for batch in batches:
            for text in _texts(batch):
                held.append(shingles(text, k))
                if len(held) == LOCAL_DOCS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    counts = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT)
    return np.sort(counts.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def sets(docs: DataFrame, k: int, percent: int, last: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), sig (128-bit hash of the set), bitmap, keys (the elements it is grouped by)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        common.claim("words", _words.clear)
        for batch in batches:
            sizes, signs, maps, keys = [], [], [], []
            for text in _texts(batch):
                s = shingles(text, k)
                n = len(s)
                sizes.append(n)
                signs.append(xxhash.xxh3_128_digest(s.tobytes()) if n else b"")
                maps.append(bitmap(s, bits(n)).tobytes() if n else b"")
                first = n - -(-percent * n // 100) + 1 if n else 0
                if n and len(last):
                    at = np.searchsorted(last, s)
                    late = last[np.minimum(at, len(last) - 1)] == s
                    s = np.concatenate((s[~late], s[late]))
                keys.append(s[:first].view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n", "sig", "bitmap", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, bitmap binary, keys array<long>")


def whole(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, sig and the set itself, as bytes."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        common.claim("words", _words.clear)
        for batch in batches:
            found = [shingles(t, k).tobytes() for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) if x else b"" for x in found], pa.binary()), pa.array(found, pa.binary())], ["doc_id", "sig", "shingles"])

    return docs.mapInArrow(run, "doc_id long, sig binary, shingles binary")


def bits(n: int) -> int:
    """Width of the token bitmap of a set of n: a power of two of 2 to 4 bits an element."""
    return 64 << int(2 * n // 64).bit_length()


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, bool)
    out[s & np.uint64(width - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


class Tree:
    """A signature tree over some of a unit's documents: levels of nodes, the leaves first."""

    def __init__(self, order: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, slack: np.ndarray):
        self.order = order
        at = np.arange(0, len(order), LEAF)
        ends = np.minimum(at + LEAF, len(order))
        n = sizes[order]
        level = [at, ends, np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.maximum.reduceat(slack[order], at), np.bitwise_or.reduceat(bitmaps[order], at, axis=0)]
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            ends = level[1][np.minimum(at + FAN, len(level[0])) - 1]
            level = [level[0][at], ends, np.minimum.reduceat(level[2], at), np.maximum.reduceat(level[3], at), np.maximum.reduceat(level[4], at), np.bitwise_or.reduceat(level[5], at, axis=0)]
            self.levels.append(level)

    def children(self, depth: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[depth - 1][0])))


def links(found: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of linked pairs that span all links of a unit. side: 0 or 1, by block; with two blocks only pairs across count."""
    sizes = np.array([len(x) for x in found])
    width = bits(int(sizes.max()))
    bitmaps = np.stack([bitmap(s, width) for s in found])
    slack = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
    least = np.array([s[0] for s in found], np.uint64)
    rank = np.lexsort((least, np.floor(np.log(sizes) / 0.16)))
    trees = [Tree(rank[side[rank] == b], sizes, bitmaps, slack) for b in np.unique(side)]
    group = np.arange(len(found))  # of documents linked so far
    out: list[tuple[int, int]] = []

    def settled(u, v):
        return bool((group[u] == group[u[0]]).all() and (group[v] == group[u[0]]).all())

    for u, v in candidates(trees[0], trees[-1], len(trees) == 1, sizes, bitmaps, slack, percent, settled):
        if group[u] == group[v]:
            continue
        s, t = (found[u], found[v]) if sizes[u] < sizes[v] else (found[v], found[u])
        at = np.searchsorted(t, s)
        both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        if 100 * both >= percent * (len(s) + len(t) - both):
            out.append((u, v))
            group[group == group[v]] = group[u]
    return out


def survivors(sizes: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int) -> np.ndarray:
    """Which documents of a unit have a partner that their sizes and bitmaps allow. Bitmaps of different widths are
    compared at the smaller one, to which the other is folded."""
    mark = np.zeros(len(sizes), bool)
    widths = np.array([8 * len(m) for m in maps])
    order = np.argsort(sizes, kind="stable")
    for width in np.unique(widths):
        own = widths == width
        wider = (widths == 2 * width) & (sizes * percent <= 100 * sizes[own].max())
        here = np.flatnonzero(own | wider)
        if len(here) < 2:
            continue
        rows = np.stack([np.frombuffer(maps[k], np.uint64).reshape(-1, width // 64) for k in here[own[here]]])[:, 0]
        if wider.any():
            folded = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[k], np.uint64).reshape(2, -1), axis=0) for k in here[wider[here]]])
            both = np.empty((len(here), width // 64), np.uint64)
            both[own[here]], both[wider[here]] = rows, folded
            rows = both
        n, sub, b = sizes[here], mark[here], side[here]
        slack = n - np.bitwise_count(rows).sum(1, dtype=np.int64)
        rank = np.argsort(np.argsort(order)[here], kind="stable")
        trees = [Tree(rank[b[rank] == x], n, rows, slack) for x in np.unique(b)]
        for u, v in candidates(trees[0], trees[-1], len(trees) == 1, n, rows, slack, percent, lambda u, v: bool(sub[u].all() and sub[v].all())):
            sub[u] = sub[v] = True
        mark[here] |= sub
    return mark


def candidates(left: Tree, right: Tree, same: bool, sizes, bitmaps, slack, percent: int, settled):
    """Dual traversal: pairs of positions that no bound excludes. settled(u, v): whether all pairs of both are of no use."""
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        i, a, j, b = stack.pop()
        x, y = left.levels[i], right.levels[j]
        own = same and (i, a) == (j, b)
        if not own:
            if 100 * x[3][a] < percent * y[2][b] or 100 * y[3][b] < percent * x[2][a]:
                continue
            shared = int(np.bitwise_count(x[5][a] & y[5][b]).sum())
            if (100 + percent) * (shared + min(x[4][a], y[4][b])) < percent * (x[2][a] + y[2][b]):
                continue
        if settled(left.order[x[0][a] : x[1][a]], right.order[y[0][b] : y[1][b]]):
            continue
        if i or j:
            if own:
                kids = left.children(i, a)
                stack += [(i - 1, p, i - 1, q) for p in kids for q in kids if p < q]
                stack += [(i - 1, p, i - 1, p) for p in kids]
            elif i >= j:
                stack += [(i - 1, p, j, b) for p in left.children(i, a)]
            else:
                stack += [(i, a, j - 1, q) for q in right.children(j, b)]
            continue
        ka, kb = left.order[x[0][a] : x[1][a]], right.order[y[0][b] : y[1][b]]
        most = np.bitwise_count(bitmaps[ka][:, None] & bitmaps[kb][None]).sum(2, dtype=np.int64)
        most = most + np.minimum(slack[ka][:, None], slack[kb][None])
        may = (100 + percent) * most >= percent * (sizes[ka][:, None] + sizes[kb][None])
        may &= 100 * np.minimum(sizes[ka][:, None], sizes[kb][None]) >= percent * np.maximum(sizes[ka][:, None], sizes[kb][None])
        for p, q in np.argwhere(may):
            u, v = int(ka[p]), int(kb[q])
            if not own or p < q:
                yield u, v


def dealt(members: DataFrame) -> DataFrame:
    """route, i, j, side, rep: the members (route, rep, n) of each unit of work, a pair of blocks of a group."""
    per_route = members.groupBy("route").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select("route", F.greatest(F.ceil(F.col("c") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    many, _ = common.stage(per_route.where("blocks > 1"), "blocks")  # large groups only: a row for BLOCK_DOCS members or more, or for BLOCK_SHINGLES
    many = F.broadcast(many) if many.count() <= 200_000 else many
    rows = members.join(many, "route", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("route", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rep")


def by_unit(joined: DataFrame, body: str, work, names: list[str], schema: str) -> DataFrame:
    """Run work(rows of (route, i, j, side, rep, body)) on each unit; units are runs of sorted rows, held one at a time."""
    ordered = joined.select("route", "i", "j", "side", "rep", body).repartition("route", "i", "j").sortWithinPartitions("route", "i", "j", "side", "rep")

    def run(batches):
        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if name in ("i", "j", "side") else pa.int64()) for k, name in enumerate(names)], names)

        unit, rows = None, []
        for batch in batches:
            out: list = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if row[:3] != unit:
                    out += work(rows) if len(rows) > 1 else []
                    unit, rows = row[:3], []
                rows.append(row)
            yield batch_of(out)
        if len(rows) > 1:
            yield batch_of(work(rows))

    return ordered.mapInArrow(run, schema)


def pairs(docs: DataFrame, members: DataFrame, made: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: linked class representatives, spanning every linked group. members: route, rep, n and made, both staged.

    First the trees are joined on bitmaps alone; sets are then made for, and sent to, only what has a possible partner.
    """

    def kept(rows):
        mark = survivors(np.array([r[5]["n"] for r in rows]), [r[5]["bitmap"] for r in rows], np.array([r[3] for r in rows]), percent)
        return [r[:5] for r, m in zip(rows, mark) if m]

    def linked(rows):
        got = links([np.frombuffer(r[5], np.uint64) for r in rows], np.array([r[3] for r in rows]), percent)
        return [(rows[u][4], rows[v][4]) for u, v in got]

    maps = made.where("n > 0").select(F.col("doc_id").alias("rep"), F.struct("n", "bitmap").alias("m"))
    chosen = by_unit(dealt(members).join(maps, "rep"), "m", kept, ["route", "i", "j", "side", "rep"], "route long, i int, j int, side int, rep long")
    chosen, _ = common.stage(chosen.distinct(), "survivors")
    needed = chosen.select(F.col("rep").alias("doc_id")).distinct()
    needed = F.broadcast(needed) if needed.count() <= 1_000_000 else needed
    bodies = whole(docs.join(needed, "doc_id", "left_semi").select("doc_id", "text"), k).select(F.col("doc_id").alias("rep"), "sig", "shingles").dropDuplicates(["rep", "sig"])
    return by_unit(chosen.join(bodies, "rep"), "shingles", linked, ["a", "b"], "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in links (a, b), by alternating star contractions.

    Each round is two aggregations and joins of the remaining edges, written to the shared folder; it ends when a round
    changes no edge.
    """
    edges, path = common.stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        made, new_path = common.stage(small, "edges")
        common.remove(links.sparkSession, path)
        edges, path = made, new_path
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        seen = now


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of a table with doc_id and text."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    made, _ = common.stage(sets(docs, k, percent, frequent(docs, k)), "sets")
    keyed = made.where("n > 0 AND doc_id IS NOT NULL")
    copies, _ = common.stage(keyed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sig", "rep"), "copies")
    copies = F.broadcast(copies) if copies.count() <= 200_000 else copies
    first = keyed.join(copies, "sig", "left").where("rep IS NULL OR rep = doc_id")
    rows = first.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"))
    by_size = Window.partitionBy("key").orderBy("n", "rep")
    near = (F.lag("n").over(by_size) * 100 >= percent * F.col("n")) | (F.lead("n").over(by_size) * percent <= 100 * F.col("n"))
    met = rows.withColumn("near", near).where("near").withColumn("route", F.min("rep").over(Window.partitionBy("key")))
    members, members_path = common.stage(met.select("route", "rep", "n").distinct(), "members")
    found = components(pairs(docs, members, made, k, percent))
    common.remove(spark, members_path)
    out = made.select("doc_id", "n", "sig").join(copies, "sig", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(found, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller doc_id in their group.

    Rows whose doc_id is null or repeated are documents of their own, told apart by new ids beyond all others (in the order
    of storage): they are compared by their texts like any other, so equal ones leave one and unrelated ones all stay.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    again, _ = common.stage(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    if again.limit(1).count():
        few = F.broadcast(again) if again.count() <= 1_000_000 else again
        same = plain["doc_id"].eqNullSafe(few["doc_id"])
        beyond = (docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0) + 1
        if beyond > 1 << 62:
            raise ValueError("repeated doc_ids need free ids beyond the largest one")
        told, _ = common.stage(plain.join(few, same, "left_semi").select((F.lit(max(beyond, 0)) + F.monotonically_increasing_id()).alias("doc_id"), "text", "row"), "told")
        plain = plain.join(few, same, "left_anti").unionByName(told)
    groups, _ = common.stage(join(plain, k, percent).where("component_id <> doc_id").select("doc_id"), "gone")
    gone = F.broadcast(groups) if groups.count() <= 1_000_000 else groups
    return plain.join(gone, "doc_id", "left_anti").select("row.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), k=4, percent=85)
