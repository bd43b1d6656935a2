"""Vectors in blocks: exact top-k over a pivot-distance index, and nearest neighbours over int8 tiles."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, ship, table
from .words import mix

#: Bytes of the vectors of a block, and of a block of queries.
BLOCK, QUERIES = 1 << 20, 1 << 18
#: Blocks that one cell holds at most, and blocks of queries that it is asked at most.
CELL_BLOCKS, CELL_QUERIES = 16, 32
#: The index is fitted on this many vectors, those of smallest seeded hash; its pivots, and bands of distance of each.
SAMPLE, PIVOTS, BANDS = 1024, 24, 16
#: Rows below which a band, or a tile, is not made smaller.
LEAST = 256
#: Queries whose best a task holds at once.
HELD = 50_000
RESULT = "query_id long, vec_id long, rid long, score {}"


def usable(rows: DataFrame, key: str, column: str, zero: bool) -> DataFrame:
    """(id, v: array of double) without nulls, non-finite components and, unless zero, zero vectors."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return out if zero else out.where(F.exists("v", lambda x: x != 0))


def numbered(rows: DataFrame, work: Work, *more) -> tuple:
    """rows written once, with a number of their own (rid); how many they are, the longest width, and these aggregates."""
    good = work.table(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "v"), "vectors")
    n, width, *rest = good.agg(F.count("*"), F.max(F.size("v")), *more).first()
    return good, n, max(1, width or 1), *rest


def asking(good: DataFrame, every: int) -> DataFrame:
    """The query rows; rows that agree in id and vector ask once."""
    return good.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "v").agg(F.min("rid").alias("rid")).select("rid", "id", "v")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    off = np.asarray(column.offsets, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    if (size == width).all():
        return flat[off[0] : off[-1]].reshape(-1, width).astype(np.float64)
    out = np.zeros((len(size), width))
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        out[k, : b - a] = flat[a:b]
    return out


def pack(v: np.ndarray, kinds: str) -> tuple[str, bytes]:
    """The rows in the narrowest of these kinds (h, f, d: int16, float32, float64) that holds them exactly."""
    for kind in kinds:
        if kind == "d":
            break
        if kind == "h" and np.abs(v).max(initial=0) >= 1 << 15:
            continue
        with np.errstate(over="ignore"):
            small = v.astype(kind)
        if (small == v).all():
            return kind, small.tobytes()
    return "d", v.astype(np.float64).tobytes()


def unpack(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(kind)).reshape(-1, width).astype(np.float64)


def smallest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to smaller ids, in order."""
    if len(score) > k:
        bound = np.partition(score, k - 1)[k - 1]
        keep = np.flatnonzero(score <= bound)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], score[keep]))[:k]]


def best(found: DataFrame, k: int, of, order) -> DataFrame:
    """Each query's k best rows; a row that several query rows of one id found counts once, at its best."""
    once = found.groupBy("query_id", "vec_id", "rid").agg(of("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id", "rid"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _gathered(batches, rows: int, width: int, key=None):
    """Rows (rid, id, v, ...) in their order to (key, rids, ids, vectors, more) of up to so many rows of one key."""
    held, now, n = [], None, 0
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(batch.num_rows, np.int32)
        more = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("rid", "id", "v", key)]
        columns = [batch.column("rid").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"), width), *more]
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
        for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
            if held and keys[a] != now:
                yield now, *map(np.concatenate, zip(*held, strict=True))
                held, n = [], 0
            now = int(keys[a])
            while a < b:
                to = min(b, a + rows - n)
                held.append([c[a:to] for c in columns])
                n, a = n + to - a, to
                if n >= rows:
                    yield now, *map(np.concatenate, zip(*held, strict=True))
                    held, n = [], 0
    if held:
        yield now, *map(np.concatenate, zip(*held, strict=True))


def _place(n: int) -> int:
    """A number for the n-th block of this task that spreads blocks over cells."""
    return int(mix(np.array([(TaskContext.get().partitionId() << 24) + n], np.uint64))[0] >> np.uint64(1))


def tasks(spark, cells: int) -> int:
    """Partitions for so many cells: as many as there are, up to two for each core or the session's setting."""
    return max(1, min(cells, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def deal(parts: list[DataFrame], cells: int, *order: str) -> DataFrame:
    """The blocks of a cell together, in this order. The number is explicit: blocks are few bytes for much work."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.repartition(tasks(rows.sparkSession, cells), "cell").sortWithinPartitions("cell", *order)


# Exact top-k by integer inner product


def _scaled(v: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * v)


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """One component more, so that all rows have squared norm `top`: nearest is then the highest inner product."""
    return np.column_stack([v, np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0.0))])


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((a - row) ** 2).sum(axis=1) for row in pivots], axis=1))


class Index:
    """Pivots over lifted vectors, and for each pivot edges that cut distance into bands; fitted on a sample."""

    def __init__(self, sample: list[np.ndarray], ids: list[int], width: int, top: float, n: int):
        self.width, self.top = width, top
        self.some = np.array([np.pad(x, (0, width - len(x))) for x in sample]).reshape(-1, width) if sample else np.zeros((1, width))
        self.ids = np.array(ids, np.int64)
        up = lifted(self.some, top)
        self.pivots = choose_pivots(up)
        pivot, dist = self.nearest(up)
        bands = lambda d: max(1, min(BANDS, 1 + len(d) // 4, int(len(d) / len(up) * n / LEAST)))
        quantile = lambda d: np.unique(np.quantile(d, np.linspace(0, 1, bands(d) + 1)[1:-1])) if len(d) else np.zeros(0)
        self.edges = [quantile(dist[pivot == p]) for p in range(len(self.pivots))]
        #: What the rounding of distances can be off by, the added component's included.
        self.slack = 1e-6 + 1e-7 * np.sqrt(top)

    def nearest(self, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(up, self.pivots)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def reach(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How far from the lifted q a vector may be and still score floor; negative: no distance will do."""
        norm = (q**2).sum(axis=1)
        room = norm + self.top - 2.0 * floor.astype(np.float64)
        room += 1e-13 * (norm + self.top)
        return np.where(room >= 0, np.sqrt(np.maximum(room, 0)) * (1 + 1e-9) + self.slack, -1.0)


def _assign(index: Index, scale: float):
    def run(batches):
        for batch in batches:
            pivot, dist = index.nearest(lifted(_scaled(matrix(batch.column("v"), index.width), scale), index.top))
            band = np.zeros(len(pivot), np.int32)
            for p in np.unique(pivot).tolist():
                band[pivot == p] = np.searchsorted(index.edges[p], dist[pivot == p], "right")
            yield _block({"rid": batch.column("rid"), "id": batch.column("id"), "v": batch.column("v"), "annulus": pa.array((pivot * BANDS + band).astype(np.int32)), "dist": pa.array(dist)})

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in double while every sum is below 2**53, in 64-bit integers beyond."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _better(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The stronger of two floors (scores, ids): the higher score, of equal ones the smaller id."""
    first = (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] <= b[1]))
    return np.where(first, a[0], b[0]), np.where(first, a[1], b[1])


def floors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the score and id of its k-th best among x, its own id left out; the least floor where x has fewer."""
    score, at = np.full(len(q_ids), np.iinfo(np.int64).min), np.full(len(q_ids), np.iinfo(np.int64).max)
    for start in range(0, len(q_ids), 512):
        p = products(q[start : start + 512], x)
        for r, row in enumerate(p):
            others = np.flatnonzero(ids != q_ids[start + r])
            if len(others) >= k:
                last = others[smallest(-row[others], ids[others], k)[-1]]
                score[start + r], at[start + r] = row[last], ids[last]
    return score, at


BLOCKS = "annulus int, place long, near double, far double, kind string, rids binary, ids binary, v binary, dist binary, q_ids binary, q_v binary, floor binary, floor_id binary"
CELL = "cell long, part int, place long, near double, far double, kind string, rids binary, ids binary, v binary, dist binary, floor binary, floor_id binary"


def _annuli(index: Index, scale: float, every: int, k: int):
    """Rows sorted by (annulus, dist) to blocks of one annulus, and in each the queries with a floor: the k-th best that
    they reach in the block or in the sample."""
    size = max(1, BLOCK // (2 * index.width))

    def run(batches):
        for n, (annulus, rids, ids, raw, dist) in enumerate(_gathered(batches, size, index.width, "annulus")):
            v = _scaled(raw, scale)
            asked = np.flatnonzero(ids % every == 0)
            if len(asked):  # equal rows of one id ask once
                asked = asked[np.unique(np.column_stack([ids[asked], v[asked]]), axis=0, return_index=True)[1]]
            floor, floor_id = _better(floors(ids[asked], v[asked], ids, v, k), floors(ids[asked], v[asked], index.ids, index.some, k) if len(index.ids) else floors(ids[asked], v[asked], ids, v, k))
            kind, data = pack(v, "hfd")
            columns = {"rids": rids.tobytes(), "ids": ids.tobytes(), "v": data, "dist": dist.tobytes(), "q_ids": ids[asked].tobytes(), "q_v": pack(v[asked], kind)[1], "floor": floor.tobytes(), "floor_id": floor_id.tobytes()}
            head = {"annulus": pa.array([annulus], pa.int32()), "place": pa.array([_place(n)]), "near": pa.array([float(dist.min())]), "far": pa.array([float(dist.max())]), "kind": pa.array([kind])}
            yield _block(head | {c: pa.array([b], pa.binary()) for c, b in columns.items()})

    return run


def _ask(index: Index, cells: dict[int, tuple[int, float, float]]):
    """Blocks to their queries, gathered; to each annulus go those queries whose bound reaches it, once for each of its cells."""
    step = max(1, QUERIES // (2 * index.width))

    def ask(parts, part):
        ids, q, floor, floor_id = (np.concatenate(x) for x in zip(*parts, strict=True))
        d = distances(np.column_stack([q, np.zeros(len(q))]), index.pivots)
        reach = index.reach(q, floor)
        for annulus, (salts, near, far) in cells.items():
            own = d[:, annulus // BANDS]
            there = np.flatnonzero((reach >= 0) & (own + reach >= near) & (own - reach <= far))
            if len(there):
                kind, data = pack(q[there], "hfd")
                columns = {"ids": ids[there].tobytes(), "v": data, "dist": own[there].tobytes(), "floor": floor[there].tobytes(), "floor_id": floor_id[there].tobytes()}
                for salt in range(salts):
                    head = {"cell": pa.array([(annulus << 32) + salt]), "part": pa.array([1], pa.int32()), "place": pa.array([part]), "near": pa.array([0.0]), "far": pa.array([0.0]), "kind": pa.array([kind]), "rids": pa.nulls(1, pa.binary())}
                    yield _block(head | {c: pa.array([b], pa.binary()) for c, b in columns.items()})

    def run(batches):
        parts, n, part = [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = np.frombuffer(row["q_ids"], np.int64), unpack(row["kind"], row["q_v"], index.width)
                floor, floor_id = np.frombuffer(row["floor"], np.int64), np.frombuffer(row["floor_id"], np.int64)
                for at in range(0, len(ids), step):
                    parts.append(tuple(x[at : at + step] for x in (ids, q, floor, floor_id)))
                    n += len(parts[-1][0])
                    if n >= step:
                        yield from ask(parts, part)
                        parts, n, part = [], 0, part + 1
        if parts:
            yield from ask(parts, part)

    return run


def _search(index: Index, k: int, visited):
    """Sorted rows of a cell, its blocks first, then blocks of queries. From the queries' own distance outward each
    block of an annulus is visited by those queries whose bound still reaches it; what they find raises their floor."""

    def answer(blocks, row, held):
        ids, q = np.frombuffer(row["ids"], np.int64), unpack(row["kind"], row["v"], index.width)
        qd, floor, floor_id = np.frombuffer(row["dist"]), np.frombuffer(row["floor"], np.int64).copy(), np.frombuffer(row["floor_id"], np.int64).copy()
        keys = [(own, v.tobytes()) for own, v in zip(ids.tolist(), q, strict=True)]
        for m, key in enumerate(keys):  # what this task has found for the query raises its floor
            if key in held and len(held[key][0]) == k:
                x, s, _ = held[key]
                if s[-1] > floor[m] or (s[-1] == floor[m] and x[-1] < floor_id[m]):
                    floor[m], floor_id[m] = s[-1], x[-1]
        middle, seen = np.median(qd), 0
        for block in sorted(blocks, key=lambda b: max(b["near"] - middle, middle - b["far"], 0.0)):
            reach = index.reach(q, floor)
            a, b = np.searchsorted(block["dist"], qd - reach, "left"), np.searchsorted(block["dist"], qd + reach, "right")
            live = np.flatnonzero((reach >= 0) & (a < b))
            if not len(live):
                continue
            live = live[np.argsort(a[live], kind="stable")]
            for at in range(0, len(live), 128):  # queries of like range together
                some = live[at : at + 128]
                lo, hi = int(a[some].min()), int(b[some].max())
                seen += len(some) * (hi - lo)
                own = block["ids"][lo:hi]
                p = products(q[some], block["v"][lo:hi])
                hit = ((p > floor[some, None]) | ((p == floor[some, None]) & (own[None, :] <= floor_id[some, None]))) & (own[None, :] != ids[some, None])
                for t in np.flatnonzero(hit.any(axis=1)).tolist():
                    m, near = int(some[t]), np.flatnonzero(hit[t])
                    x, s, r = own[near], p[t][near], block["rids"][lo:hi][near]
                    if keys[m] in held:
                        x, s, r = (np.concatenate(c) for c in zip(held[keys[m]], (x, s, r), strict=True))
                    top = smallest(-s, x, k)
                    held[keys[m]] = x[top], s[top], r[top]
                    if len(top) == k and (s[top[-1]] > floor[m] or (s[top[-1]] == floor[m] and x[top[-1]] < floor_id[m])):
                        floor[m], floor_id[m] = s[top[-1]], x[top[-1]]
        if visited is not None:
            visited.add(seen)

    def flush(held):
        columns = [np.concatenate([np.full(len(h[0]), key[0]) for key, h in held.items()]), *(np.concatenate([h[c] for h in held.values()]) for c in (0, 2, 1))]
        return _block(dict(zip(("query_id", "vec_id", "rid", "score"), map(pa.array, columns), strict=True)))

    def run(batches):
        now, blocks, held = None, [], {}  # only a query's k best of all its cells leave the task
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["cell"] != now:
                    now, blocks = row["cell"], []
                if row["part"] == 0:
                    blocks.append({"near": row["near"], "far": row["far"], "rids": np.frombuffer(row["rids"], np.int64), "ids": np.frombuffer(row["ids"], np.int64), "v": unpack(row["kind"], row["v"], index.width), "dist": np.frombuffer(row["dist"])})
                else:
                    answer(blocks, row, held)
                    if len(held) >= HELD:
                        yield flush(held)
                        held = {}
        if held:
            yield flush(held)

    return run


def top_products(rows: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, key: str = "vec_id", column: str = "embedding", visited=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k highest scores.

    The key is an integer. Components become floor(scale * x); the score is the integer inner product, ties go to the
    smaller id, and rows of a query's own id are no candidates. Null vectors, vectors with null or non-finite components
    and rows without an id take no part; shorter vectors end in zeros; an empty table gives an empty result; other
    columns are not read. Rows that repeat an id: each is a candidate of its own, and as queries they are one, whose
    score with a candidate is the best that any of them has.

    A component more makes all norms equal, so that the highest product is the nearest vector. Vectors are keyed by
    nearest pivot and distance to it, in bands, and sorted into annuli of bounded bytes. A query takes a floor, a score
    and an id, from its own annulus and the index's sample. By the triangle inequality only annuli with
    |d(q, p) - d(x, p)| within the floor's reach can better it: it goes to the cells of these and visits their blocks
    outward, its floor rising. A cell holds CELL_BLOCKS blocks at most, so a hot annulus is many cells. visited, a
    Spark accumulator, counts the pairs (query, vector) that were multiplied.
    """
    spark = rows.sparkSession
    ship(spark)
    work = Work(spark, "topk")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * F.lit(float(scale))) + 1, F.lit(2.0)))  # no less than the floors' squares
    good, n, width, top = numbered(usable(rows, key, column, True), work, F.max(squares))
    top = (top or 0.0) * (1 + 1e-12)
    sample = good.orderBy(F.xxhash64("id", "rid", F.lit(5)), "rid").limit(SAMPLE).collect()
    index = Index([_scaled(np.array(r.v, float), scale) for r in sample], [r.id for r in sample], width, top, n)
    keyed = good.mapInArrow(_assign(index, scale), "rid long, id long, v array<double>, annulus int, dist double")
    keyed = keyed.repartitionByRange("annulus", "dist", "rid").sortWithinPartitions("annulus", "dist", "rid")
    blocks = work.table(keyed.mapInArrow(_annuli(index, scale, every, k), BLOCKS), "annuli")
    # One row for each annulus: at most PIVOTS * BANDS.
    cells = {r.annulus: (-(-r.n // CELL_BLOCKS), r.near, r.far) for r in blocks.groupBy("annulus").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()}
    salts = F.element_at(F.create_map(*[F.lit(x) for a, c in cells.items() for x in (a, c[0])]), F.col("annulus")) if cells else F.lit(1)
    cell = F.shiftleft(F.col("annulus").cast("long"), 32) + F.pmod("place", salts.cast("long"))
    none = F.lit(None).cast("binary")
    held = blocks.select(cell.alias("cell"), F.lit(0).alias("part"), "place", "near", "far", "kind", "rids", "ids", "v", "dist", none.alias("floor"), none.alias("floor_id"))
    asked = blocks.where(F.length("q_ids") > 0).select("kind", "q_ids", "q_v", "floor", "floor_id").mapInArrow(_ask(index, cells), CELL)
    dealt = deal([held, asked], sum(c[0] for c in cells.values()), "part", "place")
    return best(dealt.mapInArrow(_search(index, k, visited), RESULT.format("long")), k, F.max, F.col("score").desc())


# Nearest neighbours by int8 tiles


TILE = "cell long, part int, place long, kind string, rids binary, ids binary, v binary"


def _tiles(size: int, width: int, part: int, row_cells: int, query_cells: int):
    """Rows to tiles of up to `size` rows. A tile of vectors goes to one row of cells, a tile of queries to one column."""

    def run(batches):
        for n, (_, rids, ids, v) in enumerate(_gathered(batches, size, width)):
            place = _place(n)
            cells = [place % row_cells * query_cells + c for c in range(query_cells)] if part else [r * query_cells + place % query_cells for r in range(row_cells)]
            kind, data = pack(v, "fd")
            m = len(cells)
            head = {"cell": pa.array(cells, pa.int64()), "part": pa.array([part] * m, pa.int32()), "place": pa.array([place] * m), "kind": pa.array([kind] * m)}
            yield _block(head | {c: pa.array([b] * m, pa.binary()) for c, b in (("rids", rids.tobytes()), ("ids", ids.tobytes()), ("v", data))})

    return run


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the step of each row, and how far each row is from what its codes stand for."""
    top = np.abs(v).max(axis=1)
    step = np.where(top > 0, top / 127.0, 1.0)
    c = np.rint(v / step[:, None]).astype(np.int8)
    return c, step, np.sqrt(((v - c * step[:, None]) ** 2).sum(axis=1))


def euclid(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of q to the rows of x, summed component by component in double."""
    total = np.zeros(len(x))
    for k in range(len(q)):
        d = x[:, k] - q[k]
        total += d * d
    return np.sqrt(total)


class Heap:
    """The k nearest rows (distance, id, rid) of one query id; a row that comes again stays once, at its nearest."""

    __slots__ = ("items", "at")

    def __init__(self):
        self.items, self.at = [], {}

    def bound(self, k: int) -> float:
        return -self.items[0][0] if len(self.items) == k else np.inf

    def offer(self, d: float, vec: int, rid: int, k: int) -> bool:
        """Whether later offers, which are not nearer, can still find a place."""
        item = (-d, -vec, -rid)
        known = self.at.get(rid)
        if known is not None:
            if d < known:
                self.items.remove((-known, -vec, -rid))
                self.items.append(item)
                heapq.heapify(self.items)
                self.at[rid] = d
            return True
        if len(self.items) < k:
            heapq.heappush(self.items, item)
        elif item > self.items[0]:
            del self.at[-heapq.heapreplace(self.items, item)[2]]
        else:
            return False
        self.at[rid] = d
        return True


def _nearest(k: int, width: int):
    """Sorted rows of a cell, its queries first, then tiles of vectors: the int8 product gives each distance up to an
    error; who may be among the k is recomputed. Heaps hold each query's k nearest."""

    def flush(heaps):
        rows = [(q, -x, -r, -d) for q, h in heaps.items() for d, x, r in h.items]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return _block({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "rid", "score"), columns, kinds, strict=True)})

    def meet(query, tile, heaps):
        qi, q, qc, qs, qo, qn = query
        rids, ids, x, xc, xs, xo, xn = tile
        near = (qc @ xc.T).astype(np.float64) * (-2.0 * qs[:, None] * xs[None, :])
        near += qn[:, None]
        near += xn[None, :]
        np.sqrt(np.maximum(near, 0.0, out=near), out=near)
        off = (qo[:, None] + xo[None, :]) * (1 + 1e-9) + 1e-6 * (np.sqrt(qn)[:, None] + np.sqrt(xn)[None, :])
        same = qi[:, None] == ids[None, :]
        high = near + off
        high[same] = np.inf
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(qi), np.inf)
        known = [heaps.setdefault(own, Heap()) for own in qi.tolist()]
        bound = np.minimum(bound, [h.bound(k) for h in known])
        low = near - off
        low[same] = np.inf
        rows, cols = np.nonzero(low <= bound[:, None])
        rows, cols = rows[np.isfinite(low[rows, cols])], cols[np.isfinite(low[rows, cols])]
        cut = np.searchsorted(rows, np.arange(len(qi) + 1))
        for t in range(len(qi)):
            left = cols[cut[t] : cut[t + 1]]
            if len(left):
                d = euclid(q[t], x[left])
                for m in smallest(d, ids[left], k).tolist():
                    if not known[t].offer(float(d[m]), int(ids[left[m]]), int(rids[left[m]]), k):
                        break

    def read(row):
        ids, v = np.frombuffer(row["ids"], np.int64), unpack(row["kind"], row["v"], width)
        c, step, off = codes(v)
        exact = np.float32 if width * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are whole numbers
        return np.frombuffer(row["rids"], np.int64), ids, v, c.astype(exact), step, off, ((c * step[:, None]) ** 2).sum(axis=1)

    def run(batches):
        now, queries, heaps = None, [], {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["cell"] != now:
                    if heaps:
                        yield flush(heaps)
                    now, queries, heaps = row["cell"], [], {}
                tile = read(row)
                if row["part"] == 0:
                    queries.append(tile[1:])
                else:
                    for query in queries:
                        meet(query, tile, heaps)
        if heaps:
            yield flush(heaps)

    return run


def nearest(rows: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k nearest by Euclid.

    The key is an integer. Null and zero vectors, vectors with null or non-finite components and rows without an id take
    no part; shorter vectors end in zeros; ties go to the smaller id; rows of a query's own id are no candidates; an
    empty table gives an empty result; other columns are not read. Rows that repeat an id: each is a candidate of its
    own, and as queries they are one, whose distance to a candidate is the least that any of them has. The error bounds
    of the int8 tiles are proven, so the result is exact: recall is 1.

    Tiles of vectors and tiles of queries meet in a grid of cells whose rows and columns grow with the data: a cell
    takes CELL_BLOCKS tiles of vectors, fewer where there are idle cores, and CELL_QUERIES of queries. Tiles travel as
    the vectors themselves, in single precision where that is exact; their codes are made where they meet, so that near
    copies, which no int8 bound can part, are settled in place and only a query's k best leave a cell. Nothing is
    broadcast.
    """
    spark = rows.sparkSession
    ship(spark)
    work = Work(spark, "nearest")
    good, n, width, queries = numbered(usable(rows, key, column, False), work, F.count_if(F.pmod("id", F.lit(every)) == 0))
    asked = asking(good, every)
    cores = spark.sparkContext.defaultParallelism
    size = max(1, min(BLOCK // (4 * width), max(LEAST, -(-n // (2 * cores)))))
    q_size = max(1, QUERIES // (4 * width))
    tiles = -(-n // size)
    row_cells, query_cells = max(1, min(tiles, 2 * cores), -(-tiles // CELL_BLOCKS)), max(1, -(-queries // (q_size * CELL_QUERIES)))
    held = good.mapInArrow(_tiles(size, width, 1, row_cells, query_cells), TILE)
    tiled = asked.mapInArrow(_tiles(q_size, width, 0, row_cells, query_cells), TILE)
    dealt = deal([tiled, held], row_cells * query_cells, "part", "place")
    return best(dealt.mapInArrow(_nearest(k, width), RESULT.format("double")), k, F.min, F.col("score"))


def query_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def query_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


_GOOD = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
SQL_TOPK = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE {_GOOD}),
s AS (SELECT q.vec_id AS query_id, x.vec_id, x.rid, max(list_dot_product(q.v, x.v)::BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
SQL_NEAREST = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_GOOD} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, x.vec_id, x.rid, min(list_distance(q.v, x.v)) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2, 3)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
