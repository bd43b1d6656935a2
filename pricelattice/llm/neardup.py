"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, ship, slices, table, text_buffer, with_fields
from .graph import components
from .words import COEF, mix, shingles, word_hashes

BANDS = 36
#: A pair at the threshold may share no bucket with this probability.
MISS = 1e-6
#: Shingles that one chunk of a candidate cluster holds, about: 8 MB.
CHUNK = 1 << 20
U = np.uint64


def band_rows(num: int, den: int) -> int:
    """The most rows a band may have."""
    return max(r for r in range(1, 17) if r == 1 or (1 - (num / den) ** r) ** BANDS <= MISS)


class Sketch:
    """One permutation cut into equal bins; an empty bin takes the value of the first full one in its own order."""

    def __init__(self, rows: int):
        self.rows, self.bins = rows, BANDS * rows
        self.edges = np.array([(k << 64) // self.bins for k in range(self.bins)], np.uint64)
        tries = mix(np.arange(self.bins * 1024, dtype=np.uint64) + U(77)).reshape(self.bins, 1024)
        self.order = (tries % U(self.bins)).astype(np.int32)

    def bands(self, u: np.ndarray) -> np.ndarray:
        """Band hashes of a sorted set of 64-bit hashes."""
        at = np.searchsorted(u, self.edges)
        full = at < np.append(at[1:], len(u))
        value = u[np.minimum(at, len(u) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            hit = full[self.order[empty]]
            first = hit.argmax(axis=1)
            source = self.order[empty, first]
            lost = ~hit[np.arange(len(empty)), first]
            source[lost] = np.flatnonzero(full)[0]
            value[empty] = value[source]
        by_band = value.reshape(BANDS, self.rows) * COEF[: self.rows]
        return mix(by_band.sum(axis=1) + mix(np.arange(BANDS, dtype=np.uint64)))


@functools.lru_cache(maxsize=4)
def sketch(rows: int) -> Sketch:
    return Sketch(rows)


def _sketches(n: int, rows: int, key: str, text: str):
    def run(batches):
        own = sketch(rows)
        for batch in batches:
            for part in slices(batch, text):
                sizes, digests, off, bands = [], [], [0], []
                for u in shingles(*word_hashes(*text_buffer(part.column(text))), n):
                    sizes.append(len(u))
                    digests.append(xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None)
                    if len(u):
                        bands.append(own.bands(u))
                    off.append(len(bands) * BANDS)
                flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "n_shingles", "digest", "bands"])

    return run


def _sets(n: int, text: str):
    """Rows (node, cluster, chunk, chunks, text) to (cluster, i, j, node, set), once for each cell of the row's chunk."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                sets = shingles(*word_hashes(*text_buffer(part.column(text))), n)
                node, cluster, chunk, chunks = (part.column(c).to_pylist() for c in ("node", "cluster", "chunk", "chunks"))
                for k, u in enumerate(sets):
                    c, m = chunk[k], chunks[k]
                    others = [x for x in range(m) if x != c] if m > 1 else [c]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([cluster[k]] * len(others), pa.int64()),
                            pa.array([min(c, x) for x in others], pa.int32()),
                            pa.array([max(c, x) for x in others], pa.int32()),
                            pa.array([node[k]] * len(others), pa.int64()),
                            pa.array([u.tobytes()] * len(others), pa.binary()),
                        ],
                        ["cluster", "i", "j", "node", "shingles"],
                    )

    return run


def link(nodes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that join the sets as all links of den * intersection >= num * union would, a forest of them.

    Linked sets share one of the rarest shingles of both: of n, all but num * n / den, and one more. One set after
    another is held against those that share such a shingle and are not joined with it yet. Sets that are in the largest
    component by then need no turn of their own: whoever is not in it takes one, and meets them there. Unlike sets cost
    their own shingles, alike ones the sets that they join.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    starts = ends - size
    _, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    by_rarity = np.lexsort((flat, often[flat], owner))
    rank = np.empty(len(flat), np.int64)
    rank[by_rarity] = np.arange(len(flat)) - starts[owner]
    rare = rank < (size - -(-num * size // den) + 1)[owner]
    key, whose = flat[rare], owner[rare]
    sort = np.argsort(key, kind="stable")
    whose = whose[sort]
    first = np.searchsorted(key[sort], np.arange(len(often) + 1))
    mark = np.zeros(len(often), bool)
    label = np.unique(np.array(nodes, np.int64), return_inverse=True)[1].astype(np.int64)
    waiting = np.ones(n, bool)
    turns = np.argsort(np.abs(size - np.median(size)), kind="stable").tolist()
    edges = []
    big, again = int(np.bincount(label).argmax()), True
    while again:
        again = False
        for c in turns:
            if not waiting[c] or label[c] == big:
                continue
            waiting[c], again = False, True
            own = slice(starts[c], ends[c])
            near = np.unique(np.concatenate([whose[first[t] : first[t + 1]] for t in flat[own][rare[own]].tolist()]))
            near = near[(label[near] != label[c]) & (den * np.minimum(size[near], size[c]) >= num * np.maximum(size[near], size[c]))]
            if not len(near):
                continue
            mark[flat[own]] = True
            both = np.add.reduceat(np.concatenate([mark[flat[starts[k] : ends[k]]] for k in near.tolist()]).astype(np.int64), np.cumsum(size[near]) - size[near])
            mark[flat[own]] = False
            hit = near[den * both >= num * (size[near] + size[c] - both)]
            for k in hit.tolist():
                if label[k] != label[c]:
                    edges.append((nodes[c], nodes[k]))
                    label[label == label[k]] = label[c]
            if len(hit):
                big = int(np.bincount(label).argmax())
    return edges


def _cells(num: int, den: int):
    """Sorted rows of _sets to edges, one cell at a time."""

    def close(cell, nodes, sets):
        yield from link(nodes, sets, num, den) if len(nodes) > 1 else ()

    def run(batches):
        now, nodes, sets, out = None, [], [], []
        for batch in batches:
            i, j, cluster = (batch.column(c).to_pylist() for c in ("i", "j", "cluster"))
            node, data = batch.column("node").to_pylist(), batch.column("shingles")
            for k in range(batch.num_rows):
                if (cell := (cluster[k], i[k], j[k])) != now:
                    out += close(now, nodes, sets)
                    now, nodes, sets = cell, [], []
                nodes.append(node[k])
                sets.append(np.frombuffer(data[k].as_py(), np.uint64))
            if len(out) >= 10_000:
                yield _edges(out)
                out = []
        yield _edges([*out, *close(now, nodes, sets)])

    return run


def _edges(rows):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row, by links of den * |A & B| >= num * |A or B|.

    Words are lower-cased (A-Z) runs without white space; a document's set is its distinct `shingle`-word shingles,
    one shingle if it has fewer words, none without words or text: then it links with nothing. component_id is the
    smallest id reachable, kept whether it is the row's own. Rows with a null id link with nothing and stay, with a
    null component; rows that repeat an id count as one document. Other columns are not read.

    Equal sets become one representative first. Representatives that share a bucket are candidates: each bucket is a
    star around its smallest member, so pairs grow with rows, not with the square of a bucket. Stars only gather
    clusters; inside a cluster every link is confirmed or refuted on full sets, in cells of two bounded chunks, and
    each cell returns a forest. No link between members of one bucket is lost; that a pair at the threshold shares
    none has a probability of at most 1e-6.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "neardup")
    rows = band_rows(num, den)
    kind = dict(docs.dtypes)[key]
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = with_fields(plain.select("id").schema, "n_shingles long, digest binary, bands array<long>")
    own = work.table(plain.mapInArrow(_sketches(shingle, rows, "id", "text"), schema), "sketches")
    # Rows of one set have the same bands.
    sets = own.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").cast("long").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    sets = work.table(sets, "sets")
    members = sets.select("node", F.posexplode("bands").alias("band", "value"))
    stars = members.groupBy("band", "value").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    stars = members.join(stars, ["band", "value"]).where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    cluster = work.table(components(stars, work).withColumnRenamed("label", "cluster"), "clusters")
    size = sets.groupBy("node").agg(F.sum("n").alias("n")).join(cluster, "node")
    chunks = size.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    cells = cluster.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    texts = plain.select(F.col("id").cast("long").alias("node"), "text").join(sets.select("node").distinct().join(cells, "node"), "node")
    cut = texts.select("node", "cluster", "chunk", "chunks", "text").mapInArrow(_sets(shingle, "text"), "cluster long, i int, j int, node long, shingles binary")
    cut = cut.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = work.table(cut.mapInArrow(_cells(num, den), "a long, b long"), "links")
    label = components(found, work)
    by_set = sets.select("digest", "node").join(label, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    out = own.select("id", "n_shingles", "digest").join(by_set, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", F.col("id").cast("long"))).cast(kind)
    out = out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without the rows of a group but its smallest id; of rows that repeat an id, all stay or go."""
    gone = near_duplicates(docs, key=key, **how).where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
d AS (SELECT list_sort(s) AS s, min(doc_id) AS doc_id FROM s GROUP BY 1),
e AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS x FROM d),
rare AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS r FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM e)),
pre AS (SELECT doc_id, x FROM rare WHERE r <= n - (85 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.x = b.x AND a.doc_id < b.doc_id),
l AS (SELECT a, b FROM c JOIN d p ON p.doc_id = a JOIN d q ON q.doc_id = b
      WHERE 100 * len(list_intersect(p.s, q.s)) >= 85 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN sym e ON e.a = r.b),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE comp.component END)::BIGINT AS component_id,
       (CASE WHEN len(s.s) = 0 THEN TRUE ELSE s.doc_id = comp.component END) AS kept
FROM s LEFT JOIN d ON d.s = list_sort(s.s) LEFT JOIN comp ON comp.a = d.doc_id
"""
