"""Exact removal of repeated byte strings by suffix arrays of shards that content deals out.

Every string of LENGTH bytes has an anchor: the least hash of the GRAM-byte strings in it, leftmost. Equal strings
have equal anchors at the same place, so those whose anchor repeats, and only those, can repeat. The strings that
share an anchor occurrence are consecutive and make one context. Contexts are dealt into shards by anchor; in each
shard a suffix array and common prefixes find the equal strings. An anchor with very many contexts is several shards,
and what is first in each is merged across them by binary search. Work and shuffles grow with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, hot_join, ship, slices, table, text_buffer
from .words import TABLE, powers

LENGTH, GRAM = 100, 20
WINDOW = LENGTH - GRAM + 1
#: Documents are cut, with overlap, into parts of this many bytes; a place in a part fits in PLACE bits.
PART, PLACE = 1 << 22, 24
#: Bytes of contexts in one suffix array; contexts of an anchor beyond which it is several shards.
SHARD, HOT = 1 << 20, 4096
#: Filters that spare a join rows without a partner have this many bits a key, up to 2**FILTER_BITS bits: 2 MB.
KEY_BITS, FILTER_BITS = 16, 24
U = np.uint64


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings at every place."""
    n = len(data) - GRAM + 1
    up, down = powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(TABLE[data] * up[: len(data)], out=prefix[1:])
    x = (prefix[GRAM:] - prefix[:n]) * down[:n]
    x ^= x >> U(32)
    x *= U(0x9FB21C651E98DF25)
    x ^= x >> U(28)
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of each anchor of a part: first and last start of the strings that it is the anchor of."""
    g = grams(data)
    low = U((1 << PLACE) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    n = len(g) - WINDOW + 1
    padded = np.full(-(-len(g) // WINDOW) * WINDOW, ~U(0))
    padded[: len(g)] = key
    blocks = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return g[place[new]], new, np.append(new[1:], n) - 1


def parts(data: np.ndarray):
    """(start, part) of a document, overlapping so that each string of LENGTH bytes is in exactly one."""
    step = PART - LENGTH + 1
    for at in range(0, max(1, len(data) - LENGTH + 1), step):
        yield at, data[at : at + PART]


def _anchors(full: bool):
    """Documents to anchor hashes, or in full to occurrences (hash, doc, tie, first, last, digest of the context)."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                data, off = text_buffer(some.column("text"))
                docs, ties = (some.column(c).to_pylist() for c in ("doc", "tie"))
                got = [[] for _ in range(6)]
                for k, (doc, tie) in enumerate(zip(docs, ties, strict=True)):
                    own = data[off[k] : off[k + 1]]
                    if len(own) < LENGTH:
                        continue
                    for at, part in parts(own):
                        h, a, b = anchors(part)
                        got[0].append(h)
                        if full:
                            raw = part.tobytes()
                            got[1].append(np.full(len(h), doc, np.int64))
                            got[2].append(np.full(len(h), tie, np.int64))
                            got[3].append(a + at)
                            got[4].append(b + at)
                            got[5].append(np.fromiter((xxhash.xxh3_64_intdigest(raw[x : y + LENGTH]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a)))
                if got[0]:
                    columns = [pa.array(np.concatenate(c).view(np.int64)) for c in got[: 6 if full else 1]]
                    yield pa.RecordBatch.from_arrays(columns, ["hash", "doc", "tie", "first", "last", "digest"][: len(columns)])

    return run


# Suffix arrays


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order: first by 8 bytes, then groups that are still equal by the rank h places on, h doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << U(8)) | padded[k : n + k]
    # The end of the text sorts before a byte 0: among equal heads, what reaches the end comes by its length.
    order = np.argsort(head, kind="stable")
    near_end = np.minimum(n - order, 8)
    change = np.ones(n, bool)
    change[1:] = (head[order][1:] != head[order][:-1]) | ((near_end[1:] < 8) | (near_end[:-1] < 8))
    tail = np.flatnonzero(near_end < 8)
    if len(tail):
        order = order[np.lexsort((near_end, head[order]))]
        near_end = np.minimum(n - order, 8)
        change[1:] = (head[order][1:] != head[order][:-1]) | (near_end[1:] != near_end[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    starts = np.flatnonzero(change)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
    h = 8
    while True:
        size = np.diff(np.append(starts, n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            return order
        own = order[open_]
        key = (rank[own] << 32) | rank[np.minimum(own + h, n)]
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[open_] = own
        change[open_[1:]] |= (key[1:] != key[:-1]) & (open_[1:] == open_[:-1] + 1)
        starts = np.flatnonzero(change)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order, the bytes its suffix shares with the one before.

    In text order a suffix shares at least one byte less than the suffix before it in the text (Kasai). Where the bytes
    before both agree it is exactly one less; only the other places are compared, 8 bytes at a step.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << U(8)) | padded[k : n + k]
    place = np.arange(n)
    tied = (place > 0) & (before > 0)
    tied[tied] = text[place[tied] - 1] == text[before[tied] - 1]
    # A place is reduced only if the suffix before it, in the text, is followed by just this pair.
    tied[1:] &= before[1:] - 1 == before[:-1]
    tied[0] = False
    size = np.zeros(n, np.int64)
    live = np.flatnonzero(~tied & (before >= 0))
    while len(live):
        a, b = live + size[live], before[live] + size[live]
        inside = (a + 8 <= n) & (b + 8 <= n)
        same = inside.copy()
        same[inside] = word[a[inside]] == word[b[inside]]
        rest = live[~same]
        for _ in range(8):
            x, y = rest + size[rest], before[rest] + size[rest]
            ok = (x < n) & (y < n)
            ok[ok] = text[x[ok]] == text[y[ok]]
            rest = rest[ok]
            size[rest] += 1
            if not len(rest):
                break
        live = live[same]
        size[live] += 8
    source = np.maximum.accumulate(np.where(tied, 0, place))
    size = np.where(tied, np.maximum(size[source] - (place - source), 0), size)
    return size[order]


def repeats(contexts: list[bytes], docs: np.ndarray, ties: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, is_first, alone) of every string of LENGTH bytes in the contexts: alone if no other equals it,
    is_first if it stands first, by (doc, tie, place), of those that are equal."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    start = np.cumsum(size) - size
    order = suffix_array(text)
    group = np.cumsum(common_prefixes(text, order) < LENGTH)
    context = np.repeat(np.arange(len(size)), size)[order]
    offset = order - start[context]
    whole = offset + LENGTH <= size[context]
    context, offset, group = context[whole], offset[whole], group[whole]
    sort = np.lexsort((first[context] + offset, ties[context], docs[context], group))
    context, offset, group = context[sort], offset[sort], group[sort]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(group) else np.zeros(0, int)
    return context, offset, new, count == 1


def ranges(context: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive offsets: (context, from, to)."""
    sort = np.lexsort((offset, context))
    context, offset = context[sort], offset[sort]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(new)
    return context[at], offset[at], offset[np.append(at[1:], len(offset)) - 1] if len(at) else offset[:0]


SHARDED = "doc long, tie long, a long, b long, hash long, bucket int, prints binary, docs binary, ties binary, starts binary"


def _shards():
    """Sorted contexts (hash, salt, salts, doc, tie, first, context) to ranges that go and, of split anchors, sorted runs of what is first."""

    def close(rows):
        rows = list({(r[0], *r[3:6]): r for r in rows}.values())  # rows of one id and text are one document
        contexts = [r[6] for r in rows]
        docs, ties, first = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        c, o, new, alone = repeats(contexts, docs, ties, first)
        gone = ~new
        gc, a, b = ranges(c[gone], o[gone])
        n = len(gc)
        nothing = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(docs[gc]), pa.array(ties[gc]), pa.array(first[gc] + a), pa.array(first[gc] + b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), nothing, nothing, nothing, nothing], SHARD_NAMES)
        if rows[0][2] > 1:  # one anchor, split
            salts = rows[0][2]
            kc, ko = c[new], o[new]
            prints = np.fromiter((xxhash.xxh3_64_intdigest(contexts[x][y : y + LENGTH]) for x, y in zip(kc.tolist(), ko.tolist(), strict=True)), np.uint64, len(kc))
            sort = np.argsort(prints)
            prints, d, t, s = prints[sort], docs[kc][sort], ties[kc][sort], (first[kc] + ko)[sort]
            cut = np.searchsorted(prints, np.array([(k << 64) // salts for k in range(salts)], np.uint64))
            for k, (x, y) in enumerate(zip(cut.tolist(), [*cut.tolist()[1:], len(prints)], strict=True)):
                if y > x:
                    one = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([one, one, one, one, pa.array([rows[0][0]]), pa.array([k], pa.int32()), *[pa.array([z[x:y].tobytes()], pa.binary()) for z in (prints, d, t, s)]], SHARD_NAMES)

    def run(batches):
        rows, size, key = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hash", "salt", "salts", "doc", "tie", "first", "context")]
            for row in zip(*columns, strict=True):
                if rows and row[:2] != key and (size >= SHARD or row[2] > 1 or rows[0][2] > 1):
                    yield from close(rows)
                    rows, size = [], 0
                key = row[:2]
                rows.append(row)
                size += len(row[6])
        if rows:
            yield from close(rows)

    return run


SHARD_NAMES = ["doc", "tie", "a", "b", "hash", "bucket", "prints", "docs", "ties", "starts"]


def merge(runs):
    """Sorted runs (prints, docs, ties, starts), one of each shard, to the (docs, ties, starts) that are not first among
    equal prints. Each run is looked up in what is merged so far by binary search."""
    prints, best = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
    gone = []
    for p, *place in runs:
        place = np.column_stack(place)
        at = np.searchsorted(prints, p)
        known = at < len(prints)
        known[known] = prints[at[known]] == p[known]
        k, i = np.flatnonzero(known), at[known]
        new, old = place[k], best[i]
        earlier = (new[:, 0] < old[:, 0]) | ((new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | ((new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2]))))
        gone.append(np.where(earlier[:, None], old, new))
        best[i] = np.where(earlier[:, None], new, old)
        fresh = ~known
        prints, best = np.insert(prints, at[fresh], p[fresh]), np.insert(best, at[fresh], place[fresh], axis=0)
    return np.concatenate(gone).T


def _merged():
    """Sorted rows of runs to ranges that go, one (hash, bucket) at a time."""

    def close(runs):
        if len(runs) > 1:
            docs, ties, starts = merge(runs)
            own, at = np.unique(np.column_stack([docs, ties]), axis=0, return_inverse=True)
            c, a, b = ranges(at.ravel(), starts)
            yield pa.RecordBatch.from_arrays([pa.array(own[c, 0]), pa.array(own[c, 1]), pa.array(a), pa.array(b)], ["doc", "tie", "a", "b"])

    def run(batches):
        key, runs = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["hash"], r["bucket"]) != key:
                    yield from close(runs)
                    key, runs = (r["hash"], r["bucket"]), []
                runs.append((np.frombuffer(r["prints"], np.uint64), *(np.frombuffer(r[c], np.int64) for c in ("docs", "ties", "starts"))))
        yield from close(runs)

    return run


# Documents


def _contexts():
    """Rows (doc, tie, text, list of (first, last, hash, salt, salts)) to the contexts themselves."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                data, off = text_buffer(some.column("text"))
                out = []
                for k, (doc, tie, wanted) in enumerate(zip(*(some.column(c).to_pylist() for c in ("doc", "tie", "wanted")), strict=True)):
                    raw = data[off[k] : off[k + 1]].tobytes()
                    out += [(w["hash"], w["salt"], w["salts"], doc, tie, w["first"], raw[w["first"] : w["last"] + LENGTH]) for w in wanted]
                columns = list(zip(*out, strict=True)) if out else [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "salt", "salts", "doc", "tie", "first", "context"])

    return run


def cover(size: int, gone: list[dict]) -> np.ndarray:
    """Which bytes stay."""
    edge = np.zeros(size + 1, np.int64)
    for g in gone:
        if g["a"] < size:
            edge[g["a"]] += 1
            edge[min(size, g["b"] + LENGTH)] -= 1
    return np.cumsum(edge[:-1]) == 0


def _cut():
    """Rows (doc, tie, text, gone) to what is left of each document."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                data, off = text_buffer(some.column("text"))
                removed, spans, kept, sha = [], [], [], []
                for k, gone in enumerate(some.column("gone").to_pylist()):
                    own = data[off[k] : off[k + 1]]
                    stays = cover(len(own), gone)
                    edge = np.diff(np.concatenate([[True], stays]).astype(np.int8))
                    removed.append(int((~stays).sum()))
                    spans.append(int((edge == -1).sum()))
                    raw = own[stays].tobytes()
                    kept.append(raw)
                    sha.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column("doc"), some.column("tie"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], ["doc", "tie", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows that may have a partner in wanted (column key), by a broadcast filter of bounded size; all rows where so
    many are wanted that it would let most of them pass."""
    n = wanted.count()
    bits = max(16, min(FILTER_BITS, (KEY_BITS * n).bit_length()))
    if n > 1 << bits:
        return rows
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = wanted.select(bit(key).alias("_h")).groupBy(F.shiftright("_h", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("_bits"))
    rows = rows.withColumn("_h", bit(key))
    hit = F.expr("(_bits & shiftleft(1L, cast(_h & 63 as int))) <> 0")
    return rows.join(F.broadcast(words), F.shiftright("_h", 6) == F.col("_w")).where(hit).drop("_h", "_w", "_bits")


def removed_ranges(docs: DataFrame, work: Work) -> DataFrame:
    """(doc, tie, a, b): the strings of LENGTH bytes that start at a..b in a document also start earlier."""
    first = docs.mapInArrow(_anchors(False), "hash long")
    repeated = work.table(first.groupBy("hash").count().where("count > 1").select("hash"), "repeated")
    rows = docs.mapInArrow(_anchors(True), "hash long, doc long, tie long, first long, last long, digest long")
    # What the filter lets pass by mistake stands alone later and costs no more than its row.
    seen = work.table(only(rows, "hash", repeated), "seen")
    # A digest is of the whole context, so it stands for the anchor too.
    place = F.struct("doc", "tie", "first", "last", "hash")
    kinds = work.table(seen.groupBy("digest").agg(F.min(place).alias("f"), F.count("*").alias("n")).select("digest", "n", "f.*"), "contexts")
    # Every occurrence of a context but the first goes whole.
    often = kinds.where("n > 1").select("digest", "n", F.col("doc").alias("doc0"), F.col("tie").alias("tie0"), F.col("first").alias("first0"))
    later = hot_join(seen.select("digest", "doc", "tie", "first", "last"), often, "digest", seen.count())
    later = later.where("doc <> doc0 or tie <> tie0 or first <> first0").select("doc", "tie", F.col("first").alias("a"), F.col("last").alias("b"))
    # Contexts that share an anchor may share strings.
    several = kinds.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    want = hot_join(kinds.drop("n"), several.withColumn("salts", F.ceil(F.col("n") / HOT).cast("int")), "hash", kinds.count()).withColumn("salt", F.pmod("digest", "salts").cast("int"))
    want = work.table(want.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last", "hash", "salt", "salts")).alias("wanted")), "wanted")
    texts = only(docs, "doc", want).join(want, ["doc", "tie"]).select("doc", "tie", "text", "wanted")
    dealt = texts.mapInArrow(_contexts(), "hash long, salt int, salts int, doc long, tie long, first long, context binary")
    dealt = dealt.repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    sharded = work.table(dealt.mapInArrow(_shards(), SHARDED), "shards")
    runs = sharded.where("hash is not null").select("hash", "bucket", "prints", "docs", "ties", "starts").repartition("hash", "bucket").sortWithinPartitions("hash", "bucket")
    across = runs.mapInArrow(_merged(), "doc long, tie long, a long, b long")
    return later.unionByName(sharded.where("doc is not null").select("doc", "tie", "a", "b")).unionByName(across)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept is null where nothing is removed.

    Removed is each byte covered by a LENGTH-byte string that also starts earlier: in a smaller id, or before in the
    same document; strings are judged on the input and never cross documents. Null and empty texts have no bytes. The
    key is an integer; rows with a null key take no part. Rows that repeat an id: those of one text are one document,
    those of other texts are documents of their own, in the order of a hash of the text. Other columns are not read.
    What one document's places need, lists as long as its text, is held with that text in one row.
    """
    ship(docs.sparkSession)
    work = Work(docs.sparkSession, "substrings")
    tie = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    plain = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", tie(F.col("text")))
    long_ = plain.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH))
    gone = removed_ranges(long_, work).groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    gone = work.table(gone, "gone")
    touched = only(long_, "doc", gone).join(gone, ["doc", "tie"]).select("doc", "tie", "text", "gone")
    cut = work.table(touched.mapInArrow(_cut(), "doc long, tie long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "cut").dropDuplicates(["doc", "tie"])
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    whole = docs.select(F.col(key), F.col(key).cast("long").alias("doc"), tie(F.col(text)).alias("tie"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), sha.alias("sha"))
    out = whole.join(cut, ["doc", "tie"], "left")
    zero = F.lit(0).cast("long")
    return out.select(key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")
