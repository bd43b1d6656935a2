"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, giving_back, ship, slices, table, text_buffer, with_fields
from .words import SPACE, U, mix, prefix_hash, range_hash, spans, word_hashes

#: Words that have a vector of their own, shape buckets, width of a vector and its non-zero places.
VOCABULARY, SHAPES, WIDTH, PLACES = 16_384, 1024, 64, 4
#: Words whose sums travel as one row, and tasks that first add up a group's rows.
GROUP, FAN_IN = 256, 256
#: Bytes of text at once.
PART = 1 << 19
#: Words whose vectors are gathered at once, and words that are counted at once.
STEP, COUNTED = 1 << 14, 1 << 20
#: The network is fitted on up to so many labelled documents, those of smallest hash.
SAMPLE = 12_000
HIDDEN, EPOCHS, THRESHOLD = 32, 400, 0.3

#: Letters, capitals and digits each as one class; punctuation as itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = CLASS[128:] = 97
CLASS[65:91] = 65
CLASS[48:58] = 48


def index_places(hashes: np.ndarray):
    """The index vector of each hash, whatever it stands for: PLACES times a place and a sign; other components are 0."""
    h = mix(hashes)
    for k in range(PLACES):
        yield ((h >> U(8 * k)) % U(WIDTH)).astype(np.int64), 1.0 - 2.0 * ((h >> U(48 + k)) & U(1))


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), WIDTH))
    for at, sign in index_places(hashes):
        out[np.arange(len(hashes)), at] += sign
    return out / np.sqrt(PLACES)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, shape buckets and the first word of each row; a word that repeats the one before has a shape of its own."""
    data, off = text_buffer(column)
    words, first = word_hashes(data, off)
    start, end = spans(~SPACE[data], off)
    kind = CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    at = np.concatenate([[0], np.cumsum(new)])
    shape = (range_hash(prefix_hash(kind[new]), at[start], at[end]) % U(SHAPES - 1)).astype(np.int64) + 1
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    shape[again] = 0
    return words, shape, first


def known(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted vocabulary; -1 where it has none."""
    if not len(vocabulary):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def _counts(text: str):
    """Words with their counts, a row for each word and COUNTED words or a little more."""

    @giving_back
    def run(batches):
        words, n = [], 0
        for batch in batches:
            for part in slices(batch, text, PART):
                words.append(tokens(part.column(text))[0])
                n += len(words[-1])
                if n >= COUNTED:
                    yield from rows(words)
                    words, n = [], 0
        yield from rows(words)

    def rows(words):
        if words:
            found, n = np.unique(np.concatenate(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])

    return run


def _contexts(text: str, vocabulary: np.ndarray):
    """Sums over all neighbours of their index vectors, for the words of the vocabulary; a row for each GROUP of words."""

    @giving_back
    def run(batches):
        part_id, total = TaskContext.get().partitionId(), np.zeros(len(vocabulary) * WIDTH)
        for batch in batches:
            for part in slices(batch, text, PART):
                word, _, first = tokens(part.column(text))
                own = known(word, vocabulary)
                near = np.ones(max(0, len(word) - 1), bool)
                inner = first[1:-1]
                near[inner[(inner > 0) & (inner < len(word))] - 1] = False
                a, b = np.flatnonzero(near), np.flatnonzero(near) + 1
                for centre, other in ((a, b), (b, a)):
                    has = own[centre] >= 0
                    centre, other = own[centre[has]] * WIDTH, other[has]
                    for at, sign in index_places(word[other]):
                        total += np.bincount(centre + at, sign, len(total))
        for group, at in enumerate(range(0, len(vocabulary), GROUP)):
            own = total[at * WIDTH : (at + GROUP) * WIDTH]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part_id], pa.int32()), pa.array([own.tobytes()], pa.binary())], SUMS)

    return run


SUMS = ["group", "part", "sums"]


def _added():
    """Rows sorted by (group, part) to one row for each, their sums."""

    @giving_back
    def run(batches):
        now, total = None, None
        for batch in batches:
            for group, p, own in zip(*(batch.column(c).to_pylist() for c in SUMS), strict=True):
                if (group, p) != now:
                    if now:
                        yield row(*now, total)
                    now, total = (group, p), np.zeros(len(own) // 8)
                total = total + np.frombuffer(own)
        if now:
            yield row(*now, total)

    def row(group, part, total):
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], SUMS)

    return run


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the vocabulary, sorted; their vectors). The vocabulary is the VOCABULARY most frequent words of all
    texts; a vector is the sum of the index vectors of all neighbours in all texts, of length one. VOCABULARY rows and
    as many vectors reach the driver. Whatever is not in it keeps its index vector, so that every word has one."""
    rows = docs.select(F.col(text).alias("text"))
    counts = rows.mapInArrow(_counts("text"), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = np.sort(np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()], np.int64).view(np.uint64))
    sums = rows.mapInArrow(_contexts("text", vocabulary), "group int, part int, sums binary")
    for part in (F.pmod("part", F.lit(FAN_IN)), F.lit(0)):  # a group's rows are added up by many tasks first
        sums = sums.withColumn("part", part).repartition("group", "part").sortWithinPartitions("group", "part")
        sums = sums.mapInArrow(_added(), "group int, part int, sums binary")
    out = np.zeros((len(vocabulary), WIDTH))
    for r in sums.toLocalIterator():
        own = np.frombuffer(r.sums).reshape(-1, WIDTH)
        out[r.group * GROUP : r.group * GROUP + len(own)] += own
    return vocabulary, (out / np.maximum(1e-9, np.sqrt((out**2).sum(axis=1)))[:, None]).astype(np.float32)


def pool(column: pa.Array, vocabulary: np.ndarray, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row for each text: mean word vector, mean shape vector, share of repeats, length."""
    word, shape, first = tokens(column)
    n, count = len(first) - 1, np.diff(first)
    out = np.zeros((n, 2 * WIDTH + 2))
    out[:, -1] = np.log1p(count) / 10
    if not len(word):
        return out
    kinds, which = np.unique(word, return_inverse=True)
    at = known(kinds, vocabulary)
    own = np.zeros((len(kinds), WIDTH))
    own[at >= 0], own[at < 0] = vectors[at[at >= 0]], index_vectors(kinds[at < 0])
    for k in np.flatnonzero(count).tolist():
        a, b, size = int(first[k]), int(first[k + 1]), int(count[k])
        for lo in range(a, b, STEP):
            some = which[lo : min(b, lo + STEP)]
            out[k, :WIDTH] += np.ones(len(some)) @ own[some]
        by_shape = np.bincount(shape[a:b], minlength=SHAPES)
        out[k, WIDTH : 2 * WIDTH] = by_shape @ shapes
        out[k, -2] = by_shape[0]
        out[k, :-1] /= size
    return out


class Network:
    """One hidden layer and a logistic output, by Adam over the whole sample; a temperature is fitted on a part kept back."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kept_back: np.ndarray, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.prior = (y.sum() + 1.0) / (len(y) + 2.0)
        self.fitted = len(np.unique(y)) == 2
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        train = ~kept_back if (~kept_back).any() and len(np.unique(y[~kept_back])) == 2 else np.ones(len(y), bool)
        xt, yt = x[train], y[train]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(xt @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
            back = d[:, None] * p[2] * (1 - h**2)
            grads = [xt.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if kept_back.any():
            z, yk = self._logit(x[kept_back]), y[kept_back]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.logaddexp(0, -np.where(yk == 1, 1, -1) * z / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def fold(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def _pooled(model, text):
    @giving_back
    def run(batches):
        for batch in batches:
            for part in slices(batch, text, PART):
                x = pool(part.column(text), *model)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_key", "_y", "_fold")), flat], ["key", "y", "fold", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, key: str = "doc_id", text: str = "text"):
    """(vocabulary, word vectors, shape vectors, network). Labels come only from rows whose fold is not 0; the network
    is fitted on at most `sample` labelled ids, those of smallest hash, each once: of documents that share an id the one
    whose pooled vector is least, of its labels the greatest."""
    ship(docs.sparkSession)
    space = (*word_vectors(docs, text), index_vectors(np.arange(SHAPES, dtype=np.uint64)))
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 0))
    own = own.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("_key", F.lit(9)), "_key").limit(sample)
    own = Work(docs.sparkSession, "quality").table(own.withColumn("_fold", fold("_key").cast("int")), "sample")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(own), F.col("_id") == F.col("_key")).select("_key", "_y", "_fold", "_text")
    kind = own.schema["_key"].dataType.simpleString()
    got = rows.mapInArrow(_pooled(space, "_text"), f"key {kind}, y double, fold int, x array<double>").groupBy("key").agg(F.min(F.struct("fold", "y", "x")).alias("r")).select("r.*").collect()
    got.sort(key=lambda r: (r.fold, r.y, r.x))
    x = np.array([r.x for r in got]).reshape(len(got), 2 * WIDTH + 2)
    return *space, Network(x, np.array([r.y for r in got]), np.array([r.fold == 1 for r in got], bool))


def _score(model, text: str, keep: list[str]):
    *space, network = model

    @giving_back
    def run(batches):
        for batch in batches:
            for part in slices(batch, text, PART):
                s = network.score(pool(part.column(text), *space))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(s, pa.float64())], [*keep, "_score"])

    return run


def score_quality(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and _score, from 0 to 1, of every whole text; null and empty texts are scored as texts without words."""
    ship(docs.sparkSession)
    columns = list(dict.fromkeys([*keep, text]))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns])
    return rows.mapInArrow(_score(model, text, list(keep)), with_fields(docs.select(*[F.col(f"`{c}`") for c in keep]).schema, "_score double"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects. A text goes to the workers once, as one of its row's columns."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    scored = score_quality(plain, fit(docs, labels), f"c{docs.columns.index('text')}", tuple(plain.columns))
    return scored.where(F.col("_score") >= threshold).drop("_score").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
