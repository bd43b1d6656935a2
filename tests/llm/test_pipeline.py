"""Each stage of the pipeline on the stage before it."""

import os

import pytest

import helpers as H

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402
from pricelattice.llm import bpe, pii  # noqa: E402
from test_ops import plain_targets  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows[1]}
    judged = [i for i in labels if i in {r.doc_id for r in rows[0]}]
    assert sum((i in kept) == (labels[i] == 1) for i in judged) / len(judged) > 0.95
    groups = H.near_groups([(r.doc_id, r.text) for r in rows[1]], 5, 80, 100)
    assert {r.doc_id for r in rows[2]} == {i for i, (_, c) in groups.items() if c == i}
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]}
    assert not any(pii.base_spans(r.text) for r in rows[3]) and all(r.n_chars == len(r.text) for r in rows[3])
    before = {r.doc_id: r for r in rows[2]}
    assert all(r.text == before[r.doc_id].text for r in rows[3] if not pii.base_spans(before[r.doc_id].text) and "[" not in r.text)
    size = lambda t: len(H.WORDS.findall(t))
    sizes, taken, largest = {}, {}, {}
    for r in rows[3]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        largest[r.source] = max(largest.get(r.source, 0), size(r.text))
    for r in rows[4]:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, t in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1
    library = Tokenizer.from_file(bpe.vocabulary())
    assert sorted(r.doc_id for r in rows[5]) == sorted(r.doc_id for r in rows[4])
    texts = {r.doc_id: r.text for r in rows[4]}
    assert all(list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows[5])


def test_empty(spark, tmp_path):
    sf = str(tmp_path / "sf")
    H.empty(spark).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() == 0


def test_awkward(spark, tmp_path):
    sf = str(tmp_path / "sf")
    H.awkward(spark).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (8, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() > 0
