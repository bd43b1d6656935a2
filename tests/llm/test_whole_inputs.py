"""Rules and fits hold for whole inputs: every license pattern fires, every candidate counts."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def example(parsed, gap):
    """The least text that a pattern matches, its gaps being `gap`."""
    from re import _constants as c

    out = ""
    for op, x in parsed:
        if op is c.LITERAL:
            out += chr(x)
        elif op is c.ANY:
            out += "x"
        elif op is c.IN:
            kind, value = x[0]
            out += {c.LITERAL: chr, c.RANGE: lambda v: chr(v[0]), c.CATEGORY: {c.CATEGORY_SPACE: gap, c.CATEGORY_DIGIT: "1"}.get}[kind](value)
        elif op is c.BRANCH:
            out += example(x[1][0], gap)
        elif op is c.SUBPATTERN:
            out += example(x[3], gap)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += example(x[2], gap) * x[0]
    return out


@pytest.mark.parametrize("gap", [" ", "\n", ", ", "\n * "])
def test_every_license_pattern_fires(monkeypatch, gap):
    import re
    from re import _parser

    from pricelattice.llm import licenses

    seen: list = []
    monkeypatch.setattr(licenses, "settle", lambda found: seen.extend(found) or [])
    all_ = [r for rules in licenses.rules()[1].values() for r in rules]
    lost = []
    for priority, label, _, pattern, *_ in all_:
        text = example(_parser.parse(pattern.pattern, re.DOTALL), gap)
        m = pattern.search(text)
        seen.clear()
        licenses.scan_text(text)
        if (m.start(), m.end(), priority, label) not in {d[:4] for d in seen}:
            lost.append((label, text))
    assert len(all_) == 323 and not lost


def test_licenses_by_short_names():
    from pricelattice.llm.licenses import scan_text

    for text, label in (("ODbL", "odbl"), ("SSPL", "sspl"), ("EPL-2.0", "epl-2.0"), ("BUSL-1.1", "bsl-1.1"), ("The MIT\nLicense (MIT)", "mit"), ("End-User License Agreement", "eula")):
        assert any(x.startswith(label) for x in scan_text(text)["labels"].split(",")), text


@data
def test_licenses_as_without_a_filter():
    """On real texts the filter changes nothing."""
    from pricelattice.llm import licenses

    every = [r for rules in licenses.rules()[1].values() for r in rules]
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall():
        low = t.encode().lower().decode()
        kept = licenses.settle([(m.start(), m.end(), r[0], r[1], r[2]) for r in every for m in r[3].finditer(low)])
        assert licenses.scan_text(t)["spans"] == [f"{d[3]}:{d[0]}:{d[1]}" for d in kept]


def test_pii_learns_from_every_candidate(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from pricelattice.llm import pii

    groups = [(4, (1, 1, 1, 0, 1, 1), 22, 18, 20_000), (7, (1, 0, 1, 0, -1, 1), 90, 31, 20_000), (8, (-1, -1, -1, 0, -1, -1), 12, 0, 300)]
    part = lambda k, v, size, n, many: spark.range(many).select(F.expr(f"array(named_struct('start', 3, 'kind', {k}, 'end', {3 + size}, 'votes', array{v}, 'size', {size}, 'n_digits', {n}, 'before', 0, 'after', 0))").alias("more"))
    w = pii.fit(part(*groups[0]).union(part(*groups[1])).union(part(*groups[2])))
    assert all(w[k] for k in (4, 7, 8))
    prior, t = pii.reliabilities({g[1]: g[4] for g in sorted(groups, key=lambda g: g[1])})
    share = lambda size, n: int(n / size * 20) / 20 * min(60, size)
    x = np.array([pii.features(g[0], g[1], min(60, g[2]), share(g[2], g[3])) for g in groups for _ in range(g[4] // 100)])
    y = np.array([pii.posterior(g[1], prior, t) for g in groups for _ in range(g[4] // 100)])
    assert np.allclose(w, pii.train(x, y, np.ones(len(y))), atol=1e-3)
