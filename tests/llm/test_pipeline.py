"""Each stage of the pipeline against brute force on its own input."""

import re

import pytest

import corpus_pipeline
from fluxgrid.llm import common, quality, secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    scratch, docs, out = common.Scratch(spark), common.table(spark, sf_dir, "documents"), [("documents", common.table(spark, sf_dir, "documents").toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        out.append((name, docs.toPandas()))
    return dict(out), spark


def test_columns_and_order(stages):
    tables, _ = stages
    assert list(tables) == ["documents", "quality", "near", "leaks", "secrets", "mix"]
    for name in list(tables)[:-1]:
        assert list(tables[name].columns) == list(tables["documents"].columns)
    assert set(tables["documents"].columns) <= set(tables["mix"].columns)


def test_quality(stages):
    tables, _ = stages
    for t in tables["quality"].text:
        n, _, _, _, rep = quality.measure(t.encode())[0]
        assert n >= 50 and 100 * rep <= 50 * n
    assert 0.5 < len(tables["quality"]) / len(tables["documents"]) < 1


def test_near(stages):
    tables, _ = stages
    sets = {}
    for d, t in zip(tables["quality"].doc_id, tables["quality"].text):
        w = t.encode().lower().split()
        sets[d] = frozenset(zip(*(w[i:] for i in range(5))))
    ids = sorted(sets)
    own = {d: d for d in ids}
    changed = True
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(own[a], own[b])
            changed |= own[a] != low or own[b] != low
            own[a] = own[b] = low
    assert sorted(tables["near"].doc_id) == sorted({*own.values()})


def test_leaks_and_secrets(stages, sf_dir):
    tables, spark = stages
    items = [t.lower().split() for t in common.table(spark, sf_dir, "benchmark").toPandas().text]
    for t in tables["leaks"].text:
        w = " ".join(t.lower().split())
        assert not any(" ".join(i) in w for i in items)
    assert set(tables["leaks"].doc_id) <= set(tables["near"].doc_id)
    assert len(tables["secrets"]) == len(tables["leaks"])
    for t, n in zip(tables["secrets"].text, tables["secrets"].n_chars):
        assert not secrets.base_spans(t, t.encode()) and n == len(t)
    assert not any(re.search("AKIA[A-Z0-9]{16}", t) for t in tables["secrets"].text)


def test_mix(stages):
    tables, _ = stages
    assert set(tables["mix"].doc_id) <= set(tables["secrets"].doc_id)
    copies = tables["mix"].groupby("doc_id")
    assert (copies.size() == copies.n_copies.first()).all() and tables["mix"].shuffle_key.is_monotonic_increasing


def test_empty(spark, sf_dir):
    empty = common.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns whose names the operators use themselves."""
    import corpus_pipeline

    words = "the quick brown fox jumps over a lazy dog while seven pale birds watch from some old wooden fence near our quiet river".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i) for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, None, "en", "a", 10), (3, long, "en", "a", 9), (3, long, "en", "a", 9), (4, "a", "de", "b", 1), (5, " \n\t ", None, "a", 5), (6, long + " end", "en", "b", 1), (7, "auth_key = 'Zx81kPq90LmN2'", None, None, 5)]
    kind = "doc_id long, text string, lang string, source string, n_chars int, rate double, sid long, label string, token long"
    odd = spark.createDataFrame([(*r, 0.5, 7, "x", 3) for r in rows], kind)
    stages = dict(corpus_pipeline.STAGES)
    got = {name: [tuple(r) for r in f(spark, odd, sf_dir).select("doc_id", "text").collect()] for name, f in stages.items() if name != "mix"}
    for name, f in stages.items():
        for docs in (odd, odd.limit(0)):
            out = f(spark, docs, sf_dir)
            assert set(odd.columns) <= set(out.columns) and (name == "mix" or out.columns == odd.columns)
        assert out.count() == 0
    assert not {1, 2, 4, 5} & {d for d, _ in got["quality"]}
    assert sorted(d for d, t in got["near"] if t and len(t) > 1000) == [3] and {1, 2, 4, 5, 7} <= {d for d, _ in got["near"]}
    assert sorted(got["leaks"], key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    masked = dict(got["secrets"])
    assert masked[7] == "auth_key = '[SECRET]'" and masked[1] is None and masked[2] == "" and len(got["secrets"]) == len(rows)
    mixed = stages["mix"](spark, odd, sf_dir).toPandas()
    assert (mixed.groupby(["doc_id", "text"], dropna=False).n_copies.first() >= 1).all() and mixed.shuffle_key.is_monotonic_increasing
