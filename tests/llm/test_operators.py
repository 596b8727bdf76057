"""Document operators against brute force on small tables, and the edge cases of their docstrings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxgrid.llm import chunks, common, decontaminate, jaccard, langid, lm, mixing, quality, secrets, substrings, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(8)
VOCABULARY = ["".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(2, 9, 400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = prose(40_000)
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "no id here", "en", "a", 10), (3, long, "en", "a", 9), (3, long, "en", "a", 9), (4, "a", "de", "b", 1), (5, "  \n\t ", None, "a", 5), (6, "é" * 500, "fr", "a", 500), (7, "a" * 1300, "en", "b", 1300)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KIND + ", label string, n long, sid long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return common.texts(common.table(spark, sf_dir, "documents")).toPandas()


def spans_of_repeats(texts, n):
    count = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                hit[i : i + n] = True
        out.append(hit)
    return out


def check_repeats(spark, texts, hot=substrings.HOT):
    got = {r.doc_id: r for r in substrings.remove_repeats(common.texts(docs_of(spark, texts)), hot).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (b, hit, short) in enumerate(zip(raw, spans_of_repeats(raw, substrings.LENGTH), spans_of_repeats(raw, substrings.SHORT))):
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()), i
        assert (got[i].n_shared, got[i].n_passages) == (int(short.sum()), int((np.diff(np.concatenate([[0], short.astype(int)])) == 1).sum())), i


@pytest.mark.parametrize("hot", [512, 1])
def test_op1_brute_force(spark, hot):
    shared, other = prose(90), prose(130)
    tail = prose(70)[:320]
    texts = [tail, prose(30) + tail, prose(30) + tail + prose(30), prose(60) + shared + prose(60), shared, prose(10) + shared[5:] + prose(200), other + "x" + other, other[:399], other[1:401], None, "", "z" * 1000, prose(300), prose(20) + shared[:410], "é" * 300 + shared]
    check_repeats(spark, texts + [texts[12], texts[12]], hot)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=60), min_size=1, max_size=8), st.integers(3, 12))
def test_op1_suffix_array(texts, n):
    raw = [t.encode() for t in texts if len(t) >= n]
    if raw:
        want = spans_of_repeats(raw, n)
        for b, most, hit in zip(raw, substrings.longest_repeats(raw, [len(b) - n + 1 for b in raw], n), want):
            marked = np.zeros(len(b), bool)
            for i in np.flatnonzero(most >= n):
                marked[i : i + n] = True
            assert (marked == hit).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=5), st.integers(1, 12), st.integers(1, 9))
def test_op1_two_stages(texts, repeat, limit):
    """The suffixes in order, common prefixes by hand, and a direct sort of the smaller suffixes alone."""
    b = b"".join(bytes(np.repeat(np.frombuffer(x.encode(), np.uint8), repeat)) + b"\0" for x in texts)
    t = np.frombuffer(b, np.uint8)
    sa = substrings.suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    common_ = [0]
    for i, j in zip(sa.tolist()[1:], sa.tolist()):
        k = 0
        while k < min(limit, len(b) - max(i, j)) and b[i + k] == b[j + k]:
            k += 1
        common_.append(k)
    assert substrings.common_prefixes(t, sa, limit).tolist() == common_
    own = np.array([i for i in range(len(b) - 1) if b[i:] < b[i + 1 :]], np.int64)
    assert substrings.direct_order(t, own).tolist() == [i for i in sa.tolist() if i in set(own.tolist())]


def test_op1_sorts_smaller_suffixes_only(monkeypatch):
    """Each sort of the first stage holds those suffixes at most that are smaller than their successors, and later ones only ties."""
    b = (prose(4000).encode() + b"\0") * 2
    small = sum(b[i : i + 40] < b[i + 1 : i + 41] for i in range(len(b) - 1))
    sizes = []
    refined = substrings._refined
    monkeypatch.setattr(substrings, "_refined", lambda rank, live, keys: sizes.append(len(live)) or refined(rank, live, keys))
    substrings.suffix_array(np.frombuffer(b, np.uint8))
    assert sizes[0] == small < 0.6 * len(b) and max(sizes) == small


@settings(max_examples=60, deadline=None)
@given(st.text("ab *#\n\t|", max_size=80))
def test_op2_counts(text):
    b = text.encode()
    words = WORD.findall(b)
    wins = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    want = [len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)]
    assert quality.measure(b)[0] == want


def test_op2_trees_are_monotonic():
    x = rng.random((600, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=600)) > 0).astype(float)
    trees = quality.grow(x, y, [1, -1, 0], n_trees=20)
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.8
    grid = np.linspace(0, 1, 50)
    for j, sign in ((0, 1), (1, -1)):
        probe = np.repeat(rng.random((1, 3)), 50, 0)
        probe[:, j] = grid
        assert (sign * np.diff(trees.margin(probe)) >= -1e-12).all()


def test_op2_flat_arrays_are_the_trees():
    """Each row walked node by node gives the margin of the vectorised scorer; equal values go left."""
    own = np.random.default_rng(9)
    x = np.round(own.random((300, 4)), 1)
    trees = quality.grow(x, (x[:, 0] + x[:, 3] * x[:, 1] > 0.8).astype(float), [1, 0, 0, 1], n_trees=12)
    for row, got in zip(x, trees.margin(x)):
        want = trees.bias
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            want += leaf[node - len(f)]
        assert got == pytest.approx(want)
    assert quality.grow(x, np.ones(300), [0] * 4).margin(x[:2]).tolist() == [4.0, 4.0]
    assert quality.grow(x[:0], np.zeros(0), [0] * 4).margin(x[:2]).tolist() == [0.0, 0.0]


def test_op2_keeps_good_documents(spark, sf_dir):
    got = quality.op2_quality_rules(spark, sf_dir).toPandas().merge(common.table(spark, sf_dir, "labels").toPandas(), on="doc_id")
    free = got[~got.base_failed]
    assert (free.kept == (free.quality_y == 1)).mean() > 0.9 and not got[got.base_failed].kept.any()


def brute_classes(texts, n, t):
    sets = []
    for x in texts:
        w = WORD.findall((x or "").encode().lower())
        sets.append(set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set())
    own = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                    own[i] = own[j] = min(own[i], own[j])
    return {i: (len(s), o) for i, (s, o) in enumerate(zip(sets, own))}


def near_copies():
    base = prose(120).split()
    out = [" ".join(base)]
    for k in range(12):
        w = list(base)
        for _ in range(k % 4 + 1):
            w[int(rng.integers(0, len(w)))] = VOCABULARY[k]
        out.append(" ".join(w))
    return out + [prose(100) for _ in range(10)] + [None, "", "a b", "a b", "A  B", "one", prose(100) + " the end", " ".join(base[:110])]


@pytest.mark.parametrize("n,t,block", [(3, 90, 2048), (5, 80, 2048), (3, 90, 2)])
def test_op4_brute_force(spark, n, t, block):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(common.texts(docs_of(spark, texts)), n, t / 100, block).collect()}
    assert got == brute_classes(texts, n, t)


@pytest.mark.parametrize("n,t,block", [(3, 90, 2048), (5, 80, 2048), (3, 90, 2)])
def test_op4_number_of_links(spark, n, t, block):
    texts = near_copies()
    texts += texts[:3]
    sets = []
    for x in texts:
        w = WORD.findall((x or "").encode().lower())
        sets.append(set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set())
    want = {i: sum(bool(s) and i != j and 100 * len(s & o) >= t * len(s | o) for j, o in enumerate(sets)) for i, s in enumerate(sets)}
    got = {r.doc_id: r.n_links for r in jaccard.similar_sets(common.texts(docs_of(spark, texts)), n, t / 100, block).collect()}
    assert got == want and max(want.values()) > 3


def test_op4_count_links():
    own = np.random.default_rng(3)
    base = own.choice(1 << 40, 80, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([own.permutation(base)[: int(own.integers(60, 80))], own.integers(0, 40, 4).astype(np.uint64)])) for _ in range(150)]
    n, times = np.array([len(s) for s in sets]), own.integers(1, 4, 150)
    link = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    for side in (np.full(150, 2), own.integers(0, 2, 150)):
        ok = link & (~np.eye(150, dtype=bool) if side[0] == 2 else side[:, None] != side)
        for often in (8, 64, 1000):
            assert (jaccard.count_links(n, times, sets, side, 0.8, often) == ok @ times).all()


def test_op4_exact_round_is_not_skipped(spark, monkeypatch):
    """The round with a few pairs of each two classes finds nothing that wasn't tried; the round with all pairs has to follow."""
    whole = jaccard._pairs
    monkeypatch.setattr(jaccard, "_pairs", lambda rows, t, per_pair: whole(rows, t, per_pair).where(str(per_pair <= 0)))
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_sets(common.texts(docs_of(spark, texts)), 3, 0.9, 2).collect()}
    assert got == brute_classes(texts, 3, 90)


def test_op4_trie_join():
    sets = [np.unique(rng.integers(0, 60, int(k)).astype(np.uint64)) for k in rng.integers(5, 60, 80)]
    a = sets[0]
    want = sorted(i for i, s in enumerate(sets) if 100 * len(np.intersect1d(a, s)) >= 50 * len(np.union1d(a, s)))
    assert sorted(jaccard.trie_join(a, list(enumerate(sets)), 0.5)) == want


def test_op4_one_document_stays(spark, odd):
    texts = near_copies()
    kept = jaccard.keep_one(docs_of(spark, texts)).toPandas()
    assert sorted(kept.doc_id) == sorted({c for _, c in brute_classes(texts, 5, 80).values()})
    assert jaccard.keep_one(odd).columns == odd.columns


def test_op3_leaks(spark):
    items = [prose(35) for _ in range(12)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swapped = items[2].split()
    for k in range(3, 35, 6):
        swapped[k] = "changed"
    texts = [prose(200) for _ in range(60)] + [prose(50) + " " + items[0] + " " + prose(90), items[1].upper(), prose(70) + " " + " ".join(swapped) + " " + prose(10), None, ""]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(common.texts(docs_of(spark, texts)), bench).collect()}
    assert got == {(60, 0), (61, 1), (62, 2)}
    kept = decontaminate.drop_leaks(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 63, 64]
    assert decontaminate.leaks(common.texts(docs_of(spark, texts)), bench.limit(0)).count() == 0


def test_op3_long_items(spark):
    """Items far longer than a passage, copied whole, with changes, and in part."""
    own = np.random.default_rng(4)
    words = ["".join(own.choice(list("abcdefgh"), 7)) for _ in range(3000)]
    make = lambda n: " ".join(own.choice(words, n))
    items = [make(300), make(1500), make(200), make(35)]
    changed = items[2].split()
    changed[::9] = ["changed"] * len(changed[::9])
    texts = [make(250) for _ in range(40)] + [make(77) + " " + items[0] + " " + make(60), items[1], make(20) + " " + " ".join(changed), " ".join(items[0].split()[:100]) + " " + make(300), make(500) + " " + items[3]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(common.texts(docs_of(spark, texts)), bench).collect()}
    assert set(got) == {(40, 0), (41, 1), (42, 2), (44, 3)} and got[40, 0] == got[41, 1] == 1.0


def test_op3_verbatim_items_of_any_length(spark):
    own = np.random.default_rng(11)
    words = ["".join(own.choice(list("abcdefgh"), 7)) for _ in range(4000)]
    filler = ["".join(own.choice(list("mnopqrst"), 6)) for _ in range(600)]
    items = [" ".join(own.choice(words, n, replace=False)) for n in (1, 2, 5, 30, 120, 200, 300, 1000)]
    fill = lambda n: " ".join(own.choice(filler, n))
    texts = [fill(150) for _ in range(30)] + [f"{fill(40)} {x} {fill(55)}" for x in items]
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(common.texts(docs_of(spark, texts)), bench).collect()}
    assert got >= {(30 + k, k) for k in range(len(items))} and all(d >= 30 for d, _ in got)


def test_op3_recall_against_brute_force(spark, sf_dir):
    """Every pair of which seven in ten words of the item are in order in some stretch of the text, found by trying all stretches."""
    got = {(r.doc_id, r.item_id) for r in decontaminate.op3_decontaminate(spark, sf_dir).collect()}
    items = [(r.item_id, decontaminate.split(r.text.encode())) for r in common.table(spark, sf_dir, "benchmark").collect()]
    number = {w: k for k, w in enumerate({w for _, ws in items for w in ws})}
    want = set()
    for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        text = np.array([number.get(w, -1) for w in decontaminate.split((r.text or "").encode())], np.int64)
        for item, ws in items:
            ids = [number[w] for w in ws]
            held = np.concatenate([[0], np.cumsum(np.isin(text, ids))])
            for at in range(0, max(1, len(text)), 24):
                lo, hi = max(0, at - 24), min(len(text), at + 96)
                if held[hi] - held[lo] >= 0.7 * len(ids) and decontaminate.common_subsequence(ids, text[lo:hi]) >= 0.7 * len(ids):
                    want.add((r.doc_id, item))
                    break
    assert len(want & got) >= 0.9 * len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=20), st.lists(st.integers(-1, 4), max_size=30))
def test_op3_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common_subsequence(a, np.array(b, np.int32)) == table[-1][-1]


def test_op5_held_out(spark, sf_dir):
    got = langid.op5_language_id(spark, sf_dir).toPandas().merge(common.table(spark, sf_dir, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == h for d, h in zip(got.doc_id, got.held_out))


def lang_chunks(n, seed):
    """Chunks in three made-up languages of different letters, more than the operator's bound if n says so."""
    r = np.random.default_rng(seed)
    words = {lang: ["".join(r.choice(list(letters), int(k))) for k in r.integers(1, 9, 300)] for lang, letters in (("aa", "abcdeo"), ("bb", "abcdei"), ("cc", "rstuvé"))}
    labels = r.choice(list(words), n).tolist()
    return [" ".join(r.choice(words[x], 12)) for x in labels], labels


@pytest.mark.filterwarnings("error")
@pytest.mark.parametrize(("n", "seed"), [(1, 1), (70, 2), (2_000, 3), (20_000, 4), (2_000, 5)])
def test_op5_descent_is_stable(n, seed):
    parts, labels = lang_chunks(n, seed)
    model = langid.train(parts, labels, seed=seed)
    assert np.isfinite(model.logits).all() and np.isfinite(model.bias).all() and 0 <= model.reject_below <= 1
    new, truth = lang_chunks(300, seed)
    found = [model.predict(t) for t in new]
    assert all(0 <= s <= 1 for _, s in found)
    if n >= 2_000:
        assert np.mean([a == b for (a, _), b in zip(found, truth)]) > 0.95
    assert model.predict("12 34") == model.predict("") == model.predict(None) == ("und", 0.0)


def test_op5_learns_a_language_without_spaces(spark):
    letters = [chr(0x3042 + k) for k in range(60)]
    rows = [(i, "".join(rng.choice(letters, 2400)), "ja") for i in range(6)] + [(i, prose(400), "en") for i in range(6, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = [r for b in langid._chunks(iter(docs.where("doc_id = 0").toArrow().to_batches())) for r in b.to_pylist()]
    assert "".join(r["part"] for r in sorted(pieces, key=lambda r: r["at"])) == rows[0][1]  # nothing is left out
    model = langid.fit(docs)
    assert model.langs == ["en", "ja"]
    assert model.predict("".join(rng.choice(letters, 300)))[0] == "ja" and model.predict(prose(50))[0] == "en"


def test_op5_rows_of_one_id_keep_their_languages(spark):
    docs = spark.createDataFrame([(1, "aaa bbb " * 60, "x"), (1, "ccc ddd " * 60, "y"), (2, "aaa bbb " * 60, "x"), (3, "ccc ddd " * 60, "y")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.predict("aaa bbb aaa")[0] == "x" and model.predict("ccc ddd ccc")[0] == "y"


def test_op5_prediction_is_the_mean_of_embeddings():
    """A text's logits are the mean over its subwords, taken one by one; ties go to the language that sorts first."""
    model = langid.train(*lang_chunks(200, 6))
    text = "Abode 7 rest-é"
    raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    raw = b" " + b" ".join(raw.split()) + b" "
    grams = [raw[i : i + n] for n in (1, 2, 3, 4) for i in range(len(raw) - n + 1) if n < 3 or b" " not in raw[i + 1 : i + n - 1]]
    ids = np.concatenate(list(langid.subwords(text)))
    assert len(ids) == len(grams)
    z = (sum(model.logits[i].astype(float) for i in ids) / len(ids) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert model.predict(text) == (model.langs[int(p.argmax())], pytest.approx(p.max(), abs=1e-6))
    tied = langid.Model(["x", "y"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2))
    assert tied.predict("abc") == ("x", 0.5)


def test_op6_passages(spark):
    passage = prose(60)
    texts = [prose(80) + " " + passage + " " + prose(80), prose(33) + " " + passage, *(prose(150) for _ in range(8)), None, ""]
    got = chunks.repeated_passages(common.texts(docs_of(spark, texts))).toPandas()
    assert set(got.doc_id) == {0, 1} and set(got[got.removed].doc_id) == {1}
    for r in got.itertuples():
        at = texts[r.doc_id].index(passage)
        assert at - 1 <= r.start and r.end <= at + len(passage) + 1 and r.end - r.start > len(passage) / 2
    clean = {r.doc_id: r.text for r in chunks.remove_passages(common.texts(docs_of(spark, texts))).collect()}
    assert clean[0] == texts[0] and len(clean[1]) < len(texts[1]) and clean[10] is None


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_op6_chunks_cover_the_text(b):
    ends = chunks.cut_points(b)
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == len(b) and (sizes <= chunks.MAX_CHUNK).all() and (sizes[:-1] >= chunks.MIN_CHUNK).all()


def test_op6_brute_force(spark):
    """Runs of repeated chunks by dictionaries, over the operator's own cuts: places, copies, and which of them goes."""
    shared, other = prose(70), prose(45)
    texts = [prose(30) + shared + prose(20), shared + prose(40), prose(15) + other + shared, other + "\n" + other, prose(50), "", None, "x" * 400, prose(8) + "x" * 300]
    texts += [texts[4]]
    raw = [(t or "").encode() for t in texts]
    places: dict[bytes, list] = {}
    parts = []
    for i, b in enumerate(raw):
        ends = chunks.cut_points(b)
        parts.append(list(zip([0, *ends[:-1]], ends)))
        for a, e in parts[-1]:
            places.setdefault(b[a:e], []).append((i, a))
    want = set()
    for i, b in enumerate(raw):
        run: list[tuple] = []
        for a, e in [*parts[i], (None, None)]:
            if a is not None and len(places[b[a:e]]) > 1:
                run.append((a, e, (i, a) != min(places[b[a:e]]), len(places[b[a:e]])))
                continue
            if run and run[-1][1] - run[0][0] >= chunks.MIN_RUN:
                cut = [0, *(k for k in range(1, len(run)) if run[k][2] != run[k - 1][2]), len(run)]
                for x, y in zip(cut, cut[1:]):
                    want.add((i, run[x][0], run[y - 1][1], y - x, max(r[3] for r in run[x:y]), run[x][2]))
            run = []
    got = chunks.repeated_passages(common.texts(docs_of(spark, texts))).drop("rid").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_op6_forced_cuts_follow_the_content(monkeypatch):
    """Passages of two words without a hash cut; the same passage at other places still gives the same chunks."""
    own, shared, passages = np.random.default_rng(12), [], []
    with monkeypatch.context() as m:
        m.setattr(chunks, "MAX_CHUNK", 1 << 20)
        while len(passages) < 20:
            b = " ".join(own.choice(own.choice(VOCABULARY, 2, replace=False), 400)).encode()
            if len(chunks.cut_points(b)) == 1:
                passages.append(b)
    for passage in passages:
        sets = []
        for k in (37, 90):
            b = prose(k).encode() + b" " + passage
            ends = [0, *chunks.cut_points(b)]
            sets.append({b[x:y] for x, y in zip(ends, ends[1:])})
        shared.append(sum(map(len, sets[0] & sets[1])) > len(passage) / 4)
    assert np.mean(shared) > 0.9


def test_op7_mean_and_order(spark, sf_dir):
    rows = spark.range(6000).selectExpr("id as doc_id", "case when id % 6 = 0 then 'a' when id % 6 < 5 then 'b' end as source", "'t' as text")
    got = mixing.mix(rows, {"a": 0.5, "b": 0.25, "": 0.25}).toPandas()
    share = got.groupby(got.source.fillna("")).size() / 6000
    assert abs(share["a"] - 0.5) < 0.04 and abs(share["b"] - 0.25) < 0.04 and abs(share[""] - 0.25) < 0.04
    assert got.shuffle_key.is_monotonic_increasing and mixing.mix(rows, {"a": 1.0}).where("source <> 'a'").count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(mixing.OP7_SQL).df()
    mine = mixing.op7_mix_sources(spark, sf_dir).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d.copy_no, d.n_copies, d.shuffle_key))
    assert key(mine) == key(want)


def test_op8_base_and_probability(spark, small):
    texts = [t for t in small.text.tolist()[:60]] + [None, "", "neverseen"]
    rows = common.texts(docs_of(spark, texts)).withColumn("held_out", common.fold(5) == 1)
    got = {r.doc_id: r for r in lm.score(rows, lm.fit(rows.where("not held_out"))).collect()}
    words = [(WORD.findall((t or "").encode().lower()) + [b"\n"]) for t in texts]
    train = Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in enumerate(words):
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].score < 0
    raw = b"the cat sat on the mat"
    keys, counts = np.unique(lm.grams([raw] * 30)[0], return_counts=True)
    by_depth = []
    for d in range(lm.DEPTH + 1):
        k = ((keys >> np.uint64(8 * (lm.DEPTH - d) + 8)) << np.uint64(8)) | (keys & np.uint64(255)) if d else keys & np.uint64(255)
        by_depth.append(lm._summed(k, counts))
    tree = lm.Tree.build(by_depth)
    context = keys[3] & ~np.uint64(255)
    assert abs((10 ** tree.bits(context | np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-5


def test_op8_context_tree_by_hand(spark):
    """Every node a dictionary entry: block probabilities from the leaves up, then estimates mixed along each context."""
    texts = ["the cat sat on the mat", "The cat  ate the rat", "é ü", "", "a cat sat", "on the rat a mat", None, "zebra the"]
    rows = common.texts(docs_of(spark, texts)).withColumn("held_out", F.col("doc_id") >= 4)
    got = {r.doc_id: r.score for r in lm.score(rows, lm.fit(rows.where("not held_out"))).collect()}

    def steps(t):
        raw = b"\x0b" * lm.DEPTH + b" ".join((t or "").encode().lower().split()) + b"\n"
        for i in range(lm.DEPTH, len(raw)):
            for j in range(8):
                yield raw[i - lm.DEPTH : i][::-1], raw[i] >> (8 - j) if j else 0, j, raw[i] >> (7 - j) & 1

    counts = {}
    for t in texts[:4]:
        for context, prefix, j, bit in steps(t):
            for d in range(lm.DEPTH + 1):
                counts.setdefault((context[:d], j, prefix), [0, 0])[bit] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    block, weight, below = {}, {}, Counter()
    for node in sorted(counts, key=lambda x: -len(x[0])):
        e = kt(counts[node])
        whole = e if len(node[0]) == lm.DEPTH else math.log(0.5) + np.logaddexp(e, below[node])
        block[node], weight[node] = whole, 1.0 if len(node[0]) == lm.DEPTH else math.exp(math.log(0.5) + e - whole)
        if node[0]:
            below[node[0][:-1], node[1], node[2]] += whole
    for i, t in enumerate(texts):
        want = 0.0
        for context, prefix, j, bit in steps(t):
            p = None
            for d in range(lm.DEPTH, -1, -1):
                if n := counts.get((context[:d], j, prefix)):
                    one = (n[1] + 0.5) / (sum(n) + 1)
                    w = weight[context[:d], j, prefix]
                    p = one if p is None else w * one + (1 - w) * p
            p = 0.5 if p is None else p
            want += math.log10(p if bit else 1 - p)
        assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-5), t


def test_op8_every_gram_counts(spark):
    """More distinct grams than any fixed number of kept ones: scores are those of the whole tree."""
    letters = np.random.default_rng(5).choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8), 900_000).tobytes().decode()
    texts = [letters[i : i + 30_000] for i in range(0, len(letters), 30_000)] * 2  # twice, so that long contexts tell what follows
    rows = common.texts(docs_of(spark, texts + ["unseen" + texts[0][:300]])).withColumn("held_out", F.col("doc_id") == len(texts))
    got = {r.doc_id: r.score for r in lm.score(rows, lm.fit(rows.where("not held_out"))).collect()}
    keys, counts = np.unique(lm.grams([t.encode() for t in texts])[0], return_counts=True)
    assert len(keys) > 700_000
    by_depth = []
    for d in range(lm.DEPTH + 1):
        k = ((keys >> np.uint64(8 * (lm.DEPTH - d) + 8)) << np.uint64(8)) | (keys & np.uint64(255)) if d else keys & np.uint64(255)
        by_depth.append(lm._summed(k, counts))
    tree = lm.Tree.build(by_depth)
    for i, t in ((0, texts[0]), (17, texts[17]), (len(texts), "unseen" + texts[0][:300])):
        want = tree.bits(lm.grams([t.encode()])[0]).sum()
        assert abs(got[i] - want) < 1e-5 * abs(want)


def test_op9_base_patterns(spark):
    texts = ['password = "abcdef" x', "TOKEN: abc token=abcdefgh", "AKIA" + "A" * 16 + " AKIA12", "f" * 24 + "g" + "f" * 23, "é api_key='éabcdef' Api-key: qwerty12", 'cfg = "Zx81kPq90LmN2"\nauth_key = cfg\n', "name = \"short\"", None, ""]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    patterns = [(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, t or "") if ok(m))
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(got[i].spans.split(",")), i
    a = texts[5].index("Zx81")
    assert f"pair:{a}:{a + 13}" in got[5].spans and got[6].spans == ""
    masked = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert "Zx81" not in masked[5] and masked[7] is None and masked[8] == "" and masked[6] == texts[6]


def test_op9_long_literals(spark):
    own = np.random.default_rng(6)
    key = "aB3" + "".join(own.choice(list("abcdefghijkLMNOPQRSTUVWXYZ0123456789+/"), 5600)) + "=="
    bare = "aB3" + "".join(own.choice(list("abcdefghijkLMNOPQRSTUVWXYZ0123456789"), 9000))
    texts = [f'aws_secret_key = "{key}" # x', f"aws_secret_key = {bare}\nx", f"{'x' * 300}_auth_key = 'Zx81kPq90LmN2'", f"auth_key_{'x' * 300} = 'Zx81kPq90LmN2'"]
    masked = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert masked[0] == 'aws_secret_key = "[SECRET]" # x' and masked[1] == "aws_secret_key = [SECRET]\nx"
    assert "Zx81" not in masked[2] and "Zx81" not in masked[3]


def test_op9_elements(spark):
    key = "Zx81kPq90LmN2"
    texts = [f"<a><db_password>{key}</db_password></a>", f"<auth_key kind='x'>\n {key} </auth_key>", f'<add key="db_password" value="{key}"/>', f'<property name="db_password">{key}</property>', f"<title>{key}</title>"]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(spark, texts)).collect()}
    masked = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts[:4]):
        a = t.index(key)
        assert f"pair:{a}:{a + len(key)}" in got[i].split(",") and masked[i] == t.replace(key, "[SECRET]"), i
    assert got[4] == "" and masked[4] == texts[4]


def test_op9_lexer(spark):
    """Each form gives its literal, whole; what looks like one of them but isn't is left alone."""
    key = "Zx81kPq90LmN2"
    forms = [
        ('db_pwd = """' + key + '"""', [key]), ("db_pwd = '''\n" + key + "'''", ["\n" + key]), ('auth_key = "Zx81" + "kPq90LmN2"', ['Zx81" + "kPq90LmN2']),
        ('auth_key = ("Zx81kPq9"\n  "0LmN2abc")', []), ('auth_key = "Zx81kPq9" +\n    "0LmN2abc"', ['Zx81kPq9" +\n    "0LmN2abc']),
        (r'auth_key = "Zx81\"kPq90LmN2" + x', [r'Zx81\"kPq90LmN2']), (f'set_pwd("{key}")', [key]), (f"os.environ['DB_PWD'] = '{key}'", [key]),
        (f"auth_key = cfg\nother = 1\ncfg = '{key}'", [key]), (f"cfg = '{key}'\nmid = cfg\nauth_key = mid", [key]), (f"auth_key: str = '{key}'", [key]),
        (f"# auth_key = {key}\nx = 1", [key]), (f"auth_key = # {key}", []), (f'print("{key}")', []), (f"if auth_key == '{key}':", []), (f"auth_key = `{key}`", [key]),
        (f"const auth_key = '{key}'; // '{key}'", [key]), ("auth_key = Zx81/kPq+90LmN2==", ["Zx81/kPq+90LmN2=="]),
    ]
    block = "-----BEGIN RSA PRIVATE KEY-----\nAbC\n-----END RSA PRIVATE KEY-----"
    forms.append((f"x\n{block}\ny", [block]))
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs_of(spark, [t for t, _ in forms])).collect()}
    for i, (text, want) in enumerate(forms):
        found = [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[i].split(",") if x]
        assert found == want, (text, found)


def test_op9_lexer_in_prose_lists_and_calls():
    key = "Zx81kPq90LmN2"
    forms = [
        (f"Don't set db_passphrase = '{key}' in the sites' file", [key]), (f'print "{"x" * 300}", db_passphrase = "{key}"', [key]), (f"passphrases = ['{key}', '{key}9']", [key, key + "9"]),
        (f"set_passphrase(\n    '{key}')", [key]), (f"passphrase = os.environ.get('PP', '{key}')", [key]), ("passphrase = os.environ.get('PP')", []), (f"auth_key = b'{key}'", [key]),
        (f'5" disk, auth_key = "{key}"', [key]),
    ]
    for text, want in forms:
        found = [text[a:b] for a, _, b in secrets.scan(text, text.encode())[1]]
        assert found == want, (text, found)


def test_op9_is_linear_in_chains_and_blocks():
    import time

    chain = "v0 = 'Zx81kPq90LmN2'\n" + "".join(f"v{k + 1} = v{k}\n" for k in range(2000)) + "auth_key = v2000\n"
    blocks = "-----BEGIN RSA PRIVATE KEY-----\n" * 4000
    began = time.process_time()
    assert [chain[a:b] for a, _, b in secrets.scan(chain, chain.encode())[1]] == ["Zx81kPq90LmN2"]
    assert secrets.scan(blocks, blocks.encode())[1] == []
    assert time.process_time() - began < 2


@settings(max_examples=200, deadline=None)
@given(st.text("ab_k=:\"'`#/*\\\n ()[]+{}", max_size=60))
def test_op9_lexer_ends(text):
    """Any text is read to its end, and every pair's literal lies where it says."""
    for a, b, name, literal in secrets.pairs(text):
        assert 0 <= a <= b <= len(text) and name
        if "\\" not in text and '"' not in literal and b - a == len(literal):
            assert text[a:b] == literal


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-3, 3, allow_nan=False), max_size=25))
def test_op10_best_segment(scores):
    hits = [(i, s) for i, s in enumerate(scores)]
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    found = toxicity.segments(hits, 0.0)
    assert abs(max((x[0] for x in found), default=0) - max(best, 0)) < 1e-9
    assert all(a[2] < b[1] for a, b in zip(found, found[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_op10_all_maximal_segments(scores):
    """By definition: take the best run (the first, then the shortest), then the same left and right of it."""

    def by_hand(lo, hi):
        runs = [(-sum(scores[i : j + 1]), j - i, i, j) for i in range(lo, hi) for j in range(i, hi)]
        if not runs or min(runs)[0] >= 0:
            return []
        total = min(runs)[0]
        # of equal sums the shortest, so that no segment begins or ends with a part of sum 0
        _, _, i, j = min(x for x in runs if x[0] == total)
        return [*by_hand(lo, i), (-total, i, j), *by_hand(j + 1, hi)]

    found = toxicity.segments(list(enumerate(map(float, scores))), 0.0)
    assert sorted(x for x, _, _ in found) == sorted(x for x, _, _ in by_hand(0, len(scores)))
    assert all(sum(scores[i : j + 1]) == x for x, i, j in found)


def test_op10_lists_significant_segments():
    """Two passages far apart are both listed; a weak word that chance brings isn't."""
    model = toxicity.Model({b"vile": 4.0, b"odd": 0.6}, rate=1.0, log_k=-2.0, weights=np.array([-3.0, 1.0, 0.0]))
    text = " ".join(["so"] * 30 + ["vile"] * 3 + ["so"] * 200 + ["odd"] + ["so"] * 200 + ["vile"] * 4)
    n, best, rest, count, first, last, listed = model.measure(text.encode())
    assert (n, best, count, first, last) == (438, 16.0, 2, 434, 437) and rest == pytest.approx(12.6)
    assert [x[:3] for x in listed] == [(30, 32, 12.0), (434, 437, 16.0)]
    assert [x[3] for x in listed] == [pytest.approx(438 * math.exp(-2 - s)) for s in (12, 16)]
    assert model.measure(b"")[3:] == (0, -1, -1, [])


def test_op10_calibration(spark):
    """The curve is monotonic in the evidence, and the law's moments come back from scores drawn by it."""
    model = toxicity.Model(rate=1.3, log_k=-1.0, weights=np.array([-2.0, 0.8, 0.1]))
    p = model.probability(np.full(5, 100.0), np.array([0.0, 2.0, 4.0, 8.0, 16.0]), np.zeros(5))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_op10_held_out(spark):
    bad = ["vile", "scumlike", "wretchedly"]
    texts, labels = [], []
    for i in range(400):
        w = prose(60).split()
        if i % 4 == 0:
            for k in range(3):
                w.insert(int(rng.integers(0, 60)), bad[k])
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs_of(spark, texts)
    got = toxicity.score(d, toxicity.fit(d, lab, common.fold(4) != 2)).toPandas().set_index("doc_id").score
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97


def test_odd_rows(spark, odd, empty, no_labels):
    """Every operator takes odd rows and empty tables; results have a row for each row where the contract says so."""
    n = odd.count()
    trees = quality.fit(odd, no_labels)
    bench = spark.createDataFrame([(1, "some words of an item that nobody has")], "item_id long, text string")
    for d, size in ((odd, n), (empty, 0)):
        t = common.texts(d)
        assert substrings.remove_repeats(t).count() == size
        assert quality.score(d, trees).count() == size
        assert jaccard.similar_sets(t, 3, 0.9).count() == size
        assert langid.identify(d, langid.fit(d)).count() == size
        assert secrets.find_secrets(d).count() == size
        assert toxicity.score(d, toxicity.fit(d, no_labels)).count() == size
        rows = t.withColumn("held_out", common.fold(5) == 1)
        assert lm.score(rows, lm.fit(rows.where("not held_out"))).count() == size
        assert decontaminate.leaks(t, bench).count() == 0
        chunks.repeated_passages(t).count()
        mixing.mix(d).count()
        assert set(d.columns) <= set(mixing.mix(d).columns)
        assert quality.keep_good(d, no_labels).columns == secrets.redact(d).columns == d.columns
    got = {r.doc_id: r for r in substrings.remove_repeats(common.texts(odd)).collect()}
    assert got[7].n_removed == 1300 and got[3].n_removed == got[3].n_bytes and got[6].n_removed == 1000
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.fit(odd)).collect()}[1] == "und"
