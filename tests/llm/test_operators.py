"""Each operator against a plain count on the smallest sample and on hand-made rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartsight.llm import (
    bwt_dedup,
    decontam,
    langid,
    mixing,
    pii,
    quality_gam,
    quality_rules,
    queries,
    rlz_dedup,
    sieve,
    simhash,
    toxicity,
)
from cartsight.llm.common import components, fold, fold_of, labelled_sample

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size int"
PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, "en", "a", None, 1.0, 1, 1),
    (2, "", "en", None, 0, 1.0, 1, 1),
    (3, " \n\t ", None, "a", 3, 1.0, 1, 1),
    (4, PASSAGE, "en", "b", 9, None, None, None),
    (4, PASSAGE, "en", "b", 9, None, None, None),
    (5, "before " + PASSAGE + " after", "fr", "b", 9, 1.0, 1, 1),
    (None, PASSAGE, "en", "b", 9, 1.0, 1, 1),
    (None, PASSAGE, "en", "b", 9, 1.0, 1, 1),
    (7, "ü ß 1 2 3", "de", "c", 9, 1.0, 1, 1),
    (8, "long " * 200_000, "en", "c", 9, 1.0, 1, 1),
    (9, "12345 678", "xx", "c", 9, 1.0, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- 1: quality rules --------------------------------------------------------------------------


def test_base_figures_by_hand(spark, texts):
    found = {r.doc_id: r for r in queries.op1_quality_rules(spark, BIG).collect()}
    assert len(found) == len(texts)
    for doc, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        again = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words),
            sum(map(len, words)),
            sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)),
            len(again),
        )
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(20):
        scores, moves = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max((tuple(m >> i & 1 for i in range(6)) for m in range(64)), key=value)
        assert tuple(quality_rules.viterbi(scores, moves)) == best


def test_crf_separates_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = queries.op1_quality_rules(spark, "/root/testdata/sf0.1").where("n_words >= 50 AND NOT base_failed")
    both = kept.join(labels, "doc_id").where(fold("doc_id", 4) == 2).groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in both}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.7


def test_quality_rules_on_odd_rows(spark, odd, nothing):
    chosen = spark.createDataFrame([], "doc_id long, y int")
    found = quality_rules.judge(odd, chosen)
    assert found.count() == len(ODD)
    assert [r.base_failed for r in found.where("doc_id IN (1, 2, 3)").collect()] == [True] * 3
    assert quality_rules.judge(nothing, chosen).count() == 0


# --- 2: SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """prints: (id, fingerprint) by id; the smallest id that each reaches."""
    root = list(range(len(prints)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [prints[top(i)][0] for i in range(len(prints))]


def test_simhash_against_all_pairs(spark, texts):
    found = sorted(rows_of(queries.op2_simhash(spark, BIG), "doc_id", "fingerprint", "component_id"))
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    assert found == [(d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints), strict=True)]


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_slices_count_as_bits_do(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = np.concatenate([base[i % 3] ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, 3)]) for i in range(300)], axis=None).astype(np.uint64)
    group = np.sort(rng.integers(0, 5, 300))
    found = {(i, j) for a, b in simhash.close_pairs(prints, group, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    wanted = {
        (i, j)
        for i in range(300)
        for j in range(i + 1, 300)
        if group[i] == group[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius
    }
    assert found == wanted


def test_crowded_bands_are_cut_into_blocks_without_loss(spark):
    rng = np.random.default_rng(4)
    prints = sorted({int(0xABCD << 48) | 0x111 ^ sum(1 << int(b) for b in rng.integers(0, 40, 4)) for _ in range(400)})
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    edges = simhash.links(df.select("fp"), block=37)
    joined = components(edges)
    root = dict(rows_of(joined, "node", "root"))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    wanted = plain_components(list(enumerate(prints)))
    groups = collections.defaultdict(set)
    for p, w in zip(signed, wanted, strict=True):
        groups[w].add(root.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({min(g) for g in groups.values()})


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(200, 201), (5, 5)], "a long, b long")
    root = dict(rows_of(components(edges), "node", "root"))
    assert {n: r for n, r in root.items() if n <= 100} == {i: 0 for i in range(1, 101)}
    assert root[201] == 200


def test_simhash_on_odd_rows(odd, nothing):
    found = simhash.components_of(odd)
    by = collections.defaultdict(list)
    for d, f, c in rows_of(found, "doc_id", "fingerprint", "component_id"):
        by[d].append((f, c))
    assert by[1] == by[2] == by[3] == [("0" * 16, 1)]
    assert by[4][0] == by[4][1] and by[4][0][1] == 4 and by[None][0][1] == 4
    assert simhash.components_of(nothing).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1
    assert kept.where("doc_id IN (1, 2, 3)").count() == 1
    assert simhash.first_of_each(nothing).count() == 0


def test_components_with_one_smallest_id_all_keep_a_row(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d)]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(rows_of(kept, "text", "doc_id"), key=str) == [(a, None), (b, None), (c, 7), (d, 7)]


# --- 3: mixing ---------------------------------------------------------------------------------


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{BIG}/documents.parquet')")
    wanted = sorted(con.execute(mixing.ORACLE).fetchall())
    found = queries.op3_mixing(spark, BIG)
    assert sorted(rows_of(found, "doc_id", "size", "source_size", "target", "taken")) == wanted


def test_targets_stop_at_three_times_the_source(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 10), ("z", 0)], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    assert found["a"] == 3 and found["z"] == 0 and found[None] <= 30
    assert sum(found.values()) == pytest.approx(211)


def test_positions_follow_the_schedule(spark):
    parts = spark.range(101).select((F.col("id") / 100.0).alias("p"))
    for schedule in mixing.SCHEDULES:
        found = [r[0] for r in parts.select(mixing.position(F.col("p"), schedule)).collect()]
        assert found == sorted(found) and found[0] == 0 and found[-1] == pytest.approx(1)
        grid = np.linspace(0, 1, 20001)
        due = np.interp(grid, *zip(*schedule, strict=True))
        total = np.r_[0, np.cumsum((due[1:] + due[:-1]) / 2)]
        assert np.allclose(found, np.interp(np.linspace(0, 1, 101), total / total[-1], grid), atol=1e-3)


def test_mixing_on_odd_rows(odd, nothing):
    found = mixing.mix(odd)
    assert found.count() == len(ODD)
    assert all(r.taken <= 3 * r["size"] for r in found.collect())
    assert {r.target for r in found.where("source IS NULL").collect()} == {0.0}
    assert mixing.in_order(mixing.mix(nothing)).count() == 0
    assert sorted(map(str, found.collect())) == sorted(map(str, mixing.mix(odd).collect()))


def test_words_due_follow_the_schedule_in_all_rounds(spark):
    rows = [(i, "a" if i < 100 else "b", "w " * 10) for i in range(500)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    goal = dict(rows_of(mixed.select("source", "target").distinct(), "source", "target"))
    assert goal["a"] == 3000 and goal["b"] == pytest.approx(2000)
    copies = mixed.select("source", "size", F.explode("positions").alias("at")).collect()
    grid = np.linspace(0, 1, 20001)
    for source, schedule in zip("ab", mixing.SCHEDULES, strict=False):
        due = np.interp(grid, *zip(*schedule, strict=True))
        total = np.r_[0, np.cumsum((due[1:] + due[:-1]) / 2)]
        for t in (0.25, 0.5, 0.75, 1):
            words = sum(r["size"] for r in copies if r.source == source and r["at"] <= t)
            assert abs(words - goal[source] * np.interp(t, grid, total / total[-1])) <= 10


# --- 4, 9: classifiers -------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("query", "label", "least"),
    [(queries.op4_quality_gam, "quality", 0.98), (queries.op9_toxicity, "toxic", 0.96)],
)
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = query(spark, sf).join(labels, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] > least


def test_folds_and_samples(spark):
    ids = spark.range(100).select(F.col("id").alias("doc_id"), fold("id", 4).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 == fold_of(r.doc_id, 4) for r in ids.collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    some = labelled_sample(None, labels, "quality", 4, 2, 20).collect()
    assert len(some) == 20 and all(fold_of(r.doc_id, 4) != 2 and r.doc_id != 3 for r in some)


def test_classifiers_on_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (8, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for rows, n in ((odd, len(ODD)), (nothing, 0)):
            for found in (quality_gam.score(rows, labels), toxicity.score(rows, toxicity.fit(rows, labels))):
                assert found.count() == n
                assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found.collect())


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_gam.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.train(x[:2000], y[:2000], pair_rounds=60)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_non_negative_risk_finds_the_hidden_positives():
    rng = np.random.default_rng(0)
    common = [f"w{i}" for i in range(50)]
    def draw(toxic):
        return set(rng.choice(common, 8)) | ({"bad"} if toxic else set())
    unlabelled = [draw(i % 5 == 0) for i in range(500)]
    model = toxicity.train([draw(True) for _ in range(200)], unlabelled, 0.2)
    assert model.score("bad w1 w2") > 0.5 > model.score("w1 w2 w3")


# --- 5: language -------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op5_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_slopes_of_the_network():
    model = langid.new_model(["a", "b", "c"], hidden=3)
    for name in ("x", "u"):
        setattr(model, name, [p.astype(np.float64) for p in getattr(model, name)])
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    windows, there = langid.packed([b"hello", b"abcabc", b"x"], 6)
    y = np.array([0, 1, 2])
    _, slopes = langid.loss_and_slopes(model, windows, there, y)
    rng = np.random.default_rng(0)
    for p, g in zip(model.parameters(), slopes, strict=True):
        for _ in range(5):
            at = tuple(rng.integers(s) for s in p.shape)
            if p.shape == model.x[0].shape:
                at = (at[0], int(windows[0, 0]))
            old, step = p[at], 1e-4
            p[at] = old + step
            up = langid.loss_and_slopes(model, windows, there, y)[0]
            p[at] = old - step
            down = langid.loss_and_slopes(model, windows, there, y)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-4)


def test_language_on_odd_rows(odd, nothing):
    model = langid.fit(odd, rounds=5)
    found = langid.predict(odd, model)
    assert found.count() == len(ODD)
    by = {r.doc_id: r for r in found.collect()}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 9))
    assert langid.accepted(odd, model).columns == odd.columns
    empty = langid.fit(nothing)
    assert langid.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


# --- 6, 7: repeated strings and passages -------------------------------------------------------


def plain_repeats(docs, window):
    """docs: (id, tokens), any order; flags of the tokens that go."""
    first = {}
    for d, s in docs:
        for i in range(len(s) - window + 1):
            key = s[i : i + window]
            first[key] = min(d, first.get(key, d))
    out = []
    for d, s in docs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if first[s[i : i + window]] < d:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def test_bytes_against_all_strings(spark, texts):
    found = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, BIG).collect()}
    docs = [(d, t.encode()) for d, t in texts]
    for (d, s), gone in zip(docs, plain_repeats(docs, 50), strict=True):
        rest = bytes(c for c, g in zip(s, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        wanted = (len(s), sum(gone), spans, hashlib.sha256(rest).hexdigest())
        assert (found[d].n_bytes, found[d].n_removed, found[d].n_spans, found[d].kept_sha256) == wanted
    assert len(found) == len(docs)


def test_words_against_all_windows(spark, texts):
    found = {r.doc_id: r for r in queries.op7_substring_dedup(spark, BIG).collect()}
    docs = [(d, tuple(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t in texts]
    for (d, s), gone in zip(docs, plain_repeats(docs, 13), strict=True):
        rest = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        wanted = (len(s), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
        assert (found[d].n_words, found[d].n_removed, found[d].kept_sha256) == wanted


@pytest.mark.parametrize("name", ["op6_suffix_dedup", "op7_substring_dedup"])
def test_repeats_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{BIG}/documents.parquet')")
    wanted = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, BIG)
    assert set(found.columns) == set(columns)
    assert sorted(rows_of(found, *columns)) == sorted(wanted.fetchall())


@pytest.mark.parametrize("crowd", [0, 30])
@pytest.mark.parametrize(("operator", "window"), [(bwt_dedup, 50), (rlz_dedup, 13)])
def test_crowded_anchors_lose_nothing(spark, operator, window, crowd):
    """A short common phrase in ever new surroundings, beside passages that do repeat."""
    short = "the common phrase that everyone likes to"
    rng = np.random.default_rng(3)
    docs = []
    for i in range(240):
        draw = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
        near = " ".join(f"n{k}" for k in rng.integers(0, 2, 4))
        docs.append((i, f"{draw(6)} {near} {short} {near} write {draw(6)} {PASSAGE[: 40 * (i % 5)]}"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    tokens = [(d, tuple(t.split()) if operator is rlz_dedup else t.encode()) for d, t in docs]
    found = {r.doc_id: r for r in operator.removed(df, crowd=crowd).collect()}
    wanted = {d: sum(gone) for (d, _), gone in zip(tokens, plain_repeats(tokens, window), strict=True)}
    assert {d: r.n_removed for d, r in found.items()} == wanted
    assert sum(wanted.values()) > 1000
    for (d, s), gone in zip(tokens, plain_repeats(tokens, window), strict=True):
        rest = [c for c, g in zip(s, gone, strict=True) if not g]
        plain = " ".join(rest).encode() if operator is rlz_dedup else bytes(rest)
        assert found[d].kept_sha256 == hashlib.sha256(plain).hexdigest()


def test_crowded_anchors_are_spread(spark):
    """No owner gets more than a small part of the surroundings of one anchor."""
    short = "the common phrase that everyone likes to"
    texts = [f"before {i * 7919} {short} after {i * 104729} and on it goes".encode() for i in range(2000)]
    kind = sieve.Kind(50, 24, "u1", 1, bwt_dedup._bytes, bwt_dedup.first_documents)
    tokens, counts = kind.tokens(texts)
    ends = np.cumsum(counts)
    batch = sieve.Batch(np.arange(len(texts)), texts, tokens, ends, ends - counts)
    _, _, values, owner, _ = sieve._distinct(kind, batch, 64)
    def largest(flag):
        answers = []
        for o in np.unique(owner):
            n = int((owner == o).sum())
            answers.append({"owner": int(o), "m": np.packbits(np.ones(n, bool)).tobytes() + np.packbits(np.full(n, flag)).tobytes()})
        found = sieve._shared(kind, batch, 64, answers)
        return np.bincount(found.owner, minlength=64).max() / len(found.owner)
    assert largest(True) < 0.05 < largest(False)


def test_transform_sorts_suffixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 4, (30, 20))
    used = rng.integers(1, 21, 30)
    symbols, left, place = bwt_dedup.transform(rows, used)
    suffix = lambda p: (rows[p // 21, p % 21 : used[p // 21]].tolist() + [0], p // 21)
    keys = [suffix(p) for p in place.tolist()]
    assert keys == sorted(keys) and len(keys) == (used + 1).sum()
    assert all(symbols[r] == (0 if p % 21 == 0 else rows[p // 21, p % 21 - 1]) for r, p in enumerate(place.tolist()))
    assert all(place[left[r]] == p - 1 for r, p in enumerate(place.tolist()) if p % 21)


@pytest.mark.parametrize("operator", [bwt_dedup, rlz_dedup])
def test_repeats_on_odd_rows(operator, odd, nothing):
    found = operator.removed(odd)
    assert found.count() == len(ODD)
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r.n_removed)
    assert by[1] == by[2] == by[3] == [0] and by[4] == [0, 0] and by[8] == [0]
    n = 60 if operator is rlz_dedup else len(PASSAGE)
    # the byte string also takes in the spaces beside the passage where these are the same
    assert by[5][0] == n and by[None] == [n, n]
    assert operator.removed(nothing).count() == 0


# --- 8: decontamination ------------------------------------------------------------------------


def index_of(items):
    parts = [(i, w[k : k + decontam.PART]) for i, t in items for w in [decontam.words_of(t)] for k in range(0, len(w), decontam.PART)]
    df = collections.Counter(w for _, p in parts for w in set(p))
    return decontam.build(parts, items, df, len(parts), sum(len(p) for _, p in parts) / len(parts)), parts


def test_wand_finds_all_above_the_threshold(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").select("item_id", "text").collect()]
    index, parts = index_of(items)
    docs = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for threshold in (0.2, 0.5):
        words = [decontam.words_of(t) for t in docs]
        found = index.passages(words, threshold)
        for mine, w in zip(found, words, strict=True):
            wanted = {}
            for start in range(0, max(1, len(w) - decontam.STEP), decontam.STEP):
                terms = set(w[start : start + decontam.PASSAGE])
                for number, (item, _) in enumerate(parts):
                    score = sum(x for t in terms & index.top.keys() for a, x in zip(*index.postings[t], strict=True) if a == number)
                    if score >= threshold:
                        wanted[item] = max(score, wanted.get(item, 0))
            assert mine == pytest.approx(wanted)


def test_decontamination_finds_the_items_in_texts(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").select("item_id", "text").collect()]
    found = set(rows_of(queries.op8_decontamination(spark, BIG), "doc_id", "item_id"))
    assert {(d, i) for d, t in texts for i, q in items if q in t} <= found
    five = {i: decontam.shingles(decontam.words_of(q)) for i, q in items}
    by_id = dict(texts)
    assert all(len(five[i] & decontam.shingles(decontam.words_of(by_id[d]))) >= 0.8 * len(five[i]) for d, i in found)


def test_decontamination_on_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (None, PASSAGE), (3, ""), (4, "never. seen here")], "item_id long, text string")
    found = decontam.contaminated(odd, items)
    assert set(rows_of(found, "doc_id", "item_id")) == {(4, 1), (5, 1), (None, 1)}
    assert decontam.contaminated(nothing, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    clean = decontam.clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 5
    assert decontam.clean(odd, items.limit(0)).count() == len(ODD)


# --- 10: personal data -------------------------------------------------------------------------


def plain_spans(text):
    def digits(t):
        return re.sub("[^0-9]", "", t)

    def luhn(d):
        return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15),
    )
    found = [
        (m.start(), k, m.end(), name)
        for k, (name, pattern, good) in enumerate(kinds)
        for m in re.finditer(pattern, text)
        if good(m.group())
    ]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


HARD = [
    "", "a@b.c_d@e.f x@y..z me@host", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111",
    "4111 1111  1111 1111 41111111111111111111111", "+1 (555) 010-9999 ++49 30 1234567 +12", "ü@x.de 😀 a.b@c.de😀 +1 (212) 555-0100",
    "1 " * 3000 + "4111111111111111", "a" * 20000 + "@", "9" * 5000 + ".1.1.1", "x@a.b@c.d 1.1.1.1@a.b", "﷐" + "4111111111111111﷐" + "1",
]


def test_spans_against_plain_search(spark, texts):
    rows = [*texts, *((-1 - i, t) for i, t in enumerate(HARD))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(df).collect()}
    for d, t in rows:
        wanted = plain_spans(t)
        assert found[d].base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), t[:80]
        assert set(wanted) <= set(found[d].spans.split(",")) | {""}
        counts = collections.Counter(s.split(":")[0] for s in wanted)
        assert [found[d][f"n_{k}"] for k in pii.KINDS] == [counts[k] for k in pii.KINDS]


def test_telling_terms_are_generalised(spark):
    rows = [(i, f"call zorblax now joe{'.' * i} at joe@zorb.com the end {i}") for i in range(8)]
    rows += [(100 + i, f"the plain text number {i} has call and now and at and end") for i in range(200)]
    rows += [(300, None), (None, "the zorblax of joe@zorb.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]["doc_id"]: r for r in pii.sanitised(df).collect()}
    assert "[EMAIL]" in found[1].text and "[TERM]" in found[1].text and "zorblax" not in found[1].text
    assert "the end" in found[1].text and found[105].text == dict(rows)[105]
    assert found[300].text is None and found[300].spans == ""
    assert found[None].text == "the zorblax of [EMAIL]"


def test_terms_of_rare_entities_are_generalised(spark):
    rows = [(None if i == 0 else i, f"see quorvex and plain at joe@zorb.com number {i}") for i in range(3)]
    rows += [(10 + i, f"team vexil has {name}@rare.org on board") for i, name in enumerate(("al", "bo", "cy", "di"))]
    rows += [(100 + i, f"see and plain at number has on board once{'x' * (i % 7)} {i}") for i in range(2500)]
    rows += [(5000, "the word quirk is once near jim@solo.net")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]["doc_id"]: r.text for r in pii.sanitised(df, null_ids=True).collect()}
    assert found[1] == "see [TERM] and plain at [EMAIL] number 1"
    assert found[None] == "see [TERM] and plain at [EMAIL] number 0"
    assert found[10] == "[TERM] [TERM] has [EMAIL] on board"
    assert found[5000] == "the word quirk is once near [EMAIL]"
    digest = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert digest[None] == "term:4:11,email:25:37"


def test_personal_data_on_odd_rows(odd, nothing):
    found = pii.sanitised(odd)
    assert found.count() == len(ODD) and pii.sanitised(nothing).count() == 0
    assert found.select("row.*").columns == odd.columns


# --- short texts, hot ids, times of copies -----------------------------------------------------


def test_positions_equal_sql_and_depend_on_the_schedule(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{BIG}/documents.parquet')")
    columns = ["doc_id", "size", "source_size", "target", "taken", "position", "last_position"]
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.POSITIONS_ORACLE})").fetchall()
    found = rows_of(queries.op3_mixing(spark, BIG), *columns)
    assert sorted(found) == sorted(wanted)
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    flat = mixing.mix(docs, schedules=(((0.0, 1.0), (1.0, 1.0)),)).select("doc_id", F.round("position", 9)).collect()
    assert len(set(map(tuple, flat)) & {(r[0], r[5]) for r in found}) < 0.6 * len(found)


def test_one_id_on_very_many_rows_is_spread(spark, settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two").alias("text"))
    mixed = mixing.mix(rows)
    assert mixed.agg(F.sum("taken")).first()[0] == 200_000
    assert mixed.groupBy(F.spark_partition_id()).count().count() > 1
    assert mixed.select("position").distinct().count() == 100_000


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize(("size", "least"), [(10, 0.9), (20, 0.9), (30, 0.95), (50, 0.98), (63, 0.98)])
def test_language_of_short_texts(spark, language_model, size, least):
    """Held-out texts cut to a few bytes, which leaves most of a window empty."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = docs.where((fold("doc_id", 4) == 2) & (F.length("text") > 100) & F.col("lang").isNotNull()).select("text", "lang").collect()
    cut = [(r.text.encode()[:size].decode(errors="ignore"), r.lang) for r in held]
    cut = [(t, k) for t, k in cut if langid.has_letter(t)]
    means = langid.pooled(language_model, [t.encode() for t, _ in cut])
    right = sum(language_model.langs[b] == k for b, (_, k) in zip(means.argmax(axis=1), cut, strict=True))
    assert right / len(cut) > least


def test_padding_does_not_reach_the_network(language_model):
    """A text alone, and beside longer ones, has the probabilities of its own bytes."""
    texts = ["Über die Straße".encode(), b"x" * 200, "la école était".encode()]
    together = langid.pooled(language_model, texts)
    for text, found in zip(texts, together, strict=True):
        whole = np.zeros(len(language_model.langs))
        for at in range(0, len(text), langid.WINDOW):
            part = np.frombuffer(text[at : at + langid.WINDOW], np.uint8)[:, None]
            for _, p in langid.probabilities(language_model, part, np.ones(part.shape, np.float32)):
                whole += p[:, 0]
        assert found == pytest.approx(whole / len(text), abs=1e-5)


def test_gru_step_by_hand():
    model = langid.new_model(["a", "b"], hidden=3)
    x, u = model.x[0].astype(float), model.u[0].astype(float)
    h = np.array([0.3, -0.2, 0.5])
    z, r = (1 / (1 + np.exp(-(x[k : k + 3, 65] + u[k : k + 3] @ h))) for k in (0, 3))
    n = np.tanh(x[6:9, 65] + r * (u[6:9] @ h))
    found = langid._step(model.x[0], model.u[0], np.array([65]), h[:, None].astype(np.float32))[0]
    assert found[:, 0] == pytest.approx((1 - z) * n + z * h, abs=1e-5)


def test_letters_are_of_category_l(spark, language_model):
    rows = [(i, t) for i, t in enumerate(["½", "²", "①", "Ⅷ", "12 _ #", "", None, "中"])]
    found = dict(rows_of(langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), language_model), "doc_id", "lang_pred"))
    assert [found[i] for i in range(7)] == ["und"] * 7 and found[7] != "und"


def test_training_rows_are_bounded_where_ids_repeat(spark):
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.lit("all the same words").alias("text"))
    other = spark.range(40).select((F.col("id") * 4 + 100).alias("doc_id"), F.lit("de").alias("lang"), F.lit("über und außer dem").alias("text"))
    model = langid.fit(hot.unionByName(other), per_lang=5, rounds=3)
    assert model.langs == ["de", "en"]


def test_any_two_close_fingerprints_share_a_key(spark):
    rng = np.random.default_rng(6)
    for radius in (0, 1, 2, 3):
        for _ in range(200):
            a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
            b = a
            for bit in rng.permutation(64)[:radius]:
                b ^= 1 << int(bit)
            shared = [
                all((a ^ b) >> lo & ((1 << size) - 1) == 0 for lo, size in bits) for bits in simhash.block_keys(radius)
            ]
            assert any(shared)
    assert len(simhash.block_keys(3)) == 20 and min(sum(n for _, n in bits) for bits in simhash.block_keys(3)) >= 31


def test_few_random_fingerprints_meet(spark):
    """Of 100,000 random fingerprints, a thousandth of the pairs meet that four bands would compare."""
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 100_000, dtype=np.uint64)

    def pairs(keys):
        total = 0
        for bits in keys:
            key = np.zeros(len(prints), np.uint64)
            for lo, size in bits:
                key = key << np.uint64(size) | prints >> np.uint64(lo) & np.uint64((1 << size) - 1)
            n = np.unique(key, return_counts=True)[1].astype(float)
            total += (n * (n - 1) / 2).sum()
        return total

    assert 1000 * pairs(simhash.block_keys(3)) < pairs([[(lo, 16)] for lo in range(0, 64, 16)])


# --- the factors and the transforms decide -----------------------------------------------------


def random_block(seed, width, letters, copies):
    """Rows [n, width] with pieces of each other, which of their tokens exist, and their documents."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(1, letters, (60, width))
    for _ in range(copies):
        a, b = rng.integers(0, 60, 2)
        n = int(rng.integers(width // 3, width + 1))
        i, j = rng.integers(0, width - n + 1, 2)
        rows[a, i : i + n] = rows[b, j : j + n]
    first, last = rng.integers(0, 3, 60), width - rng.integers(0, 3, 60)
    inside = (np.arange(width) >= first[:, None]) & (np.arange(width) < last[:, None])
    return rows, inside, rng.integers(0, 40, 60)


def plain_first(rows, inside, docs, window):
    starts = rows.shape[1] - window + 1
    least = {}
    for r in range(len(rows)):
        for s in range(starts):
            if inside[r, s : s + window].all():
                key = tuple(rows[r, s : s + window])
                least[key] = min(least.get(key, docs[r]), docs[r])
    out = np.repeat(docs[:, None], starts, axis=1)
    for r in range(len(rows)):
        for s in range(starts):
            if inside[r, s : s + window].all():
                out[r, s] = least[tuple(rows[r, s : s + window])]
    return out


def word_block(seed):
    rows, inside, docs = random_block(seed, 21, 3 if seed % 2 else 50, 60)
    return np.where(inside, rows, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), inside, docs


def byte_block(seed):
    rows, inside, docs = random_block(seed, 76, 3 if seed % 2 else 200, 60)
    return np.where(inside, rows, 0).astype(np.uint8), inside, docs


@pytest.mark.parametrize("seed", range(6))
def test_first_documents_of_a_block(seed):
    for operator, block, window in ((rlz_dedup, word_block(seed), 13), (bwt_dedup, byte_block(seed), 50)):
        rows, inside, docs = block
        wanted = plain_first(rows, inside, docs, window)
        assert (wanted < docs[:, None]).sum() > 20
        assert (operator.first_documents(rows, inside, docs) == wanted).all()


def test_a_broken_factoring_changes_the_result(monkeypatch):
    blocks = [word_block(seed) for seed in range(4)]
    wanted = [rlz_dedup.first_documents(*b) for b in blocks]
    monkeypatch.setattr(rlz_dedup.ReferenceBlock, "longest", lambda self, row, start, docs: np.zeros(len(row), np.int64))
    for b, w in zip(blocks, wanted, strict=True):
        broken = rlz_dedup.first_documents(*b)
        assert (broken == b[2][:, None]).all() and (w != broken).sum() > 20


def test_a_permuted_transform_changes_the_result(monkeypatch):
    blocks = [byte_block(seed) for seed in range(4)]
    monkeypatch.setattr(bwt_dedup, "SHARD", 20)
    wanted = [bwt_dedup.first_documents(*b) for b in blocks]
    sorted_transform, calls = bwt_dedup.transform, []

    def permuted(strings, used):
        parts = sorted_transform(strings, used)
        calls.append(len(parts[0]))
        if len(calls) % 3 != 1:
            return parts
        order = np.random.default_rng(1).permutation(len(parts[0]))
        return tuple(p[order] for p in parts)

    monkeypatch.setattr(bwt_dedup, "transform", permuted)
    assert all((bwt_dedup.first_documents(*b) != w).any() for b, w in zip(blocks, wanted, strict=True))


def test_ranks_lead_left_and_prefixes_are_common():
    rng = np.random.default_rng(3)
    rows, used = rng.integers(1, 3, (24, 30)), rng.integers(1, 31, 24)
    shards = [bwt_dedup.transform(rows[i : i + 8], used[i : i + 8]) for i in (0, 8, 16)]
    for symbols, left, _ in shards:
        real = symbols != 0
        assert (bwt_dedup.step_left(symbols)[real] == left[real]).all()
    _, _, prefix = bwt_dedup.merge([s[0] for s in shards], 12)
    suffixes = []
    for k, (_, _, place) in enumerate(shards):
        for p in place.tolist():
            r, c = divmod(p, 31)
            suffixes.append(tuple(rows[8 * k + r, c : used[8 * k + r]].tolist()))
    for mine, found in zip(suffixes, prefix.tolist(), strict=True):
        shared = 0
        while shared < min(12, len(mine)) and sum(s[: shared + 1] == mine[: shared + 1] for s in suffixes) > 1:
            shared += 1
        assert found == shared


# --- training samples are bounded in rows ------------------------------------------------------


def test_samples_hold_one_row_for_each_id(spark, monkeypatch):
    """One sampled id stands on 50,000 rows; what the driver collects stays within the bound."""
    hot = spark.range(50_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("hot text "), F.col("id") % 100).alias("text"))
    rest = spark.range(4, 300).select(F.col("id").alias("doc_id"), F.lit("some other words\nand a line").alias("text"))
    docs = hot.unionByName(rest)
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    chosen = labelled_sample(docs, labels, "quality", 4, 2, 400)
    assert 3 in {r.doc_id for r in chosen.collect()}
    found = quality_rules.training_lines(docs, chosen)
    assert 0 < len(found) <= 300
    seen = []
    monkeypatch.setattr(quality_gam, "train", lambda x, y: seen.append(len(x)))
    quality_gam.fit(quality_gam.featured(docs), labels, most=400)
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.append(max(len(p), len(u))))
    toxicity.fit(docs, labels)
    assert all(0 < n <= 300 for n in seen) and len(seen) == 2


def test_contradicting_labels_are_learned_by_nobody(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(7, 0), (8, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.append(p))
    toxicity.fit(docs, labels)
    words = {w for x in seen[0] for w in x}
    texts = {r[0] for r in labelled_sample(docs, labels, "toxic", 5, 0, 99, only=1).collect()}
    assert len(seen[0]) == len(texts) and not {7, 8} & texts and words == {"word"}


def test_long_documents_are_learned_from_all_over():
    lines = [[float(i)] for i in range(5000)]
    chunks = quality_rules._chunks(lines)
    assert sum(map(len, chunks)) == quality_rules.TRAIN_LINES
    assert chunks[0][0] == [0.0] and chunks[-1][-1] == [4999.0] and all(c == lines[int(c[0][0]) :][: len(c)] for c in chunks)
    assert quality_rules._chunks(lines[:10]) == [lines[:10]] and quality_rules._chunks([]) == []


# --- boilerplate beside content ----------------------------------------------------------------


def mixed_texts(seed, n):
    """(text, quality, truth by line): good texts, and low ones of menus and slogans around some content."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 10)))
    content = lambda: " ".join(word() for _ in range(rng.integers(8, 20))).capitalize() + "."
    junk = lambda: rng.choice([" | ".join(word() for _ in range(8)), " ".join(word().upper() + "!!" for _ in range(7)), "#" * 6 + " $ " + word()])
    out = []
    for i in range(n):
        if i % 2:
            lines = [(content(), 1) for _ in range(rng.integers(3, 15))]
        else:
            lines, kind = [], 0
            for _ in range(rng.integers(8, 30)):
                kind = kind if rng.random() < 0.8 else 1 - kind
                lines.append((content() if kind else junk(), kind))
            lines += [(junk(), 0)] * max(0, 2 * sum(k for _, k in lines) - len(lines))
        out.append(("\n".join(t for t, _ in lines), i % 2, [k for _, k in lines]))
    return out


def test_boilerplate_is_found_by_line():
    sequences = [(np.array([f for _, f in quality_rules._lines(t.encode())]), y) for t, y, _ in mixed_texts(1, 300)]
    weights, moves = quality_rules.train_crf(sequences, rounds=160)
    hit = extra = lost = 0
    for text, y, truth in mixed_texts(2, 100):
        path = quality_rules.viterbi(np.array([f for _, f in quality_rules._lines(text.encode())]) @ weights.T, moves)
        assert len(path) == len(truth)
        hit += sum(a == b == 0 for a, b in zip(path, truth, strict=True))
        extra += sum(a < b for a, b in zip(path, truth, strict=True))
        lost += sum(a > b for a, b in zip(path, truth, strict=True))
    assert 2 * hit / (2 * hit + extra + lost) > 0.9


def test_marginals_by_hand():
    rng = np.random.default_rng(4)
    unary, moves = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2))
    there = np.array([[True] * 4 + [False]])
    node, pair = quality_rules._marginals(unary, moves, there)
    paths = [tuple(m >> i & 1 for i in range(4)) for m in range(16)]
    weight = {p: np.exp(sum(unary[0, i, k] for i, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths}
    z = sum(weight.values())
    for t in range(4):
        assert node[0, t, 1] == pytest.approx(sum(w for p, w in weight.items() if p[t] == 1) / z)
    assert pair[0, 1, 0, 1] == pytest.approx(sum(w for p, w in weight.items() if p[1:3] == (0, 1)) / z)
    assert not node[0, 4].any() and not pair[0, 3].any()
    tilted, _ = quality_rules._guessed(unary - [0, 9], moves * 0, there, 0.5)
    assert tilted[0, :, 0].sum() >= 2
    tilted, _ = quality_rules._guessed(unary + [0, 9], moves * 0, there, 0.5)
    assert tilted[0, :, 0].sum() == pytest.approx(2, abs=0.05)


def test_some_texts_hold_both(spark):
    found = queries.op1_quality_rules(spark, "/root/testdata/sf0.1").where("NOT base_failed")
    both = found.where("content_share > 0 AND content_share < 1").count()
    assert both > 0 and both < 0.5 * found.count()
