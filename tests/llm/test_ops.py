"""The training-data operators against brute force, exact round trips and held-out labels, with the odd rows each must take."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, quality, repetition, toxicity, urls, warc
from corpusloom.llm.common import Scratch
from corpusloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 3), (4, long, "en", "b", len(long)), (5, long.upper(), "en", "b", len(long)),
        (6, "one", "en", "a", 3), (7, "One", "en", None, 3), (8, "Ünï ⟨ÇA⟩ 中文 🙂 e\u0301 \u00a0x", "fr", "a", 9), (None, "one two three four five", "en", "a", 1), (9, "one two three four five", None, "a", 1),
        (10, "dup row", "en", "a", 7), (10, "dup row", "en", "a", 7), (11, "a\nb\n\nc d e f g\na", "en", "c", 5),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# Exact dedup


def digest(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return hashlib.sha256((text or "").translate(str.maketrans(upper, upper.lower())).encode()).hexdigest()


def test_exact_dedup_matches_groups(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, rng.choice(["Same", "same", "SAME!", f"t{i}"]), "en", "a", 1) for i in range(300)]
    got = exact_dedup.exact_dedup(spark, frame(spark, rows).withColumn("kept", F.lit("clash"))).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[digest(r[1])].append(r[0])
    want = [(i, max((x for x in groups[digest(t)] if x is not None), default=None), len(groups[digest(t)]), digest(t)) for i, t, *_ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(groups, 1)
    assert exact_dedup.exact_dedup(spark, frame(spark, [])).count() == 0


def test_exact_dedup_is_the_same_for_any_history(spark):
    rows = [(i, f"t{i % 7}", "en", "a", 1) for i in range(40)] + [(None, f"n{i % 2}", "en", "a", 1) for i in range(5)] + [(50, "t1", "en", "a", 1)] * 3
    told = lambda part: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text) for r in exact_dedup.exact_dedup(spark, frame(spark, rows), part).collect())
    base = told(None)
    for part in (F.lit(True), F.lit(False), F.col("doc_id") % 3 == 0, F.rand(1) < 0.5):
        assert told(part) == base
    assert sum(kept for _, _, _, kept, _ in base) == 9


def test_exact_dedup_is_decided_by_the_lookup(spark, monkeypatch, tmp_path):
    docs = [pd.DataFrame({"digest": [bytes([i]) * 32 for i in ids], "has": True, "top": top, "tops": 1, "n": 1}) for ids, top in (((1, 2, 3), 5), ((2, 3, 4), 9))]
    new, old = docs
    right = exact_dedup._probe(new, old)
    assert sorted(zip(right["digest"].str[0], right["top"], right["n"], strict=True)) == [(2, 9, 2), (3, 9, 2)]
    monkeypatch.setattr(exact_dedup.PerfectHash, "slots", lambda self, asked, slots=exact_dedup.PerfectHash.slots: slots(self, asked[::-1]))
    assert len(exact_dedup._probe(new, old)) < 2  # a slot that holds another digest makes no member


def test_perfect_hash_is_minimal_and_refuses_strangers():
    import numpy as np

    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), dtype=np.uint8).reshape(-1, 32)
    mph = exact_dedup.PerfectHash(keys[:4000])
    assert sorted(mph.slots(keys[:4000])) == list(range(4000)) and mph.n == 4000
    stored = np.empty((4000, 32), dtype=np.uint8)
    stored[mph.slots(keys[:4000])] = keys[:4000]
    strangers = mph.slots(keys[4000:])
    known = strangers >= 0
    assert not (stored[strangers[known]] == keys[4000:][known]).all(axis=1).any()
    assert exact_dedup.PerfectHash(keys[:0]).n == 0


# Near-dedup


def brute_components(rows, words, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        if i is not None:
            sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("words, limits", [(4, {}), (5, {}), (4, {"LIST": 2, "BLOCK": 8})])
def test_near_dedup_matches_brute_force(spark, monkeypatch, words, limits):
    for k, v in limits.items():  # long lists and small blocks, so that families are cut into many
        monkeypatch.setattr(near_dedup, k, v)
    rng = random.Random(words)
    rows, at = odd_rows(), 100
    for size in (4, 5, 6, 7, 8, 9, 12, 20, 40, 90, 300):
        for _ in range(6):
            base = text_of(rng, size).split()
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, size // 12))):
                    copy[rng.randrange(len(copy))] = rng.choice(WORDS)
                if rng.random() < 0.3:
                    copy = copy[: max(1, len(copy) - rng.randrange(3))]
                rows.append((at, " ".join(copy), "en", "a", 1))
                at += 1
    passage = text_of(rng, 60)
    rows += [(at + i, f"{passage} {text_of(rng, 20 + i)}", "en", "a", 1) for i in range(20)]
    want, sets = brute_components(rows, words)
    for r in near_dedup.near_dedup(spark, frame(spark, rows), words=words).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert sum(want[i] != i for i in want) > 50


def test_near_dedup_of_an_empty_table_and_low_thresholds(spark):
    assert near_dedup.near_dedup(spark, frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        near_dedup.near_dedup(spark, frame(spark, []), percent=50)


@pytest.mark.parametrize("common", [0, 32_768])
def test_near_dedup_of_a_large_family_is_exact_across_blocks(spark, monkeypatch, common):
    monkeypatch.setattr(near_dedup, "COMMON", common)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "LIST", 4)
    rng = random.Random(11)
    rows, base = [], text_of(rng, 60).split()
    for i in range(240):  # three strands: close copies, drifting ones, and ones that are too far from either
        if i % 3 == 1:
            base[rng.randrange(60)] = rng.choice(WORDS)
        words = list(base)
        for _ in range(rng.randrange(3) if i % 3 else rng.randrange(6)):
            words[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, " ".join(words), "en", "a", 1))
    want, _ = brute_components(rows, 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark, frame(spark, rows), words=4).collect()}
    assert got == want and 1 < len(set(want.values())) < 200


def test_union_estimate_is_exact_for_whole_sets():
    import numpy as np

    a, b = np.arange(0, 40, dtype=np.uint64), np.arange(10, 45, dtype=np.uint64)
    assert near_dedup.union_estimate(a, b, 48) == (30 / 45, 0.0)
    by, error = near_dedup.union_estimate(a, b, 20)
    assert by == 0.5 and error > 0


@pytest.mark.parametrize("small", [0, 10**9])
def test_components(spark, monkeypatch, small):
    from corpusloom.llm import components as C

    monkeypatch.setattr(C, "SMALL", small)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7), (None, 1)] + [(200, 201 + i) for i in range(30)]
    got = {r.id: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(chain, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}, **{i: 200 for i in range(200, 231)}}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), "e").count() == 0


# Classifiers


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_classifiers_tell_held_out_documents(spark):
    data = DATA.replace("0.001", "0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for query, label, least in ((quality.op2_quality, "quality", 0.97), (toxicity.op10_toxicity, "toxic", 0.88)):
        got = query(spark, data).collect()
        assert len(got) == 1000 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
        pairs = [(r.score, labels[r.doc_id][label]) for r in got if r.held_out and r.doc_id in labels]
        pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) >= least


def test_classifiers_take_odd_rows_and_no_labels(spark):
    docs, none = frame(spark, odd_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, quality.train(docs, none)).count() == len(odd_rows())
    assert toxicity.toxicity(docs, toxicity.train(docs, none)).count() == len(odd_rows())
    some = spark.createDataFrame([(2, 1, 1), (6, 0, None), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (quality.quality(docs, quality.train(docs, some)), toxicity.toxicity(docs, toxicity.train(docs, some))):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got.collect())
    kept = quality.good(docs.withColumn("score", F.lit(1)), quality.train(docs, some))
    assert kept.columns == [*docs.columns, "score"]


def test_gradient_of_the_attention_model_learns_which_passage_tells():
    import numpy as np

    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(900):
        x = rng.normal(0, 1, (rng.integers(1, 6), quality.FEATURES))
        x[:, 0] = 0
        x[rng.integers(len(x)), 0] = 3.0 * (i % 2)
        bags.append(x)
        labels.append(i % 2)
    model = quality.fit(bags[:600], np.array(labels[:600]))
    right = [(model.score(x, np.array([0]))[0] >= 0.5) == y for x, y in zip(bags[600:], labels[600:], strict=True)]
    assert np.mean(right) > 0.95


def numeric(f, w, eps=1e-6):
    import numpy as np

    out = np.zeros_like(w)
    for i in np.ndindex(w.shape):
        keep = w[i]
        w[i] = keep + eps
        above = f()
        w[i] = keep - eps
        below = f()
        w[i] = keep
        out[i] = (above - below) / (2 * eps)
    return out


def test_gradients_of_the_attention_model_are_those_of_its_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    shapes = [(quality.FEATURES, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,)]
    weights = [rng.normal(0, 0.4, shape) for shape in shapes]
    x, bags, y = rng.normal(0, 1, (14, quality.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0, 0.5])

    def loss():
        p = quality._forward(weights, x, bags)[-1]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for w, gradient in zip(weights, quality.gradients(weights, x, bags, y), strict=True):
        assert np.allclose(numeric(loss, w), gradient, atol=1e-6)


def test_gradients_of_the_risk_and_its_floor():
    import numpy as np

    rng = np.random.default_rng(4)
    fp, fu = rng.normal(0, 1, 6), rng.normal(0, 1, 9)
    _, gp, gu = toxicity.risk(fp, fu, 0.3)
    assert np.allclose(numeric(lambda: toxicity.risk(fp, fu, 0.3)[0], fp), gp, atol=1e-6) and np.allclose(numeric(lambda: toxicity.risk(fp, fu, 0.3)[0], fu), gu, atol=1e-6)
    low = np.full(9, -20.0)  # all unlabelled texts called negative, positives too: the bracket is below zero
    value, gp, gu = toxicity.risk(np.full(6, 3.0), low, 0.5)
    plain = 0.5 * float(np.log1p(np.exp(-3.0)))
    assert math.isclose(value, plain) and (gu <= 0).all() and (gp >= 0).all()


def test_scores_do_not_depend_on_what_is_scored_together():
    import numpy as np

    texts = [t for _, t, *_ in odd_rows()] + [text_of(random.Random(i), 30 * i) for i in range(90)]
    model = quality.fit([quality.encode(t) for t in texts], np.arange(len(texts)) % 2)
    one = [model.score(quality.encode(t), np.array([0]))[0] for t in texts]
    assert np.allclose(quality.scores_of(model, texts), one) and len(quality.scores_of(model, [])) == 0
    assert len(quality.part(quality.encode("a b " * 60_000))) == quality.PASSAGES


def test_classifiers_take_empty_tables_and_bound_their_samples(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    none = frame(spark, [])
    assert quality.quality(none, quality.train(none, labels)).count() == 0 and quality.good(none, quality.train(none, labels)).count() == 0
    assert toxicity.toxicity(none, toxicity.train(none, labels)).count() == 0
    same = frame(spark, [(3, f"the same id {i} {'vile ' * 9}", "en", "a", 1) for i in range(50)])
    model = quality.train(same, labels, sample=5)
    assert all(0 <= r.score <= 1 for r in quality.quality(same, model).collect())


def test_feature_frequencies_are_counted_over_all_texts(spark):
    texts = ["vile words", "Vile vilest", "kind", "", None, "vilify"] * 40
    docs = frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]).repartition(7)
    seen = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1]
    wanted = [b"vile=", b"vil", b"kind=", b"none"]
    got = toxicity._frequency(docs, wanted)
    held = lambda x: sum(x in {f for w in toxicity.words_of(t) for f in toxicity.features_of(w)} for t in seen) / len(seen)
    assert {x: held(x) for x in wanted if held(x)} == got and toxicity._frequency(frame(spark, []), wanted) == {} and toxicity._frequency(docs, []) == {}


def test_toxicity_scores_match_a_loop_over_words():
    import re

    rng = random.Random(8)
    weights = {w.encode(): rng.uniform(-2, 2) for w in ["vil", "vile", "vile=", "vileness=", "w1=", "the=", "\u00fc=", "abcdefgh"]}
    model = toxicity.Model(weights, -0.3)
    for text in ["", None, "Vile VILENESS the, vile", "w12 abcdefghijk \u00dc x", " ".join(WORDS) * 40]:
        total = -0.3
        for word in {w.encode() for w in re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())}:
            for name in [word + b"=", *(word[:n] for n in (3, 4, 5, 6, 7, 8) if n <= len(word))]:
                total += weights.get(name, 0.0)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-total)))


def test_steps_over_a_table_are_those_over_rows_in_memory(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    positive, free = ([np.sort(rng.choice(6, rng.integers(0, 4))) for _ in range(n)] for n in (30, 200))
    known, rest = toxicity.Rows(positive), toxicity.Rows(free)
    w, adam = rng.normal(0, 1, 7), toxicity.Adam(7)
    table = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in free], "features binary").repartition(5)
    for prior in (0.05, 0.8):  # with the correction above zero, and below
        got = toxicity.refine(w, toxicity.Adam(7), known, table, prior, steps=3)
        want, adam = w, toxicity.Adam(7)
        for _ in range(3):
            _, gp, gu = toxicity.risk(known.score(want), rest.score(want), prior)
            want = adam.step(want, known.gradient(gp, 6) + rest.gradient(gu, 6))
        assert np.allclose(got, want)


def test_all_unlabelled_texts_are_fitted_on(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "START", 5)
    texts = ["vile thing here"] * 40 + ["vile but fine"] * 30 + ["plain words"] * 400
    docs = frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, 1) for i in range(40)] + [(i, 1, 0) for i in range(400, 430)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "refine", lambda w, adam, known, table, prior, steps, f=toxicity.refine: (seen.append(table.count()), f(w, adam, known, table, prior, steps))[1])
    toxicity.train(docs, labels, steps=2)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40, 470) if not 400 <= i < 430)]


def test_quality_scores_match_loops():
    import numpy as np

    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 99, 100, 101, 350)] + ["", "a\n\nb. C!"]
    model = quality.fit([quality.encode(t) for t in texts], np.arange(len(texts)) % 2, seed=2)
    w1, b1, v, u, a, c, d = (w.tolist() for w in model.weights)
    got = quality.scores_of(model, texts)
    for k, text in enumerate(texts):
        h = []
        for row in (quality.encode(text) - model.mean) / model.scale:
            h.append([math.tanh(sum(x * w1[i][j] for i, x in enumerate(row)) + b1[j]) for j in range(quality.HIDDEN)])
        gate = lambda m, x: [sum(x[i] * m[i][j] for i in range(quality.HIDDEN)) for j in range(quality.GATE)]
        e = [sum(a[j] * math.tanh(t) / (1 + math.exp(-s)) for j, (t, s) in enumerate(zip(gate(v, x), gate(u, x), strict=True))) for x in h]
        share = [math.exp(x - max(e)) for x in e]
        z = [sum(s * x[j] for s, x in zip(share, h, strict=True)) / sum(share) for j in range(quality.HIDDEN)]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-sum(x * y for x, y in zip(z, c, strict=True)) - d[0])), abs=1e-5)
        words, seen = text.split(), set()
        for p, row in enumerate(quality.encode(text) if words else []):
            own = words[p * quality.PASSAGE : (p + 1) * quality.PASSAGE]
            assert row[-quality.WORDS - 1] == pytest.approx(sum(w in seen for w in own) / len(own)) and row[-quality.WORDS :].sum() == pytest.approx(1)
            seen |= set(own)


def test_non_negative_risk_finds_the_words_of_positives():
    rng = random.Random(5)
    draw = lambda bad: {w.encode() for w in rng.sample(WORDS, 30)} | ({b"vile" + rng.choice([b"", b"ness"])} if bad else set())
    model = toxicity.fit([draw(True) for _ in range(80)], [draw(i % 10 == 0) for i in range(800)], 0.1)
    bad, good = [model.score(b" ".join(draw(True)).decode()) for _ in range(50)], [model.score(b" ".join(draw(False)).decode()) for _ in range(200)]
    assert sum(s >= 0.7 for s in bad) >= 48 and sum(s >= 0.7 for s in good) <= 2


# Line dedup


def test_line_dedup_drops_recurring_templates_only(spark):
    rng = random.Random(2)
    rows, letters = [], [a + b + "o" for a in "bcdfghklmn" for b in "aeiouy"]
    for i in range(30):
        own = [" ".join(rng.choice(letters) for _ in range(8)) for _ in range(3)]
        lines = [own[0], f"Copyright {2000 + i} by the owner of this page", own[1], own[2]]
        if i < 12:
            lines.append(f"posted by user {letters[i]} in the evening news")
        rows.append((i, "\n".join(lines), "en", "a", 1))
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark, frame(spark, [*rows, *odd_rows()[:1]])).collect() if r.doc_id is not None}
    assert all("Copyright" not in got[i].text for i in range(30) if i != 1) and all("posted by" not in got[i].text for i in range(12) if i != 1)
    for i, t, *_ in rows:
        if i != 1:
            assert got[i].n_lines == len(t.split("\n")) and got[i].n_dropped == 1 + (i < 12)
            assert got[i].text == "\n".join(x for x in t.split("\n") if "Copyright" not in x and "posted by" not in x)


def test_line_dedup_takes_odd_rows(spark):
    docs = frame(spark, odd_rows()).withColumn("n_lines", F.lit("clash")).withColumn("line_doc", F.lit(1))
    got = line_dedup.line_dedup(spark, docs).collect()
    assert len(got) == len(odd_rows()) and sorted(str(r.text) for r in got) == sorted(str(r[1]) for r in odd_rows())
    assert line_dedup.line_dedup(spark, frame(spark, [])).count() == 0


def test_line_dedup_keeps_the_first_of_lines_that_recur_verbatim(spark):
    rng = random.Random(5)
    passage, single, ten = text_of(rng, 52), text_of(rng, 51), text_of(rng, 10)
    digits = "in 1999 " + text_of(rng, 60)
    rows = [(i, "\n".join(["Les.", "", f"page {i}", f"own line number{i} stays", *([passage] if i < 2 else []), *([single, digits] if i == 5 else [])]), "en", "a", 1) for i in range(12)]
    rows += [(20, single + "\nx", "en", "a", 1), (21, "alone " + text_of(rng, 60), "en", "a", 1), (22, "alone " + text_of(rng, 60), "en", "a", 1)]
    rows += [(None, digits + "\n" + single, "en", "a", 1)] + [(40 + i, ten, "en", "a", 1) for i in range(9)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark, frame(spark, rows), verbatim=True).collect()}
    assert [i for i in range(12) if "Les." in got[i].text] == [0] and all(f"page {i}" in got[i].text for i in range(12))
    assert passage in got[0].text and passage not in got[1].text and single in got[5].text and digits in got[5].text
    assert got[20].text == "x" and all(got[i].n_dropped == 0 for i in (21, 22, *range(40, 49))) and got[None].n_dropped == 2
    odd = line_dedup.line_dedup(spark, frame(spark, odd_rows()), verbatim=True).collect()
    assert len(odd) == len(odd_rows())


def test_line_floor_falls_without_a_jump(spark):
    floors = [r[0] for r in spark.range(1, 80).select(line_dedup.floor_of(F.col("id"), 10)).collect()]
    assert floors[:10] == [10] * 10 and floors[48:] == [3, *[2] * 30] and all(0 <= a - b <= 1 for a, b in zip(floors, floors[1:], strict=False))


def test_line_dedup_finds_several_templates_in_a_leaf(spark):
    letters = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "klmn"]
    tails = ["says that all trains run", "will close over the winter", "has no seats left today"]
    rng, rows = random.Random(6), []
    for i in range(36):
        noise = " ".join(["notes from station", *(rng.choice(letters) for _ in range(6))])
        rows.append((i, f"notes from station {letters[i]} {tails[i % 3]}\n{noise}\n{noise[::-1]}", "en", "a", 1))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark, frame(spark, rows), several=True).collect()}
    assert got == {i: t.split("\n", 1)[1] for i, t, *_ in rows}


def test_line_dedup_joins_no_text_by_its_leaf(spark, monkeypatch):
    rows = [(i, f"news of the day {i}\nall that was said today\nown line {i}", "en", "a", 1) for i in range(12)]
    plans, write = {}, line_dedup.Scratch.write

    def told(self, df, name, *args, **kwargs):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name, *args, **kwargs)

    monkeypatch.setattr(line_dedup.Scratch, "write", told)
    docs = frame(spark, [*rows, rows[3], (None, rows[4][1], "en", "a", 1)])
    got = line_dedup.line_dedup(spark, docs, verbatim=True, several=True).collect()
    assert len(got) == 14 and sum("all that was said" in r.text for r in got) == 1 and sum("news of" in r.text for r in got) == 0
    reading = {name: [x for x in plan.splitlines() if "Join " in x] for name, plan in plans.items() if "text#" in plan}
    assert reading and not any("leaf" in x for joins in reading.values() for x in joins)


# Packing


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = ["a''s it's I'LL \t x\r\ny ß ÀÉ 12345 ½ ² naïve don't–never <|endoftext|> z", "İı ĲǅΣας", "'s", "!'re  __x", " "]
    rows = odd_rows() + [(50 + i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(100 + i, text_of(rng, rng.randrange(1, 900)), "en", "a", 1) for i in range(150)]
    got = packing.pack(spark, frame(spark, rows)).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = reference_ids(t)
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[i, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    full = collections.defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(full) <= math.ceil(sum(r.length for r in got) / 4096) + 2
    assert packing.pack(spark, frame(spark, [])).count() == 0


def test_ids_equal_the_library_for_every_letter_of_the_fast_way():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["Ɓaure Ɗan", "Ọ̀yọ́ Ɔkɔ Ɛdɛ Əliyev ǅ İstanbul"]
    for c in map(chr, range(0x20, 0x250)):
        texts += [c, f"a{c}b {c}aure x{c}", f"{c}{c} 1{c}'s don{c}t '{c}ll .{c}!"]
    for t in texts:
        assert list(memoryview(encoder.encode(t)).cast("I")) == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 257): rng.randrange(1, 500) for _ in range(60)} | {256: 9, 129: 400, 127: 300}
    plan = packing.plan(dict(counts), 256, 200)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(s * m for s, m in pattern.items()) <= 256 and times > 0
        for s, m in pattern.items():
            used[s] += m * times
    assert used == counts
    best = sum(t for _, t in packing.best_fit(counts, 256))
    assert sum(t for _, t in plan) <= 1.01 * best + 1
    assert sum(math.floor(x) for _, x in packing._fractional({s: float(n) for s, n in counts.items()}, 256, 200)) > best / 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("size, more", [("0.01", 0), ("0.1", 1)])
def test_plan_needs_no_more_than_best_fit_on_the_drivers_lengths(size, more):
    import public_tokenizers
    import pyarrow.parquet as pq

    encoder, counts = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for t in pq.read_table(f"{DATA.replace('0.001', size)}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(encoder.encode(t or "")) // 4 + 1
        counts.update([4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0))
    assert sum(t for _, t in packing.plan(counts, 4096)) <= sum(t for _, t in packing.best_fit(counts, 4096)) + more


def test_plan_fills_sequences_where_small_pieces_abound():
    rng = random.Random(1)
    counts = collections.Counter(min(1024, max(8, int(rng.lognormvariate(5.2, 0.9)))) for _ in range(20_000))
    bound = math.ceil(sum(s * n for s, n in counts.items()) / 1024)
    assert sum(t for _, t in packing.plan(dict(counts), 1024)) <= 1.002 * bound + 1


# URLs


def test_urls_match_plain_rules(spark):
    rng = random.Random(6)
    hosts = ["a.org", "x.Example.ORG", "example.org", "notexample.org", "y.com", "com", "org", "", "b.c.d.com:80", "ü.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/fr/a", "/de/b#c", "?q", "#f", "/FR/"]
    every = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/x", "a://", "http:///x", "x://y.com/fr/://z.org/", "http://y.com/fr/" * 3]
    rows = spark.createDataFrame([(i, u, u) for i, u in enumerate(every)], "page_id long, url string, other string")
    extra = [("block", "com", "/fr/a"), ("allow", "y.com", "/fr"), ("allow", "", "/nothing")]
    rules = [*urls.RULES, *extra]
    got = {r.page_id: r for r in urls.url_filter(spark, rows, ["page_id"], rules).collect()}
    for i, u in enumerate(every):
        host, path = urls.parts(u)
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[3])
    assert {r.verdict for r in urls.url_filter(spark, rows, ["page_id"], [], "block").collect()} == {"block"}
    assert urls.url_filter(spark, rows.limit(0), ["page_id"]).count() == 0
    clash = urls.url_filter(spark, rows.withColumn("host", F.lit("x")).withColumn("Rule", F.lit(1)), ["page_id", "host", "Rule", "other"], rules)
    assert clash.columns == ["page_id", "other", "host", "path", "rule", "verdict"]
    assert {r.page_id: r.host for r in clash.select("page_id", "host").collect()} == {i: r.host for i, r in got.items()}


def test_url_index_confirms_full_strings(monkeypatch, tmp_path):
    monkeypatch.setattr(urls, "_key", lambda host, path: 7)  # every key collides
    name = urls.write_index(urls.RULES, str(tmp_path))
    found = urls.Index(str(tmp_path), name).look_up([("a.org", "/"), ("a.net", "/"), ("example.org", "/en/1")])
    assert found == [("org/", "allow"), None, ("example.org/en/1", "block")]


# WARC


def test_warc_round_trip(spark):
    big = "é" * 100
    rows = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "http://b", big), (7, "u", "small"), (8, "u", "small"), (1, "http://n", None), (2, "v", "\r\n\r\nWARC/1.1\r\n" * 20), (None, "w", big), (4, "x", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch = Scratch(spark, "t")
    folder = f"{scratch.path}/warc"
    index = scratch.write(warc.write_warc(spark, pages.withColumn("digest", F.lit("clash")), folder), "index")
    got = {r.page_id: r for r in warc.read_warc(index, folder).collect()}
    for i, u, h in rows:
        payload = (h or "").encode()
        revisit = h == big and i != 3
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.html == (None if revisit else (h or ""))
    picked = warc.read_warc(index.filter("page_id = 2 or page_id = 9"), folder).collect()
    assert sorted(r.page_id for r in picked) == [2, 9]
    empty = scratch.write(warc.write_warc(spark, pages.limit(0), f"{scratch.path}/none"), "empty")
    assert warc.read_warc(empty, f"{scratch.path}/none").count() == 0


# Mixing


def water(sizes, weights):
    """Share by weight, cap at three times the size, share the excess again until no target is above."""
    total, full, target = sum(sizes), set(), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(3 * sizes[i] for i in full)
        target = {i: 3 * sizes[i] if i in full else left * weights[i] / sum(weights[j] for j in rest) for i in range(len(sizes))}
        over = {i for i in rest if target[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 500, 5000]) + rng.randrange(3) for _ in range(11)]
    names = [f"s{i:02d}" for i in range(10)] + [None]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(11)])
    assert all(math.isclose(got[n], want[i], rel_tol=1e-9, abs_tol=1e-6) for i, n in enumerate(names))


def test_mixing_meets_targets_and_reruns_agree(spark):
    rng = random.Random(8)
    rows = [(i, text_of(rng, rng.randrange(20, 60)), "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(3000)]
    first = mixing.mix(spark, frame(spark, rows).withColumn("target", F.lit("clash"))).collect()
    again = mixing.mix(spark, frame(spark, rows).repartition(9)).collect()
    assert {r.doc_id: r.copies for r in first} == {r.doc_id: r.copies for r in again} and len(first) == 3000
    taken, target = collections.Counter(), {}
    for r in first:
        assert 0 <= r.copies <= 3 and r.size == len(r.text.split())
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.01 * t + 60 for s, t in target.items())
    mixed = mixing.repeated(mixing.mix(spark, frame(spark, rows)), ["doc_id", "text"])
    assert mixed.count() == sum(r.copies for r in first)


def test_pivotal_rounding_keeps_the_probabilities(spark):
    units = spark.createDataFrame([("s", i, i * 7919, 5, 5, 1.3) for i in range(1000)], "source string, doc_id long, h long, each long, size long, rate double")
    for seed in (1, 2, 3):
        ups = [r.doc_id for r in mixing.picked(spark, units, seed).filter("up").collect()]
        assert abs(len(ups) - 300) <= 1 and len(set(ups)) == len(ups)


def test_mixing_takes_odd_rows(spark):
    got = mixing.mix(spark, frame(spark, odd_rows()).withColumn("mix_key", F.lit(1)).withColumn("h", F.lit(2))).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.copies <= 3 for r in got)
    assert {r.size for r in got if r.text is None or not r.text.strip()} == {0}
    assert mixing.mix(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("run", [4096, 7])
def test_repeated_rows_are_documents_of_their_own(spark, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(1, "four words and more", "en", "a", 1)] * 100 + [(i, text_of(random.Random(i), 30), "en", "b", 1) for i in range(2, 40)] + [(None, "no id", None, "b", 1)] * 3
    docs = frame(spark, rows).withColumn("mix_row", F.lit(1)).repartition(5)
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 31 for s, t in target.items())
    copies = sorted(r.copies for r in got if r.doc_id == 1)
    assert copies[-1] - copies[0] <= 1 and sum(copies) in (math.floor(target["a"] / 4), math.ceil(target["a"] / 4))


# Repetition


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_repetition_counts_match_brute_force(spark):
    rng = random.Random(9)
    texts = [t for _, t, *_ in odd_rows()]
    for _ in range(60):
        parts = [text_of(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) + rng.choice(["", " #$ é", "\x0b|"]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition(rows, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t)
        assert r.kept == (r.rule is None) and not (r.base_failed and r.kept)


def test_repetition_takes_empty_tables_and_clashing_names(spark):
    docs = frame(spark, odd_rows()).withColumn("kept", F.lit("clash")).withColumn("N_words", F.lit(1))
    got = repetition.repetition(docs, ["doc_id", "kept", "N_words", "lang"])
    assert got.columns == ["doc_id", "lang", *(k for k, _ in repetition.FIELDS)] and got.select("kept").count() == len(odd_rows())
    assert repetition.repetition(frame(spark, []), ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [5, 10])
def test_coverage_measures_characters_in_duplicated_ngrams(n):
    own = [f"u{i}" for i in range(40)]
    text = " ".join([*own, *own[: n + 1], "end"])
    words = text.split()
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    twice = {g for g, c in collections.Counter(grams).items() if c > 1}
    inside = {i + k for i, g in enumerate(grams) if g in twice for k in range(n)}
    assert repetition.judge(text)[8] >= sum(len(words[i]) for i in inside) / sum(map(len, words)) - 1e-12


# Pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch, before, n = Scratch(spark, "t"), docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.write(stage(spark, before, DATA), name)
        assert after.columns == docs.columns
        if name == "exact_dedup":
            assert after.count() == len({digest(r.text) for r in before.collect()})
        if name == "near_dedup":
            want, _ = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
            assert sorted(r.doc_id for r in after.collect()) == sorted({*want.values()})
        before = after
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() <= n and packed.columns[0] == "doc_id"


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = [(200 + i, text_of(random.Random(i), 120), "en", "ab"[i % 2], 1) for i in range(30)]
    rows = odd_rows() + good + [good[0], (300, good[1][1].upper(), "en", "a", 1), (301, good[2][1] + " end", None, "b", 1)]
    docs = frame(spark, rows).withColumn("copies", F.lit("clash")).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at, before = dict(corpus_pipeline.STAGES), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, str(tmp_path))
        assert before.columns == docs.columns, name
    kept = at["quality"](spark, docs, str(tmp_path))
    unique = at["exact_dedup"](spark, kept, str(tmp_path)).collect()
    assert len(unique) == len({digest(r.text) for r in kept.collect()})  # one row of each text, repeated rows included
    ids = sorted(r.doc_id for r in at["near_dedup"](spark, frame(spark, rows), str(tmp_path)).collect() if r.doc_id is not None)
    assert ids.count(200) == 2 and 300 not in ids and 301 not in ids and {202, 201, 1, 2, 3} <= set(ids)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= {r.doc_id for r in unique} and {202, 229} & {r.doc_id for r in packed}
    ends = collections.Counter()
    for r in packed:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
