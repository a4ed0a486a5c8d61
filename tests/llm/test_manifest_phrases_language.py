"""The manifest, phrases and languages against brute force, with the odd rows each must take."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language, merkle, phrases
from tests.llm.test_ops import DATA, DOCS, frame, odd_rows, text_of

NO_DATA = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


# Manifest


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row) -> str:
    i, text, lang, source, n = row
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def brute_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def brute_path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for now in levels[:-1]:
        first = at - at % 3
        out.append(("".join(now[first:at]), "".join(now[at + 1 : first + 3])))
        at //= 3
    return out


def brute_manifest(rows, lose) -> list[tuple]:
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    trees, out = {}, []
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[s] = brute_tree([brute_leaf(r) for r in by[s]])
    top = brute_tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = brute_path(trees[s], i) + brute_path(top, k)
            h = brute_leaf((r[0], lose(r), *r[2:]))
            for a, b in path:
                h = sha(a, h, b)
            out.append((r[0], brute_leaf(r), trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


def lost(r):
    return r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_matches_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = odd_rows() + [(None, "no\nid", "en", None, 1), (900, None, None, None, None)]
    for k, n in enumerate((1, 2, 3, 4, 9, 10, 28, 82)):
        rows += [(1000 * k + 500 + i, text_of(rng, 4) + rng.choice(["", "\n", "\nx\n"]), "en", f"s{k}é", k) for i in range(n)]
    rows += rows[-3:]
    docs = frame(spark, rows).withColumn("leaf", F.lit("clash")).withColumn("at", F.lit(1))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", ""))
    got = sorted(map(tuple, merkle.merkle_manifest(spark, docs, tampered, levels).collect()), key=str)
    want = brute_manifest(rows, lost)
    assert got == want
    assert {v for *_, v in got} == {True, False}
    assert all(r[-1] for r in merkle.merkle_manifest(spark, docs, levels=levels).collect())


def test_manifest_of_empty_tables_and_of_one_row(spark):
    assert merkle.merkle_manifest(spark, frame(spark, [])).count() == 0
    row = (1, "a", "en", "s", 1)
    (r,) = merkle.merkle_manifest(spark, frame(spark, [row])).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == brute_leaf(row) and r.proof_sha256 == sha() and r.verified


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 82, 243, 244, 500, 728, 729])
@pytest.mark.parametrize("full", [False, True])
def test_walk_is_in_time_and_holds_few_nodes(n, full):
    leaves = [sha(str(i)) for i in range(n)]
    levels = 6 if full else merkle.depth(n)
    tree = [leaves]
    for _ in range(levels):
        tree.append([sha(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
    walk = merkle.Walk([x.encode() for x in leaves], levels)
    for i, path in enumerate(walk.paths()):
        assert [(b"".join(x[:at]).decode(), b"".join(x[at + 1 :]).decode()) for x, at in path] == brute_path(tree, i)
        assert [x[at].decode() for x, at in path] == [tree[j][i // 3**j] for j in range(levels)]
    assert walk.late == 0
    assert walk.held <= 8 * max(levels, 1)  # of the n / 2 nodes above n leaves


def test_paths_survive_packing():
    path = [([b"a" * 64, b"b" * 64, b"c" * 64], 1), ([b"d" * 64], 0), ([b"e" * 64, b"f" * 64], 1)]
    assert merkle.unpack(merkle.pack(path)) == [(b"a" * 64, b"c" * 64), (b"", b""), (b"e" * 64, b"")]


@NO_DATA
def test_manifest_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, merkle.op11_merkle(spark, DATA).collect()), key=str) == brute_manifest(rows, lost)


# Phrases


def brute_phrases(rows, least, longest, most):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least, longest, most, shard", [(3, 5, 10_000, 25_000), (2, 4, 7, 40), (300, 3, 50, 25_000)])
def test_phrases_match_brute_force(spark, monkeypatch, least, longest, most, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rng = random.Random(least)
    some = ["the", "of", "New", "new", "york", "é", "中文", "a b", "\x1fx", "-"]
    rows = odd_rows()
    for i in range(160):
        words = [rng.choice(some + [f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 60))]
        rows.append((100 + i, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!", "\x0b"]) for w in words), rng.choice(["en", "de", None, ""]), "a", 1))
    docs = frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(map(tuple, phrases.collocations(spark, docs, least, longest, most).collect()))
    want = brute_phrases(rows, least, longest, most)
    assert got == want and (want or least == 300)
    assert len(want) > 20 or least == 300


def test_phrases_of_tables_without_any(spark):
    names = "lang rank phrase a l r n score".split()
    for rows in ([], odd_rows()[:3]):
        got = phrases.collocations(spark, frame(spark, rows))
        assert got.columns == names and got.count() == 0


def test_tree_of_sums_adds_every_array(spark):
    import numpy as np

    rows = [(p, t, np.array([t, p, 1], dtype="<i8").tobytes()) for p in range(3) for t in range(70)]
    got = {r.part: np.frombuffer(r.n, dtype="<i8").tolist() for r in phrases.tree_sum(spark.createDataFrame(rows, phrases.SUMS), 70).collect()}
    assert got == {p: [sum(range(70)), 70 * p, 70] for p in range(3)}


def test_strangers_find_no_slot(spark, tmp_path):
    import numpy as np
    import pandas as pd

    keys = np.arange(0, 3000, 3)
    built = phrases._built(pd.DataFrame({"shard": 0, "key": keys, "second": keys + 1}))
    spark.createDataFrame(built).write.partitionBy("shard").parquet(f"{tmp_path}/k")
    held = phrases.Shards(f"file://{tmp_path}/k", 1)
    assert sorted(held.slots(keys)) == list(range(1000)) and set(held.slots(keys + 1)) == {-1}


def test_windows_are_handed_on_as_gaps_and_summed_by_part():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(7)
    words, kinds = rng.integers(0, 300, 200_000).astype("<i4"), 301
    batch = pa.RecordBatch.from_arrays([pa.array([words[i : i + 20_000].tobytes() for i in range(0, len(words), 20_000)], pa.binary())], ["words"])
    parts = phrases.parts_for(3 * phrases.PART - 1, kinds)
    rows = pa.Table.from_batches(phrases._enumerated(2, kinds, parts)(iter([batch, batch]))).to_pandas()
    _, key, _ = zip(*(phrases.windows(words[i : i + 20_000], words[i : i + 20_000], 2, kinds) for i in range(0, len(words), 20_000)), strict=True)
    own, n = np.unique(np.concatenate(key), return_counts=True)
    assert len(rows) == parts == 3 and rows["n"].sum() == len(own)
    assert sum(rows["gaps"].str.len() + rows["seen"].str.len()) < 3 * len(own)  # where a key with its count takes 16 bytes
    often = pd.concat([phrases._frequent(parts, 8)(rows[rows["part"] == p]) for p in range(parts)])["key"]
    assert sorted(often) == own[2 * n >= 8].tolist() and 0 < len(often) < len(own)


def test_parts_share_no_factor_with_the_keys():
    import numpy as np

    assert phrases.parts_for(0, 7) == 1 and phrases.parts_for(6 * phrases.PART, 6) == 7 and phrases.parts_for(6 * phrases.PART, 35) == 6
    numbers = np.array([0, 1, 255, 256, 1 << 40, (1 << 62) + 3, 0])
    assert phrases.unpacked(phrases.packed(numbers), 7).tolist() == numbers.tolist()


def test_phrases_summed_in_many_parts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 50)
    monkeypatch.setattr(phrases, "WINDOWS", 40)
    monkeypatch.setattr(phrases, "SHARD", 7)
    rng = random.Random(9)
    rows = [*odd_rows(), *((100 + i, " ".join(rng.choice("abcdef") for _ in range(40)), rng.choice(["en", None]), "a", 1) for i in range(80))]
    got = sorted(map(tuple, phrases.collocations(spark, frame(spark, rows), 5, 5, 10_000).collect()))
    assert got == brute_phrases(rows, 5, 5, 10_000) and max(r[2].count(" ") for r in got) >= 3


# Languages


def brute_count(texts: list[str], text: str, span: int) -> int:
    n = 0
    for at in range(0, len(text), span):
        own, i = text[at : at + span], 0
        while i < len(own):
            k = 0
            while i + k < len(own) and any(own[i : i + k + 1] in t for t in texts):
                k += 1
            i, n = i + max(k, 1), n + 1
    return n


def test_phrases_of_a_language_match_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        letters = "abc"[: rng.randrange(1, 4)]
        some = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))] for x in ("x", "y")}
        model = language.fit(some)
        texts = ["".join(rng.choice(letters + "z") for _ in range(rng.randrange(1, 700))) for _ in range(4)]
        got = model.entropies(texts)
        for i, t in enumerate(texts):
            for k, name in enumerate(model.names):
                assert got[i, k] == pytest.approx(brute_count(some[name], t, language.SPAN) * model.bits[k] / len(t))


def test_long_texts_are_parsed_whole(monkeypatch):
    model = language.fit({"x": ["abcab", "cab"], "y": ["bbb"]})
    texts = ["abc" * 900, "b", "zz" * 700]
    want = model.entropies(texts)
    monkeypatch.setattr(language, "TOGETHER", 2 * language.SPAN)
    assert (model.entropies(texts) == want).all()


@NO_DATA
def test_languages_hold_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    model = language.train(changed)
    assert model.names == sorted(r[0] for r in docs.select("lang").distinct().collect())
    got = {r.doc_id: r for r in language.languages(docs, model).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert got == {r.doc_id: r for r in language.op13_language(spark, DATA).collect()}


def test_languages_take_odd_rows(spark):
    rows = odd_rows() + [(100 + i, t * 30, lang, "a", 1) for i in range(9) for t, lang in (("the house and ", "en"), ("das haus und ", "de"))]
    docs = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("own", F.lit(1))
    model = language.train(docs)
    got = language.languages(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    told = {r.doc_id: r.lang_pred for r in got}
    assert [told[i] for i in (1, 2, 3)] == ["und"] * 3 and told[103] in ("en", "de") and set(told.values()) <= {*model.names, "und"}
    digits = spark.createDataFrame([(1, "12 34 !?", "en", "a", 1)], DOCS)
    assert language.languages(digits, model).first().lang_pred == "und"
    nothing = language.train(frame(spark, []))
    assert language.languages(frame(spark, []), nothing).count() == 0
    assert {r.lang_pred for r in language.languages(docs, nothing).collect()} == {"und"}
    one = language.fit({"en": ["the"]})
    assert [(r.lang_pred, r.score) for r in language.languages(spark.createDataFrame([(1, "x", "de", "a", 1)], DOCS), one).collect()] == [("en", 1.0)]
