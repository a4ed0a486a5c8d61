"""Operators against hand-worked values, planted cases and invariants."""

from __future__ import annotations

import collections
import itertools
import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import calls as C
from corpusloom.functions import parsing as P
from corpusloom.functions import text as T
from corpusloom.functions.rows import by_row
from corpusloom.operators import adapters, checks, compare, contamination, dedup, flags, grade, instructions, languages, mask, profile, ranks, render, sample, split, synth, tails
from corpusloom.sources import readers
from corpusloom.streaming import events

SPAN = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


# Windows and contamination


def test_window_boundaries(spark):
    words = SPAN.split()
    rows = [(k, " ".join(words[:12] if k == 12 else words if k == 13 else [*words, "november"])) for k in (12, 13, 14)]
    found = contamination.grams(spark.createDataFrame(rows, "k long, text string"), ["k"]).groupBy("k").count()
    assert {r["k"]: r["count"] for r in found.collect()} == {13: 1, 14: 2}


def test_planted_span_case_and_sides(spark):
    idx = contamination.index(spark.createDataFrame([(1, SPAN)], "item_id long, text string"))
    rows = [("r1", SPAN.upper().replace(" ", ", "), "nothing here", "c"), ("r2", "nothing", f"so: {SPAN}!", "c"), ("r3", "a", "b", "c")]
    got = contamination.overlap_by_side(spark.createDataFrame(rows, "id string, input string, target string, corpus string"), idx, "id", ["corpus"]).first()
    assert (got.n_rows, got.n_hit, got.n_input, got.n_target, got.n_both) == (3, 2, 1, 1, 0)


def test_shared_window_has_one_owner_unless_its_set_is_alone(spark):
    items = spark.createDataFrame([("first", 5, SPAN), ("second", 2, SPAN)], "s string, item_id long, text string")
    idx = contamination.index(items, set_name=F.col("s"))
    assert [r["set"] for r in contamination.owned(idx).collect()] == ["first"]
    assert [r["item"] for r in contamination.owned(idx, ["second"]).collect()] == [2]


def test_prefix_is_cut_before_words_are_made(spark):
    long = "x " * 10_000 + SPAN
    rows, idx = spark.createDataFrame([(1, long)], "k long, text string"), contamination.index(spark.createDataFrame([(1, SPAN)], "item_id long, text string"))
    assert contamination.probed(rows, ["k"], idx, cap=True).count() == 0 and contamination.probed(rows, ["k"], idx).count() == 1


@pytest.mark.parametrize("share, chunk", [(0.5, 2_000_000), (0.1, 2_000_000), (0.1, 60), (0.01, 7), (0.3, 1)])
def test_boilerplate_is_told_from_what_recurs_in_chunks(spark, share, chunk):
    draw = random.Random(7)
    own = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(20))
    rows = [(i % 50 if i < 90 else None, f"{own()} {SPAN if i % 3 else ''} {SPAN.upper() if i % 7 == 0 else ''} {own() if i % 2 else ''}") for i in range(100)] + [(200, None), (201, "short")]
    items = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    want = contamination.boilerplate(contamination.index(items), share).collect()
    got = contamination.boilerplate_of(items, share=share, chunk=chunk).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_only_windows_that_recur_leave_a_task():
    rows = [" ".join(f"{i}x{k}" for k in range(40)) + " " + SPAN for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([r.encode() for r in rows])], ["_text"])
    out = [h for b in contamination._recurring(13, 0.2, 10_000)(iter([batch])) for h in b["h"].to_pylist()]
    assert out == contamination.window_hashes(SPAN.encode().split(), 13).tolist()
    assert list(contamination._recurring(13, 0.2, 10)(iter([])))[0].num_rows == 0


def test_an_index_beyond_what_workers_hold_is_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(1, f"a {SPAN} b"), (2, "a b"), (3, None), (4, "")], "k long, text string")
    idx = contamination.index(spark.createDataFrame([(1, f"{SPAN} november")], "item_id long, text string"))
    held = sorted(contamination.probed(rows, ["k"], idx).select("k", "at", "h", "n_windows").collect())
    monkeypatch.setattr(contamination, "HELD", 1)
    assert sorted(contamination.probed(rows, ["k"], idx).select("k", "at", "h", "n_windows").collect()) == held and len(held) == 1
    assert contamination.probed(rows, ["k"], idx.limit(0)).count() == 0


def test_registered_queries_read_whole_texts(spark, tmp_path):
    from corpusloom.plans import catalogue, records

    far = "x " * 10_000 + SPAN
    spark.createDataFrame([(1, SPAN)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, far, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, "user", far), (3, 2, "assistant", far)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert all(run(name)[0].doc_id == 7 for name in ("contam_docs", "contam_owned_hits", "contam_worst_k", "contam_quote"))
    assert (run("contam_by_lang")[0].n_hit, run("contam_items_touched")[0].rows, run("contam_overlap_fraction")[0].n_windows) == (1, "7", 10_001)
    assert run("contam_conv_sides")[0].n_both == 1
    assert catalogue.QUERIES["probe_corpus_overlap"] is records.probe_corpus_overlap and run("probe_corpus_overlap")[0].n_windows == 1
    idx = contamination.index(spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert events.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), idx, "doc_id").count() == 1


def test_touched_items_list_every_row(spark, tmp_path):
    from corpusloom.plans import catalogue

    spark.createDataFrame([(1, SPAN)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, SPAN) for i in range(250)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.contam_items_touched(spark, str(tmp_path)).first()
    assert (got.n_rows, got.n_unlisted, got.rows.split(",")) == (250, 0, [str(i) for i in range(250)])


# Text functions


def test_text_functions(spark):
    assert one(spark, T.normalize(F.col("t")), t="  Ça, VA?  x_1—y ") == "ça va x_1 y"
    assert one(spark, T.quotes(F.col("t"), F.col("v")), t="the value 42 holds", v="42!") is True
    assert one(spark, T.quotes(F.col("t"), F.col("v")), t="the value 421 holds", v="42") is False
    assert one(spark, T.first_literal(F.col("t"), F.col("n")), t="A  B\nC", n=["z", "b c"]) == "b c"
    assert one(spark, T.identifier(F.col("t")), t=" 3D Models! ") == "fn_3d_models"
    assert one(spark, T.json_type(F.col("t"))["type"], t="List[str]") == "array"
    assert tuple(one(spark, T.json_type(F.col("t")), t="Optional[int]")) == ("Optional[int]", False)
    assert one(spark, T.without_thinking(F.col("t")), t="<think>a\nb</think> answer") == "answer"
    for a, b, k, want in (("kitten", "sitting", 5, 3), ("kitten", "sitting", 2, 3), ("", "12345678", 3, 4)):
        assert one(spark, T.edit_distance(F.col("a"), F.col("b"), k), a=a, b=b) == want


@pytest.mark.parametrize("position, said", [(8, "the data is stale"), (10, "it was truncated"), (22, "only 3 of 40"), (None, "all is fine")])
def test_flags_of_text(spark, position, said):
    assert one(spark, T.flag(F.col("t")), t=said) == position


# Parsers


def test_parsers():
    assert P.split_calls('[Market Trends API(a="x, (y)", b=[1, 2]), Get(c=3)] tail') == [("Market Trends API", 'a="x, (y)", b=[1, 2]'), ("Get", "c=3")]
    assert P.split_calls("no calls") == []
    assert P.split_top_level("a, (b, c), 'd, e'") == ["a", " (b, c)", " 'd, e'"]
    assert P.split_top_level("a, (b") is None and P.split_top_level("'a") is None
    assert P.parse_args('a=1, b="x", c=yes, d=[1, {"k": 2}]') == ({"a": 1, "b": "x", "c": "yes", "d": [1, {"k": 2}]}, "ok")
    assert [P.parse_args(x)[1] for x in ("", "1, 2", "a=(1", None)] == ["empty", "positional", "unparsed", "empty"]
    assert [P.count_args(x) for x in ("", "a=1", "a=(1, 2), b='x, y'")] == [0, 1, 2]
    assert P.depth({"a": [{"b": 1}]}) == 3 and P.depth({}) == 0 == P.depth(1)
    assert P.identifiers(["Get Cars", "get_cars", "Get-Cars", "3x"]) == {"get_cars": "get_cars", "3x": "fn_3x", "Get Cars": "get_cars_2", "Get-Cars": "get_cars_3"}
    assert P.loads("{bad", "d") == "d" and P.loads(" ", 1) == 1 and P.loads("[1]") == [1]


def test_schemas_in_five_spellings():
    assert P.schema_of('Use: [{"name": "f", "parameters": {"type": "dict"}}] or not')[0::2] == ("json", ["f"])
    assert P.schema_of("<tool_name> a b </tool_name>")[0::2] == ("xml", ["a b"])
    assert P.schema_of("tool_name: f g\narguments:")[0::2] == ("yaml_block", ["f g"])
    assert P.schema_of("**tool_name**: f")[0::2] == ("markdown", ["f"])
    assert P.schema_of("tool_name & x\n f & y")[0] == "latex_tabular"
    assert P.schema_of("nothing")[0] == "unknown" and P.schema_of(None)[0] == "none"


@pytest.mark.parametrize("said", [
    '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>', 'Sure:\n```json\n[{"name": "f", "arguments": {"a": 1}}]\n```', '{"function": {"name": "f", "arguments": "{\\"a\\": 1}"}}',
    "[f(a=1)]", "<|tool_call_start|>[f(a=1)]<|tool_call_end|>", "{'name': 'f', 'args': {'a': 1}}", '<|tool_call|> [{"name": "f", "parameters": {"a": 1}}]', "[TOOL_CALLS] [f(2, a=1)]",
    '<function_call>{"name": "f", "args": {"a": 1}}</function_call>', '[{"name": "f", "arguments": {"a": 1}}, {"name": 3}, "junk"]', '<tool_call>[{"name": "f", "arguments": {"a": 1}}, {oops}]</tool_call>',
    "<|tool_call_start|>f(a=1), g(b=x), h(**k)<|tool_call_end|>", '<tool_call>{"name": "f", "arguments": {"a": 1}}', '```\n{"name": "f", "arguments": {"a": 1}}\n``` and ```json\n{oops\n```',
])
def test_calls_in_every_wrapper(said):
    assert C.parse_calls(said) == [{"name": "f", "args": {"a": 1}}]


@pytest.mark.parametrize("value", ["</tool_call>", "<tool_call>{", "}]", "a\"b", "it's", "\\", "<|tool_call_end|>"])
def test_arguments_may_hold_what_ends_a_wrapper(value):
    call = json.dumps({"name": "f", "arguments": {"a": value}})
    want = [{"name": "f", "args": {"a": value}}]
    for said in (f"<tool_call>{call}</tool_call> so", f"<|tool_call|>[{call}]", f"```json\n{call}\n```", call, f"<|tool_call_start|>[f(a={value!r})]<|tool_call_end|>"):
        assert C.parse_calls(said) == want
    assert C.parse_calls(f"<tool_call>{call}</tool_call>\n<|tool_call|>{call}") == want * 2


@pytest.mark.parametrize("said", [None, "", "no call", "<tool_call>", "<tool_call></tool_call>", "[1, 2]", "{", "[f(a=1)", "f(a=1)", '{"name": "f", "arguments": "x"}', '{"name": "f", "arguments": null}', "[" * 5000, "[f(a=b)]"])
def test_what_is_no_call(said):
    assert C.parse_calls(said) == [] and C.calls_json(said) == "[]"


def test_canonical_tools_keep_what_is_declared():
    unknown: dict = {}
    raw = [{"function": {"name": "Get It", "parameters": {"properties": {"a": {"type": "List[str]"}, "b": {"type": "money"}}, "required": ["a", "z"]}}}, {"name": "x", "arguments": {"p": {"type": "int"}}}, "junk", {"description": "nameless"}]
    tools, names = P.canonical_tools(raw, unknown)
    assert [t["name"] for t in tools] == ["get_it", "x"] and names["Get It"] == "get_it" and unknown == {"money": 1}
    assert tools[0]["parameters"] == {"type": "object", "properties": {"a": {"type": "array"}, "b": {"type": "money"}}, "required": ["a"]}
    assert tools[1]["parameters"]["properties"] == {"p": {"type": "integer"}}


@pytest.mark.parametrize("most", [None, 3])
@pytest.mark.parametrize("n_sets", [3, 70])
def test_attribution_to_many_sets_matches_brute_force(spark, most, n_sets):
    rng = random.Random(n_sets)
    draw = lambda k: " ".join(rng.choice("abcde") for _ in range(k))
    items = [(f"s{k:02}", i, draw(rng.randrange(1, 9))) for k in range(n_sets) for i in range(2)]
    docs = [(i, draw(rng.randrange(0, 25))) for i in range(30)] + [(30, None), (31, "")]
    three = lambda t: [tuple(w[i : i + 3]) for w in [(t or "").split()] for i in range(len(w) - 2)]
    owner = {}
    for s, i, t in sorted(items):
        for g in three(t):
            owner.setdefault(g, {}).setdefault(s, i)
    idx = contamination.index(spark.createDataFrame(items, "named string, item_id long, text string"), set_name=F.col("named"), n=3)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.sets, r.n_hits, r.n_windows) for r in contamination.attributed(rows, ["doc_id"], idx, n=3, most=most).collect()}
    want, each = {}, collections.Counter()
    for i, t in docs:
        hit = [g for g in three(t) if g in owner]
        if hit:
            want[i] = (sorted({s for g in hit for s in owner[g]}), len(hit), len(three(t)))
        for g in hit:
            for s, x in owner[g].items():
                each[i, s, x, "alone"] += 1
                each[i, s, x, "owned"] += s == min(owner[g])
    assert got == want
    told = contamination.attributed(rows, ["doc_id"], idx, by_item=True, n=3, most=most).collect()
    assert {(r.doc_id, r.set, r.item): (r.n_alone, r.n_owned) for r in told} == {k[:3]: (each[*k[:3], "alone"], each[*k[:3], "owned"]) for k in each}
    assert sum(r.n_owned for r in told) == sum(n for _, n, _ in want.values())
    assert contamination.attributed(rows, ["doc_id"], idx.limit(0), n=3).count() == 0


def test_budgets_meet_their_doses_and_floors(spark):
    avail = spark.createDataFrame([("tool", 1000), ("struct", 100), ("sql", 3000), ("code", 6000), ("block", 50), ("old", 10_000)], "role string, tokens long")
    kinds = {"tool": (sample.PASSES, 1.0), "struct": (sample.PASSES, 3.0), "sql": (sample.FILL, 0.0), "code": (sample.FILL, 0.0), "block": (sample.DOSE, 2.0), "old": (sample.PART, 0.0)}
    arms = {"a": (5000.0, {}), "b": (5000.0, {"block": 0.0}), "c": (5000.0, {"old": 0.1}), "d": (80.0, {}), "e": (None, {}), "f": (None, {"tool": 20.0}), "g": (1e6, {"old": 0.5})}
    rules = [(arm, role, kind, own.get(role, amount)) for arm, (_, own) in arms.items() for role, (kind, amount) in kinds.items()]
    told = sample.allocate(avail, spark.createDataFrame([(a, b, 0.5) for a, (b, _) in arms.items()], "arm string, budget double, floor double"), spark.createDataFrame(rules, "arm string, role string, kind string, amount double")).collect()
    got = {(r.arm, r.role): r for r in told}
    for arm, (budget, _) in arms.items():
        if budget:
            assert sum(r.tokens for r in told if r.arm == arm) == pytest.approx(budget)
    assert got["a", "block"].repeats == 2.0 and got["b", "block"].tokens == 0 and got["b", "tool"].tokens > got["a", "tool"].tokens
    assert got["c", "old"].tokens == 500 and got["d", "block"].tokens == 80 and got["d", "tool"].tokens == 0 and got["d", "tool"].notes == ["doses exceed the budget"]
    assert got["e", "tool"].tokens == 1000 and got["e", "sql"].tokens == pytest.approx(1300 / 3) and got["e", "code"].tokens == 2 * got["e", "sql"].tokens
    assert got["f", "sql"].tokens == 3000 and got["f", "sql"].notes == ["filler is used up"] and got["f", "tool"].priority > 0.5 and got["g", "old"].tokens == 10_000
    assert not got["a", "tool"].notes and sample.allocate(avail.limit(0), spark.createDataFrame([("a", 9.0, 0.5)], "arm string, budget double, floor double"), spark.createDataFrame(rules[:6], "arm string, role string, kind string, amount double")).filter("tokens <> 0").count() == 0


def test_headlines_and_their_spellings():
    assert synth.headline({"a": 5, "b": {"c": [1234567, 8.0]}, "d": "long enough text"}) == (("b", "c", 0), ["1234567", "1,234,567"])
    assert synth.headline({"a": True, "b": None, "c": " telling ", "d": "telling longer"}) == (("d",), ["telling longer"])
    assert synth.headline({"a": True, "b": "short"}) == (None, []) == synth.headline({}) and synth.headline([2.50]) == ((0,), ["2.5"])
    assert [synth.spellings(x) for x in (999, -1000, 1e20, "USD", " Lima ", None, False)] == [["999"], ["-1000", "-1,000"], ["1e+20"], [], ["Lima"], [], []]
    told = {"-1.5": False, "123": False, "1234": True, "12.5": True, "1.25": True, "-100": True, "Lima": True, "ok": False, "": False, "....": True}
    assert {x: synth.identifying(x) for x in told} == told and not synth.identifying(None)


def test_flips_carry_over_where_the_verdict_agrees(spark):
    flipped = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1), (9, 0)], "id long, now int")
    after = spark.createDataFrame([("x", 1, "a", 0), ("x", 2, "a", 0), ("x", 3, "b", 1), ("x", 4, "b", 0), ("y", 4, "b", 1)], "arm string, id long, cat string, correct int")
    recorded = spark.createDataFrame([("x", 0.25), ("y", 0.5)], "arm string, macro double")
    got = {r.arm: r for r in compare.transferred(flipped, after, recorded, "id", "cat").collect()}
    x, y = got["x"], got["y"]
    assert (x.macro, x.observed, x.implied, x.residual, x.n_items, x.n_missing) == (0.25, 0.0, -0.25 + 0.25, 0.0, 2, 1)
    assert (y.macro, y.observed, y.implied, y.residual, y.n_items, y.n_missing) == (1.0, 0.5, 0.0, 0.5, 0, 4)


@pytest.mark.parametrize("k", [1, 5, 90])
def test_first_rows_of_hot_groups(spark, k):
    rows = [("hot", i * 7 % 3001) for i in range(3001)] + [(f"g{i % 40}", i) for i in range(200)] + [(None, 3)]
    got = sample.first_k(spark.createDataFrame(rows, "g string, v long").repartition(9), ["g"], ["v"], k).collect()
    want = collections.defaultdict(list)
    for g, v in rows:
        want[g].append(v)
    assert sorted(map(tuple, got), key=str) == sorted(((g, v) for g, own in want.items() for v in sorted(own)[:k]), key=str)


def test_outputs_are_promoted_together_or_not_at_all(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/out"
    two = {"a": spark.range(9), "b": spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k int, t string")}
    told = readers.promote(spark, two, at)
    assert {n: r["rows"] for n, r in told.items()} == {"a": 9, "b": 3} and sorted(r[0] for r in spark.read.parquet(f"{at}/a").collect()) == list(range(9))
    more = two | {"a": spark.range(5)}
    with pytest.raises(FileExistsError):
        readers.promote(spark, more, at)
    with pytest.raises(ValueError, match="b holds"):
        readers.promote(spark, more, at, expected={"b": {"rows": 4}}, force=True)
    with pytest.raises(ValueError, match="a holds"):
        readers.promote(spark, more, at, expected={"a": told["a"]}, force=True)
    assert spark.read.parquet(f"{at}/a").count() == 9 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]
    assert readers.promote(spark, more, at, expected={"b": told["b"]}, force=True)["a"]["rows"] == 5 and spark.read.parquet(f"{at}/a").count() == 5
    real = readers._renamed
    monkeypatch.setattr(readers, "_renamed", lambda store, a, b: False if str(b).endswith("/b") and "/staged/" in str(a) else real(store, a, b))
    with pytest.raises(OSError):
        readers.promote(spark, two, at, force=True)
    assert spark.read.parquet(f"{at}/a").count() == 5 and spark.read.parquet(f"{at}/b").count() == 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]


@pytest.mark.parametrize("text, n", [
    ("One. Two! Three?", 3), ("Dr. Roe met Mrs. J. R. Poe.", 1), ("It cost 3.5 km. So", 2), ('He said "no." Then (yes!) he left.', 3), ("Wait... what?! Yes", 3), ("", 0), ("  ", 0), ("no end", 1), ("E.g. this, i.e. that.", 1), ("All etc.", 1), ("Ja. Äh… Öl.", 3),
])
def test_sentences_end_where_no_stop_is_explained(spark, text, n):
    assert one(spark, T.sentence_count(F.col("t")), t=text) == n


def test_languages_by_trigrams(spark):
    rows = [(t, lang) for lang, ts in {"en": ["the house of the man", "this thing that is there"], "de": ["das haus und der mann", "nicht ein ding ist da"]}.items() for t in ts] + [("der der der", None), (None, "en")]
    model = languages.fit(spark.createDataFrame(rows, "text string, lang string"), kept=60)
    assert model.names == ["de", "en"] and len(model.shares) == 60
    texts = spark.createDataFrame([(0, "the thing is this"), (1, "Das Ding, und nicht der Mann!"), (2, "12 %"), (3, None), (4, "")], "i int, t string")
    assert [r.x for r in texts.orderBy("i").select(model.language(F.col("t")).alias("x")).collect()] == ["en", "de", None, None, None]
    assert [r.x for r in texts.orderBy("i").select(instructions.CHECKERS["language:response_language"](F.col("t"), language="en", model=model).alias("x")).collect()] == [True, False, True, True, True]


def test_texts_are_told_together_as_each_alone():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcßü中𝔘") for _ in range(draw.randrange(1, 6)))
    texts = [" " + " ".join(word() for _ in range(draw.randrange(30))) + " " for _ in range(500)] + ["", " ", "  ", " a "]
    grams = [[t[i : i + 3] for i in range(len(t) - 2)] for t in texts]
    numbers, of = languages.numbered(texts)
    assert [(languages.spelled(g), i) for g, i in zip(numbers.tolist(), of.tolist(), strict=True)] == [(g, i) for i, own in enumerate(grams) for g in own]
    assert [t for few in languages._short(texts) for t in few] == texts and max(map(len, languages._short(texts))) <= languages.ROWS

    every = sorted({g for own in grams for g in own})
    shares = {g: (x, x if draw.random() < 0.9 else -4.0, -3.0) for g in draw.sample(every, len(every) // 3) for x in [math.log(draw.random())]}
    model = languages.Model(["x", "y", "z"], shares)

    def alone(own):
        own = [shares[g] for g in own if g in shares]
        sums = [math.fsum(s[i] for s in own) for i in range(3)]
        return "xyz"[sums.index(max(sums))] if own else None

    assert model.tell(texts) == [alone(own) for own in grams]
    assert languages.Model([], {}).tell([" a "]) == [None] and model.tell([]) == []


def test_parts_are_walked_once_however_many(spark):
    import time

    text = lambda mark: F.concat(F.col("id").cast("string"), F.repeat(F.lit(f"word {mark}\n"), F.lit(5000)))
    many = spark.range(0, 20, 1, 1).select(text("***").alias("t"), text("******").alias("u"))
    began = time.time()
    kept = many.select(instructions.follows(F.col("t"), "length_constraints:number_paragraphs", num_paragraphs=2).alias("a"), instructions.follows(F.col("u"), "combination:two_responses").alias("b"))
    assert kept.filter("a or b").count() == 0 and time.time() - began < 20


@pytest.mark.parametrize("text, n", [("a *** b", 2), ("***a\n***b***", 2), ("a *** *** b", None), ("*** ***a", None), ("a***\t", 1), ("a", 1), ("***", 0), ("*** ***", None), ("******", None), ("****", 1), ("*** a *** b *** c *** ", 3)])
def test_paragraphs_between_marks(spark, text, n):
    for k in range(4):
        assert one(spark, instructions.CHECKERS["length_constraints:number_paragraphs"](F.col("t"), num_paragraphs=k), t=text) == (n == k)


@pytest.mark.parametrize("text, good", [("a ****** b", True), ("a******  a ", False), ("******a******b****** ", True), ("a************b", False), ("a", False), ("a******b******c", False), ("******", False)])
def test_two_responses_differ(spark, text, good):
    assert one(spark, instructions.CHECKERS["combination:two_responses"](F.col("t")), t=text) == good


# Adapters and renderers


def test_a_worker_holds_few_rows_of_a_batch(spark):
    import os

    def grown(text):
        with open("/proc/self/statm") as f:
            used = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        return {"used": used, "copy": [text + str(i) for i in range(20)]}

    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("a"), F.lit(2000)).alias("text"))
    kind = "struct<used:bigint,copy:array<string>>"
    used = rows.select(by_row(grown, kind)(F.col("text")).alias("x")).agg(F.max("x.used") - F.min("x.used")).first()[0]
    assert used < 200 << 20  # all results of a batch are 320 MB

    shaped = spark.range(1).select(by_row(lambda i: {"a": 7, "b": [True, None, "x"], "c": None}, "struct<a:string,b:array<string>,c:int,d:string>")(F.col("id")).alias("x")).first().x
    assert (shaped.a, shaped.b, shaped.c, shaped.d) == ("7", ["true", None, "x"], None, None)
    assert spark.range(0).select(by_row(lambda i: i, "bigint")("id")).collect() == []


def test_tool_sources(spark):
    system = 'Tools: [{"name": "Get Cars", "parameters": {"type": "dict", "properties": {"make": {"type": "str"}}, "required": ["make"]}}] end'
    talk = json.dumps([{"from": "user", "value": "cars?"}, {"from": "assistant", "value": '[Get Cars(make="A, B")]'}])
    refuse = json.dumps([{"from": "user", "value": "cars?"}, {"from": "assistant", "value": "I cannot."}])
    rows = spark.createDataFrame([(system, talk), (system, refuse), (None, "not json")], "system string, conversations string")
    a, b, c = (r.record for r in adapters.adapt(rows, "toolace").collect())
    assert a.calls[0].name == "Get Cars" and a.calls[0].n_args == 1 and not a.calls[0].ident and a.refusal is None and a.tools[0].required == ["make"]
    assert b.refusal == "I cannot." and not b.calls and c.error is None and c.prompt == "" and c.group_key == "no-tools"
    x, y, z = (r.rendered for r in render.render(rows, "toolace").collect())
    assert x.messages[-1].content == '<tool_call>{"arguments": {"make": "A, B"}, "name": "get_cars"}</tool_call>'
    assert (y.reason, z.reason) == ("no_call_turn", "schema_not_json:none")


def test_hermes_and_reasons(spark):
    talk = json.dumps([{"from": "human", "value": "q"}, {"from": "gpt", "value": '<tool_call>\n{"name": "f", "arguments": {"b": 1}}\n</tool_call>'}])
    rows = spark.createDataFrame([("1", talk, '[{"name": "f"}]', None), ("2", talk, None, '{"type": "object"}'), ("3", talk, None, None)], "id string, conversations string, tools string, schema string")
    r = {x.id: x for x in render.render(adapters.adapt(rows, "hermes"), "hermes").collect()}
    assert r["1"].record.calls[0].args == '{"b": 1}' and r["2"].record.group_key.startswith("json-schema:")
    assert r["1"].rendered.messages[-1].content == '<tool_call>{"arguments": {"b": 1}, "name": "f"}</tool_call>'
    assert r["3"].rendered.reason == "neither_tools_nor_schema"
    counted = render.reasons(render.render(rows, "hermes"), [])
    assert [(x.reason, x.n_rows) for x in counted.collect()] == [("neither_tools_nor_schema", 1)]


def test_plain_sources(spark):
    sql = spark.createDataFrame([("q", "CREATE TABLE b (y int); CREATE TABLE a (x int)", "SELECT 1"), ("q2", "create table A (x int)\nCREATE TABLE b (y int)", ""), ("", "", "a")], "question string, context string, answer string")
    got = render.render(adapters.adapt(sql, "sql_create_context"), "sql_create_context").collect()
    assert [len(x.rendered.messages or []) for x in got] == [3, 0, 0] and [x.rendered.reason for x in got] == [None, "empty_answer", "empty_prompt"]
    code = spark.createDataFrame([("q", "Text\n```python\nimport os, sys.path\nfrom a.b import c\ndef Foo():\n  os.walk(x)\n```", "py")], "query string, answer string, lang string")
    s = adapters.adapt(code, "codefeedback").first().symbols
    assert (s.mods, s.called, s.defined) == (["a", "os", "sys"], ["foo", "os.walk"], ["foo"])
    only = adapters.adapt(spark.createDataFrame([(None, "t")], "prompt string, text string"), "prompt_only").first().record
    assert only.prompt == "t" and only.row_id == adapters.sha("t")


def test_conversation_ends_on_an_answer_or_joins_the_pool(spark):
    turn = "array<struct<from:string,value:string>>"
    rows = [("a", [("human", "q"), ("gpt", "a"), ("human", "more")]), ("b", [("human", "q")]), ("c", [("gpt", "a")]), ("d", [("other", "x"), ("user", " q "), ("model", " a ")])]
    got = {r.id: r.rendered for r in render.render(spark.createDataFrame(rows, f"id string, conversations {turn}"), "antidoom").collect()}
    assert [m.role for m in got["a"].messages] == ["user", "assistant"] and got["b"].prompt_only and got["c"].reason == "no_user_turn"
    assert [(m.role, m.content) for m in got["d"].messages] == [("user", "q"), ("assistant", "a")]


def test_rarity_keys(spark):
    sym = "struct<mods:array<string>,called:array<string>,defined:array<string>>"
    rows = [(1, ([], ["a", "b"], [])), (2, (["m"], ["a"], [])), (3, (["m"], ["b"], [])), (4, ([], ["z"], ["f"])), (5, ([], [], [])), (6, ([], ["a"], []))]
    got = {r.k: (r.group_key, r.tier) for r in adapters.rarity_keys(spark.createDataFrame(rows, f"k long, symbols {sym}"), "k", F.lit("py")).collect()}
    assert got == {1: ("b", "shared"), 2: ("a", "shared"), 3: ("b", "shared"), 4: ("def:f", "defined"), 5: ("bare:py", "bare"), 6: ("a", "shared")}


# Graders


def test_values_and_calls():
    assert grade.same_value("1,000", 1000.0000001) and not grade.same_value(True, 1) and not grade.same_value("true", True)
    assert grade.same_value([1, "A b"], ["1", " a  B"]) and not grade.same_value([1, 2], [2, 1]) and grade.same_value({"a": 1}, {"a": "1"})
    want = [{"f": {"a": [1], "b": ["", "x"]}}]
    assert grade.score_calls("simple", [{"name": "f", "args": {"a": 1}}], want)[0]
    assert "missing required" in grade.score_calls("simple", [{"name": "f", "args": {}}], want)[1]
    assert "not in the contract" in grade.score_calls("simple", [{"name": "f", "args": {"a": 1, "c": 2}}], want)[1]
    assert grade.score_calls("irrelevance", [], None)[0] and not grade.score_calls("live_relevance", [], None)[0]
    assert grade.score_calls("simple", [], want)[1] == "expected 1 call(s), parsed 0"


def test_structured_answers():
    one = '{"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}'
    rule = {"require_code_block": True, "require_no_commentary": True, "top_level_count": 2, "json_schema": '{"type": "array", "items": %s}' % one}
    assert grade.structured('```json\n[{"a": 1}, {"a": 2}]\n```', rule)["correct"]
    bad = grade.structured('Here:\n```json\n[{"a": "x"}, {}]\n```', rule)
    assert not bad["correct"] and len(bad["errors"]) == 3 and bad["score"] < 1
    assert bad["matched"] == 0 and grade.structured('```\n[{"a": 1}, {}]\n```', rule)["matched"] == 0.5
    assert grade.structured("a: 2020-01-01", {"output_format": "yaml", "json_schema": '{"type": "object", "properties": {"a": {"type": "string"}}}'})["correct"]
    assert grade.structured("no", {})["errors"] == ["parse: no JSON"] and not grade.structured("{", {})["correct"]


@pytest.mark.parametrize("said, rule, right", [
    ("```yaml\na: [1, 2]\nb: 1\n```", {"output_format": "yaml"}, True), ("```yaml\n[{a: 1}]\n```", {"output_format": "yaml"}, False), ("a:\n- {b: 1}", {"output_format": "yaml"}, False),
    ("```json\na: 1\n```", {"output_format": "yaml"}, False), ("```yaml\n{}\n```", {}, False), ("```json\n{}", {}, False), ("<think>{</think>{}", {}, True), ("{} tail", {}, False),
    ('{"k": [1]}', {"require_wrapper_key": True, "top_level_key": "k", "top_level_count": [1, 2]}, True), ('{"z": [1]}', {"require_wrapper_key": True, "top_level_key": "k"}, False),
    ("[1]", {"require_wrapper_key": True}, False), ('{"k": [1]}', {}, False), ("[1, 2, 3]", {"top_level_count": [1, 2]}, False), ("[1]", {"json_schema": '{"type": "array", "minItems": 2}'}, False),
    ('{"a": null}', {"json_schema": '{"type": "object", "properties": {"a": {"type": ["string", "null"]}}}'}, True), ('{"a": true}', {"json_schema": '{"type": "object", "properties": {"a": {"type": "integer"}}}'}, False),
    ('{"a": 3}', {"json_schema": '{"type": "object", "properties": {"a": {"type": "number", "maximum": 2}}}'}, False), ('{"b": 3}', {"json_schema": '{"type": "object", "properties": {}}'}, False),
    ('{"a": "x"}', {"json_schema": '{"type": "object", "properties": {"a": {"type": "string", "enum": ["x"]}}}'}, True), ("[" * 200_000, {}, False), ("[" * 200_000, {"output_format": "yaml"}, False),
])
def test_structured_rules(said, rule, right):
    assert grade.structured(said, rule)["correct"] is right


def test_deep_completions_are_verdicts(spark):
    deep = ["[" * 200_000, '{"name": "f", "arguments": ' + '{"a": ' * 900 + "1" + "}" * 901, "[f(a=" + "(" * 5000]
    rows = spark.createDataFrame([(x,) for x in deep], "t string").select(grade.graded_calls(F.lit("simple"), F.col("t"), F.lit('[{"f": {}}]')).alias("v"))
    assert [r.v.correct for r in rows.collect()] == [False] * 3


@pytest.mark.parametrize("instruction, kwargs, good, bad", [
    ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n- b", "* a"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a\n***\nb", "a\n***\n***\nb"),
    ("combination:two_responses", {}, "a\n******\nb", "a\n******\na"),
    ("detectable_format:title", {}, "<<T>> x", "<< >> x"),
    ("detectable_format:json_format", {}, '```json\n{"a": 1}\n```', "{a"),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "So"}, "a\n\nso, b", "a\n\nb"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b*", "*a* ** **"),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}, "x\nP.S. y", "x"),
    ("change_case:english_capital", {}, "THE CAT AND THE DOG", "The Cat"),
    ("change_case:english_lowercase", {}, "the cat", "The cat"),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "Section 1 a Section 2 b", "Section 1 a"),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "THE BIG cat", "The BIG cat"),
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two!", "One."),
    ("language:response_language", {"language": "fr"}, "le chat et la souris dans les bois", "the cat and the mouse in the wood"),
])
def test_instructions(spark, instruction, kwargs, good, bad):
    rule = instructions.follows(F.col("t"), instruction, **kwargs)
    assert one(spark, rule, t=good) is True and one(spark, rule, t=bad) is False and one(spark, rule, t="  ") is False


def test_loose_score_forgives_a_first_line(spark):
    said = "Sure, here it is:\n*the cat*"
    assert not one(spark, instructions.follows(F.col("t"), "punctuation:no_comma"), t=said)
    assert one(spark, instructions.loosely(F.col("t"), "punctuation:no_comma"), t=said)


def test_every_registered_instruction_has_a_checker():
    assert len(instructions.CHECKERS) == 25


# Statistics


@pytest.mark.parametrize("minus, plus, p", [(0, 0, 1), (1, 0, 1), (0, 5, 0.0625), (2, 8, 0.109375)])
def test_exact_test(spark, minus, plus, p):
    assert math.isclose(one(spark, compare.exact_two_sided(F.col("a"), F.col("b")), a=float(minus), b=float(plus)), p, rel_tol=1e-9)


def test_paired_and_unmatched(spark):
    ref = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False), ("e", True)], "k string, r boolean")
    cand = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", False), ("e", True), ("z", True)], "k string, c boolean")
    got = ref.join(cand, "k").agg(*compare.paired(F.col("r"), F.col("c"))).first()
    assert (got.n_minus, got.n_zero, got.n_plus, got.n) == (1, 3, 1, 5)
    assert [tuple(r) for r in compare.unmatched(ref, cand, "k").collect()] == [("z", "b")]


@pytest.mark.parametrize("p, want", [([0.01, 0.02, 0.03], [0.03, 0.04, 0.04]), ([0.4, 0.5, 0.9], [1, 1, 1])])
def test_holm(spark, p, want):
    rows = spark.createDataFrame(list(enumerate(p)), "k long, p double")
    assert [round(r.p_holm, 12) for r in compare.holm(rows, "p", [], "k").orderBy("k").collect()] == want


@pytest.mark.parametrize("pos, neg, want", [([0.9, 0.8], [0.2, 0.1], 1), ([0.5], [0.5], 0.5), ([0.5, 0.9], [0.5, 0.1], 0.875), ([0.5], [], None)])
def test_auroc(spark, pos, neg, want):
    rows = spark.createDataFrame([(s, True) for s in pos] + [(s, False) for s in neg], "s double, y boolean")
    assert compare.auroc(rows, "s", F.col("y")).first().auroc == want


@pytest.mark.parametrize("n, p", [(5, 0.3), (40, 0.9), (300, 0.01), (1000, 0.4), (0, 0.5), (7, 0.0), (7, 1.0)])
def test_binomial_draws_have_their_moments(spark, n, p):
    draws = [r[0] for r in spark.range(4000).select(compare.binomial(F.lit(n), F.lit(float(p)), 1, F.col("id"))).collect()]
    mean, var = sum(draws) / 4000, n * p * (1 - p)
    assert abs(mean - n * p) <= 5 * math.sqrt(var / 4000) and 0 <= min(draws) and max(draws) <= n
    assert var == 0 or abs(sum((x - mean) ** 2 for x in draws) / 4000 / var - 1) < 0.15


def test_tails_are_exact_at_any_count(spark):
    for n in [*range(40), 200, 999, 3001]:
        for k in range(0, n // 2 + 1, max(1, n // 30)):
            want = min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)) if n else 1.0
            assert tails.two_sided([k], [n - k])[0] == pytest.approx(want, rel=1e-11)
    huge = tails.two_sided([499_990_000, 0, 5 * 10**8], [500_010_000, 10**9, 5 * 10**8])
    assert huge[0] == pytest.approx(math.erfc((10_000 - 0.5) / math.sqrt(1e9) * math.sqrt(2)), rel=1e-6) and huge[1] == 0 and huge[2] == 1
    got = spark.createDataFrame([(3, 9), (None, 1), (0, 0)], "a long, b long").select(tails.exact_two_sided(F.col("a"), F.col("b")).alias("p")).collect()
    assert got[0].p == pytest.approx(2 * sum(math.comb(12, i) for i in range(4)) / 2**12) and got[1].p is None and got[2].p == 1


def test_calibration_and_macro(spark):
    assert compare.ece(spark.createDataFrame([(0.0, False), (0.0, False), (1.0, True), (1.0, True)], "s double, y boolean"), "s", F.col("y")).first().ece == 0
    rows = [("simple", 1, 0), ("simple", 1, 0)] + [("live", 0, 1)] * 3 + [("live", 1, 1)] * 5
    got = compare.macro_delta(spark.createDataFrame(rows, "c string, r int, k int"), "c", "r", "k").first()
    assert math.isclose(got.item_delta, 0.1) and math.isclose(got.macro_delta, (-1 + 3 / 8) / 2)


def test_bootstrap_and_permutation(spark):
    cells = spark.createDataFrame([("a", 40, 900, 60), ("b", 0, 0, 0), ("c", 4, 90, 6), ("d", 5, 0, 0)], "k string, n_minus long, n_zero long, n_plus long")
    wide, narrow = ({r.k: r for r in compare.bootstrap(cells, "k", level=x).collect()} for x in (0.95, 0.8))
    se = math.sqrt(0.1 - 0.02**2) / math.sqrt(1000)
    assert abs((wide["a"].high - wide["a"].low) / 2 / (1.96 * se) - 1) < 0.1 and wide["a"].mean == 0.02 and wide["b"][1:] == (0, 0, 0) and wide["d"][1:] == (-1, -1, -1)
    assert wide["a"].low < narrow["a"].low < narrow["a"].high < wide["a"].high and wide["c"].low < 0.02 < wide["c"].high
    assert compare.bootstrap(cells, "k").orderBy("k").collect() == compare.bootstrap(cells.repartition(3), "k").orderBy("k").collect()
    rows = [("sure", x, x == 1.0) for x in [1.0] * 8 + [0.0] * 8] + [("even", float(i % 5), i < 10) for i in range(20)] + [("one", 1.0, True)]
    got = {r.g: r for r in compare.permutation(spark.createDataFrame(rows, "g string, v double, a boolean"), "v", F.col("a"), "g").collect()}
    assert got["sure"].p < 0.01 and got["even"].p == 1 and got["one"].p == 1 and (got["sure"].n_a, got["sure"].diff) == (8, 1)
    exact = [sum(x) for x in itertools.combinations([1.0] * 8 + [0.0] * 8, 8)]  # the share of exchanges at least as far apart
    assert abs(got["sure"].p - sum(x in (0, 8) for x in exact) / len(exact)) < 1e-3


def test_running_sums_do_not_depend_on_spans(spark, monkeypatch):
    rng = random.Random(7)
    rows = [("ab"[i % 2], v, rng.randrange(9)) for i in range(2) for v in rng.sample(range(500), 120)] + [(None, 3, 4)]
    cells = spark.createDataFrame(rows, "g string, v long, n long")
    for spans in (1, 3, 256):
        monkeypatch.setattr(ranks, "SPANS", spans)
        for r in ranks.running(cells, ["g"], "v", {"s": F.col("n")}).collect():
            own = [x for x in rows if x[0] == r.g]
            assert (r.s, r.s_all) == (sum(n for _, v, n in own if v < r.v), sum(n for *_, n in own))
    assert ranks.running(cells.limit(0), ["g"], "v", {"s": F.col("n")}).count() == 0


def test_blocks_movers_and_entropy(spark):
    rows = spark.createDataFrame([("s", "a", 0.1, 0.4), ("s", "b", 0.5, 0.5), ("t", "c", 0.9, 0.2), ("t", "d", 0.1, 0.3)], "g string, k string, b double, t double")
    got = {r.g: r for r in compare.stratum_blocks(rows, "g", "b", "t").collect()}
    assert (got["s"].n, got["s"].n_up, got["s"].n_tied, round(got["s"].median_diff, 9)) == (2, 1, 1, 0.3) and (got[None].n, got[None].n_down) == (4, 1)
    assert [r.k for r in compare.movers(rows, "k", F.round(F.col("t") - F.col("b"), 9), 3).collect()] == ["c", "a", "d"]
    flat, sharp = (spark.createDataFrame([(x,)], "l array<double>").select(compare.entropy(F.col("l")).alias("e")).first().e for x in ([2.0] * 5, [50.0, 0.0, 0.0]))
    assert math.isclose(flat, 1) and sharp < 1e-9


def test_peakedness_and_controls(spark):
    base = "".join(random.Random(1).choice("abcdef") for _ in range(80))
    samples = [base] * 10 + [base[:-1] + "x"] * 5 + ["z" * 80] * 5
    rows = spark.createDataFrame([(1, s, base) for s in samples] + [(2, "", "a")], "k int, s string, g string")
    got, other = compare.peakedness(rows, "k", "s", "g").orderBy("k").collect()
    assert (other.n_within, other.peak, other.threshold, other.n) == (0, 0.0, 0, 1)
    assert (got.n_within, got.n_exact, got.peak, got.n_distinct, got.threshold) == (15, 10, 0.75, 3, 4)
    rows = [("simple", "simple_1", 100, True), ("simple", "simple_2", 200, False), ("simple", "simple_3", 105, False), ("live", "live_1", 50, True), ("live", "live_2", 55, False)]
    pairs = compare.matched_controls(spark.createDataFrame(rows, "c string, k string, n long, t boolean"), "c", "k", "n", "t").collect()
    assert {(r.treated, r.control) for r in pairs} == {("simple_1", "simple_3"), ("live_1", "live_2")}


def test_occurrence_and_flips(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, o long")
    assert sorted(r.key for r in compare.occurrence(rows, "id", "o").collect()) == ["a", "a#2", "b"]
    joined = spark.createDataFrame([(f"x{i}", "big", True, i != 7) for i in range(20)] + [("y", "small", True, True)], "k string, c string, r boolean, n boolean")
    assert [(r.k, round(r.implied, 6)) for r in compare.flips(joined, "k", "c", "r", "n").collect()] == [("x7", -0.025)]


# Duplicates, splits, samples, flags, checks


def test_first_wins_and_purity(spark):
    rows = spark.createDataFrame([(3, "A b", "test"), (1, "a B!", "train"), (2, "c", "val"), (4, None, "val")], "o long, t string, s string")
    assert sorted(r.o for r in dedup.first_wins(rows, dedup.prompt_key(F.col("t")), ["o"]).collect()) == [1, 2]
    assert sorted(r.o for r in dedup.first_split(rows, dedup.prompt_key(F.col("t")), "s", ["o"]).collect()) == [1, 2]


def test_splits_are_disjoint_filled_and_pure(spark):
    rng = random.Random(3)
    rows = [("n1" if i % 3 else "n2", f"g{rng.randrange(120)}", f"p{rng.randrange(1500)}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "ns string, g string, p string").repartition(7)
    got = split.assign(frame, "ns", "g").collect()
    again = {(r.ns, r.g): r.split for r in split.assign(frame.repartition(3), "ns", "g").collect()}
    assert all(again[r.ns, r.g] == r.split for r in got)
    for ns in ("n1", "n2"):
        groups = sorted((r for r in got if r.ns == ns), key=lambda r: __import__("hashlib").md5(f"{r.ns}\x1f{r.g}\x1f0".encode()).hexdigest())
        total, free = sum(r.n_rows for r in groups), [r for r in groups if r.n_rows <= 0.02 * sum(x.n_rows for x in groups)]
        want, filled, expect = min(0.05 * total, 0.4 * sum(r.n_rows for r in free)), {"test": 0, "val": 0}, {}
        for r in free:
            s = "test" if filled["test"] < want else "val" if filled["val"] < want else "train"
            expect[r.g] = s
            if s != "train":
                filled[s] += r.n_rows
        assert {r.g: r.split for r in groups} == {r.g: expect.get(r.g, "train") for r in groups}
    made = split.manifest(frame, "ns", "g", F.col("p"))
    assert made.count() == 3000 and split.impure(made, F.col("p")).first().n_impure == 0


def test_samples_nest_and_repeat(spark):
    pool = spark.createDataFrame([(i, "a" if i < 400 else "b" if i < 500 else "c") for i in range(520)], "i long, s string")
    assert sample.strata_targets({"a": 400, "b": 100, "c": 20}, 40, {"a": 0.45, "b": 0.05}, "c") == {"a": 18, "b": 2, "c": 20}
    with pytest.raises(ValueError):
        sample.strata_targets({}, 10, {"a": 0.9, "b": 0.2}, "c")
    draw = lambda n: {r.i for r in sample.bottom_k_by(pool, "s", sample.rank_key(F.col("i")), n).collect()}
    small, large = draw({"a": 9, "b": 1, "c": 10}), draw({"a": 18, "b": 2, "c": 20})
    assert len(small) == 20 and len(large) == 40 and small < large
    turns = sample.cyclic(pool.filter("s = 'c'"), "s", F.col("i"), {"c": 50})
    assert turns.count() == 50 and sorted(r.pos for r in turns.collect()) == list(range(50))
    assert sample.calibrate(1_000_000, {"x": 0.5}, {"x": {"mean": 100, "rows": 2500}})["x"] == {"tokens": 500_000, "rows": 5000, "repeats": 2.0}


def test_row_flags(spark):
    calls = "array<struct<name:string>>"
    rows = spark.createDataFrame([(1, [("f",)], ["f"]), (2, [("g",)], ["f"]), (3, [(None,)], ["f"]), (4, [("g",)], [])], f"k long, c {calls}, d array<string>")
    loose = {r.k: r.x for r in rows.select("k", flags.tool_mismatch(F.col("c"), F.col("d")).alias("x")).collect()}
    strict = {r.k: r.x for r in rows.select("k", flags.tool_mismatch(F.col("c"), F.col("d"), strict=True).alias("x")).collect()}
    assert loose == {1: False, 2: True, 3: True, 4: False} and strict[3] is False
    rule = flags.dropped_by(F.col("f").cast("int"), [("both", 3), ("one", 1)])
    assert [one(spark, rule, f=float(f)) for f in (3, 1, 2)] == ["both", "one", None]


def test_checks(spark):
    table = lambda rows: spark.createDataFrame(rows, "field string, value double")
    got = checks.reproduced(table([("a", 1.0), ("b", 101.0), ("c", 5.0), ("n", 1.0)]), table([("a", 1.0), ("b", 100.0), ("c", 9.0), ("m", 1.0)]), 0.02)
    assert {r.field: r.status for r in got.collect()} == {"a": "OK", "b": "DRIFT", "c": "FAIL", "n": "NEW", "m": "MISSING"}


def test_synthesis(spark):
    payload = {"city": "Lisbon", "temps": [{"max": 31.5}], "ok": True}
    for depth in (1, 2, 3):
        assert len({synth.corrupt(payload, m, depth)[0] for m in synth.CORRUPTIONS}) == 5
    assert synth.contradict(payload, "wrong_entity", {"q": "lisbon"})[0]["city"] == "Lisbox"
    assert synth.contradict(payload, "wrong_entity", {"q": "Rome"}) == (None, "no leaf repeats an argument")
    assert synth.missing_leaves(payload, "31.5") == ["Lisbon"]
    rows = spark.createDataFrame([("s", json.dumps(payload), '{"q": "Lisbon"}')], "scenario string, payload string, args string")
    got = synth.generated(rows).collect()
    assert len(got) == 27 and all(r.probe.skipped is None and r.probe.body for r in got)
    assert json.loads(next(r.probe.body for r in got if r["mode"] == "wrong_entity" and r.depth == 1))["data"]["city"] != "Lisbon"


# Sources, sinks, streams


def test_json_lines_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": bad}\n{"k": 2}\n')
    assert sorted(r.k for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k long").collect() if r.k) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "k long", bad="fail").collect()
    rows = spark.createDataFrame([("train", 1, False), ("val", 2, False), ("train", 3, True)], "s string, k long, pool boolean")
    readers.write_manifest(rows, str(tmp_path / "m"))
    with pytest.raises(Exception):  # noqa: B017
        readers.write_manifest(rows, str(tmp_path / "m"))
    readers.write_splits(rows, str(tmp_path / "w"), "s", F.col("pool"))
    assert spark.read.json(str(tmp_path / "w/rows")).count() == 2 and spark.read.json(str(tmp_path / "w/pool")).count() == 1
    assert readers.markdown(rows.filter("k = 1").select("k"), "T") == "## T\n\n| k |\n| --- |\n| 1 |\n"
    both = readers.union([rows, rows], "k")
    assert both.select("src", "ln").distinct().count() == 6


def test_harvest_falls_back_to_long_strings(spark):
    rows = spark.createDataFrame([(1, {"x": "short", "y": "a string that is long enough to be taken"})], "k long, m map<string,string>")
    assert readers.harvest(rows, ["prompt"]).first().harvest == "a string that is long enough to be taken"


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:10:00", i % 3, "a" if i % 2 else "b", 1.0) for i in range(100)]
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    frame.write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), frame.schema)
    query = events.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 100
    texts = spark.createDataFrame([(1, SPAN), (2, "other")], "k long, text string")
    texts.write.parquet(str(tmp_path / "texts"))
    idx = contamination.index(spark.createDataFrame([(1, SPAN)], "item_id long, text string"))
    hit = events.contaminated(events.read(spark, str(tmp_path / "texts"), texts.schema), idx, "k")
    events.run_once(hit, str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_profiles(spark):
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, 3), (" ", None)], "s string, n long")
    got = {r.field: (r.n_rows, r.n_null, r.n_blank) for r in profile.nulls(rows).collect()}
    assert got == {"s": (4, 1, 2), "n": (4, 1, 0)}


# Loss masks


@pytest.mark.parametrize("most", [1, 7, 40, 10_000])
def test_loss_masks_match_a_walk_over_the_characters(spark, most):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    at = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(at)
    plain.encode_special_tokens = True
    rng = random.Random(most)
    words = ["house", "Ünï", "中文", "🙂", "<|endoftext|>", "a  b", "\n", "x" * 9, ""]
    rows = [(i, [(r, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for r in rng.choices(["system", "user", "assistant", "tool"], k=rng.randrange(0, 6))]) for i in range(25)]
    rows += [(90, None), (91, [("assistant", None)])]
    docs = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>")
    got = {r.id: r for r in mask.loss_mask(docs, ["id"], F.col("messages"), at, most, 50_256).collect()}
    for i, messages in rows:
        text, marks = "", []
        for role, content in messages or []:
            head, body = f"<|im_start|>{role}\n", f"{content or ''}<|im_end|>"
            text += head + body + "\n"
            marks += [False] * len(head) + [role == "assistant"] * len(body) + [False]
        row = plain.encode(text, add_special_tokens=False)
        ids, starts = [*row.ids, 50_256], [*(a for a, _ in row.offsets), -1]
        want = [marks[a] for a in starts[:-1]] + [bool(messages) and messages[-1][0] == "assistant"]
        r = got[i]
        assert (r.n_tokens, r.ids, r.at, r.learnt) == (len(ids), ids[-most:], starts[-most:], want[-most:])
