"""Registered queries on runs and their comparison, manifests, synthesis, text functions, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import checks, compare, flags, grade, instructions, mask, render, sample, split, synth
from corpusloom.plans.catalogue import _ARMS, _MCNEMAR, _PAIRED, _RANK, _arms, query
from corpusloom.sources import readers
from corpusloom.sources.readers import folder, table
from corpusloom.streaming import events as streams


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# Joins of runs


@query("""WITH m AS (SELECT doc_id // 2 * 2 AS doc_id, doc_id AS o, source AS s FROM documents WHERE doc_id % 5 < 4), l AS (SELECT doc_id, arg_max(s, o) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, l.s, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN l USING (doc_id)""")
def manifest_last_wins(spark, d):
    docs = _docs(spark, d)
    manifest = docs.filter("doc_id % 5 < 4").select((F.floor(F.col("doc_id") / 2) * 2).alias("doc_id"), F.col("doc_id").alias("o"), F.col("source").alias("s"))
    return render.with_manifest(docs.select("doc_id"), manifest, ["doc_id"], "o").select("doc_id", "s", "matched")


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'irrelevance' WHEN 2 THEN 'live_relevance' ELSE 'parallel' END AS category, quality AS ground_truth
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR doc_id % 4 IN (1, 2)""")
def question_truths(spark, d):
    k = F.col("doc_id") % 4
    category = F.when(k == 0, "simple").when(k == 1, "irrelevance").when(k == 2, "live_relevance").otherwise("parallel")
    answers = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("ground_truth"))
    return grade.truths(_docs(spark, d).select(F.col("doc_id").alias("id"), category.alias("category")), answers)


@query("""WITH c AS (SELECT doc_id // 3 AS id, arg_min(source, doc_id) AS completion, arg_min(doc_id % 5, doc_id) AS k FROM documents WHERE doc_id % 7 > 0 GROUP BY doc_id // 3)
SELECT d.doc_id AS id, c.completion, coalesce(c.k <> d.doc_id % 5, false) AS mismatched FROM documents d LEFT JOIN c ON c.id = d.doc_id""")
def replay_first_wins(spark, d):
    docs = _docs(spark, d)
    sha = lambda c: T.prompt_sha(c.cast("string"))
    said = docs.filter("doc_id % 7 > 0").select(F.floor(F.col("doc_id") / 3).alias("id"), F.col("source").alias("completion"), sha(F.col("doc_id") % 5).alias("prompt_sha"), F.col("doc_id").alias("o"))
    out = grade.replayed(docs.select(F.col("doc_id").alias("id"), sha(F.col("doc_id") % 5).alias("prompt_sha")), said, "o")
    return out.select("id", "completion", "mismatched")


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, CASE lang WHEN 'en' THEN 400 WHEN 'fr' THEN 90 ELSE 0 END AS q FROM documents),
c AS (SELECT doc_id, unnest(range(ceil((q - i) / n)::BIGINT)) AS k, i, n FROM r WHERE q > i) SELECT doc_id, (i + k * n)::BIGINT AS pos, n_chars FROM c JOIN documents USING (doc_id)""")
def selection_with_repeats(spark, d):
    docs = _docs(spark, d)
    chosen = sample.cyclic(docs.select("doc_id", "lang"), "lang", sample.rank_key(F.col("doc_id")), {"en": 400, "fr": 90}).select("doc_id", F.col("pos").cast("long").alias("pos"))
    return sample.selected(docs.select("doc_id", "n_chars"), chosen, ["doc_id"]).select("doc_id", "pos", "n_chars")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')")
def where_map(spark, d):
    return flags.where(_docs(spark, d), {"lang": ["en", "fr"], "source": ["src1", "src2", "src3"]}).select("doc_id")


@query("SELECT lang, count(quality) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang")
def verdicts_only(spark, d):
    rows = compare.verdicts(_docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left"), "quality")
    return rows.groupBy("lang").agg(F.count("quality").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("k"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS n_words FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) <= 150")
def within_length(spark, d):
    n = T.word_count(F.col("text"))
    return render.within(_docs(spark, d), n, 150).select("doc_id", n.cast("long").alias("n_words"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND source NOT IN (SELECT source FROM documents WHERE doc_id % 3 > 0 AND source <> 'src1' AND source <> 'src4')")
def held_out_groups(spark, d):
    docs = _docs(spark, d)
    return split.held_out(docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 > 0 and source <> 'src1' and source <> 'src4'"), "source").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def both_sides(spark, d):
    return _docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 37")
def sample_first_n(spark, d):
    return sample.first_n(_docs(spark, d).select("doc_id"), "doc_id", 37)


@query(f"SELECT doc_id FROM documents ORDER BY {_RANK} LIMIT (SELECT round_even(100000 / avg(n_chars), 0)::BIGINT FROM documents)")
def sample_raw_mix(spark, d):
    return sample.raw_mix(_docs(spark, d).select("doc_id", "n_chars"), sample.rank_key(F.col("doc_id")), "n_chars", 100_000).select("doc_id")


# Statistics


@query(f"WITH {_ARMS} SELECT doc_id, round(cand - score, 12) AS change FROM arms ORDER BY abs(round(cand - score, 12)) DESC, doc_id LIMIT 25")
def largest_movers(spark, d):
    return compare.movers(_arms(spark, d), "doc_id", F.round(F.col("cand") - F.col("score"), 12), 25).select("doc_id", "change")


@query(f"""WITH {_ARMS}, x AS (SELECT unnest([lang, 'all']) AS lang, ref, score, round(score - ref, 12) AS diff FROM arms), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY diff) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM x),
b AS (SELECT lang, count(*) AS n, round(avg(ref), 9) AS base, round(avg(score), 9) AS tuned, round(avg(diff), 9) AS mean_diff, round(max(diff) FILTER (WHERE i = m // 2), 9) AS median_diff,
 count(*) FILTER (WHERE diff > 0) AS n_plus, count(*) FILTER (WHERE diff < 0) AS n_minus, count(*) FILTER (WHERE diff = 0) AS n_tied FROM r GROUP BY lang)
SELECT lang, n, base, tuned, mean_diff, median_diff, n_plus AS n_up, n_minus AS n_down, n_tied, round({_MCNEMAR}, 9) AS sign_p FROM b""")
def stratum_blocks(spark, d):
    rows = _arms(spark, d).select("lang", F.col("ref").cast("double").alias("ref"), "score")
    out = compare.stratum_blocks(rows, "lang", "ref", "score")
    nine = [F.round(c, 9).alias(c) for c in ("base", "tuned", "mean_diff", "median_diff", "sign_p")]
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "n_up", "n_down", "n_tied", *nine)


@query(f"""WITH {_ARMS}, f AS (SELECT doc_id, cand AS now FROM arms WHERE ref <> cand),
 w AS (SELECT a.arm, doc_id, lang, CASE WHEN doc_id % a.k = 0 THEN 1 - cand ELSE cand END AS c, f.now FROM arms LEFT JOIN f USING (doc_id), (VALUES ('half', 2), ('third', 3), ('some', 7)) a(arm, k) WHERE a.arm <> 'some' OR doc_id % 5 > 0),
 v AS (SELECT *, CASE WHEN c = now THEN 1 - c ELSE c END AS before FROM w), m AS (SELECT arm, lang, avg(c) AS a, avg(before) AS b, sum(CASE WHEN c = now THEN 1 ELSE 0 END) AS n, count(now) AS met FROM v GROUP BY arm, lang)
SELECT arm, round(avg(b), 9) AS recorded, round(avg(a), 9) AS macro, round(avg(a) - avg(b), 9) AS observed, round(avg(a) - avg(b), 9) AS implied, true AS explained, sum(n)::BIGINT AS n_items, ((SELECT count(*) FROM f) - sum(met))::BIGINT AS n_missing FROM m GROUP BY arm""")
def flips_transferred(spark, d):
    """Arms known after an edit, and by their mean before it, which the flips of another arm explain."""
    arms = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    arms = arms.select("doc_id", "lang", F.col("quality").alias("ref"), (1 - F.col("toxic")).alias("cand"))
    flipped = arms.filter("ref <> cand").select("doc_id", F.col("cand").alias("now"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("arm"), F.lit(k).alias("k")) for name, k in (("half", 2), ("third", 3), ("some", 7)))))
    after = arms.withColumn("a", each).select("doc_id", "lang", "a.arm", F.when(F.col("doc_id") % F.col("a.k") == 0, 1 - F.col("cand")).otherwise(F.col("cand")).alias("correct"))
    after = after.filter((F.col("arm") != "some") | (F.col("doc_id") % 5 > 0))
    before = after.join(flipped, "doc_id", "left").withColumn("c", F.when(F.col("correct") == F.col("now"), 1 - F.col("correct")).otherwise(F.col("correct")))
    recorded = before.groupBy("arm", "lang").agg(F.avg("c").alias("m")).groupBy("arm").agg(F.avg("m").alias("macro"))
    out = compare.transferred(flipped, after, recorded, "doc_id", "lang")
    nine = [F.round(c, 9).alias(c) for c in ("recorded", "macro", "observed", "implied")]
    return out.select("arm", *nine, (F.abs("residual") < 1e-9).alias("explained"), "n_items", "n_missing")


_UNIFORM = "((('0x' || substr(md5(concat_ws('|', 0, lang, round, '{0}', '{1}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _binomial(n: str, p: str, name: str) -> str:
    """The draw as SQL: n and p are columns."""
    rare = f"least({p}, 1 - {p})"
    start = f"{{'mass': exp({n} * ln(1 - {rare})), 'below': exp({n} * ln(1 - {rare})), 'x': 0.0::DOUBLE, 'i': 0.0::DOUBLE}}"
    mass = f"a.mass * ({n} - b.i + 1) / b.i * {rare} / (1 - {rare})"
    steps = f"list_reduce(list_prepend({start}, [{{'mass': 0.0::DOUBLE, 'below': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'i': i::DOUBLE}} FOR i IN range(1, 81)]), lambda a, b: {{'mass': {mass}, 'below': a.below + {mass}, 'x': a.x + (a.below < {_UNIFORM.format(name, 'u')})::INT, 'i': b.i}})"
    normal = f"greatest(0, least({n}, round_even({n} * {p} + sqrt({n} * {p} * (1 - {p})) * sqrt(-2 * ln({_UNIFORM.format(name, 'r')})) * cos(2 * pi() * {_UNIFORM.format(name, 'a')}), 0)))"
    small = f"least({n}, ({steps}).x)"
    return f"CASE WHEN {n} <= 0 OR {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} WHEN {n} * {p} * (1 - {p}) >= 9 THEN {normal} WHEN {p} <= 0.5 THEN {small} ELSE {n} - {small} END"


@query(f"""WITH {_ARMS}, c AS (SELECT lang, {_PAIRED} FROM arms GROUP BY lang UNION ALL SELECT source, {_PAIRED} FROM arms GROUP BY source),
 r AS (SELECT lang, n::DOUBLE AS n, n_minus / n AS p, n_plus / n AS q, unnest(range(1000)) AS round FROM c), x AS (SELECT *, {_binomial('n', 'p', 'minus')}::DOUBLE AS m FROM r),
 y AS (SELECT *, n - m AS rest, CASE WHEN p >= 1 THEN 0 ELSE least(1, q / (1 - p)) END AS pr FROM x), z AS (SELECT *, ({_binomial('rest', 'pr', 'plus')}::DOUBLE - m) / n AS d FROM y),
 k AS (SELECT lang, d, row_number() OVER (PARTITION BY lang ORDER BY d, round) - 1 AS at FROM z)
SELECT lang, round((n_plus - n_minus) / n, 12) AS mean, (SELECT round(d, 12) FROM k WHERE k.lang = c.lang AND at = 25) AS low, (SELECT round(d, 12) FROM k WHERE k.lang = c.lang AND at = 975) AS high FROM c""".replace(" AS at ", " AS pos ").replace("AND at =", "AND pos ="))
def bootstrap_intervals(spark, d):
    arms = _arms(spark, d)
    cells = arms.groupBy("lang").agg(*compare.paired(F.col("ref"), F.col("cand")))
    cells = cells.unionByName(arms.groupBy(F.col("source").alias("lang")).agg(*compare.paired(F.col("ref"), F.col("cand"))))
    return compare.bootstrap(cells, "lang", rounds=1000).select("lang", *(F.round(c, 12).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {_ARMS}, m AS (SELECT lang, count(*) FILTER (WHERE ref = 1) AS n_a, count(*) FILTER (WHERE ref = 0) AS n_b, avg(cand) FILTER (WHERE ref = 1) AS a, avg(cand) FILTER (WHERE ref = 0) AS b FROM arms GROUP BY lang)
SELECT lang, n_a, n_b, round(CASE WHEN n_a * n_b > 0 THEN a - b ELSE 0 END, 10) AS diff, true AS is_share FROM m""")
def permutation_tests(spark, d):
    out = compare.permutation(_arms(spark, d), "cand", F.col("ref") == 1, "lang")
    return out.select("lang", "n_a", "n_b", F.round("diff", 10).alias("diff"), F.col("p").between(1 / 10_001, 1).alias("is_share"))


@query("SELECT vec_id, round(z_ln - w / z, 6) AS nats FROM (SELECT vec_id, ln(list_sum([exp(x) for x in s])) AS z_ln, list_sum([exp(x) * x for x in s]) AS w, list_sum([exp(x) for x in s]) AS z FROM (SELECT vec_id, [x::DOUBLE - list_max(embedding)::DOUBLE for x in embedding] AS s FROM embeddings))")
def token_entropy(spark, d):
    nats = compare.entropy(F.col("embedding")) * F.log(F.size("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(nats, 6).alias("nats"))


@query("SELECT doc_id, CASE WHEN quality + toxic >= 1 THEN toxic / (quality + toxic) END AS suspicion FROM labels")
def suspicion_scores(spark, d):
    return table(spark, d, "labels").select("doc_id", compare.suspicion(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("suspicion"))


@query("""SELECT unnest(['not_saturated', 'train_rows', 'val_rows', 'test_rows', 'half_kept']) AS gate, unnest([(SELECT avg((quality >= 0.999)::INT) <= 0.5 FROM labels), bool_or(doc_id % 5 < 3), bool_or(doc_id % 5 = 3), bool_or(doc_id % 5 = 7), avg((n_chars > 500)::INT) >= 0.5]) AS passed FROM documents""")
def split_and_saturation_gates(spark, d):
    k = F.col("doc_id") % 5
    named = _docs(spark, d).withColumn("s", F.when(k < 3, "train").when(k == 3, "val").otherwise("drop"))
    first = checks.gates(table(spark, d, "labels"), checks.saturated(F.col("quality")))
    return first.unionByName(checks.gates(named, checks.split_gates("s", F.col("n_chars") > 500)))


@query("""WITH p AS (SELECT doc_id % 4 AS mode, doc_id, unnest(['defective', 'clean']) AS arm, text FROM documents), q AS (SELECT * FROM p WHERE mode < 3)
SELECT unnest(['some_rows', 'train_only', 'twins', 'all_trained', 'none_held_out', 'coverage', 'leaks']) AS gate,
 unnest([count(*) > 0, true, true, count(DISTINCT mode) = 3, true, avg(contains(text, 'the')::INT) FILTER (WHERE arm = 'defective') BETWEEN 0.05 AND 0.6, avg(contains(text, 'License')::INT) <= 0.02]) AS passed FROM q""")
def synthesis_gates(spark, d):
    rows = _docs(spark, d).withColumn("mode", F.concat(F.lit("m"), F.col("doc_id") % 4)).filter("mode <> 'm3'").withColumn("split", F.lit("train"))
    both = synth.twins(rows, F.lit("bad"), F.lit("good"))
    return checks.gates(both, checks.synthesis_gates("arm", "mode", "split", F.contains("text", F.lit("License")), F.contains("text", F.lit("the")), ("m0", "m1", "m2"), ("m3",), (0.05, 0.6)))


@query("SELECT lang, count(*) AS n, round(avg(contains(text, 'License')::INT), 10) AS valid, round(avg(n_chars / 20000), 10) AS score FROM documents GROUP BY lang")
def validity_by_format(spark, d):
    out = grade.validity(_docs(spark, d), "lang", F.contains("text", F.lit("License")), F.col("n_chars") / 20000)
    return out.select("lang", "n", F.round("valid", 10).alias("valid"), F.round("score", 10).alias("score"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'unknown kind' WHEN 1 THEN 'nothing to look for' ELSE 'no pattern' END AS reason FROM documents WHERE doc_id % 6 IN (0, 1, 3)""")
def probe_well_formedness(spark, d):
    k = F.col("doc_id") % 6
    none, some = F.array().cast("array<string>"), F.array(F.col("lang"))
    items = _docs(spark, d).select(
        "doc_id", F.when(k == 0, "other").when(k < 3, "recover").when(k < 5, "regex").otherwise("clean").alias("kind"),
        F.when(k.isin(2, 5), some).otherwise(none).alias("needles"), F.when(k == 4, some).alias("must"), none.alias("must_not"),
    )
    return grade.well_formed(items).select("doc_id", "reason")


# Text functions


@query("""SELECT doc_id, substr(sha256(text), 1, 12) AS sha, CASE WHEN contains(source, '1') THEN 'one' WHEN contains(source, '2') THEN 'two' ELSE 'other' END AS stratum FROM documents""")
def prompt_fingerprints(spark, d):
    return _docs(spark, d).select("doc_id", T.prompt_sha(F.col("text")).alias("sha"), T.stratum(F.col("source"), [("1", "one"), ("2", "two")]).alias("stratum"))


@query("SELECT lang, sha1(string_agg(doc_id::VARCHAR, chr(10) ORDER BY n_chars, doc_id)) AS sha FROM documents GROUP BY lang")
def ordered_ids_sha(spark, d):
    return _docs(spark, d).groupBy("lang").agg(T.ordered_sha(F.col("doc_id"), F.struct("n_chars", "doc_id")).alias("sha"))


@query(r"""WITH n AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, contains(' ' || t || ' ', CASE lang WHEN 'en' THEN ' the of ' WHEN 'fr' THEN ' de la ' ELSE ' de ' END) AS quoted FROM n""")
def quoted_phrases(spark, d):
    wanted = F.when(F.col("lang") == "en", "The, of!").when(F.col("lang") == "fr", "de la").otherwise("de")
    return _docs(spark, d).select("doc_id", T.quotes(F.col("text"), wanted).alias("quoted"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE trim('so ' || source) END AS said FROM documents")
def without_thinking(spark, d):
    k = F.col("doc_id") % 4
    plain = F.concat(F.lit("so "), "source")
    said = F.when(k == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> "), plain)).when(k == 1, F.concat("lang", F.lit("</THINKING>"), plain)).when(k == 2, plain).otherwise(F.concat(F.lit("<thinking>"), "lang"))
    return _docs(spark, d).select("doc_id", T.without_thinking(said).alias("said"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'array' WHEN 1 THEN 'integer' WHEN 2 THEN 'object' WHEN 3 THEN 'T' || source ELSE 'number' END AS type, doc_id % 5 <> 3 AS known FROM documents""")
def json_type_names(spark, d):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("List["), "lang", F.lit("]"))).when(k == 1, " INT ").when(k == 2, "dict").when(k == 3, F.concat(F.lit("T"), "source")).otherwise("float")
    return _docs(spark, d).select("doc_id", T.json_type(name).alias("t")).select("doc_id", "t.type", "t.known")


@query("SELECT event_id, json_extract_string('{\"a\": {\"b\": ' || props || '}}', '$.a.b.k') AS found FROM events")
def dotted_paths(spark, d):
    return table(spark, d, "events").select("event_id", T.dotted(F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}")), "a.b.k").alias("found"))


# Synthesis

_E = """CASE d WHEN 1 THEN '{"data": ' || x || '}' WHEN 2 THEN '{"body": {"result": ' || x || '}}' ELSE '{"content": {"response": {"envelope": ' || x || '}}}' END"""
_IN = """'{"nation": {"n_name": "' || n || '", "n_nationkey": ' || k || '}, "region": ' || r || '}'"""


@query(f"""WITH s AS (SELECT n_name AS n, n_nationkey::VARCHAR AS k, n_regionkey::VARCHAR AS r, d FROM nation, (SELECT unnest([1, 2, 3]) AS d)),
m AS (SELECT n, d, unnest(['truncated_json', 'type_swapped', 'error_envelope', 'empty_body', 'null_leaf', 'wrong_entity', 'silently_truncated', 'stale_as_of', 'unit_swapped']) AS mode, unnest([
 {_IN}, replace({_IN}, '"n_nationkey": ' || k, '"n_nationkey": "N/A"'), '{{"error": {{"code": "upstream_timeout", "message": "backend did not respond in 30s", "retryable": true}}}}', '{{}}', replace({_IN}, '"n_nationkey": ' || k, '"n_nationkey": null'),
 replace({_IN}, n, substr(n, 1, length(n) - 1) || CASE WHEN n[-1] BETWEEN '0' AND '9' THEN ((n[-1]::INT + 5) % 10)::VARCHAR WHEN lower(n[-1]) = 'x' THEN 'q' ELSE 'x' END),
 '{{"partial": true, "returned": 1, "total_matching": 47, "result": ' || {_IN} || '}}', '{{"cached": true, "generated_at": "2019-11-02T04:15:00Z", "result": ' || {_IN} || '}}',
 '{{"units": "unspecified", "note": "values are in the provider''s base units", "result": ' || {_IN} || '}}']) AS x FROM s),
w AS (SELECT n AS scenario, d AS depth, mode, {_E} AS body FROM m) SELECT scenario, depth, mode, CASE WHEN mode = 'truncated_json' THEN substr(body, 1, floor(length(body) * 0.62)::BIGINT) ELSE body END AS body FROM w""")
def synth_probes(spark, d):
    few = table(spark, d, "nation").select(
        F.col("n_name").alias("scenario"), F.to_json(F.struct(F.struct("n_name", "n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))).alias("payload"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("args")
    )
    return synth.generated(few).select("scenario", "depth", "mode", "probe.body")


@query("""SELECT doc_id, unnest(['plain', 'polite']) AS form, unnest([source || '?', 'Please: ' || source || '? Thanks.']) AS prompt FROM documents""")
def synth_surface_forms(spark, d):
    asked = _docs(spark, d).select("doc_id", F.concat("source", F.lit("?")).alias("question"))
    return synth.surface_forms(asked, {"plain": "%s", "polite": "Please: %s Thanks."}).select("doc_id", "form", "prompt")


@query("""SELECT doc_id, ['a', 'b', 'c'][doc_id % 3 + 1] AS mode, ['t0', 't1', 't2', 't3', 't4'][(('0x' || substr(md5(source), 1, 8))::BIGINT % 5) + 1] AS template FROM documents""")
def synth_rotation(spark, d):
    return _docs(spark, d).select("doc_id", synth.rotated(F.col("doc_id"), ("a", "b", "c")).alias("mode"), synth.template(F.col("source"), ("t0", "t1", "t2", "t3", "t4")).alias("template"))


@query("SELECT doc_id, unnest(['defective', 'clean']) AS arm, unnest(['bad ' || lang, 'good ' || source]) AS messages FROM documents")
def synth_twins(spark, d):
    return synth.twins(_docs(spark, d).select("doc_id", "lang", "source"), F.concat(F.lit("bad "), "lang"), F.concat(F.lit("good "), "source")).select("doc_id", "arm", "messages")


@query("""WITH t AS (SELECT doc_id // 4 AS conv, doc_id AS turn, doc_id % 3 AS k, lead(doc_id % 4 = 1 OR text LIKE '% the %') OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS answered, lead(doc_id) OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS next,
  CASE WHEN doc_id % 5 = 0 THEN '{"s": "' || source || '", "ok": true}' WHEN doc_id % 5 = 1 THEN '{"s": "of ' || source || '"}' ELSE '{"s": "' || source || '", "n": ' || doc_id || '}' END AS body FROM documents)
SELECT conv, arg_min(turn, turn) AS turn, arg_min(body, turn) AS text FROM t WHERE k = 0 AND answered AND next IS NOT NULL AND turn % 5 <> 0 GROUP BY conv""")
def usable_tool_returns(spark, d):
    docs, k = _docs(spark, d), F.col("doc_id") % 5
    said = (F.col("doc_id") % 4 == 1) | F.col("text").like("% the %")
    rest = F.when(k == 0, F.concat(F.lit('{"s": "'), "source", F.lit('", "ok": true}'))).when(k == 1, F.concat(F.lit('{"s": "of '), "source", F.lit('"}')))
    body = rest.otherwise(F.concat(F.lit('{"s": "'), "source", F.lit('", "n": '), "doc_id", F.lit("}")))
    tool = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") * 2).alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("<tool_response>"), body, F.lit("</tool_response>")).alias("text"))
    reply = docs.filter("doc_id % 4 > 0").select((F.col("doc_id") - 1).alias("doc_id"), ((F.col("doc_id") - 1) * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.when(said, "so").otherwise("<tool_call>x</tool_call>").alias("text"))
    turns = tool.unionByName(reply).withColumn("conv", F.floor(F.col("doc_id") / 4))
    return synth.usable_returns(turns, "conv", "turn").select("conv", (F.col("turn") / 2).cast("long").alias("turn"), "text")


@query("""WITH p AS (SELECT doc_id, doc_id % 3 AS k, source, lang, n_chars + 900 AS n, (doc_id % 1000) / 4.0 AS rate FROM documents)
SELECT doc_id, CASE k WHEN 2 THEN 'note' WHEN 1 THEN 'of.count' ELSE 'of.rate' END AS path,
 CASE k WHEN 2 THEN 'about ' || source WHEN 1 THEN n || CASE WHEN n >= 1000 THEN '|' || format('{:,}', n) ELSE '' END ELSE CASE WHEN rate = floor(rate) THEN rate::INT::VARCHAR ELSE rate::DOUBLE::VARCHAR END END AS spellings,
 CASE k WHEN 2 THEN 'about ' || source WHEN 1 THEN concat_ws('|', CASE WHEN n >= 1000 THEN n || '|' || format('{:,}', n) END) ELSE CASE WHEN rate <> floor(rate) AND len(rate::DOUBLE::VARCHAR) >= 4 AND len(replace(rate::DOUBLE::VARCHAR, '.', '')) >= 3 THEN rate::DOUBLE::VARCHAR ELSE '' END END AS forbidden FROM p""")
def synth_headlines(spark, d):
    """What a right answer quotes of a return, and what it must not quote once the return shows its first field alone."""
    k, n, rate = F.col("doc_id") % 3, F.col("n_chars") + 900, (F.col("doc_id") % 1000) / 4
    head = F.concat(F.lit('{"id": "'), "source", F.lit('", '))
    own = F.when(k == 0, F.concat(F.lit('"total": 1, "of": {"rate": '), rate, F.lit(', "at": 7}}'))).when(k == 1, F.concat(F.lit('"of": {"lang": null, "count": '), n, F.lit("}, \"ok\": true}")))
    docs = _docs(spark, d).select("doc_id", F.concat(head, own.otherwise(F.concat(F.lit('"note": "about '), "source", F.lit('"}')))).alias("payload"), F.concat(head, F.lit("...")).alias("shown"))
    out = docs.select("doc_id", synth.headlines(F.col("payload")).alias("h"), synth.unquotable(F.col("payload"), F.col("shown")).alias("f"))
    return out.select("doc_id", "h.path", F.array_join("h.spellings", "|").alias("spellings"), F.array_join("f", "|").alias("forbidden"))


@query()
def conv_loss_mask(spark, d):
    """Conversations cut to their last 256 tokens: lengths, where the kept text begins, and the tokens that are learnt."""
    from public_tokenizers import path

    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(said, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    out = mask.loss_mask(rows, ["conv_id"], F.col("messages"), path("byte_bpe_50k.json"), 256, 50_256)
    kept = F.size("ids").cast("long")
    return out.select("conv_id", "n_tokens", kept.alias("n_kept"), F.get("at", F.lit(0)).alias("first_kept"), F.size(F.filter("learnt", lambda x: x)).cast("long").alias("n_learnt"))


# Sources, sinks, streams

_SCHEMA = "doc_id long, lang string, n_chars long"


def _lines(spark: SparkSession, d: str, name: str, broken: bool = False) -> str:
    """The documents as gzipped JSON lines, one in nine of them broken off if wanted."""
    at = folder(spark, name)
    line = F.to_json(F.struct("doc_id", "lang", "n_chars", "text"))
    line = F.when((F.col("doc_id") % 9 == 0) & F.lit(broken), F.substring(line, 1, 12)).otherwise(line)
    _docs(spark, d).select(line.alias("value")).write.option("compression", "gzip").text(at)
    return at


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 9 <> 0")
def read_lines_skipping(spark, d):
    return readers.json_lines(spark, _lines(spark, d, "skip", True), _SCHEMA, bad="skip")


@query("SELECT doc_id, lang, n_chars FROM documents")
def read_lines_strict(spark, d):
    return readers.json_lines(spark, readers.landed(spark, _lines(spark, d, "strict")), _SCHEMA, bad="fail")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 9 = 0) AS n_broken FROM documents")
def read_lines_keeping(spark, d):
    rows = readers.json_lines(spark, _lines(spark, d, "keep", True), _SCHEMA, bad="keep").select("doc_id", "_corrupt_record")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("doc_id").isNull() & F.col("_corrupt_record").isNotNull(), 1)).alias("n_broken"))


@query("SELECT lang AS category, count(*) AS n_rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def read_file_family(spark, d):
    at = folder(spark, "family")
    _docs(spark, d).select("lang", "doc_id", "n_chars").write.partitionBy("lang").json(at)  # files of each language, by one write
    rows = readers.family(spark, f"{at}/*/*.json", "doc_id long, n_chars long")
    named = F.substring_index(F.element_at(F.split(F.input_file_name(), "/"), -2), "=", -1)
    return rows.withColumn("category", named).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("chars"))


@query("SELECT 'by_lang' AS name, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'by_source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'verified', 'rows', count(DISTINCT lang) + count(DISTINCT source) FROM documents")
def promoted_outputs(spark, d):
    """Two tables published together, over older ones, after their rows were verified."""
    at, docs = folder(spark, "promoted"), _docs(spark, d)
    two = {f"by_{c}": docs.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")) for c in ("lang", "source")}
    readers.promote(spark, {name: rows.limit(1) for name, rows in two.items()}, at)
    told = readers.promote(spark, two, at, expected={name: {"rows": rows.count()} for name, rows in two.items()}, force=True)
    found = [spark.read.parquet(f"{at}/{name}").select(F.lit(name).alias("name"), "key", "n") for name in two]
    verified = spark.range(1).select(F.lit("verified").alias("name"), F.lit("rows").alias("key"), F.lit(sum(x["rows"] for x in told.values())).cast("long").alias("n"))
    return found[0].unionByName(found[1]).unionByName(verified)


@query("SELECT src, ln, t FROM (SELECT 0 AS src, doc_id AS ln, lang AS t FROM documents UNION ALL SELECT 1, page_id, NULL FROM pages UNION ALL SELECT 2, doc_id, NULL FROM labels)")
def union_of_sources(spark, d):
    parts = [_docs(spark, d).select("doc_id", F.col("lang").alias("t")), table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), table(spark, d, "labels").select("doc_id")]
    return readers.union(parts, "doc_id").select("src", "ln", "t")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 100")
def manifest_round_trip(spark, d):
    at = folder(spark, "manifest")
    readers.write_manifest(_docs(spark, d).filter("n_chars > 100").select("doc_id", "lang", "n_chars"), at)
    return readers.json_lines(spark, at, _SCHEMA, bad="fail")


@query("SELECT CASE WHEN n_chars <= 200 THEN 'pool' ELSE CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END END AS part, count(*) AS n_rows, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY part")
def splits_round_trip(spark, d):
    at = folder(spark, "splits")
    rows = _docs(spark, d).select("doc_id", "n_chars", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    readers.write_splits(rows, at, "split", F.col("n_chars") <= 200)
    kept = spark.read.schema("doc_id long, split string").json(f"{at}/rows").select(F.col("split").alias("part"), "doc_id")
    pool = spark.read.schema("doc_id long").json(f"{at}/pool").select(F.lit("pool").alias("part"), "doc_id")
    return kept.unionByName(pool).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("ids"))


@query("SELECT 'documents' AS name, count(*) AS n_rows, max(n_chars) AS largest FROM documents")
def artifact_round_trip(spark, d):
    n, largest = _docs(spark, d).agg(F.count(F.lit(1)), F.max("n_chars")).first()
    at = f"{folder(spark, 'artifact')}/facts.json"
    readers.write_artifact(spark, {"name": "documents", "n_rows": n, "largest": largest}, at)
    return spark.read.schema("name string, n_rows long, largest long").json(readers.landed(spark, at))


@query("SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang")
def markdown_report(spark, d):
    text = readers.markdown(_docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "Languages")
    return spark.createDataFrame([(x,) for x in text.splitlines() if x.startswith("| ") and " --- " not in x and "lang" not in x], "line string")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "arriving")
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(at)
    return streams.read(spark, at, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Everything a stream gives, by complete batches."""
    out, seen = folder(spark, name), f"{folder(spark, name)}-seen"
    streams.run_once(stream, out, seen)
    return spark.read.schema(stream.schema).parquet(out)


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS total, max(max(ts)) OVER () AS last FROM events GROUP BY w, event_type)
SELECT w::VARCHAR AS hour, event_type, n, total FROM e WHERE w + INTERVAL 1 HOUR <= last - INTERVAL 2 HOUR""")
def stream_windows(spark, d):
    out = _run(spark, streams.windowed(_streamed(spark, d)), "windows")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, (SELECT max(ts) FROM events) AS last FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), x AS (SELECT user_id, count(*) AS n, max(ts) AS ended, any_value(last) AS last FROM s GROUP BY user_id, k)
SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events FROM x WHERE ended + INTERVAL 30 MINUTE <= last - INTERVAL 2 HOUR GROUP BY user_id""")
def stream_sessions(spark, d):
    out = _run(spark, streams.sessions(_streamed(spark, d)), "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))
