"""Registered queries on conversations, graders, parsers, synthesis and the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import adapters, checks, compare, contamination, grade, instructions, render, sample, synth
from corpusloom.plans.catalogue import _grams, _norm, query
from corpusloom.sources.readers import harvest, table

# Conversations


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(said.alias("said"))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select("conv_id", render.conversation(F.col("said")).alias("rendered"))


_SAID = "t AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE trim(text) <> ''), e AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last, bool_or(role = 'user') AS asked FROM t GROUP BY conv_id)"


@query(f"""WITH {_SAID} SELECT conv_id, count(*) AS n_messages, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
FROM t JOIN e USING (conv_id) WHERE asked AND last IS NOT NULL AND turn <= last GROUP BY conv_id""")
def conv_render(spark, d):
    rows = _rendered(spark, d).filter("rendered.reason is null and not rendered.prompt_only")
    m = F.col("rendered.messages")
    return rows.select("conv_id", F.size(m).cast("long").alias("n_messages"), render.chat_text(m).alias("chat"))


@query(f"WITH {_SAID} SELECT conv_id, count(*) AS n_messages FROM t JOIN e USING (conv_id) WHERE asked AND last IS NULL GROUP BY conv_id")
def conv_prompt_pool(spark, d):
    return _rendered(spark, d).filter("rendered.prompt_only").select("conv_id", F.size("rendered.messages").cast("long").alias("n_messages"))


@query(f"""WITH {_SAID}, m AS (SELECT conv_id, turn, role, length('<|im_start|>' || role || chr(10)) AS head, length(text || '<|im_end|>') AS body FROM t JOIN e USING (conv_id) WHERE asked AND last IS NOT NULL AND turn <= last),
p AS (SELECT *, coalesce(sum(head + body + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m)
SELECT conv_id, (base + head)::BIGINT AS start_at, (base + head + body)::BIGINT AS end_at FROM p WHERE role = 'assistant'""")
def conv_loss_spans(spark, d):
    rows = _rendered(spark, d).filter("rendered.reason is null and not rendered.prompt_only")
    spans = rows.select("conv_id", F.explode(render.loss_spans(F.col("rendered.messages"))).alias("s"))
    return spans.select("conv_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@query("SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def conv_first_user(spark, d):
    turns = F.transform("said", lambda t: F.struct(t["role"].alias("from"), t["content"].alias("value")))
    out = _conversations(spark, d).select("conv_id", adapters.first_turn(turns, ("human", "user")).alias("prompt"))
    return out.filter("prompt <> ''")


@query("""SELECT 'no_user_turn' AS reason, count(DISTINCT conv_id) AS n_rows FROM conversations WHERE conv_id % 5 = 0 HAVING count(*) > 0""")
def conv_unrendered_reasons(spark, d):
    """Every fifth conversation has lost what its user said."""
    talks = _conversations(spark, d)
    said = F.when(F.col("conv_id") % 5 == 0, F.filter("said", lambda t: t["role"] != "user")).otherwise(F.col("said"))
    return render.reasons(talks.select("conv_id", render.conversation(said).alias("rendered")), [])


# Adapters and parsers over records made from the driver's tables


def _antidoom(spark: SparkSession, d: str) -> DataFrame:
    turns = F.transform("said", lambda t: F.struct(t["role"].alias("from"), t["content"].alias("value")))
    return _conversations(spark, d).select(
        F.col("conv_id").cast("string").alias("id"), turns.alias("conversations"), F.lit("driver").alias("source"), F.lit(None).cast("string").alias("source_config"), F.lit(None).cast("string").alias("source_sample_id")
    )


@query("""WITH p AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> ''), '') AS prompt, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS row_id, prompt, 'src:driver/-|' || substr(sha1(prompt || chr(31)), 1, 16) AS group_key, n AS n_turns FROM p""")
def adapt_conversations(spark, d):
    out = adapters.adapt(_antidoom(spark, d), "antidoom")
    return out.select("record.row_id", "record.prompt", "record.group_key", F.col("record.n_turns").cast("long").alias("n_turns"))


@query("""SELECT substr(sha1(text || chr(31)), 1, 16) AS row_id, text AS prompt, 'prompt-only' AS group_key FROM documents""")
def adapt_prompt_only(spark, d):
    return adapters.adapt(table(spark, d, "documents").select("text"), "prompt_only").select("record.row_id", "record.prompt", "record.group_key")


def _tool_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as call records: a tool declared by its property names, and a call that gives them."""
    tool = F.concat(F.lit('[{"name": "Log '), F.col("event_type"), F.lit('", "parameters": {"type": "dict", "properties": {"user_id": {"type": "int"}, "value": {"type": "float"}}, "required": ["user_id"]}}]'))
    call = F.concat(F.lit('[{"name": "Log '), F.col("event_type"), F.lit('", "arguments": {"user_id": '), F.col("user_id"), F.lit("}}]"))
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("hash_id"), F.concat(F.lit("log "), F.col("event_type")).alias("query"), tool.alias("tools"), call.alias("answers"), F.lit(None).cast("string").alias("func_name"))


@query("""SELECT event_id::VARCHAR AS row_id, 'log ' || event_type AS prompt, substr(sha1('Log ' || event_type || '(user_id,value)' || chr(31)), 1, 16) AS group_key, 1::BIGINT AS n_calls, 2::BIGINT AS n_params, 3::BIGINT AS depth FROM events""")
def adapt_tool_rows(spark, d):
    r = adapters.adapt(_tool_rows(spark, d), "apigen").select("record.*")
    return r.select("row_id", "prompt", "group_key", F.size("calls").cast("long").alias("n_calls"), F.col("tools")[0]["n_params"].cast("long").alias("n_params"), F.col("tools")[0]["depth"].cast("long").alias("depth"))


@query("""SELECT event_id::VARCHAR AS row_id, '<tool_call>{"arguments": {"user_id": ' || user_id || '}, "name": "log_' || event_type || '"}</tool_call>' AS answer FROM events""")
def render_tool_rows(spark, d):
    out = render.render(_tool_rows(spark, d), "apigen")
    return out.select(F.col("hash_id").alias("row_id"), F.element_at("rendered.messages", -1)["content"].alias("answer"))


@query("""SELECT event_id::VARCHAR AS row_id, user_id % 2 = 0 AS correct, CASE WHEN user_id % 2 = 0 THEN 'correct' ELSE 'wrong arguments' END AS family FROM events""")
def grade_tool_calls(spark, d):
    e = table(spark, d, "events")
    completion = F.concat(F.lit('<tool_call>{"name": "log", "arguments": {"user_id": "'), F.col("user_id") % 2, F.lit('.0"}}</tool_call>'))
    g = e.select(F.col("event_id").cast("string").alias("row_id"), grade.graded_calls(F.lit("simple"), completion, F.lit('[{"log": {"user_id": [0], "note": [""]}}]')).alias("v"))
    return g.select("row_id", "v.correct", grade.reason_family(F.col("v.reason")).alias("family"))


@query("""SELECT event_id, event_type = 'click' AS correct, event_type IN ('click', 'view') AS in_enum FROM events""")
def grade_structured(spark, d):
    schema = '{"json_schema": {"type": "object", "required": ["t"], "properties": {"t": {"type": "string", "enum": ["click"]}}}}'
    wide = schema.replace('"click"', '"click", "view"')
    answer = F.concat(F.lit('```json\n{"t": "'), F.col("event_type"), F.lit('"}\n```'))
    return table(spark, d, "events").select("event_id", grade.graded_structure(answer, F.lit(schema))["correct"].alias("correct"), grade.graded_structure(answer, F.lit(wide))["correct"].alias("in_enum"))


@query("""SELECT n_name AS scenario, d AS depth, CASE d WHEN 1 THEN '{"data": {"k": ' || n_nationkey || '}}' WHEN 2 THEN '{"body": {"result": {"k": ' || n_nationkey || '}}}' ELSE '{"content": {"response": {"envelope": {"k": ' || n_nationkey || '}}}}' END AS body FROM nation, (SELECT unnest([1, 2, 3]) AS d)""")
def synth_clean(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("scenario"), F.to_json(F.struct(F.col("n_nationkey").alias("k"))).alias("payload"), F.lit("{}").alias("args"))
    return synth.generated(rows, modes=("clean",)).select("scenario", "depth", "probe.body")


# Rule graders over documents

_LENGTHS = "SELECT doc_id, {0} AS kept FROM documents"
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _follows(spark: SparkSession, d: str, instruction: str, **kwargs) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", instructions.follows(F.col("text"), instruction, **kwargs).alias("kept"))


@query(f"SELECT doc_id, {_STRIP} <> '' AND NOT contains(text, ',') AS kept FROM documents")
def ifeval_no_comma(spark, d):
    return _follows(spark, d, "punctuation:no_comma")


@query(f"SELECT doc_id, {_STRIP} <> '' AND len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) >= 200 AS kept FROM documents")
def ifeval_number_words(spark, d):
    return _follows(spark, d, "length_constraints:number_words", num_words=200, relation="at least")


@query(f"SELECT doc_id, {_STRIP} <> '' AND len(regexp_extract_all(text, '(?i)the')) < 40 AS kept FROM documents")
def ifeval_keyword_frequency(spark, d):
    return _follows(spark, d, "keywords:frequency", keyword="the", frequency=40, relation="less than")


@query(f"SELECT doc_id, {_STRIP} <> '' AND regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)version') AS kept FROM documents")
def ifeval_keywords(spark, d):
    return _follows(spark, d, "keywords:existence", keywords=["license", "version"])


@query(rf"SELECT doc_id, {_STRIP} <> '' AND NOT regexp_matches(text, '(?i)\bmoron\b') AND NOT regexp_matches(text, '(?i)\bidiot\b') AS kept FROM documents")
def ifeval_forbidden_words(spark, d):
    return _follows(spark, d, "keywords:forbidden_words", forbidden_words=["moron", "idiot"])


@query(f"SELECT doc_id, {_STRIP} <> '' AND len(regexp_extract_all(lower(text), 'z')) >= 5 AS kept FROM documents")
def ifeval_letter_frequency(spark, d):
    return _follows(spark, d, "keywords:letter_frequency", letter="z", let_frequency=5, let_relation="at least")


@query(f"SELECT doc_id, length({_STRIP}) > 1 AND starts_with({_STRIP}, '\"') AND ends_with({_STRIP}, '\"') AS kept FROM documents")
def ifeval_quotation(spark, d):
    return _follows(spark, d, "startend:quotation")


@query(f"SELECT doc_id, {_STRIP} <> '' AND ends_with(lower(trim({_STRIP}, '\"')), 'version 3.') AS kept FROM documents")
def ifeval_end_checker(spark, d):
    return _follows(spark, d, "startend:end_checker", end_phrase="version 3.")


@query(f"SELECT doc_id, {_STRIP} <> '' AND starts_with(lower({_STRIP}), 'the') AS kept FROM documents")
def ifeval_repeat_prompt(spark, d):
    return _follows(spark, d, "combination:repeat_prompt", prompt_to_repeat="The ")


@query(rf"SELECT doc_id, {_STRIP} <> '' AND len(regexp_extract_all(text, '\[.*?\]')) >= 1 AS kept FROM documents")
def ifeval_placeholders(spark, d):
    return _follows(spark, d, "detectable_content:number_placeholders", num_placeholders=1)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bcontradict') THEN 3 WHEN regexp_matches(text, '(?i)\bincomplete\b') THEN 12 END AS f FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' this is incomplete' WHEN 1 THEN ' they contradict' ELSE '' END AS text FROM documents)
WHERE doc_id % 5 < 2""")
def probe_flags(spark, d):
    tail = F.when(F.col("doc_id") % 5 == 0, " this is incomplete").when(F.col("doc_id") % 5 == 1, " they contradict").otherwise("")
    out = table(spark, d, "documents").select("doc_id", T.flag(F.concat("text", tail)).alias("f"))
    return out.filter("f is not null")


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, NOT contains(t, 'license') AS correct, CASE WHEN contains(t, 'license') THEN 'License' END AS literal FROM s""".replace("\\\\", "\\"))
def probe_recover(spark, d):
    none = F.lit(None).cast("array<string>")
    v = grade.graded_probe(F.col("text"), F.lit("recover"), F.array(F.lit("License")), none, none)
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.correct", "v.literal")


@query("SELECT page_id, 3::BIGINT AS lines, 2::BIGINT AS opened, 1::BIGINT AS closed, 'html' AS lang, false AS blank FROM pages")
def fence_envelopes(spark, d):
    wrapped = F.concat(F.lit("```html\n"), F.regexp_replace(F.coalesce("html", F.lit("")), "`", ""), F.lit("\n```\n``` "))
    v = table(spark, d, "pages").select("page_id", T.fences(wrapped).alias("e"))
    return v.select("page_id", *(F.col(f"e.{c}").cast("long").alias(c) for c in ("lines", "opened", "closed")), "e.lang", "e.blank")


@query("""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT a, b, CASE WHEN levenshtein(x, y) > 6 THEN 7 ELSE levenshtein(x, y) END AS d FROM p""")
def edit_distance_pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), "b", T.edit_distance(F.col("p_name"), F.col("y"), 6).cast("long").alias("d"))


@query("""WITH s AS (SELECT p_brand, list(p_type) AS s, min(p_type) AS g FROM part GROUP BY p_brand), l AS (SELECT p_brand, s, g, floor(0.2 * least(greatest(list_max([length(x) FOR x IN s]), length(g)), 100)) AS t FROM s)
SELECT p_brand, round(len([x FOR x IN s IF levenshtein(x, g) <= t]) / len(s), 10) AS peak, len([x FOR x IN s IF x = g]) AS n_exact, len(list_distinct(s)) AS n_distinct, t::BIGINT AS threshold FROM l""")
def peakedness(spark, d):
    part = table(spark, d, "part")
    first = part.groupBy("p_brand").agg(F.min("p_type").alias("greedy"))
    out = compare.peakedness(part.join(first, "p_brand"), "p_brand", "p_type", "greedy", 0.2)
    return out.select("p_brand", F.round("peak", 10).alias("peak"), "n_exact", "n_distinct", F.col("threshold").cast("long").alias("threshold"))


@query(f"""WITH w AS (SELECT doc_id, lang, list_slice(list_sort(list_distinct([x FOR x IN string_split({_norm()}, ' ') IF length(x) > 2])), 1, 64) AS called FROM documents), s AS (SELECT doc_id, unnest(called) AS s FROM w),
f AS (SELECT s, count(*) AS df FROM s GROUP BY s HAVING count(*) >= 2), b AS (SELECT doc_id, min(struct_pack(weight := df, s := s)) AS best FROM s JOIN f USING (s) GROUP BY doc_id)
SELECT w.doc_id, coalesce(b.best.s, 'bare:' || lang) AS group_key, CASE WHEN b.doc_id IS NULL THEN 'bare' ELSE 'shared' END AS tier FROM w LEFT JOIN b ON b.doc_id = w.doc_id""")
def code_rarity_key(spark, d):
    none = F.array().cast("array<string>")
    called = F.slice(F.array_sort(F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) > 2))), 1, 64)
    rows = table(spark, d, "documents").select("doc_id", "lang", F.struct(none.alias("mods"), called.alias("called"), none.alias("defined")).alias("symbols"))
    return adapters.rarity_keys(rows, "doc_id", F.col("lang"))


@query()
def match_controls(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", "doc_id", "n_chars", (F.col("toxic") == 1).alias("treated"))
    return compare.matched_controls(rows, "lang", "doc_id", "n_chars", "treated")


# Semi-structured, checks and relational queries over the driver's tables


@query("SELECT event_type, count(*) AS n, count(json_extract(props, '$.*')) AS n_json, sum(len(json_keys(props)))::BIGINT AS n_keys FROM events GROUP BY event_type")
def json_props_agg(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.try_parse_json("props")).alias("n_json"), F.sum(F.size(F.json_object_keys("props"))).cast("long").alias("n_keys"))


@query("SELECT page_id, concat_ws(chr(10), url, html) AS harvest FROM pages")
def harvest_pages(spark, d):
    return harvest(table(spark, d, "pages"), ["url", "html", "title"]).select("page_id", "harvest")


@query("SELECT unnest(['n_documents', 'n_labels', 'n_never']) AS field, unnest([(SELECT count(*) FROM documents), (SELECT count(*) FROM documents), 7]) AS want, unnest([(SELECT count(*) FROM documents), (SELECT count(*) FROM labels), NULL]) AS got, unnest(['OK', 'FAIL', 'MISSING']) AS status")
def reproduction_checks(spark, d):
    n = lambda t, f: table(spark, d, t).agg(F.count(F.lit(1)).alias("value")).select(F.lit(f).alias("field"), "value")
    measured = n("documents", "n_documents").unionByName(n("labels", "n_labels"))
    recorded = n("documents", "n_documents").unionByName(n("documents", "n_labels")).unionByName(spark.range(1).select(F.lit("n_never").alias("field"), F.lit(7).cast("long").alias("value")))
    return checks.reproduced(measured, recorded)


@query("SELECT unnest(['completions_blank', 'join_matched']) AS gate, unnest([true, (SELECT avg((doc_id IN (SELECT doc_id FROM labels))::INT) >= 0.99 FROM documents)]) AS passed")
def run_gates(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("m")), "doc_id", "left")
    return checks.gates(rows, checks.blank_gate(F.col("text")) | checks.matched_gate(F.coalesce("m", F.lit(False))))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def local_supplier_volume(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n FROM events GROUP BY hour, event_type")
def hourly_events(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("SELECT vec_id, label, round(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])), 4) AS norm FROM embeddings")
def embedding_norms(spark, d):
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(sq), 4).alias("norm"))


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents) SELECT lang, doc_id, n_chars FROM r WHERE k <= 3""")
def shortest_by_lang(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    langs = {lang: 3 for lang in ("de", "en", "es", "fr")}
    return sample.bottom_k_by(docs, "lang", F.struct("n_chars", "doc_id"), langs).select("lang", "doc_id", "n_chars")


@query("SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS lost, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS gained, count(*) FILTER (WHERE quality = 0 AND toxic = 0) - count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS net FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def win_loss(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("r"), (F.col("toxic") == 0).alias("c"))
    return grade.win_loss(rows, "r", "c", ["lang"])


@query(f"SELECT md5({_norm()}) AS key, count(*) AS n_items, count(DISTINCT source) AS n_scenarios FROM documents GROUP BY key HAVING count(*) > 1")
def prompt_collisions(spark, d):
    return grade.collisions(table(spark, d, "documents"), F.md5(T.normalize(F.col("text"))), "source")


@query(f"""WITH pg AS {_grams('benchmark', 'item_id')}, dg AS (SELECT DISTINCT g FROM {_grams('documents', 'doc_id')}), f AS (SELECT item_id, count(*) AS n FROM pg WHERE g IN (SELECT g FROM dg) GROUP BY item_id)
SELECT b.item_id, coalesce(f.n, 0) AS n_windows FROM benchmark b LEFT JOIN f USING (item_id)""")
def probe_corpus_overlap(spark, d):
    return contamination.clean_probes(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(text, '```')) AS n_none, count(*) FILTER (WHERE NOT contains(text, '```')) AS n_envelope, 0::BIGINT AS n_schema, avg(CASE WHEN contains(text, '```') THEN 1.0::DOUBLE END) AS valid_if_clean FROM documents GROUP BY source")
def error_classes(spark, d):
    errors = F.when(F.contains("text", F.lit("```")), F.array().cast("array<string>")).otherwise(F.array(F.lit("envelope: no code block")))
    return grade.error_breakdown(table(spark, d, "documents").withColumn("errors", errors), "errors", ["source"])
