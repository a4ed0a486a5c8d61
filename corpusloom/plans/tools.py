"""Registered queries on adapters, renderers, flags and instruction checkers, over records made from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import adapters, flags, grade, instructions, languages, render
from corpusloom.plans.catalogue import query
from corpusloom.sources.readers import table

_SHA = "substr(sha1({0}), 1, 16)"
_BLANK = r"NOT regexp_matches(text, '\S')"


def _pieces(*parts: Column | str) -> Column:
    """Text and columns, strung together; column names stand in braces."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if isinstance(p, str) and p.startswith("{") and p.endswith("}") else p if isinstance(p, Column) else F.lit(p) for p in parts))


def _said(*turns: tuple[str, Column]) -> Column:
    return F.to_json(F.array(*(F.struct(F.lit(who).alias("from"), what.alias("value")) for who, what in turns)))


# Tool calls in brackets: documents as questions, answered by a call, in prose, by position only, or in another format


def _bracketed(spark: SparkSession, d: str) -> DataFrame:
    schema = _pieces('[{"name": "Find ', "{lang}", '", "description": "d", "parameters": {"type": "dict", "properties": {"q": {"type": "str"}, "', "{source}", '": {"type": "int"}}, "required": ["q"]}}]')
    k = F.col("doc_id") % 4
    answer = (
        F.when(k == 0, _pieces("[Find ", "{lang}", '(q="n7, (x)", ', "{source}", "=", "{doc_id}", ")]"))
        .when(k == 1, _pieces("I cannot help with ", "{doc_id}", "."))
        .when(k == 2, _pieces("[Find ", "{lang}", "(", "{doc_id}", ")]"))
        .otherwise(_pieces("[Find ", "{lang}", "] - ", "{doc_id}"))
    )
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("You may use "), schema, F.lit(" only.")).alias("system"), _said(("user", F.col("text")), ("assistant", answer)).alias("conversations"))


_TOOL = """'[{"name": "Find ' || lang || '", "description": "d", "parameters": {"type": "dict", "properties": {"q": {"type": "str"}, "' || source || '": {"type": "int"}}, "required": ["q"]}}]'"""


@query(f"""SELECT doc_id, {_SHA.format(f"'You may use ' || {_TOOL} || ' only.' || chr(31) || text || chr(31)")} AS row_id, text AS prompt, {_SHA.format("'Find ' || lang || '(q,' || source || ')' || chr(31)")} AS group_key,
 CASE WHEN doc_id % 4 = 1 THEN 0 ELSE 1 END::BIGINT AS n_calls, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END::BIGINT AS n_args, CASE WHEN doc_id % 4 = 1 THEN 'I cannot help with ' || doc_id || '.' END AS refusal,
 2::BIGINT AS n_turns, 'json' AS schema_format, {_TOOL} AS schema_text FROM documents""")
def adapt_bracket_calls(spark, d):
    r = adapters.adapt(_bracketed(spark, d), "toolace").select("doc_id", "record.*")
    return r.select(
        "doc_id", "row_id", "prompt", "group_key", F.size("calls").cast("long").alias("n_calls"), F.get("calls", F.lit(0))["n_args"].cast("long").alias("n_args"), "refusal",
        F.col("n_turns").cast("long").alias("n_turns"), "schema_format", "schema_text",
    )


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'pyargs_positional' WHEN 3 THEN 'unsplittable_call_turn' ELSE CASE WHEN {_BLANK} THEN 'no_user_turn' WHEN doc_id % 4 = 1 THEN 'no_call_turn' END END AS reason,
 CASE WHEN doc_id % 4 = 0 AND NOT ({_BLANK}) THEN '<tool_call>{{"arguments": {{"q": "n7, (x)", "' || source || '": ' || doc_id || '}}, "name": "find_' || lang || '"}}</tool_call>' END AS answer FROM documents""")
def render_bracket_calls(spark, d):
    out = render.render(_bracketed(spark, d), "toolace")
    return out.select("doc_id", "rendered.reason", F.element_at("rendered.messages", -1)["content"].alias("answer"))


# Tool calls in tags, under declared tools, under an answer's schema, or under neither


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    call = _pieces('<tool_call>\n{"name": "look", "arguments": {"n": ', "{doc_id}", "}}\n</tool_call>")
    answer = F.when(F.col("doc_id") % 2 == 0, call).otherwise(_pieces("Plain ", "{doc_id}"))
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), _said(("human", F.col("text")), ("gpt", answer)).alias("conversations"),
        F.when(k == 0, '[{"name": "look"}]').alias("tools"), F.when(k == 1, _pieces('{"title": "', "{lang}", '", "type": "object"}')).alias("schema"),
    )


@query(f"""SELECT doc_id::VARCHAR AS row_id, text AS prompt, CASE doc_id % 3 WHEN 0 THEN {_SHA.format("'look()' || chr(31)")} WHEN 1 THEN 'json-schema:' || {_SHA.format('''('{"title": "' || lang || '", "type": "object"}') || chr(31)''')} ELSE 'no-tools' END AS group_key,
 CASE WHEN doc_id % 2 = 0 THEN '{{"n": ' || doc_id || '}}' END AS args FROM documents""")
def adapt_tagged_calls(spark, d):
    r = adapters.adapt(_tagged(spark, d), "hermes").select("record.*")
    return r.select("row_id", "prompt", "group_key", F.get("calls", F.lit(0))["args"].alias("args"))


@query(f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'neither_tools_nor_schema' WHEN {_BLANK} THEN 'no_user_turn' END AS reason,
 CASE WHEN doc_id % 2 = 0 THEN '<tool_call>{{"arguments": {{"n": ' || doc_id || '}}, "name": "look"}}</tool_call>' ELSE 'Plain ' || doc_id END AS answer FROM documents)
SELECT doc_id::VARCHAR AS row_id, reason, CASE WHEN reason IS NULL THEN answer END AS answer FROM a""")
def render_tagged_calls(spark, d):
    out = render.render(_tagged(spark, d), "hermes")
    return out.select(F.col("id").alias("row_id"), "rendered.reason", F.element_at("rendered.messages", -1)["content"].alias("answer"))


# Completions in every wrapper: JSON in tags that an argument holds too, a list with entries that are none, code, fences, bare


def _wrapped() -> Column:
    call = lambda name, value: _pieces('{"name": "', name, '", "arguments": {"n": ', "{doc_id}", ', "s": "', value, '"}}')
    plain = call("find_x", "{source}")
    spoken = _pieces("find.x(n=", "{doc_id}", ", s='", "{source}", "')")
    said = [
        _pieces("So:<tool_call>", call("find_x", "</tool_call> {"), "</tool_call> and <tool_call>\n", plain, "\n</tool_call>"),
        _pieces("<|tool_call|> [", plain, ', {"name": 1}, "junk", ', plain, "]"),
        _pieces("<tool_call>[", plain, ", {oops: ], ", "]</tool_call>"),
        _pieces("<tool_call>[", plain, ", {oops}]</tool_call>"),
        _pieces("<|tool_call_start|>[", spoken, ", other(**k), g(a=b), h()]<|tool_call_end|>"),
        _pieces("[TOOL_CALLS] [", plain, "]"),
        _pieces("Here:\n```json\n[", plain, "]\n```\nDone."),
        _pieces("[", spoken, "]"),
        _pieces("{'function': {'name': 'find_x', 'parameters': {'n': ", "{doc_id}", ", 's': '", "{source}", "'}}}"),
        _pieces("find_x(n=", "{doc_id}", ")"),
    ]
    k, out = F.col("doc_id") % len(said), said[-1]
    for i, one in enumerate(said[:-1]):
        out = F.when(k == i, one).otherwise(out)
    return out


_CALL = """'{{"args": {{"n": ' || doc_id || ', "s": "' || {0} || '"}}, "name": "find{1}x"}}'"""
_ONE, _DOT = _CALL.format("source", "_"), _CALL.format("source", ".")


@query(f"""WITH c AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN {_CALL.format("'</tool_call> {'", "_")} || ', ' || {_ONE} WHEN 1 THEN {_ONE} || ', ' || {_ONE} WHEN 3 THEN {_ONE} WHEN 4 THEN {_DOT} || ', {{"args": {{}}, "name": "h"}}'
  WHEN 5 THEN {_ONE} WHEN 6 THEN {_ONE} WHEN 7 THEN {_DOT} WHEN 8 THEN {_ONE} ELSE '' END AS c, CASE doc_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 4 THEN 2 WHEN 9 THEN 0 ELSE 1 END::BIGINT AS n_calls FROM documents)
SELECT doc_id, '[' || c || ']' AS calls, n_calls, doc_id % 10 IN (3, 5, 6, 8) AS correct FROM c""")
def grade_wrapped_calls(spark, d):
    truth = _pieces('[{"find_x": {"n": [', "{doc_id}", '], "s": ["', "{source}", '"]}}]')
    docs = table(spark, d, "documents").select("doc_id", grade.graded_calls(F.lit("simple"), _wrapped(), truth).alias("v"))
    return docs.select("doc_id", "v.calls", F.col("v.n_calls").cast("long").alias("n_calls"), "v.correct")


# Questions on tables, instructions, code


def _schema(spark: SparkSession, d: str, names: tuple[str, str, str]) -> DataFrame:
    ddl = _pieces("CREATE TABLE t_", "{lang}", " (id INT, c", (F.col("doc_id") % 7).cast("string"), " TEXT)")
    ddl = F.when(F.col("doc_id") % 2 == 0, ddl).otherwise("") if names[1] == "input" else ddl
    return table(spark, d, "documents").select("doc_id", F.col("text").alias(names[0]), ddl.alias(names[1]), _pieces("SELECT ", "{doc_id}", " FROM t_", "{lang}").alias(names[2]))


_DDL = "('CREATE TABLE t_' || lang || ' (id INT, c' || (doc_id % 7) || ' TEXT)')"
_GROUP = "substr(sha1({0} || chr(31) || {1} || chr(31)), 1, 16)"


@query(f"""SELECT {_GROUP.format('text', _DDL)} AS row_id, text AS prompt, {_GROUP.format("('t_' || lang)", "('id INT, c' || (doc_id % 7) || ' TEXT')")} AS group_key, {_DDL} AS schema_text FROM documents""")
def adapt_sql_context(spark, d):
    return adapters.adapt(_schema(spark, d, ("question", "context", "answer")), "sql_create_context").select("record.row_id", "record.prompt", "record.group_key", "record.schema_text")


@query(f"""WITH x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN {_DDL} ELSE '' END AS ddl FROM documents)
SELECT {_GROUP.format('text', 'ddl')} AS row_id, text AS prompt, CASE WHEN ddl = '' THEN {_GROUP.format("''", "''")} ELSE {_GROUP.format("('t_' || lang)", "('id INT, c' || (doc_id % 7) || ' TEXT')")} END AS group_key, ddl AS schema_text FROM x""")
def adapt_sql_instruction(spark, d):
    return adapters.adapt(_schema(spark, d, ("instruction", "input", "response")), "clinton_sql").select("record.row_id", "record.prompt", "record.group_key", "record.schema_text")


def _shown(rows: DataFrame, kind: str) -> DataFrame:
    m = F.col("rendered.messages")
    return render.render(rows, kind).select("doc_id", "rendered.reason", F.size(m).cast("long").alias("n_messages"), F.get(m, F.lit(0))["content"].alias("first"), F.element_at(m, -1)["content"].alias("answer"))


_PAIR = """SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty_prompt' END AS reason, CASE WHEN trim(text) <> '' THEN {n} END::BIGINT AS n_messages, CASE WHEN trim(text) <> '' THEN {first} END AS first, CASE WHEN trim(text) <> '' THEN {answer} END AS answer FROM documents"""


@query(_PAIR.format(n=3, first=f"'Write SQL for these tables.' || chr(10) || {_DDL}", answer="'SELECT ' || doc_id || ' FROM t_' || lang"))
def render_sql_context(spark, d):
    return _shown(_schema(spark, d, ("question", "context", "answer")), "sql_create_context")


@query(_PAIR.format(n="CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END", first=f"CASE WHEN doc_id % 2 = 0 THEN 'Write SQL for these tables.' || chr(10) || {_DDL} ELSE trim(text) END", answer="'SELECT ' || doc_id || ' FROM t_' || lang"))
def render_sql_instruction(spark, d):
    return _shown(_schema(spark, d, ("instruction", "input", "response")), "clinton_sql")


def _code(spark: SparkSession, d: str) -> DataFrame:
    fenced = _pieces("So:\n```python\nimport os_", "{lang}", ", sys\nfrom pkg.part import x\ndef do_", (F.col("doc_id") % 9).cast("string"), "(a):\n    return np.load(a) + ab(a) + Find_", "{source}", "(a)\n```")
    bare = _pieces("try call_", "{lang}", "(1)")
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("query"), F.when(F.col("doc_id") % 5 == 0, bare).otherwise(fenced).alias("answer"))


@query(f"""SELECT {_SHA.format("text || chr(31)")} AS row_id, text AS prompt, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'os_' || lang || '|pkg|sys' END AS mods,
 CASE WHEN doc_id % 5 = 0 THEN 'call_' || lang ELSE 'do_' || (doc_id % 9) || '|find_' || source || '|np.load' END AS called, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'do_' || (doc_id % 9) END AS defined FROM documents""")
def adapt_code(spark, d):
    r = adapters.adapt(_code(spark, d), "codefeedback")
    return r.select("record.row_id", "record.prompt", *(F.array_join(f"symbols.{c}", "|").alias(c) for c in ("mods", "called", "defined")))


@query(_PAIR.format(n=2, first="trim(text)", answer="""CASE WHEN doc_id % 5 = 0 THEN 'try call_' || lang || '(1)' ELSE 'So:' || chr(10) || '```python' || chr(10) || 'import os_' || lang || ', sys' || chr(10) || 'from pkg.part import x' || chr(10)
 || 'def do_' || (doc_id % 9) || '(a):' || chr(10) || '    return np.load(a) + ab(a) + Find_' || source || '(a)' || chr(10) || '```' END"""))
def render_code(spark, d):
    return _shown(_code(spark, d), "codefeedback")


# Flags on parsed records


def _records(spark: SparkSession, d: str) -> DataFrame:
    required = F.array_join(F.transform(F.slice(F.array(*(F.lit(f'"p{i}"') for i in range(5))), F.lit(1), (F.col("doc_id") % 5).cast("int")), lambda x: x), ", ")
    tools = _pieces('[{"name": "look_', "{lang}", '", "parameters": {"type": "dict", "properties": {"p0": {"type": "int"}}, "required": [', required, "]}}]")
    call = _pieces('[{"name": "', F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.concat(F.lit("look_"), "lang")), '", "arguments": {"p0": 1}}]')
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("hash_id"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text")).alias("query"), tools.alias("tools"),
        F.when(k == 0, "").when(k == 1, "I will not.").otherwise(call).alias("answers"), F.concat(F.lit("look_"), "lang").alias("func_name"),
    )


_FLAGGED = """SELECT doc_id, (doc_id % 6 = 0 OR (doc_id % 3 = 0 AND text = '')) AS parse_fail, doc_id % 3 = 2 AND doc_id % 4 = 0 AS tool_mismatch, doc_id % 3 = 1 AND doc_id % 5 <= 2 AS over_refusal FROM documents"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    r = adapters.adapt(_records(spark, d), "apigen").select("doc_id", "record.*")
    names = F.transform("tools", lambda t: t["name"])
    return r.select(
        "doc_id", flags.parse_fail(F.col("prompt"), F.col("calls"), F.col("refusal")).alias("parse_fail"), flags.tool_mismatch(F.col("calls"), names).alias("tool_mismatch"),
        flags.over_refusal(F.col("refusal"), F.col("target"), F.col("tools")).alias("over_refusal"),
    )


@query(_FLAGGED)
def flags_of_records(spark, d):
    return _flagged(spark, d)


@query(f"WITH r AS ({_FLAGGED}) SELECT (CASE WHEN parse_fail THEN 16 ELSE 0 END) | (CASE WHEN tool_mismatch THEN 2 ELSE 0 END) | (CASE WHEN over_refusal THEN 4 ELSE 0 END) AS f, count(*) AS n_rows FROM r GROUP BY f")
def flag_bits_of_records(spark, d):
    rows = _flagged(spark, d)
    return rows.groupBy(flags.bits(**{c: F.col(c) for c in ("parse_fail", "tool_mismatch", "over_refusal")}).alias("f")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 2000) WHEN 1 THEN 'I will not.' ELSE '[{"name":"' || CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE 'look_' || lang END || '","keys":["p0"]}]' END AS surface FROM documents""")
def answer_surfaces(spark, d):
    r = adapters.adapt(_records(spark, d), "apigen").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return r.select("doc_id", adapters.answer_surface(F.col("record"), F.col("text")).alias("surface"))


# Calls graded against values that differ row by row, in every wrapper


@query("""SELECT doc_id, doc_id % 5 < 3 AS correct, CASE doc_id % 5 WHEN 3 THEN 'wrong arguments' WHEN 4 THEN 'did not call' ELSE 'correct' END AS family, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 1 END::BIGINT AS n_calls FROM documents""")
def grade_call_wrappers(spark, d):
    arg = lambda shift: (F.col("doc_id") + shift).cast("string")
    k = F.col("doc_id") % 5
    said = (
        F.when(k == 0, _pieces('<tool_call>{"name": "get", "arguments": {"n": ', "{doc_id}", ', "s": "A  b"}}</tool_call>'))
        .when(k == 1, _pieces("Sure:\n```json\n", '[{"name": "get", "arguments": {"n": "', "{doc_id}", '", "s": "a B"}}]\n```'))
        .when(k == 2, _pieces("[get(n=", "{doc_id}", ".0, s='a b')]"))
        .when(k == 3, _pieces('{"name": "get", "parameters": {"n": ', arg(1), ', "s": "a b"}}'))
        .otherwise(_pieces("I did ", "{doc_id}", "."))
    )
    truth = _pieces('[{"get": {"n": [', "{doc_id}", '], "s": ["a b"], "free": ["", 1]}}]')
    g = table(spark, d, "documents").select("doc_id", grade.graded_calls(F.lit("simple"), said, truth).alias("v"))
    return g.select("doc_id", "v.correct", grade.reason_family(F.col("v.reason")).alias("family"), F.col("v.n_calls").cast("long").alias("n_calls"))


@query("""SELECT doc_id, doc_id % 4 = 0 AS correct, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'envelope' WHEN 2 THEN 'schema' ELSE 'parse' END AS first FROM documents""")
def grade_structured_kinds(spark, d):
    body = F.to_json(F.array(F.struct("doc_id", "lang", F.col("text").alias("t"))))
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body).when(k == 2, F.concat(F.lit("```\n"), F.replace(body, F.lit('"doc_id":'), F.lit('"id":')), F.lit("\n```"))).otherwise(F.concat(F.lit("```yaml\n"), body, F.lit("\n```")))
    schema = r'{\"type\": \"array\", \"items\": {\"type\": \"object\", \"required\": [\"doc_id\"], \"properties\": {\"doc_id\": {\"type\": \"integer\"}, \"lang\": {\"type\": \"string\"}, \"t\": {\"type\": \"string\"}}}}'
    v = table(spark, d, "documents").select("doc_id", grade.graded_structure(said, F.lit('{"require_code_block": true, "top_level_count": 1, "json_schema": "%s"}' % schema)).alias("v"))
    return v.select("doc_id", "v.correct", F.coalesce(F.substring_index(F.get("v.errors", F.lit(0)), ":", 1), F.lit("")).alias("first"))


# The other instruction checkers

_STRIP = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"


def _follow(spark: SparkSession, d: str, response: Column, instruction: str, **kwargs) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", instructions.follows(response, instruction, **kwargs).alias("kept"))


def _checked(response: str, rule: str) -> str:
    return f"SELECT doc_id, {_STRIP} <> '' AND ({rule}) AS kept FROM (SELECT doc_id, {response} AS v FROM documents)"


def _with(k: int, before: str = "", after: str = "") -> Column:
    """The text, with something before or after it for every k-th document."""
    return F.when(F.col("doc_id") % k == 0, F.concat(F.lit(before), "text", F.lit(after))).otherwise(F.col("text"))


#: Stops that end no sentence go first; initials twice, as neighbours share a letter.
_STOPS = r"regexp_replace(text, '(?i)(^|[^\p{L}\p{N}])(mr|mrs|ms|dr|prof|sr|jr|st|vs|etc|e\.g|i\.e|cf|fig|vol|approx)\.', '\1\2', 'g')"
_INITIALS = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}})\.(\s*\p{{Lu}})', '\1\2\3', 'g')"
_CLOSED = r"""["'')\]”’]*"""
_SENTENCES = rf"""(len(regexp_extract_all(v, '[.!?…]+{_CLOSED}(?:\s|$)')) + regexp_matches(v, '[^.!?…\s"'')\]”’]{_CLOSED}\s*$')::INT)"""


@query(f"SELECT doc_id, {_STRIP} <> '' AND {_SENTENCES} + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END >= 20 AS kept FROM (SELECT doc_id, {_INITIALS.format(_INITIALS.format(_STOPS))} AS v FROM documents)")
def ifeval_number_sentences(spark, d):
    return _follow(spark, d, _with(2, 'Dr. J. R. Roe met Mrs. Poe (at 3.5 km, e.g. here!) "there." '), "length_constraints:number_sentences", num_sentences=20, relation="at least")


@query(_checked("CASE WHEN doc_id % 2 = 0 THEN '* a' || chr(10) || '- b' || chr(10) || text ELSE text END", r"len(regexp_extract_all(v, '(?m)^\s*\*[^*\n].*$')) + len(regexp_extract_all(v, '(?m)^\s*-.*$')) = 2"))
def ifeval_bullet_lists(spark, d):
    return _follow(spark, d, _with(2, "* a\n- b\n"), "detectable_format:number_bullet_lists", num_bullets=2)


@query(_checked("CASE WHEN doc_id % 3 = 0 THEN text || ' My answer is maybe.' ELSE text END", r"regexp_matches(v, 'My answer is (?:yes|no|maybe)\.')"))
def ifeval_constrained_response(spark, d):
    return _follow(spark, d, _with(3, after=" My answer is maybe."), "detectable_format:constrained_response")


@query(_checked("CASE WHEN doc_id % 3 = 0 THEN '*one* and **two** ' || text ELSE text END", r"len(list_filter(regexp_extract_all(v, '\*[^\n*]*\*'), lambda h: trim(trim(h, '*')) <> '')) + len(list_filter(regexp_extract_all(v, '\*\*[^\n*]*\*\*'), lambda h: trim(trim(h, '*')) <> '')) >= 2"))
def ifeval_highlighted_sections(spark, d):
    return _follow(spark, d, _with(3, "*one* and **two** "), "detectable_format:number_highlighted_sections", num_highlights=2)


@query(_checked("CASE WHEN doc_id % 4 = 0 THEN 'Section 1 ' || text || ' Section 2' ELSE text END", r"len(regexp_extract_all(v, '\s?Section\s?\d+\s?')) >= 2"))
def ifeval_multiple_sections(spark, d):
    return _follow(spark, d, _with(4, "Section 1 ", " Section 2"), "detectable_format:multiple_sections", section_spliter="Section", num_sections=2)


@query(_checked("CASE WHEN doc_id % 3 = 0 THEN 'a ' || chr(10) || '***' || chr(10) || text ELSE text END", r"len(list_filter(regexp_split_to_array(v, '\s?\*\*\*\s?'), lambda p: regexp_matches(p, '\S'))) = 2"))
def ifeval_number_paragraphs(spark, d):
    return _follow(spark, d, _with(3, "a \n***\n"), "length_constraints:number_paragraphs", num_paragraphs=2)


@query(_checked("CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'P.S. more' ELSE text END", r"regexp_matches(lower(v), '(?m)\s*p\.\s?s\..*$')"))
def ifeval_postscript(spark, d):
    return _follow(spark, d, _with(3, after="\nP.S. more"), "detectable_content:postscript", postscript_marker="P.S.")


@query(_checked("CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || to_json({'t': text}) || chr(10) || '```' WHEN 1 THEN '{a' ELSE text END", "doc_id % 3 = 0"))
def ifeval_json_format(spark, d):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("t"))), F.lit("\n```"))).when(k == 1, "{a").otherwise(F.concat(F.lit("so "), F.col("text")))
    return _follow(spark, d, said, "detectable_format:json_format")


@query(_checked("CASE WHEN doc_id % 2 = 0 THEN 'first' || chr(10) || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '\"So, ' ELSE 'No ' END || replace(text, chr(10) || chr(10), ' ') ELSE text END", "doc_id % 4 = 0"))
def ifeval_nth_paragraph(spark, d):
    second = F.concat(F.when(F.col("doc_id") % 4 == 0, '"So, ').otherwise("No "), F.replace("text", F.lit("\n\n"), F.lit(" ")))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("first\n\n"), second)).otherwise(F.concat(F.lit("so "), F.replace("text", F.lit("\n\n"), F.lit(" "))))
    return _follow(spark, d, said, "length_constraints:nth_paragraph_first_word", num_paragraphs=2, nth_paragraph=2, first_word="so")


@query("""SELECT doc_id, doc_id % 3 = 0 AS kept FROM documents""")
def ifeval_two_responses(spark, d):
    k = F.col("doc_id") % 3
    own = F.concat(F.lit("x"), "text")
    said = F.when(k == 0, F.concat(own, F.lit("\n******\nother"))).when(k == 1, F.concat(own, F.lit("\n******\n"), own)).otherwise(own)
    return _follow(spark, d, said, "combination:two_responses")


@query(_checked("CASE doc_id % 3 WHEN 0 THEN '<<Title>> ' || text WHEN 1 THEN '<< >> ' || text ELSE text END", "len(list_filter(regexp_extract_all(v, '<<[^\\n]+>>'), lambda t: trim(trim(t, '<>')) <> '')) > 0"))
def ifeval_title(spark, d):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("<<Title>> "), "text")).when(k == 1, F.concat(F.lit("<< >> "), "text")).otherwise(F.col("text"))
    return _follow(spark, d, said, "detectable_format:title")


_VOTES = {k: f"len(regexp_extract_all(v, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(w)})(?:[^\\p{{L}}\\p{{N}}_]|$)'))" for k, w in instructions.COMMON.items()}
_ASCII = r"regexp_replace(text, '[^A-Za-z]+', '  ', 'g')"
_ENGLISH = f"{_VOTES['en']} >= greatest({', '.join(_VOTES.values())})"


def _letters() -> Column:
    return F.regexp_replace("text", "[^A-Za-z]+", "  ")


# Languages by trigrams: fitted on documents of even number, told for all

_TELL = r"""c AS (SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM documents), g AS (SELECT doc_id, lang, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS g FROM c),
 f AS (SELECT lang, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS g FROM (SELECT lang, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM documents WHERE doc_id % 2 = 0)),
 n AS (SELECT g, lang, count(*) AS n FROM f GROUP BY g, lang), top AS (SELECT g FROM n GROUP BY g ORDER BY sum(n) DESC, g LIMIT 2000), l AS (SELECT DISTINCT lang FROM n JOIN top USING (g)),
 tot AS (SELECT lang, sum(n) + (SELECT count(*) FROM top) AS t FROM n JOIN top USING (g) GROUP BY lang), s AS (SELECT top.g, l.lang AS of, ln((coalesce(n.n, 0) + 1) / t) AS s FROM top CROSS JOIN l JOIN tot USING (lang) LEFT JOIN n ON n.g = top.g AND n.lang = l.lang),
 k AS (SELECT doc_id, g, count(*) AS k FROM g GROUP BY doc_id, g), p AS (SELECT doc_id, of, sum(k * s) AS p FROM k JOIN s USING (g) GROUP BY doc_id, of), told AS (SELECT doc_id, arg_max(of, p) AS told FROM p GROUP BY doc_id)"""


def _model(spark: SparkSession, d: str) -> languages.Model:
    return languages.fit(table(spark, d, "documents").filter("doc_id % 2 = 0"))


@query(f"WITH {_TELL.format('text')} SELECT doc_id, told FROM documents LEFT JOIN told USING (doc_id)")
def language_told(spark, d):
    return table(spark, d, "documents").select("doc_id", _model(spark, d).language(F.col("text")).alias("told"))


@query(f"WITH {_TELL.format('text')} SELECT lang, count(*) AS n, count(*) FILTER (WHERE told = lang) AS n_right FROM documents LEFT JOIN told USING (doc_id) WHERE doc_id % 2 = 1 GROUP BY lang")
def language_accuracy(spark, d):
    """How often the language of documents that the model has not seen is told right."""
    rest = table(spark, d, "documents").filter("doc_id % 2 = 1").withColumn("told", _model(spark, d).language(F.col("text")))
    return rest.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("told") == F.col("lang"), 1)).alias("n_right"))


@query(f"WITH {_TELL.format(_ASCII)} SELECT doc_id, regexp_matches(text, '[A-Za-z]') AND coalesce(told = 'en', true) AS kept FROM documents LEFT JOIN told USING (doc_id)")
def ifeval_response_language(spark, d):
    return _follow(spark, d, _letters(), "language:response_language", language="en", model=_model(spark, d))


@query(_checked(f"CASE WHEN doc_id % 2 = 0 THEN upper({_ASCII}) ELSE {_ASCII} END", f"upper(v) = v AND lower(v) <> v AND {_ENGLISH}"))
def ifeval_english_capital(spark, d):
    return _follow(spark, d, F.when(F.col("doc_id") % 2 == 0, F.upper(_letters())).otherwise(_letters()), "change_case:english_capital")


@query(_checked(f"CASE WHEN doc_id % 2 = 0 THEN lower({_ASCII}) ELSE {_ASCII} END", f"lower(v) = v AND upper(v) <> v AND {_ENGLISH}"))
def ifeval_english_lowercase(spark, d):
    return _follow(spark, d, F.when(F.col("doc_id") % 2 == 0, F.lower(_letters())).otherwise(_letters()), "change_case:english_lowercase")


@query(_checked(f"CASE WHEN doc_id % 3 = 0 THEN 'THE BIG A1 cat ' || {_ASCII} ELSE {_ASCII} END", r"len(list_filter(regexp_split_to_array(v, '[^A-Za-z0-9]+'), lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]*$'))) >= 3"))
def ifeval_capital_word_frequency(spark, d):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("THE BIG A1 cat "), _letters())).otherwise(_letters())
    return _follow(spark, d, said, "change_case:capital_word_frequency", capital_frequency=3, capital_relation="at least")


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), v AS (SELECT doc_id, text, unnest([text, array_to_string(l[2:], chr(10)), array_to_string(l[:-2], chr(10)), array_to_string(l[2:-2], chr(10))]) AS v FROM l)
SELECT doc_id, any_value(regexp_matches(text, '\S') AND NOT contains(text, ',')) AS strict, bool_or(regexp_matches(v, '\S') AND NOT contains(v, ',')) AS loose FROM v GROUP BY doc_id""")
def ifeval_strict_and_loose(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", instructions.follows(F.col("text"), "punctuation:no_comma").alias("strict"), instructions.loosely(F.col("text"), "punctuation:no_comma").alias("loose"))


@query(r"""WITH x AS (SELECT lang, [regexp_matches(text, '\S') AND NOT contains(text, ','), regexp_matches(text, '\S') AND regexp_matches(text, '(?i)license')] AS s FROM documents)
SELECT lang, round(avg((s[1] AND s[2])::INT), 10) AS prompt_level, round(sum(s[1]::INT + s[2]::INT) / sum(2), 10) AS instruction_level FROM x GROUP BY lang""")
def ifeval_rates(spark, d):
    kept = F.array(instructions.follows(F.col("text"), "punctuation:no_comma"), instructions.follows(F.col("text"), "keywords:existence", keywords=["license"]))
    out = table(spark, d, "documents").select("lang", kept.alias("s")).groupBy("lang").agg(*instructions.rates(F.col("s")))
    return out.select("lang", F.round("prompt_level", 10).alias("prompt_level"), F.round("instruction_level", 10).alias("instruction_level"))
