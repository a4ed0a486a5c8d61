"""Records to chat messages: one renderer a source, each giving messages or the reason why there are none."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import parsing as P
from corpusloom.functions.rows import by_row
from corpusloom.operators.adapters import ROLES, turns

MESSAGES = "array<struct<role:string,content:string>>"
RENDERED = f"struct<messages:{MESSAGES},reason:string,prompt_only:boolean>"
#: System texts before the tools, the schema of the answer, and the tables.
WITH_TOOLS = "You may call the functions below. Answer with <tool_call> blocks where a call is needed.\n<tools>\n%s\n</tools>"
WITH_SCHEMA = "Answer with JSON that fits this schema.\n%s"
WITH_TABLES = "Write SQL for these tables.\n%s"


class _NotRendered(Exception):
    """Its text is the reason."""


def _need(ok: Any, reason: str) -> None:
    if not ok:
        raise _NotRendered(reason)


def _pretty(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, indent=1, sort_keys=True, default=str)


def _block(calls: list[tuple[Any, Any]], names: dict[str, str]) -> str:
    for name, args in calls:
        _need(name, "call_without_name")
        _need(isinstance(args, dict), "call_args_not_object")
    return "\n".join(P.render_call(names.get(n) or P.identifiers([n])[n], P.plain(a)) for n, a in calls)


def _apigen(row: dict) -> list[tuple[str, str]]:
    tools, names = P.canonical_tools(P.tools_of(row.get("tools")))
    _need(tools, "no_tools_declared")
    user = (row.get("query") or "").strip()
    _need(user, "empty_prompt")
    answers = P.loads(row.get("answers"))
    if isinstance(answers, list):
        _need(all(isinstance(c, dict) for c in answers), "call_without_name")
        _need(answers, "empty_call_list")
        answer = _block([(c.get("name"), c.get("arguments") or c.get("args") or {}) for c in answers], names)
    else:
        answer = (row.get("answers") or "").strip()
        _need(answer, "empty_refusal")
    return [("system", WITH_TOOLS % _pretty(tools)), ("user", user), ("assistant", answer)]


def _said(row: dict) -> list[tuple[str, str]]:
    given = [(ROLES.get(r), v.strip()) for r, v in turns(row.get("conversations"))]
    return [(r, v) for r, v in given if r and v]


def _ends_well(out: list[tuple[str, str]], wanted: str, missing: str, seen: bool) -> list[tuple[str, str]]:
    _need(any(r == "user" for r, _ in out), "no_user_turn")
    _need(seen, missing)
    _need(out[-1][0] == "assistant", wanted)
    return out


def _toolace(row: dict) -> list[tuple[str, str]]:
    kind, raw, _, _ = P.schema_of(row.get("system"))
    tools, names = P.canonical_tools(raw)
    _need(tools, f"schema_not_json:{kind}")
    out, called = [("system", WITH_TOOLS % _pretty(tools))], False
    for role, text in _said(row):
        if role == "tool":
            text = f"<tool_response>{text}</tool_response>"
        elif role == "assistant" and P.call_format(text) != "natural_language":
            pairs = P.split_calls(text)
            _need(pairs, "unsplittable_call_turn")
            parsed = [(n, *P.parse_args(a)) for n, a in pairs]
            for _, _, verdict in parsed:
                _need(verdict in ("ok", "empty"), f"pyargs_{verdict}")
            text, called = _block([(n, a) for n, a, _ in parsed], names), True
        if role != "system":
            out.append((role, text))
    return _ends_well(out, "conversation_ends_off_assistant", "no_call_turn", called)


def _hermes(row: dict) -> list[tuple[str, str]]:
    raw, schema, names = P.tools_of(row.get("tools")), row.get("schema"), {}
    _need(raw or schema, "neither_tools_nor_schema")
    if raw:
        tools, names = P.canonical_tools(raw)
        _need(tools, "tools_field_unparsed")
        out = [("system", WITH_TOOLS % _pretty(tools))]
    else:
        out = [("system", WITH_SCHEMA % _pretty(P.loads(schema, schema)))]
    answered = False
    for role, text in _said(row):
        if role == "assistant":
            calls = P.tagged_calls(text)
            text, answered = _block([(c["name"], c["args"]) for c in calls], names) if calls else text, True
        elif role == "tool" and not text.startswith("<tool_response>"):
            text = f"<tool_response>{text}</tool_response>"
        if role != "system":
            out.append((role, text))
    return _ends_well(out, "conversation_ends_off_assistant", "no_assistant_turn", answered)


PARSED = {"apigen": _apigen, "toolace": _toolace, "hermes": _hermes}


def _parsed(kind: str):
    renderer = PARSED[kind]

    def render(row: str) -> dict:
        try:
            return {"messages": [{"role": r, "content": c} for r, c in renderer(json.loads(row))], "reason": None, "prompt_only": False}
        except _NotRendered as e:
            return {"messages": None, "reason": str(e), "prompt_only": False}

    return by_row(render, RENDERED)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _result(messages: Column, reason: Column, prompt_only: Column | None = None) -> Column:
    return F.struct(F.when(reason.isNull(), messages).alias("messages"), reason.alias("reason"), (F.lit(False) if prompt_only is None else prompt_only).alias("prompt_only")).cast(RENDERED)


def _pair(question: Column, answer: Column, context: Column | None = None) -> Column:
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    reason = F.when(q == "", "empty_prompt").when(a == "", "empty_answer")
    both = F.array(_message("user", q), _message("assistant", a))
    if context is not None:
        c = F.trim(F.coalesce(context, F.lit("")))
        both = F.when(c == "", both).otherwise(F.concat(F.array(_message("system", F.concat(F.lit(WITH_TABLES.replace("%s", "")), c))), both))
    return _result(both, reason)


def conversation(turns_: Column) -> Column:
    """Turns (role, content) kept as they are: up to the last answer, or all of them, as a prompt only, without any."""
    said = F.filter(F.transform(turns_, lambda t: F.struct(t["role"].alias("role"), F.trim(t["content"]).alias("content"))), lambda t: t["role"].isNotNull() & (t["content"] != ""))
    answers = F.filter(F.transform(said, lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    none = F.size(answers) == 0
    reason = F.when(~F.exists(said, lambda t: t["role"] == "user"), "no_user_turn")
    return _result(F.when(none, said).otherwise(F.slice(said, F.lit(1), F.coalesce(F.array_max(answers), F.lit(0)))), reason, none & reason.isNull())


def render(rows: DataFrame, kind: str) -> DataFrame:
    """rows with rendered (messages, reason, prompt_only) by the source's kind; for antidoom conversations has from and value."""
    if kind in PARSED:
        return rows.withColumn("rendered", _parsed(kind)(F.to_json(F.struct(*rows.columns))))
    col = lambda *names: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names if c in rows.columns), F.lit(""))
    if kind == "sql_create_context":
        return rows.withColumn("rendered", _pair(col("question"), col("answer"), col("context")))
    if kind == "clinton_sql":
        return rows.withColumn("rendered", _pair(col("instruction"), col("response", "output", "answer"), col("input")))
    if kind == "codefeedback":
        return rows.withColumn("rendered", _pair(col("query"), col("answer")))
    if kind == "antidoom":
        names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
        role = lambda t: F.try_element_at(names, F.lower(t["from"]))
        return rows.withColumn("rendered", conversation(F.transform("conversations", lambda t: F.struct(role(t).alias("role"), F.coalesce(t["value"], F.lit("")).alias("content")))))
    raise ValueError(f"no renderer {kind}")


def reasons(rendered: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """How often each reason kept a row from being rendered, the most frequent first."""
    return rendered.filter("rendered.reason is not null").groupBy(*by, F.col("rendered.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), *by, "reason").limit(most)


def chat_text(messages: Column) -> Column:
    """The messages as one text with role markers."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.array_join(parts, "")


def loss_spans(messages: Column) -> Column:
    """Start and end (characters, end exclusive) of the answers in chat_text, which are what is learnt."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["role"]) + len("<|im_start|>\n")
        end = begin + F.length(m["content"]) + len("<|im_end|>")
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(m["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(messages, start, step)["spans"]


def within(rendered: DataFrame, tokens: Column, most: int) -> DataFrame:
    """The length filter; it comes after dedup and purity, for which long rows count."""
    return rendered.filter(tokens <= most)


def last_wins(manifest: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order: what a manifest that names a row twice means."""
    best = manifest.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in manifest.columns if c not in keys]), order).alias("_r"))
    return best.select(*keys, "_r.*")


def with_manifest(rows: DataFrame, manifest: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows joined to the manifest's last word on them, with matched."""
    known = last_wins(manifest, keys, order).withColumn("matched", F.lit(True))
    return rows.join(known, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
