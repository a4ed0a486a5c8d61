"""Source rows to the common record: native expressions where the source is plain, one Arrow UDF where it must be parsed.

A row that an adapter fails on keeps its error text instead of a record, so that it can be counted and left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha1
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import parsing as P
from corpusloom.functions.rows import by_row
from corpusloom.functions.text import fingerprint

TOOL = "struct<name:string,params:array<string>,required:array<string>,types:array<string>,container_type:string,depth:int,n_params:int>"
CALL = "struct<name:string,args:string,n_args:int,ident:boolean>"
RECORD = (
    f"row_id string, prompt string, refusal string, target string, group_key string, schema_text string, declared array<string>,"
    f" tools array<{TOOL}>, calls array<{CALL}>, schema_format string, n_turns int, error string"
)
# Names of the roles in the sources.
ROLES = {
    "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "model": "assistant", "tool": "tool",
    "function": "tool", "observation": "tool", "function_response": "tool", "system": "system",
}


def sha(*parts: Any) -> str:
    return sha1(b"".join(str(p).encode("utf-8", "replace") + b"\x1f" for p in parts)).hexdigest()[:16]


def turns(raw: Any) -> list[tuple[str, str]]:
    """Role (as given, lower case) and text of each turn, in either spelling of the keys."""
    found = P.loads(raw, [])
    return [((t.get("from") or t.get("role") or "").lower(), t.get("value") or t.get("content") or "") for t in found if isinstance(t, dict)]


def _group(tools: list[dict]) -> str:
    return sha(*P.surface(tools)) if tools else "no-tools"


def _call(name: Any, args: Any = None, n_args: int | None = None) -> dict[str, Any]:
    args = {} if args is None else args
    return {
        "name": name, "args": json.dumps(args, ensure_ascii=False, sort_keys=True, default=str),
        "n_args": len(args) if n_args is None and isinstance(args, dict) else n_args, "ident": bool(P._NAME.fullmatch(name or "")),
    }


def _apigen(row: dict) -> dict:
    tools = [t for t in map(P.tool_summary, P.tools_of(row.get("tools"))) if t]
    answers = P.loads(row.get("answers"))
    calls = isinstance(answers, list)
    return {
        "row_id": row.get("hash_id") or sha(row.get("query")), "prompt": row.get("query") or "", "tools": tools, "group_key": _group(tools),
        "calls": [_call(c.get("name"), c.get("arguments") or c.get("args")) for c in answers if isinstance(c, dict)] if calls else [],
        "refusal": None if calls else (row.get("answers") or "").strip(), "target": row.get("func_name"), "schema_text": row.get("tools") or "",
    }


def _turn_calls(text: str, declared: list[str]) -> list[dict[str, Any]] | None:
    """The calls of one turn; None where it is prose. Where the format hides them, the declared names that occur."""
    form = P.call_format(text)
    if form == "natural_language":
        return None
    bracketed = form == "pythonic_bracket"
    return [_call(n, n_args=P.count_args(a)) for n, a in P.split_calls(text)] if bracketed else [_call(n, n_args=0) for n in declared if n in text]


def _toolace(row: dict) -> dict:
    said = turns(row.get("conversations"))
    prompt = next((v for r, v in said if ROLES.get(r) == "user" and v), "")
    own = [v.strip() for r, v in said if r in ("assistant", "gpt")]
    kind, raw, declared, text = P.schema_of(row.get("system"))
    tools = [t for t in map(P.tool_summary, raw) if t]
    read = [_turn_calls(v, declared) for v in own]
    out = {"row_id": sha(row.get("system"), prompt), "prompt": prompt, "n_turns": len(said)}
    out |= {"tools": tools, "declared": declared, "schema_format": kind, "schema_text": text}
    out |= {"calls": [c for found in read if found for c in found], "refusal": own[0][:200] if own and read.count(None) == len(own) else None}
    return out | {"group_key": sha(*sorted(declared)) if declared and not tools else _group(tools)}


def _hermes(row: dict) -> dict:
    tools = [t for t in map(P.tool_summary, P.tools_of(row.get("tools"))) if t]
    said = turns(row.get("conversations"))
    prompt = next((v for r, v in said if ROLES.get(r) == "user" and v), "")
    schema = row.get("schema")
    return {
        "row_id": str(row.get("id") or sha(prompt)), "prompt": prompt, "tools": tools, "n_turns": len(said),
        "calls": [_call(c["name"], c["args"]) for r, v in said if ROLES.get(r) == "assistant" for c in P.tagged_calls(v)],
        "group_key": _group(tools) if tools or not schema else "json-schema:" + sha(schema), "schema_text": row.get("tools") or schema or "",
    }


PARSED: dict[str, Callable[[dict], dict]] = {"apigen": _apigen, "toolace": _toolace, "hermes": _hermes}


def _parsed(kind: str) -> Callable[[Column], Column]:
    adapter, names = PARSED[kind], T._parse_datatype_string(RECORD).names

    def adapt(row: str) -> dict:
        empty = dict.fromkeys(names) | {"declared": [], "tools": [], "calls": []}
        try:
            return empty | adapter(json.loads(row))
        except Exception as e:  # the row is counted and left out
            return empty | {"error": f"{type(e).__name__}: {e}"[:200]}

    return by_row(adapt, RECORD.join(["struct<", ">"]).replace(" string", ":string").replace(" array", ":array").replace(" int", ":int"))


def sql_group(ddl: Column) -> Column:
    """The tables and columns that a schema text creates, whatever their order, hashed."""
    tables = F.transform(F.regexp_extract_all(ddl, F.lit(r'(?i)CREATE TABLE\s+([A-Za-z0-9_"`.]+)'), F.lit(1)), lambda t: F.btrim(t, F.lit('"`')))
    columns = F.transform(F.regexp_extract_all(ddl, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda c: F.trim(c))
    return fingerprint(F.array_join(F.array_sort(tables), ","), F.array_join(F.array_sort(columns), ","))


def code_symbols(answer: Column, most_called: int = 64, most_defined: int = 32) -> Column:
    """Struct (mods, called, defined) of lower-case symbols in the code fences of an answer, or in all of it without any;
    of called and defined ones the first so many in order."""
    fenced = F.regexp_extract_all(answer, F.lit(r"(?s)```[A-Za-z0-9_+#.-]*\n(.*?)```"), F.lit(1))
    code = F.when(F.size(fenced) > 0, F.array_join(fenced, "\n")).otherwise(answer)
    take = lambda p: F.regexp_extract_all(code, F.lit(p), F.lit(1))
    imports = F.concat(
        take(r"(?m)^[ \t]*from[ \t]+([A-Za-z_][\w.]*)"),
        F.flatten(F.transform(take(r"(?m)^[ \t]*import[ \t]+([A-Za-z_][\w.]*(?:[ \t]*,[ \t]*[A-Za-z_][\w.]*)*)"), lambda x: F.split(x, r"[ \t]*,[ \t]*"))),
        take(r"(?m)^[ \t]*#include[ \t]*[<\"]([\w./]+)"), take(r"(?m)^[ \t]*require\(['\"]([\w./@-]+)"), take(r"(?m)^[ \t]*using[ \t]+([A-Za-z_][\w.]*)"),
    )
    mods = F.filter(F.transform(imports, lambda m: F.lower(F.regexp_extract(m, r"^([^./]*)", 1))), lambda m: m != "")
    called = F.filter(take(r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\("), lambda c: F.contains(c, F.lit(".")) | (F.length(c) > 2))
    defined = take(r"\b(?:def|class|function|func|fn|sub|void|public|private)\s+([A-Za-z_]\w*)")
    clean = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.lower(x))))
    return F.struct(clean(mods).alias("mods"), F.slice(clean(called), 1, most_called).alias("called"), F.slice(clean(defined), 1, most_defined).alias("defined"))


def first_turn(conversation: Column, roles: tuple[str, ...]) -> Column:
    """The text of the first turn (struct from, value) of one of the roles that has any."""
    said = F.filter(conversation, lambda t: F.lower(t["from"]).isin(*roles) & (F.coalesce(t["value"], F.lit("")) != ""))
    return F.coalesce(F.get(said, F.lit(0))["value"], F.lit(""))


def _plain(rows: DataFrame, **fields: Column) -> DataFrame:
    schema = T._parse_datatype_string(RECORD)
    empty = {"declared": F.array().cast("array<string>"), "tools": F.array().cast(f"array<{TOOL}>"), "calls": F.array().cast(f"array<{CALL}>")}
    return rows.select("*", F.struct(*(fields.get(f.name, empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema)).alias("record"))


def adapt(rows: DataFrame, kind: str) -> DataFrame:
    """rows with record, by the adapter of one of: apigen, toolace, hermes, sql_create_context, clinton_sql, codefeedback,
    antidoom, prompt_only. Where record.error is not null the row is to be left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    if kind in PARSED:
        return rows.withColumn("record", _parsed(kind)(F.to_json(F.struct(*rows.columns))))
    if kind == "sql_create_context":
        return _plain(rows, prompt=text("question"), group_key=sql_group(text("context")), row_id=fingerprint(F.col("question"), F.col("context")), schema_text=text("context"))
    if kind == "clinton_sql":
        return _plain(rows, prompt=text("instruction"), group_key=sql_group(text("input")), row_id=fingerprint(F.col("instruction"), text("input")), schema_text=text("input"))
    if kind == "codefeedback":
        return _plain(rows, prompt=text("query"), row_id=fingerprint(F.col("query")), schema_text=F.lit("")).withColumn("symbols", code_symbols(text("answer")))
    if kind == "antidoom":
        prompt = first_turn(F.col("conversations"), ("human", "user"))
        sample = F.coalesce(F.nullif(F.col("source_sample_id"), F.lit("")), fingerprint(prompt))
        conf = F.coalesce(F.nullif(F.col("source_config"), F.lit("")), F.lit("-"))
        group = F.concat(F.lit("src:"), F.coalesce(F.col("source"), F.lit("unknown")), F.lit("/"), conf, F.lit("|"), sample)
        return _plain(rows, prompt=prompt, group_key=group, row_id=F.coalesce(F.col("id").cast("string"), fingerprint(prompt)), schema_text=F.lit(""), n_turns=F.size("conversations"))
    if kind == "prompt_only":
        found = [F.nullif(F.col(c), F.lit("")) for c in ("prompt", "text", "instruction", "query") if c in rows.columns]
        prompt = F.coalesce(*found, F.lit(""))
        return _plain(rows, prompt=prompt, group_key=F.lit("prompt-only"), row_id=fingerprint(prompt), schema_text=F.lit(""))
    raise ValueError(f"no adapter {kind}")


def answer_surface(record: Column, fallback: Column, refused: int = 300, said: int = 2000) -> Column:
    """What an answer does: its calls' names and sorted argument names, else the refusal's first characters, else the given
    text's."""
    calls = F.transform(record["calls"], lambda c: F.struct(c["name"].alias("name"), F.array_sort(F.json_object_keys(c["args"])).alias("keys")))
    refusal = F.nullif(F.substring(record["refusal"], 1, refused), F.lit(""))
    return F.when(F.size(calls) > 0, F.to_json(calls)).otherwise(F.coalesce(refusal, F.substring(fallback, 1, said)))


def rarity_keys(rows: DataFrame, key: str, lang: Column) -> DataFrame:
    """key, group_key, tier: a row's rarest shared symbol. Called symbols weigh their document frequency, modules three
    times theirs, both if two rows have them at least; else the first defined symbol; else the language."""
    sym = rows.select(key, F.explode(F.concat(F.transform("symbols.called", lambda c: F.struct(c.alias("s"), F.lit(1).alias("w"))), F.transform("symbols.mods", lambda m: F.struct(F.concat(F.lit("mod:"), m).alias("s"), F.lit(3).alias("w"))))).alias("x")).select(key, "x.*").distinct()
    df = sym.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    best = sym.join(df, "s").groupBy(key).agg(F.min(F.struct((F.col("df") * F.col("w")).alias("weight"), "s")).alias("best"))
    first = F.get(F.col("symbols.defined"), F.lit(0))
    out = rows.join(best, key, "left")
    tier = F.when(F.col("best").isNotNull(), "shared").when(first.isNotNull(), "defined").otherwise("bare")
    group = F.coalesce(F.col("best.s"), F.concat(F.lit("def:"), first), F.concat(F.lit("bare:"), F.coalesce(lang, F.lit("-"))))
    return out.select(key, group.alias("group_key"), tier.alias("tier"))
