"""Synthetic probes: tool returns in envelopes of several depths, damaged or contradicted, and their clean twins."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import parsing as P
from corpusloom.functions.rows import by_row

# The keys of the envelopes by depth, from the inside out, and the names of the defects.
ENVELOPES = {1: ("data",), 2: ("result", "body"), 3: ("envelope", "response", "content")}
CORRUPTIONS = ("truncated_json", "type_swapped", "error_envelope", "empty_body", "null_leaf")
CONTRADICTIONS = ("wrong_entity", "silently_truncated", "stale_as_of", "unit_swapped")
# The part of a text that a truncated return keeps, the error that stands for a result, and what the
# contradictions add to a payload.
KEPT = 0.62
ERROR = {"code": "upstream_timeout", "message": "backend did not respond in 30s", "retryable": True}
TRUNCATED = {"partial": True, "returned": 1, "total_matching": 47}
STALE = {"cached": True, "generated_at": "2019-11-02T04:15:00Z"}
UNITS = {"units": "unspecified", "note": "values are in the provider's base units"}


def wrap(payload: Any, depth: int) -> Any:
    for key in ENVELOPES[depth]:
        payload = {key: payload}
    return payload


def leaves(value: Any, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if inner is None:
        yield path, value
    for k, v in inner or ():
        yield from leaves(v, (*path, k))


def replaced(value: Any, path: tuple, new: Any) -> Any:
    """A copy with another value at the path."""
    out = copy.deepcopy(value)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = new
    return out


def number_path(payload: Any) -> tuple | None:
    """The deepest number, of several the first; without numbers the first leaf."""
    found = list(leaves(payload))
    numbers = [p for p, v in found if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return max(numbers, key=len) if numbers else found[0][0] if found else None


#: Characters of a text leaf that an answer would quote, and of one that can stand for a whole return.
QUOTED, TELLING = 4, 6


def spellings(value: Any) -> list[str]:
    """How an answer would write a leaf: numbers shortest, whole ones from 1,000 on with separators too; texts as they are."""
    if isinstance(value, str):
        own = value.strip()
        return [own] if len(own) >= QUOTED else []
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return []
    plain = f"{value:g}" if isinstance(value, float) else str(value)
    return [plain, f"{value:,}"] if isinstance(value, int) and abs(value) >= 1000 else [plain]


def headline(payload: Any) -> tuple[tuple | None, list[str]]:
    """The leaf that a right answer quotes, and its spellings: the deepest number, or else the longest telling text; of
    several the first."""

    def rank(path: tuple, value: Any) -> tuple[int, int]:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return 2, len(path)
        return (1, len(value.strip())) if isinstance(value, str) and len(value.strip()) >= TELLING else (0, 0)

    path, value = max(leaves(payload), key=lambda leaf: rank(*leaf), default=((), None))
    return (path, spellings(value)) if rank(path, value)[0] else (None, [])


def identifying(text: str | None) -> bool:
    """Four characters at least, and if they write a number, three digits: less occurs in any prose."""
    own = (text or "").strip()
    digits = sum(c.isdigit() for c in own)
    number = digits > 0 and digits + sum(c in ".-+" for c in own) == len(own)
    return len(own) >= QUOTED and (not number or digits >= 3)


def missing_leaves(payload: Any, shown: str, most: int = 12) -> list[str]:
    """Identifying leaves that a damaged return no longer shows: quoting one is making it up."""
    seen = " ".join(shown.lower().split())
    out = dict.fromkeys(s for _, v in leaves(payload) for s in spellings(v) if identifying(s) and s.lower() not in seen)
    return list(out)[:most]


def corrupt(payload: Any, mode: str, depth: int) -> tuple[str, str]:
    """The text of a damaged return and what is wrong with it."""
    text = lambda x: json.dumps(x, ensure_ascii=False)
    inside = wrap(payload, depth)
    if mode == "truncated_json":
        whole = text(inside)
        return whole[: int(len(whole) * KEPT)], "the text ends in the middle of an object"
    if mode in ("type_swapped", "null_leaf"):
        path = number_path(inside)
        new, why = ("N/A", "is text, not a number") if mode == "type_swapped" else (None, "is null")
        return text(replaced(inside, path, new)), f"the value at {'.'.join(map(str, path))} {why}"
    if mode == "error_envelope":
        return text(wrap({"error": ERROR}, depth)), "an upstream error stands where the result should"
    if mode == "empty_body":
        return text(wrap({}, depth)), "the body is empty"
    raise ValueError(f"no corruption {mode}")


def contradict(payload: Any, mode: str, args: dict[str, Any]) -> tuple[Any, str] | tuple[None, str]:
    """A well-formed return that answers another question, and why it does; None and the reason where none can be made."""
    if mode == "wrong_entity":
        wanted = {s.lower() for v in args.values() for s in spellings(v)}
        echo = next(((p, v) for p, v in leaves(payload) if any(s.lower() in wanted for s in spellings(v))), None)
        if echo is None:
            return None, "no leaf repeats an argument"
        path, value = echo
        if isinstance(value, (int, float)):
            new: Any = value + 7
        else:
            last = value[-1]
            step = str((int(last) + 5) % 10) if last.isdigit() else ("q" if last.lower() == "x" else "x") if last.isalpha() else last + "x"
            new = value[:-1] + step
        return replaced(payload, path, new), f"{'.'.join(map(str, path))} is {new} where {value} was asked for"
    if mode == "silently_truncated":
        return TRUNCATED | {"result": payload}, "one match of many is returned"
    if mode == "stale_as_of":
        return STALE | {"result": payload}, "the return was cached years ago"
    if mode == "unit_swapped":
        path = number_path(payload)
        if path is None:
            return None, "there is nothing to name a unit of"
        return UNITS | {"result": payload}, f"the unit of {'.'.join(map(str, path))} is not given"
    raise ValueError(f"no contradiction {mode}")


PROBE = "struct<body:string,why:string,forbidden:array<string>,skipped:string>"


def _defective(payload: str, args: str, mode: str, depth: int) -> dict:
    value, called = P.loads(payload), P.loads(args, {})
    if not isinstance(value, dict) or not value:
        return {"body": None, "why": None, "forbidden": [], "skipped": "the payload is no object"}
    if mode == "clean":
        return {"body": json.dumps(wrap(value, depth), ensure_ascii=False), "why": None, "forbidden": [], "skipped": None}
    if mode in CORRUPTIONS:
        body, why = corrupt(value, mode, depth)
        return {"body": body, "why": why, "forbidden": missing_leaves(value, body), "skipped": None}
    bad, why = contradict(value, mode, called)
    if bad is None:
        return {"body": None, "why": None, "forbidden": [], "skipped": why}
    body = json.dumps(wrap(bad, depth), ensure_ascii=False)
    return {"body": body, "why": why, "forbidden": missing_leaves(value, body), "skipped": None}


def defective(payload: Column | str, args: Column | str, mode: Column | str, depth: Column | str) -> Column:
    """PROBE: one damaged or contradicted return (mode clean: an intact one); skipped says why there is none."""
    return by_row(_defective, PROBE)(payload, args, mode, depth)


def generated(scenarios: DataFrame, modes: tuple[str, ...] = (*CORRUPTIONS, *CONTRADICTIONS), depths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Every scenario (scenario, payload, args) at every depth in every mode: scenario, depth, mode, probe.

    The modes and depths are a fixed list, so each scenario just repeats len(modes) * len(depths) times.
    """
    grid = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(d).alias("depth")) for m in modes for d in depths))
    return scenarios.withColumn("g", F.explode(grid)).select("scenario", "g.depth", "g.mode", defective("payload", "args", "g.mode", "g.depth").alias("probe"))


def surface_forms(questions: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Each question in each form; a form holds %s where the question goes."""
    grid = F.array(*(F.struct(F.lit(k).alias("form"), F.lit(v).alias("t")) for k, v in forms.items()))
    return questions.withColumn("g", F.explode(grid)).select(*questions.columns, "g.form", F.replace(F.col("g.t"), F.lit("%s"), F.col("question")).alias("prompt"))


def rotated(order: Column, modes: tuple[str, ...]) -> Column:
    """The mode of a row by its number, in turn."""
    return F.element_at(F.array(*map(F.lit, modes)), (F.pmod(order, F.lit(len(modes))) + 1).cast("int"))


def template(key: Column, templates: tuple[str, ...]) -> Column:
    """One of the templates, by a hash of the key."""
    return F.element_at(F.array(*map(F.lit, templates)), (F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(len(templates))) + 1).cast("int"))


def twins(rows: DataFrame, bad: Column, clean: Column) -> DataFrame:
    """Two rows of each: the defective one and the clean one, told apart by arm."""
    both = F.array(F.struct(F.lit("defective").alias("arm"), bad.alias("messages")), F.struct(F.lit("clean").alias("arm"), clean.alias("messages")))
    return rows.withColumn("_t", F.explode(both)).select(*rows.columns, "_t.arm", "_t.messages")


def usable_returns(turns: DataFrame, key: str, order: str) -> DataFrame:
    """The first tool return of each conversation that is a JSON object with a headline and is answered in words: key, order, text."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    said = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    body = F.regexp_replace("text", r"</?tool_response>", "")
    good = said.filter((F.col("role") == "tool") & F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False)))
    good = good.filter((F.col("_role") == "assistant") & (F.trim("_text") != "") & ~F.contains("_text", F.lit("<tool_call>"))).withColumn("_headline", headlines(body))
    good = good.filter(F.col("_headline.path").isNotNull())
    return good.groupBy(key).agg(F.min(F.struct(order, body.alias("text"))).alias("_f")).select(key, "_f.*")


def _told(text: str) -> dict:
    try:
        path, own = headline(P.loads(text))
    except RecursionError:
        path, own = None, []
    return {"path": None if path is None else ".".join(map(str, path)), "spellings": own}


def headlines(payload: Column) -> Column:
    """Struct (path, spellings) on the headline of a return in JSON; path is null where it has none."""
    return by_row(_told, "struct<path:string,spellings:array<string>>")(payload)


def unquotable(payload: Column, shown: Column) -> Column:
    """The identifying leaves of a return in JSON that a text no longer shows."""
    return by_row(lambda p, s: missing_leaves(P.loads(p), s or ""), "array<string>")(payload, shown)
