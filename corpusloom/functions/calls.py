"""Calls in a completion: wrappers are found by their openers, and what they hold by balancing its brackets.

A blob ends where its brackets balance outside quotes, so an argument may hold anything, the wrapper's own closing tag too.
Of a list, every entry that is a call counts, whatever the others are. Plain Python on single values.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from typing import Any

from corpusloom.functions.parsing import CLOSES, loads, plain, split_top_level

# How models wrap calls, as openers and their closers, and what a fence may be named.
WRAPPERS = {
    "<tool_call>": "</tool_call>",
    "<function_call>": "</function_call>",
    "<|tool_call|>": "\n",
    "<|tool_call_start|>": "<|tool_call_end|>",
    "[TOOL_CALLS]": "\n",
}
ARGUMENTS = ("arguments", "args", "parameters")
_OPENER = re.compile("|".join(map(re.escape, WRAPPERS)))
_FENCE = re.compile(r"```(?:json|tool_call)?\s*(?=[\[{])")
_DOTTED = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*")


def balanced(text: str, at: int) -> int | None:
    """The place after the bracketed value that opens at `at`; None if its brackets or quotes do not balance."""
    stack, i, n = [], at, len(text)
    while i < n:
        ch = text[i]
        if ch in CLOSES:
            stack.append(CLOSES[ch])
        elif stack and ch == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        elif ch in ")]}":
            return None
        elif ch in "'\"":
            i += 1
            while i < n and text[i] != ch:
                i += 1 + (text[i] == "\\")
        i += 1
    return None


def _value(text: str) -> Any:
    """A JSON value or a Python literal; None for anything else."""
    found = loads(text)
    if found is not None:
        return found
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def call_of(entry: Any) -> dict[str, Any] | None:
    """An object as a call: a name, and arguments that are an object or JSON text of one."""
    if not isinstance(entry, dict):
        return None
    inner = entry["function"] if isinstance(entry.get("function"), dict) else entry
    given = next((inner[k] for k in ARGUMENTS if k in inner), {})
    given = loads(given)
    return {"name": inner["name"], "args": plain(given)} if isinstance(inner.get("name"), str) and isinstance(given, dict) else None


def _spoken(entry: str) -> dict[str, Any] | None:
    """`name(key=literal, ...)` as a call; arguments by position are left out."""
    try:
        tree = ast.parse(entry.strip(), mode="eval").body
        name = ast.unparse(tree.func) if isinstance(tree, ast.Call) else ""
        if not _DOTTED.fullmatch(name) or any(k.arg is None for k in tree.keywords):
            return None
        return {"name": name, "args": {k.arg: plain(ast.literal_eval(k.value)) for k in tree.keywords}}
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def calls_in(blob: str) -> list[dict[str, Any]]:
    """The calls of a blob: an object, a list of them, or a list of `name(key=literal, ...)`, in brackets or bare."""
    text = blob.strip()
    value = _value(text)
    if value is not None:
        return [c for c in map(call_of, value if isinstance(value, list) else [value]) if c]
    inner = text[1:-1] if text[:1] + text[-1:] == "[]" else text
    parts = split_top_level(inner) or []
    # A list with an entry that is no value keeps its other entries.
    found = [call_of(_value(p)) if p.lstrip()[:1] == "{" else _spoken(p) for p in parts]
    return [c for c in found if c]


def wrapped(text: str) -> Iterator[str]:
    """What the wrappers of a text hold, in order: up to where it balances, or else to the closer or the end."""
    at = 0
    while opener := _OPENER.search(text, at):
        start = opener.end()
        while start < len(text) and text[start].isspace():
            start += 1
        end = balanced(text, start) if text[start : start + 1] in CLOSES else None
        if end is None:
            end = text.find(WRAPPERS[opener[0]], start)
            end = len(text) if end < 0 else end
        yield text[start:end]
        at = max(end, opener.end())


def fenced(text: str) -> Iterator[str]:
    """The bracketed values that stand alone in a code fence."""
    at = 0
    while opener := _FENCE.search(text, at):
        end = balanced(text, opener.end())
        at = opener.end() if end is None else end
        if end is not None and text[end:].lstrip().startswith("```"):
            yield text[opener.end() : end]


def parse_calls(completion: str | None) -> list[dict[str, Any]]:
    """The calls of a completion, in its first form that has any: all its wrappers, its fences, or the whole as one value."""
    text = completion or ""
    bare = [text] if text.strip()[:1] + text.strip()[-1:] in ("{}", "[]") else []
    return next((found for found in ([c for b in blobs for c in calls_in(b)] for blobs in (wrapped(text), fenced(text), bare)) if found), [])


def calls_json(completion: str | None) -> str:
    """The calls of a completion as JSON, keys sorted."""
    try:
        return json.dumps(parse_calls(completion), ensure_ascii=False, sort_keys=True)
    except (RecursionError, ValueError):  # nested too deeply
        return "[]"
