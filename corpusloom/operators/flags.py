"""Row flags as bits, and rules that drop a row when all bits of a mask are set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bit of each flag.
CONTAMINATED, TOOL_MISMATCH, OVER_REFUSAL, CONTRADICTION, PARSE_FAIL = 1, 2, 4, 8, 16


def parse_fail(prompt: Column, calls: Column, refusal: Column) -> Column:
    """No prompt, no call and no refusal."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return none(prompt) & (F.coalesce(F.size(calls), F.lit(0)) < 1) & none(refusal)


def tool_mismatch(calls: Column, declared: Column, strict: bool = False) -> Column:
    """Some call names a tool that is not declared; nothing to tell where none is declared. A call without a name counts,
    unless strict."""
    bad = lambda c: F.when(c["name"].isNull(), F.lit(not strict)).otherwise(~F.array_contains(declared, c["name"]))
    return (F.size(declared) > 0) & F.coalesce(F.exists(calls, bad), F.lit(False))


def over_refusal(refusal: Column, target: Column, tools: Column) -> Column:
    """A refusal although the wanted tool is declared and needs two arguments at most (its first declaration counts)."""
    first = F.get(F.filter(tools, lambda t: t["name"] == target), F.lit(0))
    return (F.coalesce(refusal, F.lit("")) != "") & F.coalesce(F.size(first["required"]) <= 2, F.lit(False))


def bits(**flags: Column) -> Column:
    """The bits of the flags that hold; keys are names of this module's bits, in lower case."""
    out = F.lit(0)
    for name, held in flags.items():
        out = out.bitwiseOR(F.when(F.coalesce(held, F.lit(False)), F.lit(globals()[name.upper()])).otherwise(0))
    return out


def dropped_by(flag_bits: Column, rules: list[tuple[str, int]]) -> Column:
    """The name of the first rule whose mask the bits cover; null if none does."""
    return F.coalesce(*(F.when(flag_bits.bitwiseAND(m) == m, F.lit(name)) for name, m in rules), F.lit(None).cast("string"))


def where(rows: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns have one of the wanted values each."""
    for c, values in wanted.items():
        rows = rows.filter(F.col(c).isin(values))
    return rows
