"""Text functions as column expressions: normalization, word windows, hashes, containment, phrase flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a prompt that are compared with evaluation items.
PREFIX = 20_000

# Phrases that say a tool's return cannot be used as it is; the first that matches counts.
FLAGS = (
    r"(?i)\bdo(?:es)?\s+not\s+match\b",
    r"(?i)\bdoesn'?t\s+match\b",
    r"(?i)\bmismatch",
    r"(?i)\bcontradict",
    r"(?i)\binconsistent\b",
    r"(?i)\bnot\s+(?:the\s+)?(?:one|value|date|account|entity|environment|city|id|units?)\s+(?:you|that\s+was)\s+(?:asked|requested|wanted)",
    r"(?i)\b(?:is|are|was|were)\s+(?:for|as\s+of)\s+a\s+different\b",
    r"(?i)\ba\s+different\s+(?:date|account|site|environment|city|ticket|resource|invoice|unit|measure|column|entity)\b",
    r"(?i)\bstale\b",
    r"(?i)\bout\s+of\s+date\b",
    r"(?i)\btruncat",
    r"(?i)\bcut\s+off\b",
    r"(?i)\bincomplete\b",
    r"(?i)\bmalformed\b",
    r"(?i)\bdid\s+not\s+parse\b|\bdoes\s+not\s+parse\b|\bfailed\s+to\s+parse\b",
    r"(?i)\b(?:empty|missing|null)\s+(?:body|result|response|field|value)\b",
    r"(?i)\bno\s+(?:results?|data|value)\s+(?:was\s+)?return",
    r"(?i)\breturned\s+an?\s+error\b",
    r"(?i)\bupstream\s+error\b",
    r"(?i)\bcannot\s+(?:answer|confirm|determine|rely)\b|\bcan'?t\s+(?:answer|confirm|determine|rely)\b",
    r"(?i)\bunable\s+to\s+(?:answer|confirm|determine)\b",
    r"(?i)\bnot\s+(?:enough|sufficient)\s+(?:information|data)\b",
    r"(?i)\bonly\s+\d+\s+of\s+\d+\b",
    r"(?i)\b(?:no|without)\s+(?:a\s+)?unit\b|\bunit\s+is\s+(?:not|un)",
    r"(?i)\bshould\s+(?:be\s+)?re-?(?:try|run|quest|call)\b|\bre-?try\s+the\s+call\b",
    r"(?i)\bwrong\s+(?:date|account|site|environment|city|ticket|resource|invoice|entity|units?|measure|column)\b",
)


def normalize(text: Column) -> Column:
    """Lower case, with every run of other characters than letters, digits and `_` as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def capped(text: Column, chars: int = PREFIX) -> Column:
    """The part of a text that is compared: its first characters, before normalization."""
    return F.substring(text, 1, chars)


def words(text: Column) -> Column:
    """The words of a normalized text; none for an empty one."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-1 over the parts, each followed by the unit separator."""
    return F.substring(F.sha1(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("None")), F.lit("\x1f"))))), 1, 16)


def joined_hash(*parts: Column) -> Column:
    """MD5 over the parts joined by the unit separator: the hash to use where its order can be seen."""
    return F.md5(F.concat_ws("\x1f", *parts))


def prompt_sha(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def ordered_sha(ids: Column, order: Column) -> Column:
    """Aggregate: SHA-1 of the ids joined by newlines in the given order (for lists of bounded length)."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), ids.cast("string").alias("i"))))
    return F.sha1(F.array_join(F.transform(pairs, lambda x: x["i"]), "\n"))


def quotes(text: Column, value: Column) -> Column:
    """Whether the normalized value occurs in the normalized text as whole words."""
    v = normalize(value)
    return (v != "") & F.contains(F.concat(F.lit(" "), normalize(text), F.lit(" ")), F.concat(F.lit(" "), v, F.lit(" ")))


def folded(text: Column) -> Column:
    """Lower case, trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def first_literal(text: Column, needles: Column) -> Column:
    """The first needle, in lower case, that the folded text contains; null if none does."""
    t = folded(F.coalesce(text, F.lit("")))
    return F.get(F.filter(needles, lambda n: F.contains(t, F.lower(n))), F.lit(0))


def flag(text: Column) -> Column:
    """The position (from 0) of the first of FLAGS that the text matches; null if none does."""
    return F.coalesce(*(F.when(F.rlike(text, F.lit(p)), F.lit(i)) for i, p in enumerate(FLAGS)))


def stratum(item_id: Column, parts: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The stratum of the first part that the id contains."""
    return F.coalesce(*(F.when(F.contains(item_id, F.lit(k)), F.lit(v)) for k, v in parts), F.lit(otherwise))


def fences(text: Column) -> Column:
    """Struct on a completion's code fences: fence lines, blocks opened and closed, first language, characters, blank."""
    ticks = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*```([A-Za-z0-9_+#.-]*)[ \t]*$"), F.lit(1))
    n = F.size(ticks)
    return F.struct(
        n.alias("lines"), F.ceil(n / 2).cast("int").alias("opened"), F.floor(n / 2).cast("int").alias("closed"),
        F.coalesce(F.get(ticks, F.lit(0)), F.lit("")).alias("lang"), F.length(text).alias("chars"), (F.trim(text) == "").alias("blank"),
    )


def without_thinking(text: Column) -> Column:
    """The text without `<think>` blocks and channel markers, trimmed; an unclosed block runs to the end."""
    out = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    out = F.regexp_replace(out, r"(?is)<think(?:ing)?>.*$", "")
    out = F.regexp_replace(out, r"(?is)^.*?</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(out, r"(?is)<\|channel\|>.*?<\|message\|>", ""))


def word_count(text: Column) -> Column:
    """Runs of letters, digits and `_`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


#: Words whose full stop ends no sentence, as a pattern; initials are single capital letters before another word.
ABBREVIATED = r"(?i)(?<![\p{L}\p{N}])(mr|mrs|ms|dr|prof|sr|jr|st|vs|etc|e\.g|i\.e|cf|fig|vol|approx)\."
INITIAL = r"(?<![\p{L}\p{N}])(\p{Lu})\.(?=\s*\p{Lu})"


def sentence_count(text: Column) -> Column:
    """Runs that end in . ! ? or an ellipsis, with quotes or brackets closed behind, before white space or the end, plus an
    unfinished last one. Stops of abbreviations, initials and numbers end none."""
    plain = F.regexp_replace(F.regexp_replace(text, ABBREVIATED, "$1"), INITIAL, "$1")
    ends = F.regexp_count(plain, F.lit(r"[.!?\x{2026}]+[\"')\]\x{201D}\x{2019}]*(?=\s|$)"))
    return ends + F.when(F.rlike(plain, F.lit(r"[^.!?\x{2026}\s\"')\]\x{201D}\x{2019}][\"')\]\x{201D}\x{2019}]*\s*$")), 1).otherwise(0)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def identifier(name: Column) -> Column:
    """A display name as a lower-case identifier, without regard to others."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(base == "", "fn").when(F.rlike(base, F.lit(r"^\d")), F.concat(F.lit("fn_"), base)).otherwise(base)


# Spellings of type names and the JSON Schema type that each stands for.
TYPES = {
    "dict": "object", "dictionary": "object", "object": "object", "json": "object", "map": "object", "struct": "object",
    "list": "array", "array": "array", "tuple": "array", "set": "array", "sequence": "array", "vector": "array",
    "str": "string", "string": "string", "text": "string", "char": "string",
    "int": "integer", "integer": "integer", "long": "integer", "int32": "integer", "int64": "integer",
    "float": "number", "double": "number", "number": "number", "decimal": "number",
    "bool": "boolean", "boolean": "boolean",
    "none": "null", "null": "null", "nonetype": "null",
    "any": "any",
}


def json_type(name: Column) -> Column:
    """Struct (type, known): a type name in any spelling, containers by their outer name; unknown names stay."""
    key = F.lower(F.trim(name))
    outer = F.regexp_extract(key, r"^([a-z_][a-z0-9_]*)\s*[\[(<]", 1)
    key = F.when(outer != "", outer).otherwise(key)
    table = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    found = F.when(~key.isin("optional", "union"), F.try_element_at(table, key))
    return F.struct(F.coalesce(found, F.trim(name)).alias("type"), found.isNotNull().alias("known"))


def dotted(document: Column, path: str) -> Column:
    """The value at a path `a.b.c` of a JSON text, as text; null where there is none."""
    return F.get_json_object(document, "$." + path)
