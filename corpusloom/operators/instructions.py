"""Checkers of written instructions as column expressions: does a response keep to the rule?

Languages are told by a model of trigrams (operators/languages.py) where the checker is given one, else by their commonest
words; sentences are counted by end marks that no abbreviation, initial or number explains. The other rules are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import sentence_count, word_count
from corpusloom.operators.languages import Model

#: Commonest words by language, to tell one from another.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with"),
    "de": ("der", "die", "und", "den", "das", "ist", "mit", "nicht", "ein", "von"),
    "fr": ("le", "la", "les", "de", "des", "et", "que", "est", "dans", "pour"),
    "es": ("el", "los", "las", "que", "del", "con", "por", "una", "para", "es"),
}


def _quoted(text: str) -> str:
    """A literal as a pattern."""
    return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in text)


def _count(v: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(v, F.lit(pattern)), F.lit(0))


def _compare(n: Column, relation: str, than: int) -> Column:
    return n < than if relation == "less than" else n >= than


def language_votes(v: Column, lang: str) -> Column:
    return _count(v, rf"(?i)\b(?:{'|'.join(COMMON[lang])})\b")


def is_language(v: Column, lang: str, model: Model | None = None) -> Column:
    """Whether the model tells the language; without one, whether its common words occur at least as often as any other's. A
    text that tells nothing passes."""
    if model:
        return model.is_language(v, lang)
    return language_votes(v, lang) >= F.greatest(*(language_votes(v, x) for x in COMMON))


def _first_word(paragraph: Column) -> Column:
    """The first word, lower case, up to its first punctuation and without quotes before it."""
    word = F.get(F.split(F.trim(paragraph), r"\s+"), F.lit(0))
    return F.lower(F.regexp_extract(F.regexp_replace(word, r"^['\"]+", ""), r"^([^.,?!'\"]*)", 1))


def _stripped(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s+|\s+$", "")


def _full(v: Column) -> Column:
    return F.rlike(v, F.lit(r"\S"))


def _parts_are(parts: Column, full: int) -> Column:
    """Whether so many parts are full and none is blank but the first and the last; the parts are walked once, however many."""
    shape = F.array_join(F.transform(parts, lambda p: F.when(_full(p), "1").otherwise("0")), "")
    return F.rlike(shape, F.lit(f"^0?1{{{full}}}0?$"))


def _two_responses(v: Column) -> Column:
    parts = F.split(v, r"\*\*\*\*\*\*")
    said = F.transform(F.filter(parts, _full), _stripped)
    return _parts_are(parts, 2) & (F.get(said, F.lit(0)) != F.get(said, F.lit(1)))


def _paragraphs(v: Column, num_paragraphs: int) -> Column:
    return _parts_are(F.split(v, r"\*\*\*"), num_paragraphs)  # a blank beside the mark makes no part full


def _nth_paragraph(v: Column, num_paragraphs: int, nth_paragraph: int, first_word: str) -> Column:
    parts = F.split(v, r"\n\n")
    full = F.size(F.filter(parts, lambda p: _stripped(p) != ""))
    nth = F.get(parts, F.lit(nth_paragraph - 1))
    return (full == num_paragraphs) & (F.lit(nth_paragraph) <= F.size(parts)) & F.coalesce((_stripped(nth) != "") & (_first_word(nth) == first_word.lower()), F.lit(False))


def _highlights(v: Column, num_highlights: int) -> Column:
    single = F.filter(F.regexp_extract_all(v, F.lit(r"\*[^\n*]*\*"), F.lit(0)), lambda h: F.trim(F.btrim(h, F.lit("*"))) != "")
    double = F.filter(F.regexp_extract_all(v, F.lit(r"\*\*[^\n*]*\*\*"), F.lit(0)), lambda h: F.trim(F.btrim(h, F.lit("*"))) != "")
    return F.size(single) + F.size(double) >= num_highlights


def _postscript(v: Column, postscript_marker: str) -> Column:
    known = {"P.P.S": r"\s*p\.\s?p\.\s?s.*$", "P.S.": r"\s*p\.\s?s\..*$"}
    return F.rlike(F.lower(v), F.lit("(?m)" + known.get(postscript_marker, r"\s*" + _quoted(postscript_marker.lower()) + ".*$")))


def _unfenced(v: Column) -> Column:
    return _stripped(F.regexp_replace(F.regexp_replace(_stripped(v), r"^```(?:json|Json|JSON)?", ""), r"```$", ""))


CHECKERS: dict[str, Callable[..., Column]] = {
    "language:response_language": lambda v, language, model=None: is_language(v, language, model),
    "length_constraints:number_sentences": lambda v, num_sentences, relation: _compare(sentence_count(v), relation, num_sentences),
    "detectable_content:number_placeholders": lambda v, num_placeholders: _count(v, r"\[.*?\]") >= num_placeholders,
    "detectable_format:number_bullet_lists": lambda v, num_bullets: _count(v, r"(?m)^\s*\*[^*\n].*$") + _count(v, r"(?m)^\s*-.*$") == num_bullets,
    "detectable_format:constrained_response": lambda v: F.rlike(v, F.lit(r"My answer is (?:yes|no|maybe)\.")),
    "detectable_format:number_highlighted_sections": _highlights,
    "detectable_format:multiple_sections": lambda v, section_spliter, num_sections: _count(v, rf"\s?{_quoted(section_spliter)}\s?\d+\s?") >= num_sections,
    "length_constraints:number_paragraphs": _paragraphs,
    "detectable_content:postscript": _postscript,
    "keywords:existence": lambda v, keywords: F.forall(F.array(*map(F.lit, keywords)), lambda k: F.rlike(v, F.concat(F.lit("(?i)"), k))),
    "keywords:frequency": lambda v, keyword, frequency, relation: _compare(_count(v, f"(?i){keyword}"), relation, frequency),
    "length_constraints:number_words": lambda v, num_words, relation: _compare(word_count(v), relation, num_words),
    "detectable_format:json_format": lambda v: F.try_parse_json(_unfenced(v)).isNotNull(),
    "length_constraints:nth_paragraph_first_word": _nth_paragraph,
    "keywords:forbidden_words": lambda v, forbidden_words: ~F.exists(F.array(*map(F.lit, forbidden_words)), lambda k: F.rlike(v, F.concat(F.lit(r"(?i)\b"), k, F.lit(r"\b")))),
    "combination:two_responses": _two_responses,
    "combination:repeat_prompt": lambda v, prompt_to_repeat: F.startswith(F.lower(_stripped(v)), F.lit(prompt_to_repeat.strip().lower())),
    "startend:end_checker": lambda v, end_phrase: F.endswith(F.lower(F.btrim(_stripped(v), F.lit('"'))), F.lit(end_phrase.strip().lower())),
    "detectable_format:title": lambda v: F.exists(F.regexp_extract_all(v, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda t: F.trim(F.btrim(t, F.lit("<>"))) != ""),
    "keywords:letter_frequency": lambda v, letter, let_frequency, let_relation: _compare(_count(F.lower(v), _quoted(letter.lower())), let_relation, let_frequency),
    "change_case:english_capital": lambda v, model=None: (F.upper(v) == v) & (F.lower(v) != v) & is_language(v, "en", model),
    "change_case:english_lowercase": lambda v, model=None: (F.lower(v) == v) & (F.upper(v) != v) & is_language(v, "en", model),
    "punctuation:no_comma": lambda v: ~F.contains(v, F.lit(",")),
    "change_case:capital_word_frequency": lambda v, capital_frequency, capital_relation: _compare(_count(v, r"\b[\p{Lu}][\p{Lu}\p{N}]*\b(?![\p{Ll}])"), capital_relation, capital_frequency),
    "startend:quotation": lambda v: (F.length(_stripped(v)) > 1) & F.startswith(_stripped(v), F.lit('"')) & F.endswith(_stripped(v), F.lit('"')),
}


def follows(response: Column, instruction: str, **kwargs: Any) -> Column:
    """Whether a response keeps to an instruction; a blank one never does."""
    return _full(response) & CHECKERS[instruction](response, **kwargs)


def variants(response: Column) -> Column:
    """The distinct readings that the loose score allows: without first or last line or both, and without asterisks."""
    lines = F.split(response, "\n")
    n = F.size(lines)
    cut = lambda a, z: _stripped(F.array_join(F.slice(lines, F.lit(1 + a), F.greatest(n - a - z, F.lit(0))), "\n"))
    read = [response, cut(1, 0), cut(0, 1), cut(1, 1)]
    return F.array_distinct(F.array(*read, *(F.regexp_replace(r, r"\*", "") for r in read)))


def loosely(response: Column, instruction: str, **kwargs: Any) -> Column:
    return F.exists(variants(response), lambda v: follows(v, instruction, **kwargs))


def rates(strict: Column) -> list[Column]:
    """Aggregates over rows with an array of verdicts: share of rows that keep to all, share of verdicts."""
    kept = F.size(F.filter(strict, lambda x: x))
    return [F.avg((kept == F.size(strict)).cast("double")).alias("prompt_level"), (F.sum(kept) / F.sum(F.size(strict))).alias("instruction_level")]
