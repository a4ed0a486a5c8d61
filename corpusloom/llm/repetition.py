"""Quality rules by repetition coverage: the share of a text's characters that lies in duplicated n-grams and lines.

Word hashes roll into n-gram hashes of every length at once (the hash of n words is that of n-1 words times a base plus
the next word's), all in numpy; a length whose n-grams are all distinct ends the search, as longer ones are distinct too.
Each text is judged on its own in one pass over the table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import slices

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Largest share of characters inside duplicated n-grams, by n. A header line that a short text repeats once stays below.
COVERAGE = {5: 0.30, 6: 0.28, 7: 0.27, 8: 0.26, 9: 0.25, 10: 0.24}
#: Largest share of the words' characters inside lines that occur before.
LINES = 0.20
MIN_WORDS = 20
#: Words of a window for n_repeat_words, and the largest percentage of words in repeated windows.
WINDOW, REPEATED = 8, 30
_BASE = np.uint64(0x9E3779B97F4A7C15)

FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_share", pa.float64()),
    ("dup_gram_share", pa.float64()), ("rule", pa.string()),
]


def _covered(hashes: np.ndarray, n: int, n_words: int) -> np.ndarray | None:
    """Which words lie in an n-gram that occurs twice or more; None if none does."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n_words + 1, dtype=np.int64)
    edge[: len(hashes)] += twice
    edge[n : n + len(hashes)] -= twice
    return np.cumsum(edge[:-1]) > 0


def judge(text: str | None) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    if len(set(lines)) < len(lines):
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_chars += len(x) - sum(map(x.count, SPACE))
            seen.add(x)
    repeat, worst, rule = 0, 0.0, None
    if n >= min(COVERAGE):
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
        size = None
        rolled = own
        for k in range(2, max(*COVERAGE, WINDOW) + 1):
            if k > n:
                break
            rolled = rolled[:-1] * _BASE + own[k - 1 :]
            if k not in COVERAGE and k != WINDOW:
                continue
            inside = _covered(rolled, k, n)
            if inside is None:
                break
            if k == WINDOW:
                repeat = int(inside.sum())
            if k in COVERAGE:
                if size is None:
                    size = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=n)
                share = int(size[inside].sum()) / word_chars
                worst = max(worst, share)
                if rule is None and share > COVERAGE[k]:
                    rule = f"dup_{k}_grams"
    line_share = dup_chars / word_chars if word_chars else 0.0
    if rule is None and line_share > LINES:
        rule = "dup_lines"
    failed = n < MIN_WORDS or 100 * repeat > REPEATED * n
    if failed:
        rule = "base"
    return n, word_chars, n_symbols, dup_lines, repeat, failed, rule is None, line_share, worst, rule


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        new = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *(k for k, _ in FIELDS)])


def repetition(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns of docs with the values of FIELDS.

    kept is false if the base rules fail (fewer than MIN_WORDS words, or more than REPEATED % of the words in windows
    of WINDOW words that occur twice), else the verdict of the coverage thresholds; rule names the first that failed.

    Defined cases: a null text is the empty text and fails the base rules; a text of any length is judged whole; an empty
    table gives an empty result; repeated rows are judged each; carried columns may hold anything, and those that have a
    name of FIELDS are replaced.
    """
    carry = [c for c in carry if c.lower() not in {k for k, _ in FIELDS}]
    kinds = {"int64": "long", "bool": "boolean", "double": "double", "string": "string"}
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    new = ", ".join(f"{k} {kinds[str(v)]}" for k, v in FIELDS)
    return docs.select(*carry, F.col(text)).mapInArrow(_judged, f"{own}, {new}")


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d),
     base AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
     l AS (SELECT doc_id, line, count(*) AS c, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
     dup AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum((c - 1) * chars)::BIGINT AS chars FROM l GROUP BY doc_id),
     g AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS i, unnest([array_to_string(w[i + 1:i + k], ' ') FOR i IN range(len(w) - k + 1)]) AS g FROM w, (SELECT unnest([5, 6, 7, 8, 9, 10]) AS k) WHERE len(w) >= k),
     twice AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, g) AS c FROM g) WHERE c > 1),
     inside AS (SELECT DISTINCT doc_id, k, i + j AS pos FROM (SELECT doc_id, k, i, unnest(range(k)) AS j FROM twice)),
     cover AS (SELECT i.doc_id, i.k, count(*) AS n, sum(length(w.w[i.pos + 1])) / any_value(b.word_chars) AS share FROM inside i JOIN w USING (doc_id) JOIN base b USING (doc_id) GROUP BY i.doc_id, i.k),
     most AS (SELECT * FROM (VALUES (5, 0.30), (6, 0.28), (7, 0.27), (8, 0.26), (9, 0.25), (10, 0.24)) AS m(k, most)),
     worst AS (SELECT doc_id, max(share) AS share, max(n) FILTER (WHERE c.k = 8) AS n_repeat, min(c.k) FILTER (WHERE share > most::DOUBLE) AS first FROM cover c JOIN most m ON m.k = c.k GROUP BY doc_id),
     x AS (SELECT b.*, coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, CASE WHEN word_chars > 0 THEN coalesce(dup.chars, 0) / word_chars ELSE 0.0::DOUBLE END AS dup_line_share,
                  coalesce(worst.share, 0.0::DOUBLE) AS dup_gram_share, worst.first FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN worst USING (doc_id)),
     y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x),
     z AS (SELECT *, CASE WHEN base_failed THEN 'base' WHEN first IS NOT NULL THEN 'dup_' || first || '_grams' WHEN dup_line_share > 0.2::DOUBLE THEN 'dup_lines' END AS rule FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule IS NULL AS kept, dup_line_share, dup_gram_share, rule FROM z
"""
