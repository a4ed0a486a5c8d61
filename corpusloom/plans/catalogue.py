"""Registered queries over the driver's tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import compare, contamination, dedup, flags, profile, sample, split
from corpusloom.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _norm(x: str = "text") -> str:
    return NORM.format(x)


def _grams(table_name: str, key: str, text: str = "text") -> str:
    return f"""(SELECT {key}, unnest(range(len(w) - 12)) AS pos, unnest([array_to_string(w[i + 1:i + 13], ' ') FOR i IN range(len(w) - 12)]) AS g
      FROM (SELECT {key}, string_split({_norm(text)}, ' ') AS w FROM {table_name}) WHERE len(w) >= 13)"""


_INDEX = f"ix AS (SELECT DISTINCT g, item_id AS item FROM {_grams('benchmark', 'item_id')}), own AS (SELECT g, min(item) AS item FROM ix GROUP BY g)"
_DOCS = f"dg AS {_grams('documents', 'doc_id')}"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return contamination.index(table(spark, d, "benchmark"))


def _doc_grams(spark: SparkSession, d: str) -> DataFrame:
    return contamination.probed(table(spark, d, "documents"), ["doc_id"], _index(spark, d))


# Contamination


@query(f"WITH {_INDEX}, {_DOCS} SELECT doc_id, count(*) AS n_hits FROM dg WHERE g IN (SELECT g FROM ix) GROUP BY doc_id")
def contam_docs(spark, d):
    return contamination.attributed(table(spark, d, "documents"), ["doc_id"], _index(spark, d)).select("doc_id", "n_hits")


@query(f"""WITH {_INDEX}, {_DOCS}, h AS (SELECT doc_id, count(*) AS n FROM dg WHERE g IN (SELECT g FROM ix) GROUP BY doc_id)
SELECT lang, count(*) AS n_rows, count(h.n) AS n_hit, coalesce(sum(h.n), 0)::BIGINT AS n_windows FROM documents LEFT JOIN h USING (doc_id) GROUP BY lang""")
def contam_by_lang(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    hit = contamination.attributed(docs, ["lang"], _index(spark, d)).select("lang", "n_hits")
    rows = docs.select("lang").withColumn("n_hits", F.lit(None).cast("long")).withColumn("n", F.lit(1)).unionByName(hit.withColumn("n", F.lit(0)))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_rows"), F.count("n_hits").alias("n_hit"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_windows"))


@query(f"WITH {_INDEX}, n AS (SELECT item, count(*) AS k FROM own GROUP BY item) SELECT (SELECT count(DISTINCT g) FROM ix) AS n_grams, (SELECT count(*) FROM ix) AS n_entries, (SELECT count(DISTINCT item) FROM ix) AS n_items, (SELECT count(*) FROM n) AS n_owners")
def contam_index_stats(spark, d):
    idx = _index(spark, d)
    owners = contamination.owned(idx).agg(F.count_distinct("item").alias("n_owners"))
    return idx.agg(F.count_distinct("h").alias("n_grams"), F.count(F.lit(1)).alias("n_entries"), F.count_distinct("item").alias("n_items")).crossJoin(F.broadcast(owners))


@query(f"WITH {_INDEX}, {_DOCS} SELECT doc_id, item, count(*) AS n_windows FROM dg JOIN own USING (g) GROUP BY doc_id, item")
def contam_owned_hits(spark, d):
    out = contamination.attributed(table(spark, d, "documents"), ["doc_id"], _index(spark, d), by_item=True)
    return out.select("doc_id", "item", F.col("n_owned").alias("n_windows"))


@query(f"WITH {_INDEX}, {_DOCS}, p AS (SELECT DISTINCT item, doc_id FROM dg JOIN own USING (g)) SELECT item, count(*) AS n_rows, array_to_string(list_sort(list(doc_id)), ',') AS rows, 0::BIGINT AS n_unlisted FROM p GROUP BY item")
def contam_items_touched(spark, d):
    out = contamination.items_touched(_doc_grams(spark, d), contamination.owned(_index(spark, d)), "doc_id", listed=None)
    return out.select("item", "n_rows", F.array_join("rows", ",").alias("rows"), F.col("n_unlisted").cast("long").alias("n_unlisted"))


@query(f"""WITH {_INDEX}, {_DOCS}, p AS (SELECT DISTINCT item, doc_id FROM dg JOIN own USING (g)), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY doc_id) AS k FROM p)
SELECT item, count(*) AS n_rows, array_to_string(list_sort(list(doc_id) FILTER (WHERE k <= 1)), ',') AS rows, count(*) - count(*) FILTER (WHERE k <= 1) AS n_unlisted FROM k GROUP BY item""")
def contam_items_listed(spark, d):
    """As contam_items_touched, with the first row of each item listed and the others counted."""
    out = contamination.items_touched(_doc_grams(spark, d), contamination.owned(_index(spark, d)), "doc_id", listed=1)
    return out.select("item", "n_rows", F.array_join("rows", ",").alias("rows"), F.col("n_unlisted").cast("long").alias("n_unlisted"))


@query(f"WITH {_INDEX}, {_DOCS} SELECT doc_id, count(*) AS n_hits FROM dg WHERE g IN (SELECT g FROM ix) GROUP BY doc_id ORDER BY n_hits DESC, doc_id LIMIT 10")
def contam_worst_k(spark, d):
    return contamination.worst(contam_docs(spark, d), "n_hits", "doc_id", 10)


@query(f"""WITH {_INDEX}, {_DOCS}, f AS (SELECT doc_id, count(DISTINCT CASE WHEN g IN (SELECT g FROM ix) THEN g END) / count(*) AS fraction, count(*) AS n_windows FROM dg GROUP BY doc_id)
SELECT doc_id, fraction, n_windows, fraction > 0.3 AS over FROM f WHERE fraction > 0""")
def contam_overlap_fraction(spark, d):
    out = contamination.overlap_fraction(_doc_grams(spark, d), ["doc_id"])
    return out.withColumn("over", F.col("fraction") > 0.3)


@query(f"WITH ix AS (SELECT DISTINCT g, doc_id AS item FROM {_grams('documents', 'doc_id')}), n AS (SELECT greatest(1, floor(count(DISTINCT item) * 0.005)) AS most FROM ix), df AS (SELECT g, count(*) AS df FROM ix GROUP BY g) SELECT df, count(*) AS n_grams FROM df, n WHERE df > most GROUP BY df")
def contam_boilerplate_df(spark, d):
    found = contamination.boilerplate_of(table(spark, d, "documents"), "doc_id", 0.005)
    return found.groupBy("df").agg(F.count(F.lit(1)).alias("n_grams"))


@query(f"""WITH {_INDEX}, ip AS (SELECT g, item_id AS item, pos FROM {_grams('benchmark', 'item_id')}), {_DOCS}
SELECT doc_id, item, min(ip.pos) AS item_at FROM dg JOIN ip USING (g) GROUP BY doc_id, item""")
def contam_quote(spark, d):
    named = table(spark, d, "benchmark").select(F.lit("benchmark").alias("set"), F.col("item_id").alias("item"), "text")
    out = contamination.quote(_doc_grams(spark, d), contamination.grams(named, ["set", "item"]), ["doc_id"])
    return out.select("doc_id", "item", F.col("item_at").cast("long").alias("item_at"))


@query(f"""WITH {_INDEX}, s AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS input,
       coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS target FROM conversations GROUP BY conv_id),
  i AS (SELECT DISTINCT conv_id FROM {_grams('s', 'conv_id', 'input')} WHERE g IN (SELECT g FROM ix)), t AS (SELECT DISTINCT conv_id FROM {_grams('s', 'conv_id', 'target')} WHERE g IN (SELECT g FROM ix))
SELECT 'conversations' AS corpus, count(*) AS n_rows, count(*) FILTER (WHERE i.conv_id IS NOT NULL OR t.conv_id IS NOT NULL) AS n_hit, count(i.conv_id) AS n_input, count(t.conv_id) AS n_target,
       count(*) FILTER (WHERE i.conv_id IS NOT NULL AND t.conv_id IS NOT NULL) AS n_both FROM s LEFT JOIN i USING (conv_id) LEFT JOIN t USING (conv_id)""")
def contam_conv_sides(spark, d):
    two = contamination.sides(table(spark, d, "conversations"), "conv_id").withColumn("corpus", F.lit("conversations"))
    return contamination.overlap_by_side(two, _index(spark, d), "conv_id", ["corpus"])


# Several named sets of items: all, those of even number, every third. They share items, so windows have several owners.

_SETS = {"all": "true", "even": "item_id % 2 = 0", "third": "item_id % 3 = 0"}
_MANY = f"""b AS (SELECT item_id, g FROM {_grams('benchmark', 'item_id')}), sx AS (SELECT s AS "set", g, min(item_id) AS item FROM b, (VALUES ('all'), ('even'), ('third')) t(s)
  WHERE s = 'all' OR s = 'even' AND item_id % 2 = 0 OR s = 'third' AND item_id % 3 = 0 GROUP BY s, g), so AS (SELECT g, min("set") AS first FROM sx GROUP BY g)"""


def _named_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in _SETS.items())))
    return contamination.index(table(spark, d, "benchmark").withColumn("named", F.explode(sets)), set_name=F.col("named"))


@query(f"""WITH {_MANY}, {_DOCS}, x AS (SELECT doc_id, g, pos FROM dg WHERE g IN (SELECT g FROM so)), n AS (SELECT doc_id, count(*) AS n_windows FROM dg GROUP BY doc_id)
SELECT doc_id, (SELECT array_to_string(list_sort(list(DISTINCT "set")), ',') FROM x JOIN sx USING (g) WHERE x.doc_id = y.doc_id) AS sets, count(*) AS n_hits, any_value(n_windows) AS n_windows FROM x y JOIN n USING (doc_id) GROUP BY doc_id""")
def contam_sets(spark, d):
    out = contamination.attributed(table(spark, d, "documents"), ["doc_id"], _named_sets(spark, d))
    return out.withColumn("sets", F.array_join("sets", ","))


@query(f"""WITH {_MANY}, {_DOCS} SELECT doc_id, "set", item, count(*) AS n_alone, count(*) FILTER (WHERE "set" = first) AS n_owned FROM dg JOIN sx USING (g) JOIN so USING (g) GROUP BY doc_id, "set", item""")
def contam_set_items(spark, d):
    return contamination.attributed(table(spark, d, "documents"), ["doc_id"], _named_sets(spark, d), by_item=True)


@query(f"""WITH {_MANY}, {_DOCS}, x AS (SELECT doc_id, "set", item, count(*) AS alone, count(*) FILTER (WHERE "set" = first) AS owned FROM dg JOIN sx USING (g) JOIN so USING (g) GROUP BY doc_id, "set", item)
SELECT "set", count(DISTINCT doc_id) AS n_docs, count(DISTINCT item) AS n_items, sum(alone)::BIGINT AS n_alone, sum(owned)::BIGINT AS n_owned, (SELECT count(*) FROM dg WHERE g IN (SELECT g FROM so)) AS n_hits FROM x GROUP BY "set" """)
def contam_per_set(spark, d):
    """What each set owns if it were the only one, and among all: the latter add up to the windows hit."""
    each = contam_set_items(spark, d)
    out = each.groupBy("set").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("item").alias("n_items"), F.sum("n_alone").alias("n_alone"), F.sum("n_owned").alias("n_owned"))
    return out.withColumn("n_hits", F.sum("n_owned").over(Window.partitionBy()))  # a row a set


# Duplicates

_KEY = f"md5({_norm()})"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first_wins(spark, d):
    docs = table(spark, d, "documents").select("doc_id", dedup.prompt_key(F.col("text")).alias("prompt"))
    return dedup.first_wins(docs, F.col("prompt"), ["doc_id"]).select("doc_id")


_STATS = "sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, count(*) FILTER (WHERE n > 1) AS n_dup_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_dup_rows, (sum(n) - count(*))::BIGINT AS n_removable"


@query(f"SELECT lang, {_STATS} FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang, {_KEY}) GROUP BY lang")
def dup_stats(spark, d):
    return dedup.duplicate_stats(table(spark, d, "documents"), dedup.prompt_key(F.col("text")), ["lang"])


@query(f"SELECT {_STATS} FROM (SELECT count(*) AS n FROM documents GROUP BY md5(concat_ws(chr(31), {_norm()}, source, lang)))")
def triple_dup_stats(spark, d):
    return dedup.duplicate_stats(table(spark, d, "documents"), dedup.triple_key(F.col("text"), F.col("source"), F.col("lang")))


@query(f"SELECT corpora, count(*) AS n_keys FROM (SELECT array_to_string(list_sort(list(DISTINCT source)), ' | ') AS corpora FROM documents GROUP BY {_KEY} HAVING count(DISTINCT source) > 1) GROUP BY corpora")
def cross_source_overlap(spark, d):
    return dedup.cross_overlap(table(spark, d, "documents"), dedup.prompt_key(F.col("text")), "source")


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM n)
SELECT source, count(*) AS n_groups, quantile_cont(n, 0.5) AS p50, max(n) AS largest, max(n) / sum(n) AS largest_share, sum(n) FILTER (WHERE rank <= 10) / sum(n) AS top10_share FROM r GROUP BY source""")
def group_concentration(spark, d):
    return profile.concentration(table(spark, d, "documents"), "source", "lang")


@query(f"SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM documents GROUP BY {_KEY}) GROUP BY size")
def size_histogram(spark, d):
    return profile.size_histogram(table(spark, d, "documents"), dedup.prompt_key(F.col("text")))


# Splits

_GROUPED = f"g AS (SELECT doc_id, lang, text, md5(source || '/' || (doc_id % 40)) AS grp, md5({_norm()}) AS prompt FROM documents)"
_ASSIGN = f"""{_GROUPED}, c AS (SELECT lang, grp, count(*) AS n_rows FROM g GROUP BY lang, grp), t AS (SELECT *, sum(n_rows) OVER (PARTITION BY lang) AS total FROM c),
 l AS (SELECT *, n_rows > 0.02 * total AS large, md5(concat_ws(chr(31), lang, grp, '0')) AS h FROM t), f AS (SELECT *, sum(CASE WHEN large THEN 0 ELSE n_rows END) OVER (PARTITION BY lang) AS free,
 coalesce(sum(n_rows) OVER (PARTITION BY lang, large ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
 p AS (SELECT *, NOT large AND before < least(0.05 * total, 0.4 * free) AS is_test FROM f), q AS (SELECT *, sum(CASE WHEN is_test THEN n_rows ELSE 0 END) OVER (PARTITION BY lang) AS taken FROM p),
 a AS (SELECT lang, grp, n_rows, CASE WHEN is_test THEN 'test' WHEN NOT large AND before - taken < least(0.05 * total, 0.4 * free) THEN 'val' ELSE 'train' END AS split FROM q)"""
_MANIFEST = f"""{_ASSIGN}, m AS (SELECT g.doc_id, g.lang, g.prompt, a.split AS s0 FROM g JOIN a USING (lang, grp)),
 e AS (SELECT prompt, bool_or(s0 = 'train') AS tr, bool_or(s0 = 'val') AS va FROM m GROUP BY prompt),
 s AS (SELECT m.doc_id, m.lang, m.prompt, m.s0, CASE WHEN s0 <> 'train' AND tr THEN 'drop' WHEN s0 = 'test' AND va THEN 'val' ELSE s0 END AS s FROM m JOIN e USING (prompt))"""


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    norm = T.normalize(F.col("text"))
    group = F.md5(F.concat("source", F.lit("/"), F.col("doc_id") % 40))
    return table(spark, d, "documents").select("doc_id", "lang", group.alias("grp"), F.md5(norm).alias("prompt"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return split.manifest(_grouped(spark, d), "lang", "grp", F.col("prompt"))


@query(f"WITH {_ASSIGN} SELECT lang, grp, n_rows, split FROM a")
def split_assign(spark, d):
    return split.assign(_grouped(spark, d), "lang", "grp")


@query(f"WITH {_MANIFEST} SELECT lang, s0, s, count(*) AS n_rows FROM s GROUP BY lang, s0, s")
def split_summary(spark, d):
    return _manifest(spark, d).groupBy("lang", "s0", "s").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_MANIFEST} SELECT splits, count(*) AS n_prompts, sum(n)::BIGINT AS n_rows FROM (SELECT array_to_string(list_sort(list(DISTINCT s0)), '|') AS splits, count(*) AS n FROM s GROUP BY prompt HAVING count(DISTINCT s0) > 1) GROUP BY splits")
def straddle_audit(spark, d):
    return split.straddles(_manifest(spark, d), F.col("prompt"))


@query(f"WITH {_MANIFEST} SELECT count(*) FILTER (WHERE n > 1) AS n_impure, count(*) AS n_prompts FROM (SELECT count(DISTINCT s) AS n FROM s WHERE s <> 'drop' GROUP BY prompt)")
def purity_recheck(spark, d):
    return split.impure(_manifest(spark, d), F.col("prompt"))


@query(f"WITH {_MANIFEST}, fs AS (SELECT prompt, arg_min(s0, doc_id) AS first FROM s GROUP BY prompt) SELECT s0, count(*) AS n_rows FROM s JOIN fs USING (prompt) WHERE s0 = first GROUP BY s0")
def purity_first_split(spark, d):
    return dedup.first_split(_manifest(spark, d), F.col("prompt"), "s0", ["doc_id"]).groupBy("s0").agg(F.count(F.lit(1)).alias("n_rows"))


# Profiles

@query("""SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field, count(*) AS n_rows, unnest([count(*) - count(doc_id), count(*) - count(text), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars)]) AS n_null,
 unnest([0, count(*) FILTER (WHERE trim(text) = ''), count(*) FILTER (WHERE trim(lang) = ''), count(*) FILTER (WHERE trim(source) = ''), 0]) AS n_blank FROM documents""")
def profile_nulls(spark, d):
    return profile.nulls(table(spark, d, "documents"))


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 2) AS mean, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS largest FROM documents GROUP BY lang")
def profile_chars(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(*profile.percentiles(F.col("n_chars")))


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n_chars) FILTER (WHERE i = n // 2) AS median, max(n_chars) FILTER (WHERE i = floor(0.9 * (n - 1))) AS p90, max(n_chars) FILTER (WHERE i = n // 4) AS q1, max(n_chars) FILTER (WHERE i = 3 * n // 4) AS q3 FROM r GROUP BY lang""")
def index_percentiles(spark, d):
    return profile.index_percentiles(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"])


@query("SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type ORDER BY n_rows DESC, event_type LIMIT 3")
def top_event_types(spark, d):
    return profile.top_values(table(spark, d, "events"), "event_type", 3)


@query("""SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE quality IS NULL) AS n_unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def flag_sums_by_source(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return profile.flag_sums(rows, ["source"], {"n_good": F.col("quality") == 1, "n_toxic": F.col("toxic") == 1, "n_unlabelled": F.col("quality").isNull()})


@query("SELECT lang, avg(CASE WHEN doc_id % 10 = 0 THEN n_chars END) * count(*) AS tokens, count(*) AS n_rows FROM documents GROUP BY lang")
def estimated_chars(spark, d):
    return profile.estimated_tokens(table(spark, d, "documents"), ["lang"], F.col("n_chars"), F.col("doc_id") % 10 == 0)


# Flags

_BITS = f"""fl AS (SELECT doc_id, lang, (CASE WHEN length({_norm()}) = 0 THEN 16 ELSE 0 END) | (CASE WHEN quality = 0 THEN 4 ELSE 0 END) | (CASE WHEN toxic = 1 THEN 8 ELSE 0 END) | (CASE WHEN n_chars > 20000 THEN 2 ELSE 0 END) AS f
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    f = flags.bits(parse_fail=T.normalize(F.col("text")) == "", over_refusal=F.col("quality") == 0, contradiction=F.col("toxic") == 1, tool_mismatch=F.col("n_chars") > 20000)
    return rows.select("doc_id", "lang", f.alias("f"))


@query(f"WITH {_BITS} SELECT f, count(*) AS n_rows FROM fl GROUP BY f")
def flag_bits(spark, d):
    return _flagged(spark, d).groupBy("f").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_BITS} SELECT CASE WHEN f & 16 = 16 THEN 'empty' WHEN f & 12 = 12 THEN 'bad_toxic' WHEN f & 4 = 4 THEN 'bad' END AS rule, count(*) AS n_rows FROM fl GROUP BY rule")
def drop_rules(spark, d):
    rule = flags.dropped_by(F.col("f"), [("empty", 16), ("bad_toxic", 12), ("bad", 4)])
    return _flagged(spark, d).groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT doc_id, kind FROM (SELECT doc_id, source AS kind, min(source) OVER w AS a, max(source) OVER w AS b FROM documents WINDOW w AS (PARTITION BY md5({_norm()}))) WHERE a <> b")
def label_contradictions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("kind"), dedup.prompt_key(F.col("text")).alias("prompt"))
    return dedup.contradictions(rows, F.col("prompt"), "kind").select("doc_id", "kind")


# Samples

_RANK = "md5(concat_ws(chr(31), doc_id::VARCHAR, '0'))"


@query(f"SELECT doc_id FROM documents ORDER BY {_RANK} LIMIT 50")
def sample_hash_rank(spark, d):
    return sample.bottom_k(table(spark, d, "documents"), sample.rank_key(F.col("doc_id")), 50).select("doc_id")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}) AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 7 WHEN 'de' THEN 5 ELSE 0 END")
def sample_stratified(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sample.bottom_k_by(docs, "lang", sample.rank_key(F.col("doc_id")), {"en": 20, "fr": 7, "de": 5})


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i % greatest(n // 12, 1) = 0 AND i // greatest(n // 12, 1) < 12")
def sample_strided(spark, d):
    return sample.strided(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 12, ["lang"])


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) ORDER BY k, lang LIMIT 30")
def sample_round_robin(spark, d):
    return sample.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 30)


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, {_RANK} AS r, row_number() OVER (PARTITION BY source ORDER BY {_RANK}) AS k FROM documents) WHERE k <= 5 ORDER BY r LIMIT 40")
def sample_capped(spark, d):
    return sample.capped_by(table(spark, d, "documents").select("doc_id", "source"), "source", sample.rank_key(F.col("doc_id")), 5, 40)


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, CASE lang WHEN 'en' THEN 700 WHEN 'es' THEN 300 ELSE 0 END AS q FROM documents)
SELECT doc_id, lang, i + k * n AS pos FROM (SELECT *, unnest(range(ceil((q - i) / n)::BIGINT)) AS k FROM r WHERE q > i)""")
def sample_cyclic_quota(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    out = sample.cyclic(docs, "lang", sample.rank_key(F.col("doc_id")), {"en": 700, "es": 300})
    return out.select("doc_id", "lang", F.col("pos").cast("long").alias("pos"))


@query("""SELECT lang, round_even(1e6 * CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.3 ELSE 0.1 END / avg(n_chars), 0)::BIGINT AS n_rows FROM documents GROUP BY lang""")
def mix_calibrate(spark, d):
    share = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "fr", 0.3).otherwise(0.1)
    means = table(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean"))
    return means.select("lang", F.rint(1e6 * share / F.col("mean")).cast("long").alias("n_rows"))


# Token budgets: languages as roles of a mix, two sources as a block that is dosed and one that is replayed, seven arms

_ARM_ROWS = [("plain", 2e6, 0.5), ("no block", 2e6, 0.5), ("replay", 2e6, 0.5), ("no rows", 2e6, 0.5), ("tiny", 2e3, 0.5), ("open", None, 0.5), ("low floor", 2e6, 0.05)]
_RULES = {"de": ("passes", 1.0), "es": ("passes", 3.0), "en": ("fill", 0.0), "fr": ("fill", 0.0), "src3": ("dose", 2.0), "src7": ("part", 0.0), "none": ("part", 0.0)}
_CHANGED = {("no block", "src3"): 0.0, ("replay", "src7"): 0.05, ("no rows", "none"): 0.05, ("tiny", "src7"): 0.5}
_RULE_ROWS = [(arm, role, kind, _CHANGED.get((arm, role), amount)) for arm, *_ in _ARM_ROWS for role, (kind, amount) in _RULES.items()]
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)
_HAVE = "CASE WHEN source IN ('src3', 'src7') THEN source ELSE lang END"


@query(f"""WITH a(arm, budget, floor) AS (VALUES {_VALUES(_ARM_ROWS)}), r(arm, role, kind, amount) AS (VALUES {_VALUES(_RULE_ROWS)}), h AS (SELECT {_HAVE} AS role, sum(n_chars)::DOUBLE AS have FROM documents GROUP BY 1),
 x AS (SELECT r.*, budget, floor, coalesce(have, 0) AS have FROM r JOIN a USING (arm) LEFT JOIN h USING (role)),
 p AS (SELECT arm, any_value(budget) AS budget, any_value(floor) AS floor, sum(have * amount) FILTER (WHERE kind = 'passes') AS priority, sum(have) FILTER (WHERE kind = 'fill') AS there, sum(have * amount) FILTER (WHERE kind = 'dose') AS block,
   sum(least(coalesce(budget, 0) * amount, have)) FILTER (WHERE kind = 'part') AS replay, bool_or(kind = 'part' AND amount > 0 AND have = 0) AS missing FROM x GROUP BY arm),
 q AS (SELECT *, priority / floor - priority AS want, least(priority / floor - priority, there) AS filler, block + replay AS doses FROM p),
 t AS (SELECT x.arm, x.role, x.kind, x.have, q.want > q.there AS used, q.missing, coalesce(q.budget <= doses, false) AS over,
   CASE kind WHEN 'passes' THEN x.have * amount WHEN 'fill' THEN filler * x.have / there ELSE 0 END * CASE WHEN q.budget IS NULL THEN 1 WHEN q.budget <= doses THEN 0 ELSE (q.budget - doses) / (priority + filler) END
   + CASE kind WHEN 'dose' THEN x.have * amount WHEN 'part' THEN least(coalesce(q.budget, 0) * amount, x.have) ELSE 0 END * CASE WHEN q.budget <= doses THEN q.budget / greatest(1, doses) ELSE 1 END AS tokens FROM x JOIN q USING (arm)),
 s AS (SELECT arm, sum(tokens) AS every, sum(tokens) FILTER (WHERE kind IN ('passes', 'dose')) AS first FROM t GROUP BY arm)
SELECT arm, role, round(tokens)::BIGINT AS tokens, round(tokens / every, 4) AS share, CASE WHEN have > 0 THEN round(tokens / have, 4) ELSE 0 END AS repeats, round(first / every, 4) AS priority,
 concat_ws(', ', CASE WHEN missing THEN 'a part has no rows' END, CASE WHEN over THEN 'doses exceed the budget' END, CASE WHEN used THEN 'filler is used up' END) AS notes FROM t JOIN s USING (arm)""")
def mix_budget(spark, d):
    role = F.when(F.col("source").isin("src3", "src7"), F.col("source")).otherwise(F.col("lang"))
    avail = table(spark, d, "documents").groupBy(role.alias("role")).agg(F.sum("n_chars").alias("tokens"))
    arms = spark.createDataFrame(_ARM_ROWS, "arm string, budget double, floor double")
    out = sample.allocate(avail, arms, spark.createDataFrame(_RULE_ROWS, "arm string, role string, kind string, amount double"))
    return out.withColumn("tokens", F.round("tokens").cast("long")).withColumn("notes", F.array_join("notes", ", "))


# Comparison: two arms per labelled document (good, and not toxic), grouped by language

_ARMS = "arms AS (SELECT doc_id, lang, source, n_chars, quality AS ref, 1 - toxic AS cand, least(n_chars / 20000.0, 1.0) AS score FROM documents JOIN labels USING (doc_id))"
_PAIRED = "count(*) FILTER (WHERE cand < ref) AS n_minus, count(*) FILTER (WHERE cand = ref) AS n_zero, count(*) FILTER (WHERE cand > ref) AS n_plus, count(*) AS n"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", "n_chars", F.col("quality").alias("ref"), (1 - F.col("toxic")).alias("cand"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))


@query(f"WITH {_ARMS} SELECT lang, {_PAIRED} FROM arms GROUP BY lang")
def paired_counts(spark, d):
    return _arms(spark, d).groupBy("lang").agg(*compare.paired(F.col("ref"), F.col("cand")))


_MCNEMAR = """CASE WHEN n_minus + n_plus = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(n_minus + n_plus + 1) - lgamma(i + 1) - lgamma(n_minus + n_plus - i + 1) - (n_minus + n_plus) * ln(2)) FOR i IN range(least(n_minus, n_plus) + 1)])) END"""


@query(f"WITH {_ARMS}, p AS (SELECT source, {_PAIRED} FROM arms GROUP BY source) SELECT source, n_minus, n_plus, round({_MCNEMAR}, 9) AS p FROM p")
def mcnemar(spark, d):
    cells = _arms(spark, d).groupBy("source").agg(*compare.paired(F.col("ref"), F.col("cand")))
    return cells.select("source", "n_minus", "n_plus", F.round(compare.exact_two_sided(F.col("n_minus"), F.col("n_plus")), 9).alias("p"))


@query(f"""WITH {_ARMS}, p AS (SELECT source, {_PAIRED} FROM arms GROUP BY source), m AS (SELECT source, round({_MCNEMAR}, 9) AS p FROM p),
s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1) * p) AS s FROM m) SELECT source, p, round(max(s) OVER (ORDER BY p, source ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""")
def holm(spark, d):
    out = compare.holm(mcnemar(spark, d).select("source", "p"), "p", [], "source")
    return out.withColumn("p_holm", F.round("p_holm", 8))


@query(f"""WITH {_ARMS}, p AS (SELECT lang, source, {_PAIRED} FROM arms GROUP BY lang, source), m AS (SELECT lang, source, round({_MCNEMAR}, 9) AS p FROM p),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, source) + 1) * p) AS s FROM m)
SELECT lang, source, p, round(max(s) OVER (PARTITION BY lang ORDER BY p, source ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""")
def holm_subgroups(spark, d):
    cells = _arms(spark, d).groupBy("lang", "source").agg(*compare.paired(F.col("ref"), F.col("cand")))
    p = cells.select("lang", "source", F.round(compare.exact_two_sided(F.col("n_minus"), F.col("n_plus")), 9).alias("p"))
    return compare.holm(p, "p", ["lang"], "source").withColumn("p_holm", F.round("p_holm", 8))


@query(f"""WITH {_ARMS}, c AS (SELECT lang, avg(cand - ref) AS d, sum(cand - ref) AS s, count(*) AS n FROM arms GROUP BY lang)
SELECT round(avg(d), 10) AS macro_delta, round(sum(s) / sum(n), 10) AS item_delta, count(*) AS n_categories, 0::BIGINT AS n_without FROM c""")
def macro_delta(spark, d):
    out = compare.macro_delta(_arms(spark, d), "lang", "ref", "cand")
    return out.select(F.round("macro_delta", 10).alias("macro_delta"), F.round("item_delta", 10).alias("item_delta"), "n_categories", "n_without")


@query(f"""WITH {_ARMS}, n AS (SELECT lang, count(*) AS n FROM arms GROUP BY lang)
SELECT doc_id, lang, cand - ref AS change, round((cand - ref) / ((SELECT count(*) FROM n) * n.n), 12) AS implied FROM arms JOIN n USING (lang) WHERE cand <> ref""")
def flip_set(spark, d):
    return compare.flips(_arms(spark, d), "doc_id", "lang", "ref", "cand").withColumn("implied", F.round("implied", 12))


@query(f"""WITH {_ARMS}, r AS (SELECT lang, ref, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM arms)
SELECT lang, round(CASE WHEN sum(ref) * sum(1 - ref) > 0 THEN (sum(r) FILTER (WHERE ref = 1) - sum(ref) * (sum(ref) + 1) / 2.0) / (sum(ref) * sum(1 - ref)) END, 10) AS auroc, count(*) AS n FROM r GROUP BY lang""")
def auroc(spark, d):
    return compare.auroc(_arms(spark, d), "score", F.col("ref") == 1, ["lang"]).withColumn("auroc", F.round("auroc", 10))


@query(f"""WITH {_ARMS}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS conf, avg(ref) AS acc FROM arms GROUP BY bin)
SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM b""")
def ece(spark, d):
    return compare.ece(_arms(spark, d), "score", F.col("ref") == 1).withColumn("ece", F.round("ece", 9))


@query(f"""WITH {_ARMS}, c AS (SELECT score, sum(ref) AS pos, count(*) AS n FROM arms GROUP BY score),
k AS (SELECT score, sum(n - pos) OVER w / sum(n - pos) OVER () AS fa, sum(pos) OVER w / sum(pos) OVER () AS hits FROM c WINDOW w AS (ORDER BY score DESC))
SELECT b AS budget, min(score) AS threshold, arg_min(fa, score) AS false_alarms, arg_min(k.hits, score) AS hits FROM k, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS b) WHERE fa <= b GROUP BY b""")
def operating_points(spark, d):
    return compare.operating_points(_arms(spark, d), "score", F.col("ref") == 1, [0.05, 0.1, 0.5])


@query(f"WITH {_ARMS}, c AS (SELECT source, lang, avg(ref) AS acc, count(*) AS n, sum(ref) AS k FROM arms GROUP BY source, lang) SELECT source, round(avg(acc), 10) AS macro, round(sum(k) / sum(n), 10) AS micro, count(*) AS n_categories, sum(n)::BIGINT AS n_items FROM c GROUP BY source")
def macro_micro(spark, d):
    out = profile.macro_micro(_arms(spark, d), "lang", F.col("ref"), ["source"])
    return out.withColumn("macro", F.round("macro", 10)).withColumn("micro", F.round("micro", 10))


@query(f"WITH {_ARMS} SELECT lang AS arm, round(avg(ref), 10) AS rate, count(*) AS n FROM arms GROUP BY lang UNION ALL SELECT 'romance', round(avg(ref), 10), count(*) FROM arms WHERE lang IN ('fr', 'es') UNION ALL SELECT 'none', NULL, 0")
def pooled_rates(spark, d):
    out = profile.pooled_rates(_arms(spark, d), "lang", F.col("ref"), {"romance": F.col("lang").isin("fr", "es"), "none": F.lit(False)})
    return out.withColumn("rate", F.round("rate", 10))


@query(f"""WITH {_ARMS}, r AS (SELECT source, lang, avg(ref) AS rate FROM arms GROUP BY source, lang), k AS (SELECT r.source, r.lang, CASE WHEN f.rate > 0 THEN r.rate / f.rate END AS kept FROM r JOIN r f ON f.lang = r.lang AND f.source = 'src0' WHERE r.source <> 'src0')
SELECT source, round(min(kept), 10) AS least, round(avg(kept), 10) AS mean, array_to_string(list_sort(coalesce(list(lang) FILTER (WHERE kept < 0.9), [])), ',') AS failing FROM k GROUP BY source""")
def retention(spark, d):
    rates = _arms(spark, d).groupBy("source", "lang").agg(F.avg("ref").alias("rate"))
    out = compare.retention(rates, "lang", "source", "rate", "src0", 0.9)
    return out.select("source", F.round("least", 10).alias("least"), F.round("mean", 10).alias("mean"), F.array_join("failing", ",").alias("failing"))


@query("SELECT user_id, event_id, CASE WHEN k = 1 THEN user_id::VARCHAR ELSE user_id::VARCHAR || '#' || k END AS key FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def occurrence_keys(spark, d):
    return compare.occurrence(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT doc_id, 'a' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def unmatched_ids(spark, d):
    return compare.unmatched(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
