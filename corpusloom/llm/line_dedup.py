"""Line dedup by a log-template tree, with DataFrame operations only.

A line's words, those with a digit masked as variable fields, lead it down a tree of fixed depth: the number of words,
then the first LEAD words. In a leaf that many documents reach, every position keeps its commonest word if at least half
of the leaf's lines have it there, and is a variable field otherwise; where enough positions keep a word the leaf has a
template, and the lines that agree with it are its own. A masked line that itself recurs is a template without further
fields. Lines of templates that occur in at least `documents` different documents are dropped.

With `verbatim`, a line that recurs word for word stays where it occurs first, in the document with the smallest id, and
goes from the others; the longer it is, the fewer documents it takes: floor_of(10 words) is `documents`, and 50 words and more
need two. A line with variable fields does so as it stands as well, from 11 words on; one of fewer than LEAD words, which
has no place in the tree, in `documents` documents. With `several`, a leaf has as many templates as recur in it, whatever
their share: at each of the floors documents, 2 documents, 4 documents ... a masked line keeps the words that so many lines of
the leaf have at their position, and lines that keep the same words are a template. The registered query does both, and
OP3_SQL states it.

Lines are counted after a distinct per document and leaf, so a line that a third of all documents share spreads over all
tasks; what is gathered per leaf is one word a position, and per document the positions of its own lines.

Texts are split and masked once, into the place, leaf and hash of each line; every decision joins these. The words are taken
afterwards from the texts, at the places of lines in leaves that many documents reach, and from no others. So whole texts
meet places by document twice, for these words and for the result, and no line's text is joined by its leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, fresh

#: Documents that a template must occur in.
DOCUMENTS = 10
#: Words of a line that lead down the tree; shorter lines are left alone.
LEAD = 3
#: Least percentage of a template's positions that keep a word, and of those words that a line must agree with.
FIXED, AGREE = 60, 80
_BLANK = r"[\x20\x09-\x0D]+"
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def floor_of(n: Column, documents: int) -> Column:
    """Documents in which a line of n words has to recur word for word: fewer, two at least, the longer it is."""
    return F.greatest(F.lit(2), F.least(F.lit(documents), F.ceil(F.lit(10 * documents) / n))).cast("int")


def line_dedup(spark: SparkSession, docs: DataFrame, documents: int = DOCUMENTS, verbatim: bool = False, several: bool = False) -> DataFrame:
    """docs with the recurring lines taken out of text, and n_lines and n_dropped (long).

    Defined cases: a null text stays null and has no lines; of a text of any length all lines count; an empty table gives an empty result; lines of fewer than
    LEAD words are kept (with `verbatim`, blank ones); a line that repeats within one document counts once; rows that share doc_id and text are the
    same document; a null doc_id is an id like any other, and the last one; where rows share the smallest doc_id but not the
    text, a line stays in one of them; of words equally common at a position the larger by code
    point is kept. Columns n_lines and n_dropped of docs are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    scratch = Scratch(spark, "lines")
    split = F.split("text", "\n")
    # The hashes of a text are made before its lines are: beside them they would be made again for each.
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), split.alias("parts"))
    lines = texts.select("doc_id", "h", F.posexplode("parts").alias("at", "line"))
    line = F.col("line")
    lines = lines.withColumn("masked", _masked(line))
    lines = lines.withColumn("n", F.size(F.split("masked", " ")))
    if not verbatim:
        lines = lines.filter(F.col("n") >= LEAD)
    leaf, fields = F.xxhash64("n", F.substring_index("masked", " ", LEAD)), F.contains("masked", F.lit("<*>"))
    entry = lambda key, own, kind, need: F.struct(key.alias("leaf"), own.alias("whole"), kind.alias("kind"), need.alias("need"))
    often = F.count(F.lit(1)) >= documents
    if verbatim:  # kind 0: a masked line; 1: one without fields, which is as it stands; 2: a line as it stands, a leaf of its own
        as_is = F.xxhash64(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")), F.lit("as is"))
        floor = floor_of(F.col("n"), documents)
        usual = entry(leaf, F.xxhash64("masked"), F.when(fields, 0).otherwise(1), F.when(fields, documents).otherwise(floor))
        stands = entry(as_is, as_is, F.lit(2), floor)
        # Blank lines have no entries; a filter on them would be moved below the masking and mask every line once more.
        none = F.array().cast("array<struct<leaf:bigint,whole:bigint,kind:int,need:int>>")
        entries = F.when(F.col("masked") == "", none).when(F.col("n") < LEAD, F.array(stands)).when(fields & (floor < documents), F.array(usual, stands)).otherwise(F.array(usual))
    else:
        entries = F.array(entry(leaf, F.xxhash64("masked"), F.lit(0), F.lit(documents)))
    places = scratch.write(lines.select("doc_id", "h", "at", F.explode(entries).alias("e")).select("doc_id", "h", "at", "e.*"), "places")
    keys = scratch.write(places.drop("at").distinct(), "keys")
    leaves = keys.filter("kind < 2").select("doc_id", "h", "leaf").distinct().groupBy("leaf").agg(often.alias("often")).filter("often").select("leaf")
    leaves = scratch.write(leaves, "leaves")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h"))
    exact = keys.groupBy("leaf", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"), F.max("kind").alias("kind"), first.alias("first"))
    exact = scratch.write(exact.filter("n >= need").select("leaf", "whole", F.when(F.col("kind") > 0, F.col("first.h")).alias("stays")), "exact")
    wanted = leaves.select("leaf", F.lit(True).alias("often")).unionByName(exact.select("leaf", F.lit(False).alias("often"))).groupBy("leaf").agg(F.max("often").alias("often"))
    every = places.drop("need").join(scratch.write(wanted, "wanted"), "leaf").withColumn("often", F.col("often") & (F.col("kind") < 2))
    every = scratch.write(every.drop("kind"), "every")
    scratch.drop("places", "keys")
    near = scratch.write(_worded(docs, every.filter("often")), "near")

    size = near.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.max(F.size("words")).alias("n"))
    words = near.select("leaf", F.posexplode("words").alias("i", "word")).groupBy("leaf", "i", "word").count()
    top = words.groupBy("leaf", "i").agg(F.max(F.struct("count", "word")).alias("top"))
    fixed = top.join(size, "leaf").filter(2 * F.col("top.count") >= F.col("lines"))
    template = fixed.groupBy("leaf").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "top.word"))).alias("fixed"))
    template = template.filter(100 * F.size("fixed") >= FIXED * F.col("n")).select("leaf", "fixed")
    template = scratch.write(template, "templates")
    if several:
        exact = exact.unionByName(_grouped(scratch, near, words, documents))

    agree = F.size(F.filter("fixed", lambda x: F.col("words")[x["i"]] == x["word"]))
    fits = near.join(template, "leaf").filter(100 * agree >= AGREE * F.size("fixed")).select("doc_id", "h", "at", "leaf")
    fits = scratch.write(fits, "fits")
    recur = fits.select("doc_id", "h", "leaf").distinct().groupBy("leaf").agg(often.alias("often")).filter("often").select("leaf")
    recur = scratch.write(recur, "recur")
    gone = fits.join(recur, "leaf", "left_semi").select("doc_id", "h", "at", F.lit(False).alias("stays"))
    same = every.select("doc_id", "h", "at", "leaf", "whole").join(exact, ["leaf", "whole"])
    same = same.select("doc_id", "h", "at", F.coalesce(F.col("stays") == F.col("h"), F.lit(False)).alias("stays"))
    own, key = fresh(docs, "line_doc"), fresh(docs, "line_key")
    sets = [F.collect_set(F.when(F.col("stays") == which, F.col("at"))) for which in (False, True)]
    gone = gone.unionByName(same).groupBy(F.col("doc_id").alias(own), F.col("h").alias(key)).agg(F.array_except(*sets).alias("gone_at"))
    gone = scratch.write(gone.filter(F.size("gone_at") > 0), "gone").withColumnRenamed("gone_at", fresh(docs, "line_gone"))
    at = gone.columns[-1]
    scratch.drop("every", "near", "fits")

    joined = docs.join(gone, (F.xxhash64("doc_id", "text") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col(at), i))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _masked(line: Column) -> Column:
    """The words of a line with a blank between, those with a digit as fields."""
    # Most lines have neither a digit nor other blanks than single spaces, and need no rewriting.
    odd = F.rlike(line, F.lit(r"[0-9\x09-\x0D]|\x20\x20"))
    return F.trim(F.when(odd, F.regexp_replace(F.regexp_replace(line, _FIELD, "<*>"), _BLANK, " ")).otherwise(line))


def _worded(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The lines at these places, as often as docs has them, with their words."""
    # A set: rows that share doc_id and text have the same places, and each row meets all of them.
    marks = places.groupBy(F.col("doc_id").alias("id"), "h").agg(F.collect_set(F.struct("at", "leaf", "whole")).alias("marks"))
    own = (F.xxhash64("doc_id", "text") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))
    texts = docs.select("doc_id", "text").join(marks, own).select("doc_id", "h", F.split("text", "\n").alias("parts"), "marks")
    lines = texts.select("doc_id", "h", F.explode(F.transform("marks", lambda m: F.struct(m["at"].alias("at"), m["leaf"].alias("leaf"), m["whole"].alias("whole"), F.col("parts")[m["at"]].alias("line")))).alias("m"))
    return lines.select("doc_id", "h", "m.at", "m.leaf", "m.whole", F.split(_masked(F.col("m.line")), " ").alias("words"))


def _grouped(scratch: Scratch, near: DataFrame, words: DataFrame, documents: int) -> DataFrame:
    """leaf and whole of the masked lines that belong to a template of their leaf, of which there may be any number."""
    forms = near.groupBy("leaf", "whole").agg(F.any_value("words").alias("words"))
    tail = forms.select("leaf", "whole", F.size("words").alias("n"), F.posexplode("words").alias("i", "word")).filter(F.col("i") >= LEAD)
    held = tail.join(words.filter(F.col("count") >= documents), ["leaf", "i", "word"])
    held = held.groupBy("leaf", "whole", "n").agg(F.sort_array(F.collect_list(F.struct("i", "word", "count"))).alias("held"))
    most = F.floor(F.log2(F.array_max(F.transform("held", lambda x: x["count"])) / documents) + 1e-9).cast("int")
    kept = lambda k: F.filter("held", lambda x: x["count"] >= documents * F.pow(F.lit(2), k))
    groups = F.array_distinct(F.transform(F.sequence(F.lit(0), most), lambda k: F.transform(kept(k), lambda x: F.struct(x["i"], x["word"]))))
    groups = F.filter(groups, lambda g: 100 * (F.size(g) + LEAD) >= FIXED * F.col("n"))
    member = scratch.write(held.select("leaf", "whole", F.explode(F.transform(groups, lambda g: F.xxhash64(g))).alias("group")), "members")
    lines = near.select("doc_id", "h", "leaf", "whole").distinct().join(member, ["leaf", "whole"]).select("doc_id", "h", "leaf", "group").distinct()
    recur = lines.groupBy("leaf", "group").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= documents)
    out = member.join(recur, ["leaf", "group"], "left_semi").select("leaf", "whole", F.lit(None).cast("long").alias("stays"))
    return scratch.write(out.distinct(), "grouped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(spark, docs, verbatim=True, several=True)


OP3_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
     lines AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM split),
     masked AS (SELECT doc_id, pos, line, trim(regexp_replace(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS whole FROM lines),
     worded AS (SELECT doc_id, pos, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS own, whole, string_split(whole, ' ') AS words FROM masked WHERE whole <> ''),
     parsed AS (SELECT doc_id, pos, whole, words, len(words) AS n, words[1] AS a, words[2] AS b, words[3] AS c FROM worded WHERE len(words) >= 3),
     leaves AS (SELECT n, a, b, c FROM parsed GROUP BY n, a, b, c HAVING count(DISTINCT doc_id) >= 10),
     near AS (SELECT p.* FROM parsed p JOIN leaves USING (n, a, b, c)),
     size AS (SELECT n, a, b, c, count(*) AS lines FROM near GROUP BY n, a, b, c),
     words AS (SELECT n, a, b, c, i, word, count(*) AS k FROM (SELECT n, a, b, c, unnest(range(n)) AS i, unnest(words) AS word FROM near) GROUP BY ALL),
     top AS (SELECT *, row_number() OVER (PARTITION BY n, a, b, c, i ORDER BY k DESC, word DESC) AS r FROM words),
     fixed AS (SELECT t.n, t.a, t.b, t.c, t.i, t.word FROM top t JOIN size s USING (n, a, b, c) WHERE t.r = 1 AND 2 * t.k >= s.lines),
     template AS (SELECT n, a, b, c, count(*) AS m FROM fixed GROUP BY n, a, b, c HAVING 100 * count(*) >= 60 * n),
     agree AS (SELECT p.doc_id, p.pos, p.n, p.a, p.b, p.c, f.m, count(*) FILTER (WHERE p.words[g.i + 1] = g.word) AS k
               FROM near p JOIN template f USING (n, a, b, c) JOIN fixed g USING (n, a, b, c) GROUP BY ALL),
     fits AS (SELECT * FROM agree WHERE 100 * k >= 80 * m),
     recur AS (SELECT n, a, b, c FROM fits GROUP BY n, a, b, c HAVING count(DISTINCT doc_id) >= 10),
     exact AS (SELECT whole FROM parsed WHERE contains(whole, '<*>') GROUP BY whole HAVING count(DISTINCT doc_id) >= 10),
     plain AS (SELECT whole, min(doc_id) AS first FROM parsed WHERE NOT contains(whole, '<*>') GROUP BY whole, n HAVING count(DISTINCT doc_id) >= greatest(2, least(10, ceil(100.0 / n)))),
     held AS (SELECT t.*, w.k FROM (SELECT n, a, b, c, whole, unnest(range(n)) AS i, unnest(words) AS word FROM (SELECT DISTINCT n, a, b, c, whole, words FROM near)) t
              JOIN words w USING (n, a, b, c, i, word) WHERE t.i >= 3 AND w.k >= 10),
     floors AS (SELECT n, a, b, c, whole, unnest(range(floor(log2(max(k) / 10) + 1e-9)::INT + 1)) AS l FROM held GROUP BY n, a, b, c, whole),
     kept_words AS (SELECT n, a, b, c, whole, l, string_agg(i || ':' || word, ' ' ORDER BY i) AS g FROM held JOIN floors USING (n, a, b, c, whole)
                    WHERE k >= 10 * pow(2, l) GROUP BY n, a, b, c, whole, l HAVING 100 * (count(*) + 3) >= 60 * n),
     member AS (SELECT DISTINCT n, a, b, c, whole, g FROM kept_words),
     many AS (SELECT n, a, b, c, g FROM member JOIN parsed USING (n, a, b, c, whole) GROUP BY n, a, b, c, g HAVING count(DISTINCT doc_id) >= 10),
     several AS (SELECT DISTINCT whole FROM member JOIN many USING (n, a, b, c, g)),
     standing AS (SELECT doc_id, pos, own, len(words) AS n FROM worded WHERE len(words) < 3 OR len(words) > 10 AND contains(whole, '<*>')),
     as_is AS (SELECT own, min(doc_id) AS first FROM standing GROUP BY own, n HAVING count(DISTINCT doc_id) >= greatest(2, least(10, ceil(100.0 / n)))),
     stays AS (SELECT doc_id, pos FROM parsed JOIN plain USING (whole) WHERE doc_id = first UNION SELECT doc_id, pos FROM standing JOIN as_is USING (own) WHERE doc_id = first),
     found AS (SELECT doc_id, pos FROM fits JOIN recur USING (n, a, b, c) UNION SELECT doc_id, pos FROM parsed JOIN exact USING (whole) UNION SELECT doc_id, pos FROM parsed JOIN plain USING (whole)
               UNION SELECT doc_id, pos FROM parsed JOIN several USING (whole) UNION SELECT doc_id, pos FROM standing JOIN as_is USING (own)),
     gone AS (SELECT doc_id, pos FROM found EXCEPT SELECT doc_id, pos FROM stays),
     kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
              FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
