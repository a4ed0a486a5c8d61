"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Every document of a source is wanted target / size times. The whole part of that rate is copied outright; the fractional
part is a probability, and pivotal rounding makes it 0 or 1 for each document while the probabilities of a source keep
their sum: two documents pair up, one of them hands its mass to the other at random until one is integral, and the other
goes on to the next pair. Documents of about one size meet first, so the words taken hardly move either.

The pairs form a reduction tree: a block of at most a few times ARITY documents folds to one residual, blocks of
residuals fold again, and the last residual of a source is rounded by its own probability. No block grows with its
source, however large its share; a level shrinks the table about ARITY-fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, Scratch, fresh

#: Documents in a block of the tree, about.
ARITY = 64
#: Repeated rows of one key that a task numbers at a time.
RUN = 4096
#: A source takes at most so many times its size.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
_MEMBER = "struct<size:bigint,doc_id:bigint,h:bigint,each:bigint,p:double>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> and target: the total size shared by weight, no target above MOST times its source.

    The excess of full sources is shared by weight among the others until none is above. In closed form: in order of
    MOST * size / weight a prefix of the sources is full, and the others share what is left. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    out = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (k + 1).cast("int")))
        .withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open"))
        .withColumn("full", F.col("room") <= F.col("level"))
        .withColumn("share", F.max(F.when(~F.col("full"), F.col("level"))).over(everything) * F.col("weight"))
    )
    return out.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share")).alias("target"))


def _uniform(a: Column, b: Column, level: int, seed: int) -> Column:
    h = F.xxhash64(a, b, F.lit(level), F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def _fold(members: Column, level: int, seed: int) -> Column:
    """array of members -> struct(carry, done): pivotal rounding along the array."""

    def member(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["h"].alias("h"), x["each"].alias("each"), p.alias("p")).cast(_MEMBER)

    def step(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        total = c["p"] + x["p"]
        u = _uniform(c["h"], x["h"], level, seed)
        small = total < 1.0
        # Below 1 one of the two gets all the mass, the other 0; from 1 on one gets 1, the other the rest.
        chance = F.when(small, F.when(total > 0, c["p"] / total).otherwise(1.0)).otherwise(
            F.when(total < 2.0, (1.0 - x["p"]) / (2.0 - total)).otherwise(1.0)
        )
        carry_first = u < chance  # small: the carry keeps the mass; else: the carry becomes 1
        settled = F.when(small == carry_first, x).otherwise(c)
        stays = F.when(small == carry_first, c).otherwise(x)
        done = F.concat(acc["done"], F.array(member(settled, F.when(small, 0.0).otherwise(1.0))))
        return F.struct(
            member(stays, F.when(small, total).otherwise(total - 1.0)).alias("carry"), done.alias("done")
        )

    start = F.struct(F.element_at(members, 1).cast(_MEMBER).alias("carry"), F.array().cast(f"array<{_MEMBER}>").alias("done"))
    return F.aggregate(F.slice(members, F.lit(2), F.size(members)), start, step)


def _level(rows: DataFrame, by: list[str], level: int, seed: int) -> DataFrame:
    """Rows with a probability (source, size, doc_id, h, each, p) dealt into blocks; a fold of each block."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ARITY).alias("blocks"))
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in by), "blocks")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    dealt = rows.join(counts, on).withColumn("block", F.pmod(F.xxhash64("h", F.lit(1000 + level)), F.col("blocks")))
    member = F.struct("size", "doc_id", "h", "each", "p").cast(_MEMBER)
    folds = dealt.groupBy(*by, "block").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return folds.select("source", _fold(F.col("members"), level, seed).alias("fold"))


def picked(spark: SparkSession, units: DataFrame, seed: int = 7) -> DataFrame:
    """units (source, doc_id, h, each, size, rate; doc_id and h tell the units apart) -> doc_id, h, each, up.

    up marks the units that the rounding picks for one copy more than floor(rate); per source their number is the sum
    of the fractions, up to the last residual.
    """
    scratch = Scratch(spark, "mix")
    fraction = F.col("rate") - F.floor("rate")
    rows = units.withColumn("p", fraction).withColumn("class", F.floor(F.log(F.col("size") + 1.0) * 16).cast("int"))
    decided, level, by = [], 0, ["source", "class"]
    while True:
        folds = scratch.write(_level(rows, by, level, seed), f"level{level}")
        decided.append(folds.select(F.explode("fold.done").alias("x")).select("x.doc_id", "x.h", "x.each", (F.col("x.p") > 0.5).alias("up")))
        rows = folds.select("source", "fold.carry.*")
        left, sources = rows.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce("source", F.lit("")), F.col("source").isNull())).first()
        if left == sources:
            break
        level, by = level + 1, ["source"]
    last = rows.select("doc_id", "h", "each", (_uniform(F.col("h"), F.col("h"), level + 1, seed) < F.col("p")).alias("up"))
    up = last
    for more in decided:
        up = up.unionByName(more)
    return up


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document, 0 to MOST).

    Reruns agree: every random choice is a hash of the documents and the seed.

    Defined cases: a null text has size 0; a text of any length is one document; a null source is a source of its own,
    ordered last; an empty table gives an empty result; rows that repeat doc_id, source and text are documents of their
    own, and the rounding picks so many of them; a null doc_id is a document like any other. Columns of docs under the
    four new names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    names = {}
    for base in ("key", "of", "id", "h", "rows", "up", "row"):
        names[base] = fresh(docs, f"mix_{base}", names.values())
    key, of, same_id, h, rows, up, row = names.values()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    scratch = Scratch(spark, "mixed")
    units = keyed.groupBy("source", "doc_id", F.col(key).alias("h")).agg(
        F.max(n_words(F.col("text"))).alias("each"), F.count(F.lit(1)).alias("rows")
    )
    units = scratch.write(units, "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("each") * F.col("rows")).cast("long").alias("source_size"))
    targets = scratch.write(source_targets(sizes, weights), "targets").withColumnRenamed("source", of)
    same = F.col("source").eqNullSafe(F.col(of))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    again = units.filter("rows > 1").select("source", "doc_id", "h", "each", "rows")
    n_again = again.count()
    own = units.filter("rows = 1").withColumn("unit", F.col("h"))
    if n_again:  # a unit for each repeated row, dealt out in runs, so that no task makes all rows of a key
        runs = again.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN)))).repartition("h", "run")
        last = F.least(F.col("rows"), (F.col("run") + 1) * RUN)
        each = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN + 1, last))).withColumn("unit", F.xxhash64("h", "k"))
        repeats = scratch.write(each.select("source", "doc_id", "h", "each", "rows", "unit"), "repeats")
        own = own.unionByName(repeats)
    rated = own.join(targets, same).select("source", "doc_id", F.col("unit").alias("h"), "each", F.col("each").alias("size"), rate.alias("rate"))
    ups = picked(spark, rated, seed).select("doc_id", "h", "each", F.col("up").cast("long").alias("up"), F.lit(1).alias("rows"))
    if n_again:
        known = repeats.select(F.col("doc_id").alias("of_id"), "unit", F.col("h").alias("first"))
        ups = ups.join(known, (F.col("h") == F.col("unit")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
        ups = ups.groupBy("doc_id", F.coalesce("first", "h").alias("h"), "each").agg(F.sum("up").alias("up"), F.sum("rows").alias("rows"))
    ups = ups.select(F.col("doc_id").alias(same_id), F.col("h").alias(h), F.col("each").alias("size"), F.col("up").alias(up), F.col("rows").alias(rows))
    met = (F.col(key) == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(same_id))

    def told(part: DataFrame, more: Column) -> DataFrame:
        n = F.floor(rate) + more
        return part.join(targets, same).select(*docs.columns, "size", "source_size", "target", F.least(n, F.lit(MOST)).cast("long").alias("copies"))

    # The decisions are as many as the documents, so at any size the documents meet them by one shuffle.
    joined = keyed.join(ups.hint("merge"), met)
    if not n_again:
        return told(joined, F.col(up))
    # Repeated rows are written once with numbers, and the first of them get the picks; numbers count on from one input
    # partition to the next, so that no key meets in one task.
    hot = again.select(F.col("h").alias(h), F.col("doc_id").alias(same_id))
    numbered = scratch.write(keyed.join(hot, met, "left_semi").withColumn(row, F.monotonically_increasing_id()), "again")
    part = F.shiftright(F.col(row), 33).alias("part")
    parts = numbered.groupBy(key, "doc_id", part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key, "doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(key).alias(h), F.col("doc_id").alias(same_id), F.col("part").alias(rows), F.coalesce(before, F.lit(0)).alias(up))
    inside = F.row_number().over(Window.partitionBy(key, "doc_id", F.shiftright(F.col(row), 33)).orderBy(row))
    numbered = numbered.withColumn(of, inside).join(parts, met & (F.shiftright(F.col(row), 33) == F.col(rows)))
    numbered = numbered.withColumn(row, F.col(of) + F.col(up)).drop(of, same_id, h, rows, up).join(ups, met)
    return told(joined.filter(F.col(rows) == 1), F.col(up)).unionByName(told(numbered, (F.col(row) <= F.col(up)).cast("long")))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it was taken."""
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(spark, docs)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
