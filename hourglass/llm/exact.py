"""Exact duplicates by content sort, with DataFrame operations only.

Rows are ordered by (leading characters, hash, full normalised text, id). Splitters sampled from that order cut it into ranges,
each range is sorted externally, and every row is compared in full with its neighbour. A group of equal texts that crosses
range edges (a text with a third of all rows crosses many) is put together from the first and last group of each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourglass.llm.common import SPACE, buckets_wanted, set_aside, settle

LEAD = 48
SAMPLE_PER_RANGE = 10


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _order_key(text: Column, ident: Column) -> Column:
    """What ranges are cut by: bounded in size, equal for equal texts but for the id."""
    once = lambda t: F.struct(F.substring(t, 1, LEAD).alias("lead"), F.xxhash64(t).alias("hash"), F.coalesce(ident, F.lit(2**63 - 1)).cast("long").alias("id"))
    return F.get(F.transform(F.array(normalised(text)), once), 0)


def sampled_splitters(docs: DataFrame, text: str, ident: str, ranges: int, seed: int = 17) -> list:
    """Ascending order keys of a bounded row sample, one per range edge; fewer (or none) when rows are few."""
    rows = docs.count()
    if not rows:
        return []
    sample = docs.sample(fraction=min(1.0, SAMPLE_PER_RANGE * ranges / rows), seed=seed)
    keys = sorted(tuple(r) for r in sample.select(_order_key(F.col(text), F.col(ident)).alias("k")).select("k.*").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _range(key: Column, splitters: list) -> Column:
    """Number of splitters not above ``key``, by bisection; the key rides along, or each step would normalise the text again."""
    if not splitters:
        return F.lit(0)
    edges = F.array(*[F.struct(F.lit(a).alias("lead"), F.lit(h).cast("long").alias("hash"), F.lit(i).cast("long").alias("id")) for a, h, i in splitters])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"), key.alias("key"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s.lo + s.hi, 1)
        above = F.get(edges, mid) <= s.key
        done = s.lo >= s.hi
        return F.struct(F.when(~done & above, mid + 1).otherwise(s.lo).alias("lo"), F.when(done | above, s.hi).otherwise(mid).alias("hi"), s.key.alias("key"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length())), start, halve, lambda s: s.lo)


def sorted_groups(docs: DataFrame, text: str, ident: str, carried: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled rows with __range, __place, __group and __new; the groups within ranges; and those that meet groups of other ranges.

    The last frame has at most two rows for each range, with the group's overall size and smallest id and the range in which
    the row that stays lies (``home``).
    """
    spark = docs.sparkSession
    ranges = buckets_wanted(spark, 4)
    splitters = sampled_splitters(docs.select(text, ident), text, ident, ranges)
    dealt = docs.withColumn("__range", _range(_order_key(F.col(text), F.col(ident)), splitters))
    # one exchange; the normalised text is made again behind it, so that only the text itself travels
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__range").withColumn("__norm", normalised(F.col(text)))
    order = [F.substring("__norm", 1, LEAD), F.xxhash64("__norm"), F.col("__norm"), F.col(ident).asc_nulls_last()]
    sequence = Window.partitionBy("__range").orderBy(*order)
    before = F.lag("__norm").over(sequence)
    marked = dealt.withColumn("__new", before.isNull() | (before != F.col("__norm")))
    running = sequence.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("__group", F.sum(F.col("__new").cast("long")).over(running)).withColumn("text_sha256", F.sha2("__norm", 256))
    rows = settle(numbered.select(*[F.col(f"`{c}`") for c in carried], "__range", "__group", "__new", "text_sha256"))
    local = rows.groupBy("__range", "__group").agg(F.min(ident).alias("least"), F.count("*").alias("n"), F.min("text_sha256").alias("sha"))
    ends = rows.groupBy("__range").agg(F.max("__group").alias("last"))
    edge = local.join(ends, "__range").filter("__group = 1 or __group = last")
    joined = edge.groupBy("sha").agg(F.min("least").alias("keep_id"), F.sum("n").alias("size"), F.min("__range").alias("first_range"), F.min(F.when(F.col("least").isNotNull(), F.col("__range"))).alias("id_range"))
    merged = edge.select("__range", "__group", "sha").join(joined, "sha").select("__range", "__group", "keep_id", "size", F.coalesce("id_range", "first_range").alias("home"))
    return rows, local, merged


def content_sort(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` without their texts, with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after white space runs become one space; NULL text counts as empty. The smallest id of a
    group stays (NULL ids come last, so a NULL id stays only in a group without ids). Rows that repeat text and id count as
    separate members of which one is ``kept``. Input columns named like results are replaced. The sorted rows without their
    texts are settled once; an empty table gives no rows.
    """
    given = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    source, back = set_aside(given, (text, ident))
    rows, local, merged = sorted_groups(source, text, ident, [c for c in source.columns if c != text])
    back = [b for b, name in zip(back, given.columns, strict=True) if name != text]
    groups = local.join(merged, ["__range", "__group"], "left").select(
        "__range", "__group", F.when(F.col("home").isNull(), F.col("least")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", "n").alias("group_size"), F.coalesce("home", F.col("__range")).alias("home")
    )
    kept = F.col("__new") & (F.col("__range") == F.col("home"))
    return rows.join(groups, ["__range", "__group"]).select(*back, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``content_sort`` keeps, with their columns and unchanged texts."""
    source, back = set_aside(docs, (text, ident))
    rows, _, merged = sorted_groups(source, text, ident, source.columns)
    # at most two rows for each range, whose number is a setting: small enough to broadcast
    elsewhere = F.broadcast(merged.filter("__range <> home").select("__range", "__group"))
    heads = rows.filter("__new").join(elsewhere, ["__range", "__group"], "left_anti")
    return heads.select(*back)
