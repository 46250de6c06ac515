"""Operator 3: mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sizes are words. All sources together keep the size of the input; each source's target is its weight's
share of that, but at most ``most`` times its own size, and what is cut off is shared out again by
weight. Every document of a source with target/size = r is taken floor(r) times for certain. What the
source still lacks comes from a sample of fixed size, in words, with unequal probabilities: a document's
inclusion odds are lambda * sqrt(c), where c is the least power of two above its size and lambda is
such that the expected words of the source's sample are those it lacks. Longer documents are likelier to come in, none is
certain. With U a hash of doc_id in (0, 1), documents rank by the odds U/(1-U) divided by their inclusion odds, the
least first, and the sample is the head of that order: down the order, a document comes in if its words
still fit, until less than ``TOLERANCE`` of the target is missing. In a large source that is one cutoff; in
a small one a few long documents are passed over. Last, where more is missing, the shortest document
that is left comes in too if that brings the sum nearer.

The head is found without sorting a source: words are summed by slices of the order first, the slice
in which it ends is cut into slices again, and so on, so a source with a third of all rows never
meets in one task. A document passed over starts this again, with the documents after it that still fit; where these are few, one fold in order ends it. Rows
with equal doc_id, source and size share their rank and stay or go together.

Null texts have size 0; the null source is a source of its own, last in order. Documents of size 0 take
0 words. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Sources that may be sent to every executor (a row of some 100 bytes each); with more, the join shuffles.
BROADCAST_SOURCES = 10_000
#: Slices of the rank order by round; after all rounds a slice holds one rank of 2^-48.
SLICE_BITS = 16
ROUNDS = 3
END = 1 << (SLICE_BITS * ROUNDS)
#: The share of its target that a source may lack.
TOLERANCE = 0.001
#: Ranks after a misfit, of a source, that one fold takes; where a source has more, its order is cut in rounds again.
FOLD_RANKS = 5_000
#: Halvings of the range in which log2(lambda) is looked for.
HALVINGS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that a document's id fixes: the first 12 hex digits of its MD5."""
    u48 = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    return (u48 + F.lit(0.5)) / F.lit(float(END))


def size_class(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size))


def relative_odds(digits: Column) -> Column:
    """Inclusion odds of a size class but for the source's factor."""
    return F.sqrt(F.pow(F.lit(2.0), digits))


def pareto_rank(u: Column, odds: Column) -> Column:
    """Random odds divided by inclusion odds, s, as the whole number floor(2^48 s/(1 + s)): in the same order, and the same everywhere."""
    return F.floor(u / (u + (1 - u) * odds) * F.lit(float(END))).cast("long")


def rank_of(doc_id: Column, size: Column) -> Column:
    return pareto_rank(uniform(doc_id), relative_odds(size_class(size)))


def with_ranks(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and rank of every document."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return sized.withColumn("rank", rank_of(F.col("doc_id"), F.col("size")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from source, size: one row for each source.

    Weighted shares of the total, capped: in order of cap per weight, sources stay at their cap as long
    as the common level of the others is above it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    low = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_first())
    before = low.rowsBetween(Window.unboundedPreceding, -1)
    after = low.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ranked.withColumns(
        {
            "left": F.sum("source_size").over(Window.partitionBy(F.lit(0)))
            - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "shares": F.sum("weight").over(after),
        }
    ).withColumn("level", F.col("left") / F.col("shares"))
    open_ = level.withColumn("free", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    common = F.first("free", ignorenulls=True).over(low.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(F.least(F.col("cap").cast("double"), common * F.col("weight")), F.col("cap").cast("double"))
    return open_.select("source", "source_size", target.alias("target"))


def with_sources(df: DataFrame, sources: DataFrame, on: Column, few: bool, how: str = "left") -> DataFrame:
    """Joins a table of one row for each source at most, broadcast only if the counted sources are few."""
    return df.join(F.broadcast(sources) if few else sources, on, how)


def is_few(sources: DataFrame) -> bool:
    return sources.count() <= BROADCAST_SOURCES


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """s, copies, lacking, slack, lambda of every source: what is certain, what its sample is to hold, how near that must come, the factor of its odds."""
    counts = sizes.where("size > 0").groupBy("source", size_class(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"))
    classes = counts.groupBy(F.col("source").alias("s2")).agg(F.array_sort(F.collect_list(F.struct(relative_odds(F.col("digits")).alias("odds"), "words"))).alias("classes"))  # at most 63 for each source
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select(F.col("source").alias("s"), "source_size", "target", copies.alias("copies"))
    plan = plan.withColumn("lacking", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("slack", F.col("target") * TOLERANCE)
    plan = plan.join(classes, F.col("s").eqNullSafe(F.col("s2")), "left")

    def expected(power: Column) -> Column:
        odds = lambda c: F.pow(F.lit(2.0), power) * c["odds"]
        return F.aggregate("classes", F.lit(0.0), lambda x, c: x + c["words"] * odds(c) / (1 + odds(c)))

    def halved(x: Column, _: Column) -> Column:
        middle = (x["low"] + x["high"]) / 2
        return F.when(expected(middle) < F.col("lacking"), F.struct(middle.alias("low"), x["high"].alias("high"))).otherwise(F.struct(x["low"].alias("low"), middle.alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(-80.0).alias("low"), F.lit(80.0).alias("high")), halved)
    return plan.select("s", "copies", "lacking", "slack", F.when(F.col("classes").isNotNull() & (F.col("lacking") > 0), F.pow(F.lit(2.0), found["high"])).otherwise(0.0).alias("lambda"))


def first_end(ranks: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """``state`` with the first rank after ``after`` that takes the sum above ``lacking - slack`` (``end``, null if none does), the words before it and of it.

    Of the documents with at most ``longest`` words. state: s, after, longest, taken, lacking, slack. The order is cut in
    rounds, each with one of the 2^16 slices of the one before.
    """
    plan = state.withColumn("prefix", F.lit(0).cast("long"))
    bound = plan.select("s", "after", "longest")
    own = with_sources(ranks, bound, ranks["source"].eqNullSafe(F.col("s")), few, "inner").where((F.col("rank") > F.col("after")) & (F.col("size") <= F.col("longest"))).select("s", "rank", "words")
    columns = state.columns
    for i in range(ROUNDS):
        shift = SLICE_BITS * (ROUNDS - 1 - i)
        slices = own.groupBy("s", F.shiftright("rank", shift).alias("slice")).agg(F.sum("words").alias("words"))
        if i:
            open_ = plan.select(F.col("s").alias("s3"), "prefix")
            slices = with_sources(slices, open_, slices["s"].eqNullSafe(F.col("s3")) & (F.shiftright("slice", SLICE_BITS) == F.col("prefix")), few, "inner")
        ordered = slices.groupBy(F.col("s").alias("s2")).agg(F.array_sort(F.collect_list(F.struct("slice", "words"))).alias("slices"))
        found = plan.join(ordered, F.col("s").eqNullSafe(F.col("s2")), "left")
        # Moves over the slices that leave the sum below; stops in the first that does not.
        begin = F.struct(F.col("taken").alias("taken"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("words"))
        moved = F.aggregate(
            F.coalesce("slices", F.array().cast("array<struct<slice:bigint,words:bigint>>")),
            begin,
            lambda x, y: F.when(x["at"].isNotNull(), x)
            .when((x["taken"] + y["words"]).cast("double") <= F.col("lacking") - F.col("slack"), F.struct((x["taken"] + y["words"]).alias("taken"), x["at"].alias("at"), x["words"].alias("words")))
            .otherwise(F.struct(x["taken"].alias("taken"), y["slice"].alias("at"), y["words"].alias("words"))),
        )
        plan = stored(found.withColumn("moved", moved).select(*[c for c in columns if c != "taken"], F.col("moved.taken").alias("taken"), F.coalesce("moved.at", F.lit(-1).cast("long")).alias("prefix"), F.col("moved.words").alias("words")))
    return plan.withColumn("end", F.when(F.col("prefix") >= 0, F.col("prefix"))).drop("prefix")


def after_misfits(ranks: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """``state`` after the documents that are left: one fold for each source, in order, over what still fits."""
    bound = state.select("s", "after", "longest")
    own = with_sources(ranks, bound, ranks["source"].eqNullSafe(F.col("s")), few, "inner").where((F.col("rank") > F.col("after")) & (F.col("size") <= F.col("longest")))
    listed = own.groupBy(F.col("s").alias("s2")).agg(F.array_sort(F.collect_list(F.struct("rank", "size", "words"))).alias("left"))
    found = state.join(listed, F.col("s").eqNullSafe(F.col("s2")), "left")

    def step(x: Column, y: Column) -> Column:
        fits = (x["taken"].cast("double") <= F.col("lacking") - F.col("slack")) & ((x["taken"] + y["words"]).cast("double") <= F.col("lacking"))
        one = F.array(F.struct(y["rank"].alias("first"), y["rank"].alias("last"), y["size"].alias("longest")))
        return F.when(fits, F.struct((x["taken"] + y["words"]).alias("taken"), F.concat(x["ranges"], one).alias("ranges"))).otherwise(x)

    folded = F.aggregate(F.coalesce("left", F.array().cast("array<struct<rank:bigint,size:bigint,words:bigint>>")), F.struct("taken", "ranges"), step)
    return found.withColumn("folded", folded).select("s", "lacking", "slack", "folded.taken", "folded.ranges")


def sampled(sizes: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """s, ranges of every source: a document is in the sample if its rank is in one of the ranges (first, last) and its size at most the range's ``longest``."""
    ranks = stored(sizes.where("size > 0").groupBy("source", "rank", "size").agg(F.sum("size").alias("words")))
    none = F.array().cast("array<struct<first:bigint,last:bigint,longest:bigint>>")
    state = plan.where("lacking > slack").select("s", F.lit(-1).cast("long").alias("after"), F.floor("lacking").cast("long").alias("longest"), F.lit(0).cast("long").alias("taken"), "lacking", "slack", none.alias("ranges"))
    done = state.select("s", "lacking", "slack", "taken", "ranges").limit(0)
    while True:
        found = first_end(ranks, state, few)
        fits = F.coalesce((F.col("taken") + F.col("words")).cast("double") <= F.col("lacking"), F.lit(False))
        last = F.when(F.col("end").isNull(), F.lit(END)).when(fits, F.col("end")).otherwise(F.col("end") - 1).cast("long")
        range_ = F.struct((F.col("after") + 1).alias("first"), last.alias("last"), F.col("longest").alias("longest"))
        taken = F.col("taken") + F.when(fits, F.col("words")).otherwise(0)
        judged = found.select("s", "lacking", "slack", taken.alias("taken"), F.concat("ranges", F.array(range_)).alias("ranges"), "end", (F.col("end").isNotNull() & ~fits).alias("goes_on"))
        judged = stored(judged.withColumn("longest", F.floor(F.col("lacking") - F.col("taken")).cast("long")))
        done = done.unionByName(judged.where("not goes_on").select("s", "lacking", "slack", "taken", "ranges"))
        state = judged.where("goes_on").select("s", F.col("end").alias("after"), "longest", "taken", "lacking", "slack", "ranges")
        left = with_sources(ranks, state.select("s", "after", "longest"), ranks["source"].eqNullSafe(F.col("s")), few, "inner").where((F.col("rank") > F.col("after")) & (F.col("size") <= F.col("longest")))
        if (left.groupBy("s").count().agg(F.max("count")).first()[0] or 0) <= FOLD_RANKS:
            break
    ended = stored(done.unionByName(after_misfits(ranks, state, few)))
    short = ended.where(F.col("taken").cast("double") <= F.col("lacking") - F.col("slack"))
    left = with_sources(ranks, short.withColumnRenamed("s", "s4"), ranks["source"].eqNullSafe(F.col("s4")), few, "inner")
    outside = left.where(~is_sampled(F.col("ranges"), F.col("rank"), F.col("size")) & (F.col("words") < 2 * (F.col("lacking") - F.col("taken"))))
    more = outside.groupBy(F.col("s4").alias("s5")).agg(F.min(F.struct("size", "rank")).alias("more"))
    joined = ended.join(more, F.col("s").eqNullSafe(F.col("s5")), "left")
    extra = F.array(F.struct(F.col("more.rank").alias("first"), F.col("more.rank").alias("last"), F.col("more.size").alias("longest")))
    return joined.select("s", F.when(F.col("more").isNull(), F.col("ranges")).otherwise(F.concat("ranges", extra)).alias("ranges"))


def is_sampled(ranges: Column, rank: Column, size: Column) -> Column:
    return F.exists(ranges, lambda r: (rank >= r["first"]) & (rank <= r["last"]) & (size <= r["longest"]))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, rank of every document; source, source_size, target, copies, lambda, ranges of every source), both stored."""
    sizes = stored(with_ranks(docs))
    targets = stored(source_targets(sizes, weights, most))
    plan = stored(inclusion(sizes, targets))
    few = is_few(plan)
    ranges = sampled(sizes, plan, few).withColumnRenamed("s", "s6")
    whole = targets.join(plan.select("s", "copies", "lambda"), targets["source"].eqNullSafe(plan["s"])).join(ranges, F.col("s").eqNullSafe(F.col("s6")), "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint,longest:bigint>>")
    return sizes, stored(whole.select("source", "source_size", "target", "copies", "lambda", F.coalesce("ranges", none).alias("ranges")))


def copies_taken(copies: str = "copies", ranges: str = "ranges", rank: str = "rank", size: str = "size") -> Column:
    """How often a document is taken, from its rank and size and its source's plan."""
    return F.col(copies) + F.when(is_sampled(F.col(ranges), F.col(rank), F.col(size)), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rank and inclusion probability p (of the copy that is not certain) of every document."""
    sizes, plan = mix_plan(docs, weights, most)
    joined = with_sources(sizes, plan.withColumnRenamed("source", "s"), sizes["source"].eqNullSafe(F.col("s")), is_few(plan))
    odds = F.col("lambda") * relative_odds(size_class(F.col("size")))
    return joined.select(
        "doc_id", "size", "source_size", "target", (copies_taken() * F.col("size")).cast("long").alias("taken"), copies_taken().cast("long").alias("copies"), "rank", (odds / (1 + odds)).alias("p")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents of the mix, each row as often as it is taken."""
    _, plan = mix_plan(docs, weights, most)
    plan = plan.select(F.col("source").alias("__s"), F.col("copies").alias("__copies"), F.col("ranges").alias("__ranges"))
    own = docs.withColumn("__size", word_count(F.col("text")))
    own = own.withColumn("__rank", rank_of(F.col("doc_id"), F.col("__size")))
    joined = with_sources(own, plan, own["source"].eqNullSafe(F.col("__s")), is_few(plan), "inner")
    times = copies_taken("__copies", "__ranges", "__rank", "__size").cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)
