"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indexloom.llm.common import fresh, ranked, unit, word_count
from indexloom.session import written

BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in order, repeating; cap: largest target in sizes of its source; seed: of the draws."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    seed: int = 20240607
    id_col: str = "doc_id"
    text_col: str = "text"
    source_col: str = "source"


def _draws(docs: DataFrame, how: Mix) -> list[Column]:
    """What the mix knows of a document: its source, words and two hashes."""
    known = [F.col(c) for c in (how.id_col, how.source_col, how.text_col)]
    return [
        F.col(how.source_col).cast("string").alias("__source"),
        word_count(F.col(how.text_col)).alias("__size"),
        F.xxhash64(F.lit(how.seed), *known).alias("__draw"),
        F.xxhash64(F.lit(how.seed + 1), *known).alias("__tie"),
    ]


def _targets(sized: DataFrame, how: Mix) -> DataFrame:
    """One row per source: its size, rows and target in words."""
    sums = sized.groupBy("__source").agg(
        F.sum("__size").cast("long").alias("source_size"), F.count("*").alias("__rows")
    )
    sources = ranked(sums, [F.col("__source").asc_nulls_last()], "__rank")
    weights = F.array(*[F.lit(w) for w in how.weights])
    weight = F.get(weights, F.pmod(F.col("__rank"), F.lit(len(how.weights))).cast("int"))
    sources = written(sources.withColumn("__weight", weight.cast("long")), "mix-sources")
    limit = F.lit(how.cap) * F.col("source_size")
    total, free = sources.agg(F.sum("source_size"), F.sum("__weight")).first()
    total, free, capped = total or 0, free or 0, None
    level = total / free if free else 0.0
    while free:
        # the level only rises, so a source above its limit stays there; ends once no more are above
        above = F.lit(level) * F.col("__weight") > limit
        full, rest, n = sources.agg(
            F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("__weight"))), F.count(F.when(above, 1))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - (full or 0)) / rest
    target = F.least(F.lit(float(level)) * F.col("__weight"), limit.cast("double"))
    return sources.select("__source", "source_size", "__rows", target.alias("target"))


def _chance(ratio: Column) -> tuple[Column, Column]:
    """Whole copies that every document gets, and the chance of one more."""
    whole = F.floor(ratio)
    return whole.cast("long"), ratio - whole


def _odds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """To each source's targets, the factor `__factor` of its inclusion chances and `__certain`, the words of documents
    that are sure of one copy more.

    The words that whole copies leave open are sampled with chances in proportion to the root of a document's size, so
    that long documents, which tell more, come oftener. Where the chance would exceed one the copy is certain, and the
    others share what is left, until no more are certain. All of it works on counts per source and size.
    """
    counts = sized.filter("__size > 0").groupBy(F.col("__source").alias("__of"), "__size").agg(F.count("*").alias("__n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_words = F.col("target") - _chance(ratio)[0] * F.col("source_size")
    found = written(targets.select("*", open_words.alias("__open"), F.lit(0.0).alias("__factor"), F.lit(0).cast("long").alias("__certain")), "mix-odds")
    own = F.col("__source").eqNullSafe(F.col("__of"))
    counts, before = written(counts, "mix-counts"), None
    while True:
        root = F.sqrt(F.col("__size").cast("double"))
        sure = F.col("__factor") * root >= 1
        words = F.col("__n") * F.col("__size")
        sums = counts.join(found, own).groupBy(F.col("__source").alias("__at")).agg(
            F.coalesce(F.sum(F.when(sure, words)), F.lit(0)).alias("__full"), F.sum(F.when(~sure, words * root)).alias("__rest"), F.count(F.when(sure, 1)).alias("__k")
        )
        joined = found.join(sums, F.col("__source").eqNullSafe(F.col("__at")), "left")
        left = F.greatest(F.col("__open") - F.coalesce("__full", F.lit(0)), F.lit(0.0))
        factor = F.when(F.col("__rest") > 0, left / F.col("__rest")).otherwise(F.col("__factor"))
        # a factor only rises, so what is certain stays so
        moved = joined.select(*targets.columns, "__open", F.greatest(factor, "__factor").alias("__factor"), F.coalesce("__full", F.lit(0)).alias("__certain"), "__k")
        moved = written(moved, "mix-odds")
        certain = moved.agg(F.sum("__k")).first()[0]
        if certain == before:
            return moved.drop("__open", "__k")
        before, found = certain, moved.drop("__k")


def _order(chance: Column) -> Column:
    """Where a document stands: its random odds over its inclusion odds, brought into 0 to 1.

    q -> q / (1 + q) keeps the order and puts documents that a draw would take below one half.
    """
    u = unit(F.col("__draw"))
    return u * (1 - chance) / (u * (1 - chance) + chance * (1 - u))


def _placed(sized: DataFrame, plan: DataFrame, how: Mix) -> DataFrame:
    """Documents beside their source's plan. The plan is a stored table, so the planner knows its size."""
    joined = sized.join(plan.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole, residual = _chance(ratio)
    chance = F.when(residual > 0, F.col("__factor") * F.sqrt(F.col("__size").cast("double"))).otherwise(0.0)
    joined = joined.withColumn("__whole", whole + (chance >= 1).cast("long"))
    joined = joined.withColumn("__chance", F.when(chance < 1, chance).otherwise(0.0))
    buckets = F.ceil(F.col("__rows") / BUCKET_ROWS)
    order = F.when(F.col("__chance") > 0, _order(F.col("__chance")))
    joined = joined.withColumn("__order", order)
    return joined.withColumn("__bucket", F.least(F.floor(F.col("__order") * buckets), buckets - 1)).drop("__of")


def mix_plan(docs: DataFrame, how: Mix = Mix(), sized: DataFrame | None = None) -> DataFrame:
    """For each source its size, target and where its sample ends.

    Sources in code-point order (null last) weigh `weights`, repeating, and share as many words as all documents have.
    A target stops at `cap` times its source's size and the excess is shared again by weight. A document of a source
    whose target is r times its size gets floor(r) copies for certain; for the rest documents have unequal chances, in
    proportion to the root of their sizes, or a certain copy more where that exceeds one. They are ranked by Pareto's ratio
    of random odds to inclusion odds and taken until the words are reached. The size of the sample is fixed in words: where the next document would
    go beyond it, later ones of its bucket that fit fill the rest. The ranking is cut in two levels: counts of words by bucket of the ranking, and the
    documents of the one bucket in which the sample ends, so no task holds a source.

    Null texts have no words, null sources are one source, equal rows share their draw, an empty table gives no plan.
    Very long texts are counted whole; columns of other names are carried along, whatever their names.
    """
    sized = sized if sized is not None else written(docs.select(*_draws(docs, how)), "mix-sizes")
    plan = _odds(sized, written(_targets(sized, how), "mix-targets"))
    placed = _placed(sized, plan, how)
    whole = _chance(F.col("target") / F.col("source_size"))[0]
    need = F.col("target") - whole * F.col("source_size") - F.col("__certain")
    by_bucket = (
        placed.filter("__order IS NOT NULL AND __size > 0")
        .groupBy("__source", "__bucket")
        .agg(F.sum("__size").alias("__words"), F.any_value(need).alias("__need"))
    )
    upto = Window.partitionBy("__source").orderBy("__bucket")
    cuts = (
        by_bucket.withColumn("__upto", F.sum("__words").over(upto))
        .filter(F.col("__upto") > F.col("__need"))
        .groupBy(F.col("__source").alias("__of"))
        .agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__words")).alias("below"), "__need")).alias("__cut"))
        .select(
            "__of",
            F.col("__cut.__bucket").alias("__last"),
            (F.col("__cut.__need") - F.col("__cut.below")).alias("__left"),
        )
    )
    cuts = written(cuts, "mix-cuts")
    edge = placed.filter("__order IS NOT NULL AND __size > 0").join(
        cuts, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__last"))
    )
    row = F.struct("__order", "__tie")
    upto = Window.partitionBy("__of").orderBy("__order", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("__sum", F.sum("__size").over(upto)).withColumn("__in", F.col("__sum") <= F.col("__left"))
    item = F.struct(F.col("__order").alias("order"), F.col("__tie").alias("tie"), F.col("__size").alias("size"))
    taken = F.coalesce(F.sum(F.when(F.col("__in"), F.col("__size"))), F.lit(0))
    ends = edge.groupBy("__of").agg(
        F.max(F.when(F.col("__in"), row)).alias("__cut"),
        F.sort_array(F.collect_list(F.when(~F.col("__in"), item))).alias("__rest"),
        (F.first("__left") - taken).alias("__gap"),
    )
    # the bucket's other documents fill the gap in their order where they fit
    start = F.struct(F.col("__gap").alias("gap"), F.array().cast("array<bigint>").alias("ties"))
    filled = F.aggregate(
        "__rest",
        start,
        lambda acc, x: F.when(
            x["size"] <= acc["gap"],
            F.struct((acc["gap"] - x["size"]).alias("gap"), F.array_append(acc["ties"], x["tie"]).alias("ties")),
        ).otherwise(acc),
    )
    ends = ends.select("__of", "__cut", filled["ties"].alias("__closing"))
    ends = cuts.join(ends.withColumnRenamed("__of", "__at"), F.col("__of").eqNullSafe(F.col("__at")), "left").drop("__at", "__left")
    plan = plan.join(ends, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    return written(plan, "mix-plan")


def _copies() -> Column:
    row = F.struct("__order", "__tie")
    extra = (
        F.col("__last").isNull()
        | (F.col("__bucket") < F.col("__last"))
        | ((F.col("__bucket") == F.col("__last")) & ((row <= F.col("__cut")) | F.array_contains("__closing", F.col("__tie"))))
    )
    extra = F.col("__order").isNotNull() & F.coalesce(extra, F.lit(False))
    return (F.col("__whole") + extra.cast("long")).alias("copies")


def mix_sizes(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """One row per document: its id, size and source's size and target in words, copies and words taken."""
    keyed = docs.select(F.col(how.id_col).alias("__id"), *_draws(docs, how))
    sized = written(keyed, "mix-sizes")
    placed = _placed(sized, mix_plan(docs, how, sized), how).withColumn("copies", _copies())
    return placed.select(
        F.col("__id").alias(how.id_col),
        F.col("__source").alias(how.source_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("__size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mixed documents: every row as often as the plan takes it, with the columns of the input."""
    names = [fresh(docs, f"__in{i}") for i in range(len(docs.columns))]
    plan = mix_plan(docs, how)
    sized = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *_draws(docs, how))
    placed = _placed(sized, plan, how).withColumn("copies", _copies()).filter("copies > 0")
    placed = placed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return placed.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
