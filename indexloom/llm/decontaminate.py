"""Benchmark decontamination: test n-grams that stand in training texts, found with a broadcast hash set.

Words are runs of a-z, digits and all characters beyond ASCII, after A-Z are lower-cased. Every `window` consecutive words
of a benchmark item are an n-gram; an item of fewer words is one as a whole. Texts are scanned window by window against
the hashes of the n-grams, and a hit counts only when the words themselves agree. All of it is Spark's own functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm.common import fresh, let, lowered
from indexloom.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Grams:
    """window: words of an n-gram; broadcast_bytes: of n-grams that one scan of the texts holds, more take more scans;
    stretch: words of a text that are scanned as one row."""

    window: int = 10
    broadcast_bytes: int = 64 * 1024 * 1024
    stretch: int = 2048
    id_col: str = "doc_id"
    text_col: str = "text"
    item_col: str = "item_id"
    item_text_col: str = "text"


def words(text: Column) -> Column:
    """Normalised words in order; none for null."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), GAP), "")


def window_hashes(part: Column, n: int) -> Column:
    """A hash of each `n` consecutive words, from hashes of 1, 2, 4, ... words, so none is hashed word by word again."""

    def joined(a: Column, b: Column, by: int) -> Column:
        """Hashes of the windows of `a`, each with that of `b` which begins `by` words later."""
        size = F.greatest(F.size(b) - by, F.lit(0))
        return F.zip_with(F.slice(a, 1, size), F.slice(b, by + 1, size), lambda x, y: F.xxhash64(x, y))

    def widened(power: Column, width: int, found: Column | None, reach: int) -> Column:
        """`found` holds windows of `reach` words, `power` windows of `width`."""
        if n & width:
            found, reach = power if found is None else joined(found, power, reach), reach + width
        if 2 * width > n:
            return found
        if found is None:
            return let(joined(power, power, width), lambda p: widened(p, 2 * width, None, 0))
        return let(found, lambda f: let(joined(power, power, width), lambda p: widened(p, 2 * width, f, reach)))

    return let(F.transform(part, lambda w: F.xxhash64(w)), lambda p: widened(p, 1, None, 0))


def benchmark_grams(benchmark: DataFrame, how: Grams = Grams()) -> tuple[DataFrame, DataFrame]:
    """The n-grams `(gram, hash, n, says)`, each once, and the items `(gram, item)` that have them.

    Items without words have none. Windows of an item with a null id are n-grams that belong to no item.
    """
    item, text = F.col(f"`{how.item_col}`").cast("string"), F.col(f"`{how.item_text_col}`")
    own = benchmark.select(item.alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - how.window + 1, F.lit(1)))
    says = F.transform(starts, lambda i: F.slice("w", i, how.window))
    pairs = own.select("item", F.explode(says).alias("says")).distinct()
    grams = pairs.select("says").distinct().withColumn("gram", F.monotonically_increasing_id())
    hash_ = F.coalesce(*[F.when(F.size("says") == n, F.get(window_hashes(F.col("says"), n), F.lit(0))) for n in range(1, how.window + 1)])
    grams = written(grams.select("gram", hash_.alias("hash"), F.size("says").alias("n"), "says"), "grams")
    # as texts, since a join on arrays cannot hash them
    text_of = F.array_join("says", " ").alias("t")
    named = pairs.filter(F.col("item").isNotNull()).select("item", text_of).join(grams.select("gram", text_of), "t")
    return grams, written(named.select("gram", "item"), "gram-items")


def _stretches(docs: DataFrame, row: str, keep: list[str], lengths: list[int], how: Grams) -> DataFrame:
    """Each text in stretches `(seg, own, part)`: `own` words of the stretch and those after it that a window may reach.

    Rows of bounded length, so that what a window is compared with is never copied with a whole long text. A text without
    words is one empty stretch.
    """
    s, reach = how.stretch, max(lengths, default=1) - 1
    worded = docs.select(row, *keep, words(F.col(f"`{how.text_col}`")).alias("w"))
    n = F.size("w")
    segments = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / s).cast("int"))
    parts = F.transform(segments, lambda k: F.struct(k.alias("seg"), F.slice("w", k * s + 1, s + reach).alias("part")))
    cut = worded.select(row, *keep, n.cast("long").alias("n_words"), F.explode(parts).alias("p"))
    return cut.select(row, *keep, "n_words", F.col("p.seg").alias("seg"), F.col("p.part").alias("part"))


def _scan(stretches: DataFrame, grams: DataFrame, row: str, keep: list[str], lengths: list[int], how: Grams) -> DataFrame:
    """Hits `(row, start, n, gram)` of one broadcast set of n-grams, and one row without a gram for each text."""
    own = F.least(F.size("part"), F.lit(how.stretch))

    def hashes(n: int) -> Column:
        """One for each of the stretch's own words, null where the text ends before the window."""
        found = window_hashes(F.col("part"), n)
        return let(found, lambda f: F.concat(F.slice(f, 1, own), F.array_repeat(F.lit(None).cast("bigint"), own - F.size(f))))

    # `at` counts the windows of the first length, then those of the next: `own` of each
    windows = F.concat(*map(hashes, lengths)) if lengths else F.array().cast("array<bigint>")
    each = stretches.select(row, *keep, "n_words", "seg", "part", F.posexplode_outer(windows).alias("at", "h"))
    set_ = grams.select(F.col("hash").alias("h"), "gram", "n", "says")
    met = each.join(F.broadcast(set_), "h", "left")
    start = F.col("at") % own
    # a hash only tells where to look: the words decide
    same = F.slice("part", start + 1, F.col("n")) == F.col("says")
    gram = F.when(same, F.col("gram"))
    first = (F.col("seg") == 0) & (F.coalesce(F.col("at"), F.lit(0)) == 0)
    return met.select(
        row,
        *keep,
        "n_words",
        first.alias("first"),
        (F.col("seg").cast("long") * how.stretch + start).alias("start"),
        F.col("n").alias("n"),
        gram.alias("gram"),
    ).filter(F.col("gram").isNotNull() | F.col("first"))


def find(docs: DataFrame, benchmark: DataFrame, row: str, keep: list[str], how: Grams = Grams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of the n-grams of `benchmark` in `docs`, whose column `row` numbers the rows.

    Three tables: `(row, *keep, n_words)` for each text; `(row, spans)` of texts with hits, spans being arrays of
    `(start, end)` in words, without overlaps and in order; `(row, item)` for each item with an n-gram in a text.
    """
    grams, items = benchmark_grams(benchmark, how)
    lengths = [r["n"] for r in grams.select("n").distinct().collect()]  # 1 to `window`
    size = grams.agg(F.sum(F.octet_length(F.array_join("says", " ")) + 64)).first()[0] or 0
    scans = max(1, math.ceil(size / how.broadcast_bytes))
    stretches = _stretches(docs, row, keep, lengths, how)
    if scans > 1:
        stretches = written(stretches, "stretches")
    found = [
        _scan(stretches, grams.filter(F.pmod("hash", F.lit(scans)) == k), row, keep, lengths, how) for k in range(scans)
    ]
    hits = [written(f, "gram-hits") for f in found]
    texts = hits[0].filter("first").groupBy(row).agg(*[F.first(c).alias(c) for c in (*keep, "n_words")])
    hit = reduce(DataFrame.union, hits).filter(F.col("gram").isNotNull())
    return texts, _merged(hit, row, how), hit.select(row, "gram").distinct().join(items, "gram").select(row, "item").distinct()


def _merged(hit: DataFrame, row: str, how: Grams) -> DataFrame:
    """Spans of each text. Hits are merged within stretches, of bounded size, then put together."""
    s = how.stretch
    end = F.col("start") + F.col("n")
    cells = F.array_distinct(F.array(F.floor(F.col("start") / s), F.floor((end - 1) / s)))
    cut = hit.select(row, "start", end.alias("end"), F.explode(cells).alias("cell")).select(
        row, "cell", F.greatest("start", F.col("cell") * s).alias("start"), F.least("end", (F.col("cell") + 1) * s).alias("end")
    )
    each = cut.groupBy(row, "cell").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"))
    # the last span grows while hits touch it; it is kept apart and joins the others when one does not
    last = F.get("all", F.lit(0))
    state = F.struct(F.slice("all", 1, 0).alias("done"), last["start"].alias("start"), last["end"].alias("end"))

    def step(a: Column, x: Column) -> Column:
        touches = x["start"] <= a["end"]
        closed = F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))
        return F.struct(
            F.when(touches, a["done"]).otherwise(closed).alias("done"),
            F.when(touches, a["start"]).otherwise(x["start"]).alias("start"),
            F.when(touches, F.greatest(a["end"], x["end"])).otherwise(x["end"]).alias("end"),
        )

    def finish(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))

    merged = each.select(row, F.aggregate("all", state, step, finish).alias("spans"))
    return merged.groupBy(row).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def span_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def report(docs: DataFrame, benchmark: DataFrame, how: Grams = Grams()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit (words inside a hit), n_items (items that hit), items_sha256 (of
    their ids as strings, sorted and joined by commas) and contaminated.

    Null and empty texts have no words. Rows with equal ids are told apart by their place; equal items are one, by their
    id. Columns of other names are not looked at. An empty table gives no rows, an empty benchmark no hits. A very long
    text is scanned in stretches, which changes no hit.
    """
    identifier = F.col(f"`{how.id_col}`").alias("id")
    numbered = docs.select(identifier, F.col(f"`{how.text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    texts, spans, items = find(numbered, benchmark.select(*[F.col(f"`{c}`") for c in {how.item_col, how.item_text_col}]), "row", ["id"], _plain(how))
    n_hit = spans.select("row", span_words(F.col("spans")).alias("n_hit"))
    named = items.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = texts.join(n_hit, "row", "left").join(named, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(how.id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _plain(how: Grams) -> Grams:
    return Grams(how.window, how.broadcast_bytes, how.stretch, "id", "text", how.item_col, how.item_text_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", how: Grams = Grams()) -> DataFrame:
    """`docs` with the same columns, without benchmark text.

    remove: `spans` takes the hit words out of the texts, with what stands between two of them, and leaves all rows;
    `documents` drops rows with a hit. Texts without a hit are not changed. Nulls, repeats and empty tables as in `report`.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    row, spans = fresh(docs, "__row"), fresh(docs, "__spans")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(F.col(row).alias("row"), F.col(f"`{how.text_col}`").alias("text"))
    found = find(slim, benchmark.select(*[F.col(f"`{c}`") for c in {how.item_col, how.item_text_col}]), "row", [], _plain(how))[1]
    found = found.select(F.col("row").alias(row), F.col("spans").alias(spans))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if remove == "documents":
        return numbered.join(found, row, "left_anti").select(*columns)
    joined = numbered.join(found, row, "left")
    text = F.col(f"`{how.text_col}`")
    clean = F.when(F.col(spans).isNull(), text).otherwise(_without(text, F.col(spans)))
    return joined.withColumn(how.text_col, clean).select(*columns)


def _without(text: Column, spans: Column) -> Column:
    """A text less the words of `spans` and what stands between them: pieces between spans are kept as they are written."""
    kept_words = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    shown = F.regexp_extract_all(text, F.lit(kept_words), F.lit(0))  # as written, not lower-cased
    gaps = F.split(text, kept_words, -1)
    n = F.size(shown)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda x: x["end"]))
    ends = F.concat(F.transform(spans, lambda x: x["start"]), F.array(n.cast("bigint")))

    def piece(start: Column, end: Column) -> Column:
        """gaps[start], word, gap, ..., gaps[end]"""
        word = F.slice(shown, (start + 1).cast("int"), (end - start).cast("int"))
        after = F.slice(gaps, (start + 2).cast("int"), (end - start).cast("int"))
        first = F.get(gaps, start.cast("int"))
        return F.concat(first, F.array_join(F.zip_with(word, after, lambda w, g: F.concat(w, g)), ""))

    return F.array_join(F.zip_with(starts, ends, piece), "")
