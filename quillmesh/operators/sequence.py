"""Ordered data: islands, spans, slices, as-of matches, running totals and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive distinct whole numbers of each key: (key, first, last)."""
    w = Window.partitionBy(key).orderBy(value)
    run = F.col(value) - F.row_number().over(w)
    return df.select(key, value).distinct().withColumn("_run", run).groupBy(key, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_run")


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered_repeats(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Repeats of a label get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order))
    return df.withColumn(label, F.when(n > 1, F.concat_ws("-", label, n)).otherwise(F.col(label)))


def toc_end_pages(entries: DataFrame, document: str, start: str, order: list[str], last_page: str) -> DataFrame:
    """An entry ends on the page before the next one starts, on its own start page at least."""
    following = F.lead(start).over(Window.partitionBy(document).orderBy(*order))
    return entries.withColumn("end_page", F.greatest(F.col(start), F.coalesce(following - 1, F.col(last_page))))


def spans(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Character spans of parts joined by one separator; empty parts have none."""
    size = F.length(text)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    some = parts.filter(size > 0)
    start = F.coalesce(F.sum(size + 1).over(w), F.lit(0))
    return some.withColumn("start", start).withColumn("end", start + size)


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (a_start, a_end) and (b_start, b_end) of a key that overlap.

    Both sides are dealt into cells of `width`; pairs meet in the cell of their later start, so each comes once and no
    key's rows are all compared.
    """
    cells = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width))
    left = a.withColumn("_cell", F.explode(cells("a_start", "a_end")))
    right = b.withColumn("_cell", F.explode(cells("b_start", "b_end")))
    meet = (F.col("b_start") < F.col("a_end")) & (F.col("b_end") > F.col("a_start")) & (F.col("_cell") == F.floor(F.greatest("a_start", "b_start") / width))
    return left.join(right, [key, "_cell"]).filter(meet).drop("_cell")


def next_after(events: DataFrame, marks: DataFrame, key: str, at: str, fallback: Column | None = None) -> DataFrame:
    """For each event the least mark after it (as-of forward): one sort by key and time, no pairs."""
    both = events.withColumn("_mark", F.lit(None).cast(dict(events.dtypes)[at])).withColumn("_e", F.lit(True))
    m = marks.select(key, at, F.col(at).alias("_mark"), F.lit(False).alias("_e"))
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("_e").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.unionByName(m, allowMissingColumns=True)
    # Marks at the same time as an event don't count: events come before them in descending order.
    out = out.withColumn("next_mark", F.last("_mark", ignorenulls=True).over(w)).filter("_e").drop("_mark", "_e")
    return out if fallback is None else out.withColumn("next_mark", F.coalesce("next_mark", fallback))


def balanced_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 20260708) -> DataFrame:
    """Round-robin over groups in a seeded order: no group gives its second row before all have given their first."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return df.withColumn("turn", turn).orderBy("turn", F.xxhash64(F.lit(seed), F.col(group)), group).limit(n)


def previous_by_role(messages: DataFrame, key: str, order: str, role: str = "user") -> DataFrame:
    """The latest earlier text of a role."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous", F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(w))


def fold(messages: DataFrame, key: str, order: str, text: str, sep: str = "") -> DataFrame:
    """Ordered concatenation."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return messages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias("folded"))


def best_range(counts: DataFrame, document: str, page: str, profile: str, n: str, last: int = 30) -> DataFrame:
    """The page range whose best profile matches most lines; the shortest, then the latest start. Prefix sums, `last` pages at most.

    A document without any match has pages 3 to 5 and a total of 0.
    """
    w = Window.partitionBy(document, profile).orderBy(page).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = counts.filter(F.col(page) <= last)
    upto = some.withColumn("upto", F.sum(n).over(w))
    a = upto.select(document, profile, F.col(page).alias("start"), (F.col("upto") - F.col(n)).alias("low"))
    b = upto.select(document, profile, F.col(page).alias("end"), F.col("upto").alias("high"))
    total = F.col("high") - F.col("low")
    ranges = a.join(b, [document, profile]).filter("start <= end").withColumn("total", total).filter("total > 0")
    best = F.max(F.struct("total", (F.col("start") - F.col("end")).alias("neg"), "start", "end"))
    found = ranges.groupBy(document).agg(best.alias("b"))
    part = lambda x, other: F.coalesce(F.col("b")[x], F.lit(other)).alias(x)
    return counts.select(document).distinct().join(found, document, "left").select(document, part("start", 3), part("end", 5), part("total", 0))
