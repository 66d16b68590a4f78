"""Lines repeated across one site's documents: found by excess over other sources, removed by position.

Texts are brought to one form and cut into lines in the JVM; a line is known by a hash of its form without outer blanks and with
each run of digits read as one. Counts of rows by source and line are aggregated before any join. A log-likelihood ratio
compares a line's rate within its source with its rate in the others; sources in which the line is itself a running line
don't count as background, else a notice shared by many sites would hide itself. False discoveries are held down over all tests by the
step-up rule on a histogram of the ratios, so that no global sort is needed. What is significant must then pass the exact
rule of rows and share.

Defined results: null texts have no lines; blank lines never count; rows delivered again count once; a null source is no
group; ties at the threshold are in; an empty table gives nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.canon import canonical
from loamgrid.session import durable, fitting, fresh_rows

#: Copies of the short lists of lines, one for each salt of the rows of a source.
SALTS = 32
#: Groups whose lists are broadcast.
LISTS = 20_000
#: Steps of the histogram of ratios and its last bin, beyond which a chance is below 1e-20.
STEP, LAST = 0.05, 2000


def line_keys(text: Column) -> Column:
    """array<bigint> of a text in one form: a key for each line, null for a blank one."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.regexp_replace(F.trim(x), "[0-9]+", "0"))))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def log_likelihood_ratio(inside: Column, size: Column, outside: Column, rest: Column) -> Column:
    """G² of two rates, negative where the inside rate isn't the higher one."""
    a, b, c, d = (x.cast("double") for x in (inside, outside, size - inside, rest - outside))
    g = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) - _xlogx(a + b) - _xlogx(c + d) - _xlogx(a + c) - _xlogx(b + d) + _xlogx(a + b + c + d))
    return F.when(a * (b + d) > b * (a + c), F.greatest(g, F.lit(0.0))).otherwise(F.lit(0.0))


def critical_ratio(ratios: DataFrame, rate: float) -> float:
    """The lowest ratio that keeps the rate of false discoveries, by the step-up rule over bins; ratios has column g."""
    bins = ratios.groupBy(F.least(F.floor(F.col("g") / STEP), F.lit(LAST)).cast("int").alias("bin")).count().collect()  # at most LAST + 1 rows
    tests = sum(r["count"] for r in bins)
    passed, lowest = 0, math.inf
    for row in sorted(bins, key=lambda r: -r["bin"]):
        passed += row["count"]
        chance = math.erfc(math.sqrt(row["bin"] * STEP / 2))
        if chance <= rate * passed / tests:
            lowest = row["bin"] * STEP
    return lowest


def keyed_lines(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """row_id, grp and keys of the lines, one row for each key, stored as it is used several times."""
    rows = df.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("row_id"), F.col(group).alias("grp"), line_keys(canonical(F.col(text))).alias("keys"))
    return durable(rows.dropDuplicates(["row_id"]))


def excess_lines(rows: DataFrame, min_rows: int = 3, min_share: float = 0.2, rate: float = 0.1) -> DataFrame:
    """grp, key and g of lines in significant excess that pass the exact rule."""
    counts = rows.select("grp", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")).groupBy("grp", "key").agg(F.count("*").alias("n"))
    counts = durable(counts)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    total = rows.count()
    totals = counts.groupBy("key").agg(F.sum("n").alias("n_all"), F.max("n").alias("most")).where(F.col("most") >= min_rows).drop("most")
    tested = counts.where(F.col("n") >= min_rows).join(sizes, "grp").withColumn("running", F.col("n") >= F.col("size") * min_share)
    running = tested.where("running").groupBy("key").agg(F.sum("n").alias("n_running"))
    tested = tested.join(totals, "key").join(running, "key", "left")
    own = F.when(F.col("running"), F.lit(0)).otherwise(F.col("n"))
    outside = F.greatest(F.col("n_all") - F.coalesce("n_running", F.lit(0)) - own, F.lit(0))
    # Where a source is most of the table, as many imagined rows without the line stand outside. A line that others hold just below
    # the share is still in excess of what is usual, so the background counts up to a quarter of the share.
    rest = F.greatest(F.lit(total) - F.col("size"), F.col("size"))
    outside = F.when(F.col("running"), F.least(outside, F.floor(rest * (min_share / 4)))).otherwise(outside)
    g = log_likelihood_ratio(F.col("n"), F.col("size"), outside, rest)
    tested = durable(tested.select("grp", "key", "n", "size", "running", g.alias("g")))
    lowest = critical_ratio(tested, rate)
    return tested.where((F.col("g") >= lowest) & F.col("running")).select("grp", "key", "g")


def with_running(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of a group (grp) that has running lines, with the keys of these lines.

    A group has at most 1 / min_share times its mean number of lines as running lines, so its list is short. Lists of few
    groups are broadcast; else rows are salted, so that those of a large group meet a copy of its list each in many tasks.
    """
    lists = durable(lists.groupBy("grp").agg(F.collect_set("key").alias("running")))
    if lists.count() <= LISTS:
        return rows.join(F.broadcast(lists), "grp")
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(lists, ["grp", "salt"]).drop("salt")


def lines_to_remove(df: DataFrame, key: str, group: str, text: str, min_rows: int = 3, min_share: float = 0.2, rate: float = 0.1) -> DataFrame:
    """row_id and line_no, from 0, of every running line."""
    rows = keyed_lines(df, key, group, text)
    hit = with_running(rows, excess_lines(rows, min_rows, min_share, rate)).select("row_id", F.posexplode("keys").alias("line_no", "key"), "running")
    return hit.where(F.array_contains("running", F.col("key"))).select("row_id", "line_no")


def without_running_lines(df: DataFrame, key: str, group: str, text: str, **limits) -> DataFrame:
    """row_id, the text put together again by position from the lines that stay, and how many went; one row for each key.

    Each row's lines are anti-joined with its group's list where they stand, so that no text is shuffled but for rows
    delivered again. Rows without a group or without such lines stay whole; a null text stays null.
    """
    gone = durable(excess_lines(keyed_lines(df, key, group, text), **limits))
    rows = fresh_rows(df.select(F.col(key).alias("row_id"), F.col(group).alias("grp"), F.col(text).alias("text")), "row_id")
    listed = durable(gone.select("grp").distinct())
    found = with_running(rows.where("text is not null").withColumn("keys", line_keys(canonical(F.col("text")))), gone)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("running", F.get("keys", i)) | F.get("keys", i).isNull())
    found = found.withColumn("kept", kept).select("row_id", F.array_join("kept", "\n").alias("text"), (F.size("keys") - F.size("kept")).alias("n_removed"))
    rest = rows.where("text is not null and grp is not null").join(fitting(listed), "grp", "left_anti").unionByName(rows.where("text is null or grp is null"))
    return found.unionByName(rest.select("row_id", "text", F.lit(0).alias("n_removed")))
