"""Mixing sources to target weights: a min-cost flow from patterns of membership to the quotas of sources.

Records with one text, once in one form, are one text that several sources hold, a source perhaps by several records. Records are
added up by the set of sources that hold their text, its pattern: few rows, whatever the corpus. A flow routes the tokens of patterns
to the quotas; each record of a source can be used, as often as the source may repeat. Each further use of
a text costs more than the one before, so that small sources repeat only as often as they must, and evenly. For each source, the records of
a pattern lie on a circle in a seeded order, further copies of a text behind the first ones, and the source takes an arc as long as
its flow: a record is used as often as the arc holds all of it. What records at the ends of arcs leave open is filled in further rounds
by records that fit, until none fits.

Where each record lies is a running sum over hash buckets, first of the buckets and then within each, so that no task holds a source.

Defined results: records without a source, of a source without a target or without tokens aren't chosen; a record delivered again
counts once; a source without records gets a share of 0 and the others keep their proportions; repeats of a source are at least 1
and null ones are 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.llm.canon import canonical
from loamgrid.llm.tokens import TOKENIZER, token_count
from loamgrid.session import durable, small

#: Pairs of a pattern and a source that the driver routes at most, as three arrays of numbers; beyond that `mix` raises. Sources of
#: a corpus are few, and texts held by several of them make far fewer patterns than there are texts.
ARCS = 5_000_000


class Flow:
    """Tokens of patterns on their way to sources, by levels of cost.

    A first use costs nothing, a second one 1 and so on, and nothing else has a cost. The cheapest way to the sources with
    an open quota therefore costs the level of the supply it begins at: all that the supply of a level can give is sent before
    the next level is opened. A way leads from a pattern with supply to a source, or on by moving what another pattern
    gave to that source to a further one. All patterns that can give to a way do so at once.
    """

    def __init__(self, pattern: np.ndarray, source: np.ndarray, room: np.ndarray, quotas: np.ndarray):
        self.pattern, self.source, self.room, self.open = pattern, source, room.copy(), quotas.copy()
        self.sent = np.zeros(len(pattern), np.int64)
        self.of = [np.flatnonzero(source == s) for s in range(len(quotas))]

    def way(self, supply: np.ndarray) -> list[int] | None:
        """Sources of the shortest way to one with an open quota."""
        giving, seen = supply > 0, np.zeros(len(self.open), bool)
        layers: list[np.ndarray] = []
        while True:
            met = np.zeros(len(self.open), bool)
            met[self.source[giving[self.pattern] & (self.room > 0)]] = True
            met &= ~seen
            if not met.any():
                return None
            layers.append(np.flatnonzero(met))
            if (met & (self.open > 0)).any():
                break
            seen |= met
            giving = np.zeros(len(supply), bool)
            giving[self.pattern[met[self.source] & (self.sent > 0)]] = True
        out = [int(layers[-1][self.open[layers[-1]] > 0][0])]
        for layer in reversed(layers[:-1]):
            takes = self.of[out[0]]
            can = np.zeros(len(supply), bool)
            can[self.pattern[takes[self.room[takes] > 0]]] = True
            gives = np.zeros(len(self.open), bool)
            gives[self.source[can[self.pattern] & (self.sent > 0)]] = True
            out.insert(0, int(layer[gives[layer]][0]))
        return out

    def send(self, supply: np.ndarray) -> None:
        """Sends what the supply can give; takes it from the supply."""
        while (way := self.way(supply)) is not None:
            steps, most = [], int(self.open[way[-1]])
            for k, to in enumerate(way):
                into = self.of[to]
                if not k:
                    out, held = self.pattern[into], supply[self.pattern[into]]
                else:
                    before = self.of[way[k - 1]]
                    _, x, y = np.intersect1d(self.pattern[before], self.pattern[into], assume_unique=True, return_indices=True)
                    out, into = before[x], into[y]
                    held = self.sent[out]
                can = np.minimum(held, self.room[into])
                steps.append((out, into, can))
                most = min(most, int(can.sum()))
            for k, (out, into, can) in enumerate(steps):
                moved = np.clip(most - (np.cumsum(can) - can), 0, can)
                if k:
                    self.sent[out] -= moved
                    self.room[out] += moved
                else:
                    supply[out] -= moved
                self.sent[into] += moved
                self.room[into] -= moved
            self.open[way[-1]] -= most


@dataclass(frozen=True)
class Plan:
    """total: tokens of the whole mix; quotas by source; arcs: (pattern, source) and where its arc on the source's circle begins and ends."""

    total: int
    quotas: dict[str, int]
    arcs: list[tuple[int, str, int, int]]


def largest_total(held: dict[str, int], wanted: dict[str, tuple[float, int]]) -> int:
    """The largest mix in which each source keeps its share: none can give more than all it holds as often as it may, and each
    can give that much, as a record belongs to one source."""

    def fits(total: int) -> bool:
        return all(round(total * share) <= held[s] * repeats for s, (share, repeats) in wanted.items())

    low, high = 0, int(min(((held[s] * repeats + 1) / share for s, (share, repeats) in wanted.items()), default=0)) + 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low


def route(arcs: list[tuple[int, str, int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> Plan:
    """Routes the tokens of patterns to sources. Without a total, the largest at which all sources with records keep their share.

    arcs has pattern, source, tokens of its records and tokens of its texts once; patterns are numbered from 0.
    """
    held: dict[str, int] = {}
    for _, s, tokens, _ in arcs:
        held[s] = held.get(s, 0) + tokens
    wanted = {s: (share, repeats) for s, (share, repeats) in targets.items() if s in held and share > 0}
    names = sorted(wanted)
    if total is None:
        total = largest_total(held, wanted)
    quotas = {s: round(total * wanted[s][0]) for s in names}
    at = {s: k for k, s in enumerate(names)}
    mine = [x for x in arcs if x[1] in at]
    if not mine:
        return Plan(total, quotas, [])
    pattern, source = np.array([x[0] for x in mine]), np.array([at[x[1]] for x in mine])
    tokens, once = np.array([x[2] for x in mine], np.int64), np.array([x[3] for x in mine], np.int64)
    repeats = np.array([wanted[names[s]][1] for s in source], np.int64)
    n = int(pattern.max()) + 1
    texts, rounds, levels = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(texts, pattern, once)
    np.maximum.at(rounds, pattern, tokens)
    np.add.at(levels, pattern, repeats)
    flow = Flow(pattern, source, tokens * repeats, np.array([quotas[s] for s in names], np.int64))
    supply, level = texts.copy(), 0
    while True:
        flow.send(supply)
        level += 1
        if not flow.open.any() or level > levels.max():
            break
        # A copy's first use is a further use of its text.
        supply = supply + np.where(level < levels, rounds, 0) + (rounds - texts if level == 1 else 0)
    out, ends = [], [0] * n
    for k in np.flatnonzero(flow.sent).tolist():
        p, size, own = int(pattern[k]), int(flow.sent[k]), int(tokens[k])
        # Ends are told on the longest circle of the pattern and brought to the length of the source's own.
        begins = ends[p] * own // int(rounds[p])
        out.append((p, names[source[k]], begins, begins + size))
        ends[p] += -(-size * int(rounds[p]) // own)
    return Plan(total, quotas, out)


def sized_records(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens, h1 and h2 of records that can be chosen."""
    rows = documents.select("doc_id", "source", "text").where("source is not null and text is not null")
    form = canonical(F.col("text"))
    rows = rows.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens"), form.alias("f"))
    rows = rows.select("doc_id", "source", "n_tokens", F.xxhash64("f").alias("h1"), F.xxhash64("f", F.lit("salt")).alias("h2")).where("n_tokens > 0")
    return rows.join(targets.where("target_share > 0").select("source").distinct(), "source", "left_semi").dropDuplicates(["doc_id"])


def with_start(df: DataFrame, groups: list[str], place: str, size: str, ties: list[str]) -> DataFrame:
    """Adds start: the sizes that lie before a row of its group in the order of `place`, a hash.

    Buckets of the hash are added up first; only rows of one bucket are sorted together.
    """
    df = df.withColumn("_bucket", F.shiftrightunsigned(place, 52).cast("int"))  # the order of buckets is that of the hash
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, "_bucket").agg(F.sum(size).alias("_n")).select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, [*groups, "_bucket"])
    return out.withColumn("start", F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_bucket", "_before")


def filled(chosen: DataFrame, seed: int) -> DataFrame:
    """doc_id and more: further uses of records that still fit what is open of their sources' quotas, in rounds until none fits.

    Only records that are small enough take part, and each round leaves fewer; every round gives each source that any record fits
    at least one.
    """
    left = chosen.groupBy("source", "quota").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("got")).select("source", (F.col("quota") - F.col("got")).alias("open"))
    can = (F.col("repeats") < F.col("most")) & (F.col("n_tokens") <= F.col("open"))
    fits, out = chosen.join(left, "source").where(can).select("doc_id", "source", "n_tokens", "most", "repeats", "open"), None
    while True:
        seed += 1
        placed = with_start(durable(fits).withColumn("place", F.xxhash64(F.lit(seed), "doc_id")), ["source"], "place", "n_tokens", ["doc_id"])
        added = durable(placed.where(F.col("start") + F.col("n_tokens") <= F.col("open")).select("doc_id", "source", "n_tokens", F.lit(1).alias("more")))
        out = added if out is None else out.unionByName(added)
        if added.isEmpty():
            return out.groupBy("doc_id").agg(F.sum("more").cast("int").alias("more"))
        used = added.groupBy("source").agg(F.sum("n_tokens").alias("used"))
        fits = fits.join(used, "source").join(added.select("doc_id", "more"), "doc_id", "left").withColumn("open", F.col("open") - F.col("used"))
        fits = fits.withColumn("repeats", F.col("repeats") + F.coalesce("more", F.lit(0))).where(can).drop("used", "more")


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: int = 1, total: int | None = None, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens and repeats of the chosen records."""
    rows = durable(sized_records(documents, targets, path).withColumn("n_tokens", F.col("n_tokens").cast("bigint")))
    # One row for each text with the sources that hold it and the first record of each; all others are copies.
    held = rows.groupBy("h1", "h2", "source").agg(F.min("doc_id").alias("doc_id"))
    texts = held.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("source")).alias("pattern"), F.collect_list("doc_id").alias("firsts"))
    texts = texts.select("h1", "h2", F.xxhash64("pattern").alias("p1"), F.xxhash64("pattern", F.lit("salt")).alias("p2"), "firsts")
    rows = rows.join(texts, ["h1", "h2"]).withColumn("copy", ~F.array_contains("firsts", F.col("doc_id")))
    # Copies have the first bit, so that they lie behind; their place is by doc_id, as a text may have any number of them.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h1", "h2"), 1)
    behind = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h1", "h2", "doc_id"), 1).bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))
    rows = durable(rows.select("doc_id", "source", "n_tokens", "p1", "p2", "copy", F.when(F.col("copy"), behind).otherwise(place).alias("place")))
    sums = rows.groupBy("p1", "p2", "source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("copy"), F.lit(0)).otherwise(F.col("n_tokens"))).alias("once"))
    sums = sums.limit(ARCS + 1).toPandas().sort_values(["p1", "p2", "source"])
    if len(sums) > ARCS:
        raise ValueError(f"more than {ARCS} pairs of a pattern and a source can't be routed by the driver")
    number = sums.groupby(["p1", "p2"], sort=False).ngroup()
    ids = list(zip(sums.p1.tolist(), sums.p2.tolist(), strict=True))
    pairs = list(zip(number.tolist(), sums.source.tolist(), sums.tokens.tolist(), sums.once.tolist(), strict=True))
    own = {(k, s): (ids[at], tokens) for at, (k, s, tokens, _) in enumerate(pairs)}
    wanted = {r.source: (r.target_share or 0.0, max(r.max_repeats or 1, 1)) for r in small(targets.select("source", "target_share", "max_repeats"), 100_000, "targets")}
    plan = route(pairs, wanted, total)
    arcs = [(*own[k, s][0], s, a, b, own[k, s][1]) for k, s, a, b in plan.arcs]
    arcs = spark.createDataFrame(arcs, "p1 bigint, p2 bigint, source string, begins bigint, ends bigint, round bigint")
    quotas = spark.createDataFrame([(s, n, wanted[s][1]) for s, n in plan.quotas.items()], "source string, quota bigint, most int")
    lain = with_start(rows, ["p1", "p2", "source"], "place", "n_tokens", ["doc_id"])
    lain = lain.join(arcs, ["p1", "p2", "source"], "left").join(quotas, "source")
    turns = F.floor((F.col("ends") - F.col("start") - F.col("n_tokens")) / F.col("round")) - F.ceil((F.col("begins") - F.col("start")) / F.col("round")) + 1
    chosen = durable(lain.select("doc_id", "source", "n_tokens", "quota", "most", F.greatest(F.coalesce(turns, F.lit(0)), F.lit(0)).cast("int").alias("repeats")))
    chosen = chosen.join(filled(chosen, seed), "doc_id", "left").withColumn("repeats", F.col("repeats") + F.coalesce("more", F.lit(0)))
    return chosen.where("repeats > 0").select("doc_id", "source", F.col("n_tokens").cast("int").alias("n_tokens"), "repeats")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source its target, the share reached, tokens, records and the most repeats of a record."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(F.broadcast(whole))  # one row
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "records", "most_repeats")]
    return rows.select("source", "target_share", "max_repeats", *filled, F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"))
