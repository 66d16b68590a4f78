import random
import time

import numpy as np
import pyarrow as pa
import pytest

from loamgrid.llm import mixing, splitting
from loamgrid.llm.tokens import tokenized, tokenizer

PROFILES = [("s", 32, 8), ("m", 100, 0), ("x", 8, 6)]


def texts():
    rng = random.Random(3)
    parts = ["报告期内，公司持续优化产品结构。", "Over the year, the group tightened controls. ", "\n\n", "\n", "甲 | 12,3 | 乙\n", "！？", "  ", "龘龘靐", "word", "😀é", "”）", "　", "_▁"]
    return ["", "短。", "x" * 3000, "中" * 2000, " " * 500, "\n" * 300, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 200))) for _ in range(40))]


def test_pieces_make_the_text_again_within_the_limit():
    model, values = tokenizer(), texts()
    made = {}
    for row, name, k, over, n, part in splitting.pieces_of(values, PROFILES):
        made.setdefault((row, name), []).append((k, over, n, part))
    for row, value in enumerate(values):
        for name, limit, overlap in PROFILES:
            parts = made.get((row, name), [])
            assert [p[0] for p in parts] == list(range(len(parts)))
            assert b"".join(p.encode()[over:] for _, over, _, p in parts).decode() == value
            for (_, over, n, part), before in zip(parts, [None, *parts], strict=False):
                assert n == len(model.encode_ordinary(part))
                assert n <= max(limit, 12)  # a character may have more tokens than a very small limit
                if before and overlap and limit > 20:
                    lap = len(model.encode_ordinary(part.encode()[:over].decode()))
                    assert lap >= min(overlap, before[2]) - 2 and lap <= overlap + 4
            if len(model.encode_ordinary(value)) <= limit:
                assert len(parts) == bool(value)


def test_natural_boundaries_first():
    value = "".join(f"第{k}句话写在这里，它有两个分句。" for k in range(40))
    parts = [p for *_, p in splitting.pieces_of([value], [("a", 120, 0)])]
    assert len(parts) > 3 and all(p.endswith("。") for p in parts)
    value = "\n\n".join("一句话。" * 6 for _ in range(12))
    parts = [p for *_, p in splitting.pieces_of([value], [("a", 90, 0)])]
    assert all(p.endswith("\n\n") for p in parts[:-1])


def test_split_table(spark):
    rows = spark.createDataFrame([(1, "句子。" * 80, "p"), (2, None, "p"), (3, "", None), (4, "短", None)], "doc_id bigint, text string, profile string")
    limits = spark.createDataFrame([("a", 40, 5), ("b", 1000, None), ("none", None, 1)], "profile string, max_tokens int, overlap_tokens int")
    got = splitting.split_texts(rows, limits).collect()
    assert {(r.doc_id, r.profile) for r in got} == {(1, "a"), (1, "b"), (4, "a"), (4, "b")} and all(r.n_tokens <= 40 for r in got if r.profile == "a")
    assert splitting.split_texts(rows.limit(0), limits).count() == 0


def test_flow_prefers_few_repeats():
    # Text that only A holds, text that both hold: A's quota needs the shared text, B's must then repeat.
    plan = mixing.route([(0, "a", 100, 100), (1, "a", 100, 100), (1, "b", 100, 100)], {"a": (0.5, 1), "b": (0.5, 2)})
    sizes = {(k, s): y - x for k, s, x, y in plan.arcs}
    assert plan.total > 300 and sizes[0, "a"] == 100 and sizes[1, "b"] > 100
    assert mixing.route([], {"a": (1.0, 1)}).arcs == []
    plan = mixing.route([(0, "a", 10, 10)], {"a": (0.5, 3), "gone": (0.5, 1)})
    assert plan.total == pytest.approx(60, abs=1)


def plain_cost(arcs, targets, total):
    """Cost of the cheapest flow by augmenting along cheapest paths one by one, and what it sends."""
    patterns, sources = sorted({a[0] for a in arcs}), sorted({a[1] for a in arcs if a[1] in targets})
    edges, graph = [], {}

    def arc(a, b, room, cost=0):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            graph.setdefault(x, []).append(len(edges))
            edges.append([y, r, c])

    for k in patterns:
        mine = [a for a in arcs if a[0] == k and a[1] in targets]
        if not mine:
            continue
        rounds, once = max(a[2] for a in mine), max(a[3] for a in mine)
        for again in range(sum(targets[a[1]][1] for a in mine)):
            arc("from", k, rounds if again else once, again)
            if not again:
                arc("from", k, rounds - once, 1)
        for _, s, tokens, _ in mine:
            arc(k, s, tokens * targets[s][1])
    for s in sources:
        arc(s, "to", round(total * targets[s][0]))
    sent = cost = 0
    while True:
        best, by, changed = {"from": 0}, {}, True
        while changed:
            changed = False
            for x in list(best):
                for e in graph.get(x, []):
                    y, room, c = edges[e]
                    if room > 0 and best[x] + c < best.get(y, 1 << 60):
                        best[y], by[y], changed = best[x] + c, e, True
        if "to" not in by:
            return cost, sent
        path, y = [], "to"
        while y != "from":
            path.append(by[y])
            y = edges[by[y] ^ 1][0]
        step = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= step
            edges[e ^ 1][1] += step
        sent, cost = sent + step, cost + step * best["to"]


def cost_of(plan, arcs, targets):
    """What the uses of each pattern cost when its cheapest are taken."""
    used, cost = {}, 0
    for k, _, a, b in plan.arcs:
        used[k] = used.get(k, 0) + b - a
    for k, n in used.items():
        mine = [a for a in arcs if a[0] == k and a[1] in targets]
        rounds, once = max(a[2] for a in mine), max(a[3] for a in mine)
        slabs = [(0, once), (1, rounds - once), *((again, rounds) for again in range(1, sum(targets[a[1]][1] for a in mine)))]
        for level, size in slabs:
            took = min(size, n)
            n, cost = n - took, cost + level * took
        assert n == 0
    return cost


def test_the_flow_is_the_cheapest_and_fills_all_quotas():
    rng = random.Random(4)
    for _ in range(60):
        names = "abcd"[: rng.randint(1, 4)]
        arcs = []
        for k in range(rng.randint(1, 6)):
            for s in rng.sample(names, rng.randint(1, len(names))):
                once = rng.randint(1, 30)
                arcs.append((k, s, once + rng.choice([0, 0, rng.randint(1, 20)]), once))
        weights = [rng.random() + 0.05 for _ in names]
        targets = {s: (w / sum(weights), rng.randint(1, 3)) for s, w in zip(names, weights, strict=True)}
        plan = mixing.route(arcs, targets)
        sent = {}
        for _, s, a, b in plan.arcs:
            sent[s] = sent.get(s, 0) + b - a
        assert {s: n for s, n in plan.quotas.items() if n} == sent
        held = {s: sum(a[2] for a in arcs if a[1] == s) * targets[s][1] for s in plan.quotas}
        assert any(round((plan.total + 1) * targets[s][0]) > held[s] for s in plan.quotas)
        smaller = rng.randint(0, plan.total)
        for total in (plan.total, smaller):
            cost, sent = plain_cost(arcs, targets, total)
            plan = mixing.route(arcs, targets, total)
            assert sent == sum(plan.quotas.values()) and cost_of(plan, arcs, targets) == cost


def test_thousands_of_patterns_are_routed_at_once():
    rng = random.Random(6)
    names = [f"s{k}" for k in range(24)]
    arcs = [(k, s, n, n) for k in range(20_000) for n in [rng.randint(1, 10**7)] for s in rng.sample(names, rng.randint(1, 6))]
    shares = [rng.random() + 0.02 for _ in names]
    targets = {s: (w / sum(shares), rng.randint(1, 4)) for s, w in zip(names, shares, strict=True)}
    began = time.process_time()
    plan = mixing.route(arcs, targets)
    assert time.process_time() - began < 20
    held = {s: sum(a[2] for a in arcs if a[1] == s) * targets[s][1] for s in names}
    assert all(n <= held[s] for s, n in plan.quotas.items()) and any(round((plan.total + 1) * targets[s][0]) > held[s] for s in names)
    sent = dict.fromkeys(names, 0)
    for _, s, a, b in plan.arcs:
        sent[s] += b - a
    assert sent == plan.quotas


DOCS = "doc_id bigint, text string, source string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_and_keeps_caps(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for source, n in (("a", 300), ("b", 60), ("c", 20), (None, 5), ("other", 5)):
        for _ in range(n):
            k += 1
            rows.append((k, f"文{k}" + "字" * rng.randint(1, 60), source, 1))
    rows += [(9001, "共有文本", "a", 1), (9002, "共有文本", "b", 1), (9003, "", "a", 1), (9004, None, "b", None), rows[0]]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.1, 4), ("none", 0.2, 3)], TARGETS)
    docs = spark.createDataFrame(rows, DOCS)
    chosen = mixing.mix(spark, docs, targets)
    got = chosen.collect()
    caps = {"a": 1, "b": 2, "c": 4}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.repeats <= caps[r.source] for r in got)
    source = {r[0]: r[2] for r in rows}
    assert all(source[r.doc_id] == r.source for r in got)
    shares = {r.source: r.reached_share for r in mixing.shares(chosen, targets).collect()}
    assert shares["none"] == 0 and all(abs(shares[s] - w) < 0.01 for s, w in (("a", 0.625), ("b", 0.25), ("c", 0.125)))
    assert sorted(map(tuple, mixing.mix(spark, docs, targets).collect())) == sorted(map(tuple, got))
    assert mixing.mix(spark, docs.limit(0), targets).count() == 0


def test_each_record_of_a_repeated_text_counts(spark):
    # Source a is three records of one text, two of another and a near copy in other characters; b repeats a text of a.
    rows = [(k, "甲文本，写了一些字。", "a", 1) for k in (1, 2, 3)] + [(4, "乙文本", "a", 1), (5, "乙文本", "a", 1), (6, "乙\u200b文本", "a", 1)]
    rows += [(7, "乙文本", "b", 1), (8, "丙" * 40, "b", 1), rows[0]]
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    got = {r.doc_id: r.repeats for r in mixing.mix(spark, spark.createDataFrame(rows, DOCS), targets).collect()}
    assert got == dict.fromkeys(range(1, 7), 2)
    # The routed repeats are spread over the records: none is used again before all are used.
    whole = sum(r.n_tokens for r in mixing.mix(spark, spark.createDataFrame(rows[:3], DOCS), targets).collect())
    got = {r.doc_id: r.repeats for r in mixing.mix(spark, spark.createDataFrame(rows[:3], DOCS), targets, total=whole * 4 // 3).collect()}
    assert sorted(got.values()) == [1, 1, 2] and set(got) == {1, 2, 3}
    # Copies wait until each text is used once.
    once = mixing.mix(spark, spark.createDataFrame(rows[:5], DOCS), targets, total=whole * 2 // 3)
    assert {1, 4} <= {r.doc_id for r in once.collect()}


def test_copies_count_in_the_flow():
    # A has 100 tokens of texts in 300 tokens of records: the mix needn't shrink to one record for each text.
    plan = mixing.route([(0, "a", 300, 100), (1, "b", 300, 300)], {"a": (0.5, 1), "b": (0.5, 1)})
    assert plan.total > 590 and {(k, s): y - x for k, s, x, y in plan.arcs}[0, "a"] > 295
    # Copies of a are used only when the texts that a shares with b are.
    plan = mixing.route([(0, "a", 300, 100), (1, "a", 100, 100), (1, "b", 100, 100)], {"a": (1.0, 1), "b": (0.0, 1)}, 200)
    assert {(k, s): y - x for k, s, x, y in plan.arcs} == {(0, "a"): 100, (1, "a"): 100}


def test_sizes_are_those_of_the_tokenizer():
    model = tokenizer()
    values = [*texts(), "it's we'll DON'T １２ ½²Ⅷ٣ _x_  \n\t y　z\x85\x1c", "​  ﻿a", "''s 's\n's 'll'd 'l 're're 'S a's'st", "'", "x'", " '", "'t", "s"]
    rng = random.Random(5)
    values += ["".join(rng.choice(["'", "s", "re", "l", "ll", " ", "  ", "\n", "1", "x", "中", "!", "é", "　"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    block = tokenized(pa.array([None, *values]))
    sizes = np.diff(block.bounds).tolist()
    for k, value in enumerate(values, 1):
        wanted = [len(model.decode_single_token_bytes(t)) for t in model.encode_ordinary(value)]
        assert sizes[block.first[k] : block.first[k + 1]] == wanted, value


def plainly_merged(sizes, strengths, first, rest):
    """Sizes of the pieces, by looking through all pairs at each step; strength by strength, and then the first piece takes up what fits."""
    parts = [[n, k] for n, k in zip(sizes, strengths, strict=True)]
    for level in range(splitting.EDGE):
        while True:
            fits = [(parts[i][0] + parts[i + 1][0], i) for i in range(len(parts) - 1) if parts[i][1] == level and parts[i][0] + parts[i + 1][0] <= (rest if i else first)]
            if not fits:
                break
            n, i = min(fits)
            parts[i : i + 2] = [[n, parts[i + 1][1]]]
        while len(parts) > 1 and parts[0][1] <= level and parts[0][0] + parts[1][0] <= first:
            parts[:2] = [[parts[0][0] + parts[1][0], parts[1][1]]]
    return [n for n, _ in parts]


def test_merging_by_levels_is_plain_agglomeration():
    rng = random.Random(11)
    for _ in range(300):
        rest = rng.randint(5, 60)
        first = rest + rng.randint(0, 20)
        cases = [([rng.randint(1, rest) for _ in range(rng.randint(1, 40))], []) for _ in range(3)]
        cases = [(sizes, [rng.choice(range(splitting.EDGE)) for _ in sizes[1:]] + [splitting.EDGE]) for sizes, _ in cases]
        ends = np.cumsum([n for sizes, _ in cases for n in sizes])
        strengths = np.array([k for _, kinds in cases for k in kinds])
        heads = np.append(True, strengths[:-1] == splitting.EDGE)
        got = np.diff(splitting.merged(ends, strengths, heads, first, rest), prepend=0).tolist()
        assert got == [n for sizes, kinds in cases for n in plainly_merged(sizes, kinds, first, rest)]
