import random
import re
from collections import Counter

from loamgrid.llm import repeated_lines


def brute(rows, min_rows=3, share=0.2):
    """Exact counts by source."""
    rows = {k: (g, t) for k, g, t in rows if t is not None and g is not None}
    keys = {k: [re.sub("[0-9]+", "0", x.strip(" ")) for x in t.split("\n")] for k, (_, t) in rows.items()}
    size = Counter(g for g, _ in rows.values())
    n = Counter((rows[k][0], x) for k, xs in keys.items() for x in set(xs) if x)
    return {(k, i) for k, xs in keys.items() for i, x in enumerate(xs) if x and n[rows[k][0], x] >= min_rows and n[rows[k][0], x] >= share * size[rows[k][0]]}


def table(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "id bigint, grp string, text string, key int")


def rows(seed=1):
    rng, out = random.Random(seed), []
    for k in range(300):
        g = rng.choice(["a", "a", "b", "c", None])
        lines = [f"句{rng.random()}" for _ in range(rng.randint(0, 6))]
        for line, p in ((f"第 {k} 页 {g}", 0.5), ("（完）", 0.3), (f"  分享 {g}　", 0.15), ("", 0.5)):
            if rng.random() < p:
                lines.insert(rng.randint(0, len(lines)), line)
        out.append((k, g, "\n".join(lines)))
    return [*out, (900, "a", None), (901, "a", ""), (902, "z", "（完）\n（完）")]


def test_equals_exact_counts(spark):
    data = rows()
    folded = [(k, g, None if t is None else t.replace("（", "(").replace("）", ")").replace("　", " ")) for k, g, t in data]
    found = repeated_lines.lines_to_remove(table(spark, data + data[:20]), "id", "grp", "text")
    assert {tuple(r) for r in found.collect()} == brute(folded)


def test_a_notice_of_all_sources_is_found(spark):
    data = [(k, "abcd"[k % 4], f"x{k}a\n免责声明" if k % 3 else f"x{k}b") for k in range(120)]
    data = [(k, g, t.replace(f"x{k}", "x" * (k + 1))) for k, g, t in data]
    assert {tuple(r) for r in repeated_lines.lines_to_remove(table(spark, data), "id", "grp", "text").collect()} == brute(data) != set()


def test_one_source_and_empty_table(spark):
    data = [(k, "only", ("y" * k) + "\n尾") for k in range(30)]
    assert {tuple(r) for r in repeated_lines.lines_to_remove(table(spark, data), "id", "grp", "text").collect()} == {(k, 1) for k in range(30)}
    assert repeated_lines.lines_to_remove(table(spark, data).limit(0), "id", "grp", "text").count() == 0


def test_share_at_the_edge(spark):
    # One source with a line in a fifth of its rows; a line just above the share in one source and just below it in the others.
    data = [(k, "only", "y" * (k + 1) + ("\n尾" if k % 5 == 0 else "")) for k in range(100)]
    assert {tuple(r) for r in repeated_lines.lines_to_remove(table(spark, data), "id", "grp", "text").collect()} == brute(data) != set()
    data = [(k, "abcd"[k % 4], "y" * (k + 1) + ("\n尾" if (k // 4) % 50 < (12 if k % 4 == 0 else 9) else "")) for k in range(800)]
    assert {tuple(r) for r in repeated_lines.lines_to_remove(table(spark, data), "id", "grp", "text").collect()} == brute(data) != set()


def test_many_lists_are_salted(spark, monkeypatch):
    data = rows(3)
    want = {tuple(r) for r in repeated_lines.lines_to_remove(table(spark, data), "id", "grp", "text").collect()}
    whole = {tuple(r) for r in repeated_lines.without_running_lines(table(spark, data + data[:9]), "id", "grp", "text").collect()}
    monkeypatch.setattr(repeated_lines, "LISTS", 0)
    assert {tuple(r) for r in repeated_lines.lines_to_remove(table(spark, data), "id", "grp", "text").collect()} == want
    got = repeated_lines.without_running_lines(table(spark, data + data[:9]), "id", "grp", "text").collect()
    assert {tuple(r) for r in got} == whole and len(got) == len(data)
    lines = {k: (t or "").split("\n") for k, _, t in data}
    kept = {k: "\n".join(x for i, x in enumerate(xs) if (k, i) not in want) for k, xs in lines.items()}
    assert {r.row_id: r.text or "" for r in got} == kept


def test_rest_is_put_together_by_position(spark):
    data = [(k, "s", f"{'z' * k}\n尾 {k}\n\n{'w' * k}") for k in range(1, 12)] + [(50, "s", None), (51, "s", "")]
    got = {r.row_id: (r.text, r.n_removed) for r in repeated_lines.without_running_lines(table(spark, data), "id", "grp", "text").collect()}
    assert got[3] == ("zzz\n\nwww", 1) and got[50] == (None, 0) and got[51] == ("", 0)


def test_ratio_grows_with_excess(spark):
    data = spark.createDataFrame([(10, 20, 0, 100), (5, 20, 0, 100), (5, 20, 25, 100), (0, 20, 5, 100)], "a int, n int, b int, m int")
    g = [r.g for r in data.select(repeated_lines.log_likelihood_ratio(data.a, data.n, data.b, data.m).alias("g")).collect()]
    assert g[0] > g[1] > g[2] == g[3] == 0
