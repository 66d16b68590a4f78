import random

import pyarrow as pa

from loamgrid.llm import leakage


def plainly(text):
    return "".join(c.casefold() for c in text if c.isalnum())


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        t = plainly(t or "")
        for i, x in items:
            x = plainly(x or "")
            if any(x[k : k + run] in t for k in range(len(x) - run + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, pos int"), spark.createDataFrame([(*i, "k") for i in items], "item_id bigint, text string, term string")


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "保单", "持有人", "变更", "受益", "42", "第7期"]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(12)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(60)]
    for k in range(20):
        i, x = rng.choice(items)
        a = rng.randint(0, 60)
        docs.append((100 + k, "前文，" + x[a : a + rng.randint(30, 90)].upper().replace(" ", "—") + "。后文"))
    docs += [(500, None), (501, ""), (502, items[0][1] * 50), (100, docs[60][1])]
    items += [(90, None), (91, ""), (92, "short")]
    a, b = frames(spark, docs, items)
    assert {tuple(r) for r in leakage.leaked(a, b, 40).collect()} == brute(docs, items, 40)


def test_one_index_serves_several_sets_of_items(spark, tmp_path):
    items = [(k, f"条目{k}" + "".join(chr(0x4E00 + (k * 97 + j * 13) % 2000) for j in range(60))) for k in range(9)]
    docs = [(k, items[k][1][3:50]) for k in range(9)] + [(20, "无关")]
    a, b = frames(spark, docs, items)
    index = leakage.build_index(a, str(tmp_path / "postings"))
    got = {tuple(r) for part in ("item_id < 4", "item_id >= 4") for r in leakage.leaked(a, b.where(part), 40, index).collect()}
    assert got == brute(docs, items, 40) != set()


def test_postings_of_a_run_do_not_depend_on_what_surrounds_it():
    rng = random.Random(9)
    for alphabet in ("ab", "abcdefghij", "a"):
        for _ in range(40):
            run = "".join(rng.choice(alphabet) for _ in range(rng.randint(leakage.REACH, 60)))
            a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2))
            first, second = leakage.postings_of(pa.array([None, a + run + b, "x"])), leakage.windows_of(pa.array([run]))
            there = {(t, p - len(a)) for t, r, p in zip(*(x.tolist() for x in first), strict=True) if r == 1}
            mine = {(t, p) for t, _, _, p in zip(*(x.tolist() for x in second), strict=True)}
            assert mine <= there and len(second[0]) == len(run) - leakage.REACH + 1
            places = sorted({p for _, p in mine})
            assert places[0] < leakage.WINDOW and places[-1] + leakage.TERM > len(run) - leakage.WINDOW and all(q - p <= leakage.WINDOW for p, q in zip(places, places[1:], strict=False))


def brute_runs(docs, items, run):
    out = set()
    for d, t in docs:
        t = plainly(t or "")
        for i, x in items:
            x = plainly(x or "")
            for offset in range(-len(x), len(t)):
                first = None
                for k in range(len(x) + 1):
                    same = k < len(x) and 0 <= k + offset < len(t) and x[k] == t[k + offset]
                    if same and first is None:
                        first = k
                    elif not same and first is not None:
                        if k - first >= run:
                            out.add((d, i, offset, first, k - 1))
                        first = None
    return out


def test_runs_equal_brute_force_also_of_periodic_text(spark):
    rng = random.Random(12)
    items = [(1, "abcde" * 12), (2, "".join(rng.choice("abcdefgh") for _ in range(90))), (3, "z" * 45), (4, "".join(rng.choice("ab") for _ in range(80)))]
    docs = []
    for k in range(30):
        i, x = rng.choice(items)
        a, b = sorted(rng.sample(range(len(x)), 2))
        docs.append((k, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20))) + x[a:b] + "q" + x[max(a - 9, 0) : b + 9] + rng.choice(["", x[:25]])))
    docs += [(90, "z" * 60), (91, "abcde" * 30), (92, items[1][1] * 2)]
    a, b = frames(spark, docs, items)
    for run in (20, 40):
        got = [tuple(r) for r in leakage.shared_runs(a, b, run).select("doc_id", "item_id", "offset", "first", "last").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_runs(docs, items, run)


def brute_chains(runs, near, whole):
    """Letters of the largest group of runs that are linked by near offsets and near places, as parts within parts."""

    def parted(rows, far):
        parts = []
        for r in rows:
            if parts and not far(parts[-1], r):
                parts[-1].append(r)
            else:
                parts.append([r])
        return parts

    best = 0
    groups = [sorted(runs)]
    for _ in range(2):
        groups = [sorted(p) for g in groups for p in parted(sorted(g), lambda part, r: r[0] - part[-1][0] > near)]
        groups = [p for g in groups for p in parted(sorted(g, key=lambda r: (r[1], r[2], r[0])), lambda part, r: r[1] - max(x[2] for x in part) > near)]
    for g in groups:
        n = len({k for _, a, b in g for k in range(a, b + 1)})
        best = max(best, n)
    return best if best >= whole else 0


def test_proximity_equals_brute_force(spark):
    rng = random.Random(31)
    items = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(100))) for k in range(4)] + [(9, "abcde" * 16)]
    docs = []
    for k in range(40):
        i, x = rng.choice(items)
        parts = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 75)
            parts += [x[a : a + rng.randint(15, 30)], "".join(rng.choice("uvwxyz") for _ in range(rng.choice([1, 3, 8, 40])))]
        docs.append((k, "".join(parts) * rng.choice([1, 1, 2])))
    a, b = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): r.letters for r in leakage.proximity(a, b).collect()}
    runs = {}
    for d, i, offset, first, last in brute_runs(docs, items, 20):
        runs.setdefault((d, i), []).append((offset, first, last))
    want = {pair: n for pair, rows in runs.items() if (n := brute_chains(rows, 12, 40))}
    assert got == want and len(want) > 5


def test_pieces_close_to_each_other(spark):
    item = "".join(chr(0x4E00 + j * 7) for j in range(80))
    docs = [(1, item[:25] + "插入" + item[25:50]), (2, item[:25]), (3, item[:30])]
    a, b = frames(spark, docs, [(1, item)])
    assert leakage.leaked(a, b).count() == 0
    assert [(r.doc_id, r.letters, r.pieces) for r in leakage.proximity(a, b).collect()] == [(1, 50, 2)]


def test_pieces_of_copies_do_not_break_each_other(spark):
    item = "".join(chr(0x4E00 + j * 7) for j in range(80))
    cut = item[:25] + "插入词语字" + item[30:55]
    docs = [(1, cut), (2, cut + "乙" * 300 + cut), (3, cut + "乙" * 90 + item[10:30] + "丙" * 90), (4, (cut + "丁" * 50) * 5)]
    # Pieces far from each other in the document, and two copies of one short piece, are no passage.
    docs += [(5, item[:25] + "戊" * 60 + item[25:50]), (6, item[:25] + "己" * 60 + item[:25])]
    a, b = frames(spark, docs, [(1, item)])
    assert leakage.leaked(a, b).count() == 0
    assert sorted((r.doc_id, r.letters, r.pieces) for r in leakage.proximity(a, b).collect()) == [(k, 50, 2) for k in (1, 2, 3, 4)]


def test_overlapping_runs_count_letters_once(spark):
    # A period of three makes runs at several offsets; together they cover 28 letters of the item.
    item = "甲乙丙" * 9 + "丁" + "".join(chr(0x4E00 + j * 7) for j in range(60))
    a, b = frames(spark, [(1, "甲乙丙" * 9 + "丁")], [(1, item)])
    assert leakage.proximity(a, b).count() == 0


def test_empty_tables(spark):
    a, b = frames(spark, [(1, "x" * 90)], [(1, "x" * 90)])
    assert leakage.leaked(a.limit(0), b).count() == leakage.leaked(a, b.limit(0)).count() == 0
    assert leakage.leaked(a, b).count() == 1
