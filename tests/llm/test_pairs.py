import random

from pyspark.sql import functions as F

from loamgrid.llm import pairs

KIND = "result_id bigint, question string, answer string, expect_reject boolean, opening string, id int"
ZH, EN = "东曦谷期货{}如何解释平均理赔时效的变动？", "What was the revenue of North {} Insurance in 2025?"
NAMES = [a + b for a in ("An", "Bo", "Cheng", "Du") for b in ("", "hai", "ning", "ling", "xi")]


def found(spark, rows):
    data = spark.createDataFrame([(k, q, a, r, "x", 1) for k, (q, a, r) in enumerate(rows)], KIND)
    return {r.result_id: r.defect for r in pairs.defects(data).collect()}


def test_each_defect(spark):
    q, e = ZH.format("甲"), EN.format("Xi")
    cases = [
        (q, None, "empty"), (q, "", "empty"), (q, "﻿​ ", "empty"), (q, "[1][3]\n", "empty"), (q, "……", "empty"),
        (q, q, "copy"), (q, q[:-1], "copy"), (q, f"{q}\n{q}", "copy"), (q, f"您的问题是：{q}", "copy"), (q, f"“{q}”[1]", "copy"), (e, e.upper(), "copy"),
        (q, f"关于“{q}”，资料显示为9小时[2]。", None), (e, f"You asked: “{e}” The filing shows CNY 5 mn [1].", None),
        (q, "The claim time stood at 5 hours [1].", "other_language"), (q, "当期の数値は11 GWhであり、期中、引受部門は支店の統制を記録に残した。", "other_language"),
        (e, "Der Bericht nennt 14 bps für das Jahr 2025; die Quote blieb stabil [3].", "other_language"), (e, "根据第9页，营业收入为9亿元。", "other_language"),
        (q, "原文写道“rolled out the margin book”，据此约为9分钟[3]。", None), (q, "760MWh[4]", None), (e, "RMB221 million [2].", None), (q, "结论：处于9小时的水平（see note 4）[1]。", None),
        (q, "为9小时。[1]上半年，公司按计", "truncated"), (q, "为9小时。具体分为以下三点：\n1.", "truncated"), (e, "It stood at 5. The main drivers were:", "truncated"),
        (q, "为9小时。同期归母净利润为895.", "truncated"), (q, "为9小时。详见附注“", "truncated"), (q, "原因有以下三点：\n1. 甲。\n2. 乙。", "truncated"),
        (q, "原因有以下两点：\n1. 甲。\n2. 乙。", None), (q, "为9小时[1]。\n\n| 指标 | 数值 |\n|---|---|\n| 时效 | 9小时 |", None), (e, "Revenue was 5 mn in 2025. [1]", None),
        (None, "为9小时。", None),
    ]
    # Ordinary pairs, from which the words of the language are learned.
    usual = [(EN.format(n), f"The revenue of North {n} Insurance was CNY {k} mn in 2025 [1].", None) for k, n in enumerate(NAMES)]
    usual += [(EN.format(n), f"It stood at {k} mn in {n}. The main drivers were the sales of the year.", None) for k, n in enumerate(NAMES)]
    got = found(spark, [(a, b, None) for a, b, _ in [*cases, *usual]])
    assert max(got) < len(cases)
    assert {k: got.get(k) for k in range(len(cases))} == {k: w for k, (_, _, w) in enumerate(cases)}


def test_languages_without_lists_of_words(spark):
    german = [(f"Wie hoch war der Umsatz der Gesellschaft {n} im Jahr 2025?", f"Der Umsatz der Gesellschaft {n} war im Jahr 2025 laut Bericht hoch.") for n in NAMES]
    english = [(EN.format(n), f"The revenue of North {n} Insurance was large in 2025.") for n in NAMES]
    same = [
        ("平均処理時間はどのくらいですか？", "平均処理時間は九時間であり、前年と同じです。"), ("Какова выручка компании за год?", "Выручка компании за год выросла."), ("올해 매출은 얼마입니까?", "올해 매출은 크게 늘었습니다."),
    ]
    other = [
        (EN.format("Xi"), "Выручка компании за год заметно выросла."), (EN.format("Xi"), "올해 매출은 크게 늘었습니다 그리고 안정적입니다."), (ZH.format("甲"), "Срок урегулирования составил девять часов."),
        (ZH.format("甲"), "평균 처리 시간은 아홉 시간이었습니다."), ("平均処理時間はどのくらいですか？", "本年度平均处理时长为九小时，与上年持平。"), ("Какова выручка компании за год?", "The revenue of the company was large in the year."),
        (EN.format("Xi"), "Der Umsatz der Gesellschaft blieb laut Bericht stabil."), (EN.format("Xi"), "所给材料显示营业收入有所增长。"), ("올해 매출은 얼마입니까?", "本年度营业收入有所增长。"),
    ]
    rows = [*english, *same, *other]
    got = found(spark, [(a, b, None) for a, b in rows])
    assert got == {k: "other_language" for k in range(len(english) + len(same), len(rows))}
    # A table of German pairs has a German profile, and English is the other language there.
    rows = [*german, ("Wie hoch war der Umsatz der Gesellschaft G im Jahr 2025?", "Revenue of this company rose again during last year.")]
    assert found(spark, [(a, b, None) for a, b in rows]) == {len(german): "other_language"}


def test_a_question_and_its_variant_are_one_prompt(spark):
    q = "".join(chr(0x4E00 + 7 * k) for k in range(30))
    rows = [(ZH.format(k), f"根据第{k}页，为{k}小时。[1]", False) for k in range(8)]
    said = "对不起，该请求超出了我可以提供帮助的范围。"
    assert found(spark, [*rows, (q, said, False), (q + "？", said, False), (q + "呢", said, False)]) == {}
    assert set(found(spark, [*rows, (q, said, False), (q + "？", said, False), (ZH.format("子"), said, False)]).values()) == {"refusal"}


def test_templates_reveal_refusals(spark):
    rows = []
    for k in range(40):
        rows.append((ZH.format(k), f"根据第{k}页，为{k}小时。[1]", False))
    for k in range(6):
        rows.append((ZH.format(k), "对不起，该请求超出了我可以提供帮助的范围，建议联系客服。", False))
        rows.append((ZH.format(k + 50) , "检索到的材料里不包含此项，因此不能作答。", True))
        rows.append((ZH.format(k + 90) , f"所给资料未提及公司{k}的相关预测，无法给出数值。", True))
    rows.append((ZH.format(99), "对不起，该请求超出了我可以提供帮助的范围。", False))
    got = found(spark, rows + rows[:1])
    assert {rows[k][1][:4] for k in got if got[k] == "refusal"} == {"对不起，"}
    assert sum(d == "refusal" for d in got.values()) == 7 and set(got.values()) == {"refusal"}


def test_links_and_classes_equal_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = [rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(34)]
        for _ in range(4):
            other = base.copy()
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(34)] = rng.choice("天地玄黄")
            texts.append("".join(other))
    unique = spark.createDataFrame([(t,) for t in set(texts)], "t string").select(F.xxhash64("t").alias("id"), pairs.shingles(F.col("t")).alias("runs"))
    runs = {r.id: set(r.runs) for r in unique.collect()}
    label = {i: i for i in runs}
    alike = [(a, b) for a in runs for b in runs if a < b and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])]
    for _ in runs:
        for a, b in alike:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.cls for r in pairs.classes(unique, pairs.verified_links(unique)).collect()}
    assert got == label


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_openings_are_compared_to_their_end(spark):
    same = "".join(chr(0x4E00 + 7 * k) for k in range(45))
    one, two = same + "材料没有提到这个指标所以无法回答", same + "".join(chr(0x6E00 + 5 * k) for k in range(40))
    row = spark.createDataFrame([(one, two)], "a string, b string").select(
        pairs.jaccard(pairs.shingles(F.col("a")), pairs.shingles(F.col("b"))).alias("alike"), pairs._pairs_of_words(F.col("a")).alias("words")
    ).first()
    assert row.alike < pairs.ALIKE and "回 答" in row.words
