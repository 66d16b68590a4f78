"""Broken prompt and response pairs: each defective pair with the kind of its defect.

Response openings are clustered by verified MinHash. A template that recurs across unrelated prompts, carries no evidence (no
number, citation or quotation) and isn't the stock answer to prompts that should be rejected reveals refusals. Copy, language
and termination checks label the rest, all as expressions in the JVM over texts in one form.

Unique openings only are clustered, with their counts, so that copies cost nothing. Each band of each signature meets the first
opening of its bucket. Openings that turn out unlike the first of a bucket (one template with many names in it) are then
joined exactly: two that are alike share one of their rarest shingles, so those few are compared only. Classes are the smallest
number reachable over verified links.

Defined results: a null answer is empty; a null question is no copy and has no language; a null expect_reject is false; rows delivered
again count once; at most one defect for each pair, in the order empty, copy, refusal, other_language, truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.canon import canonical
from loamgrid.session import durable

#: Words in a shingle, least similarity, hashes in a signature and rows in a band.
SHINGLE, ALIKE, HASHES, BAND = 5, 0.8, 48, 3
#: Prompts that a template must recur across.
PROMPTS = 2
#: Share of an opening's pairs of words that must be those of revealed refusals, for a wording too rare to recur.
FAMILIAR = 0.5

_MARKS = r"\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]"
_QUOTED = r"“[^”]*”|\"[^\"]*\"|「[^」]*」|『[^』]*』|《[^》]*》|‘[^’]*’"
_BRACKETS = r"\([^()]*\)|【[^】]*】"
_HAN, _KANA = r"\p{IsHan}", r"[\p{IsHiragana}\p{IsKatakana}]"
_WORD = rf"{_HAN}|{_KANA}|[\p{{L}}\p{{N}}]+"

#: Scripts whose words are parted by blanks; a word of theirs weighs as much as two characters of Chinese or Japanese.
ALPHABETS = ("Latin", "Cyrillic", "Hangul", "Greek", "Arabic", "Hebrew", "Thai", "Devanagari")
#: A word belongs to a language's profile if it stands in this share of the texts and in this many at least; a profile has at most so
#: many words, and is learned from so many texts at least.
COMMON, COMMON_TEXTS, PROFILE, LEARNED = 0.03, 3, 100, 30
#: A text of another language has a smaller share of a profile's words, a text of the same language a larger one.
TYPICAL = 0.15


def _letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, _MARKS, "")


def opening_of(answer: Column) -> Column:
    """The first sentence of an answer, in lower case and without citations; quotations count as one sign."""
    bare = F.regexp_replace(without_marks(F.trim(answer)), _QUOTED, "“”")
    return F.trim(F.lower(F.regexp_extract(bare, r"^\s*([^。！？!?\n.]*)", 1)))


def shingles(text: Column) -> Column:
    """Distinct runs of five words; a shorter text is one run. A Chinese or Japanese character is a word."""
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.array_distinct(runs)


def signature(runs: Column) -> Column:
    """MinHash of an array of shingles."""
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda seed: F.array_min(F.transform(runs, lambda x: F.xxhash64(x, seed))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _rarest(unique: DataFrame) -> DataFrame:
    """id and run: the rarest shingles of each opening, as many as make it sure that two alike openings share one."""
    runs = unique.select("id", F.size("runs").alias("k"), F.explode("runs").alias("run"))
    counted = runs.join(runs.groupBy("run").agg(F.count("*").alias("n")), "run")
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "run"))  # as many rows as an opening has shingles
    return counted.withColumn("place", place).where(F.col("place") <= F.col("k") - F.ceil(F.col("k") * ALIKE - 1e-9) + 1).select("id", "run")


def verified_links(unique: DataFrame) -> DataFrame:
    """Links a < b of alike openings that make up the classes. unique has id and runs."""
    signed = unique.select("id", "runs", signature(F.col("runs")).alias("s"))
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.get("s", F.lit(k * BAND + j)) for j in range(BAND)]) for k in range(HASHES // BAND)])
    banded = durable(signed.select("id", "runs", F.explode(bands).alias("bucket")))
    # The first of each bucket is carried to the others by an aggregate, not by pairs.
    heads = banded.groupBy("bucket").agg(F.min_by(F.struct("id", "runs"), "id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = banded.join(heads, "bucket").where(F.col("id") != F.col("head.id"))
    met = durable(met.select("id", F.col("head.id").alias("to"), (jaccard(F.col("runs"), F.col("head.runs")) >= ALIKE).alias("alike")).distinct())
    links = met.where("alike").select(F.col("to").alias("a"), F.col("id").alias("b"))
    unlike = met.where("not alike").select("id").distinct()
    rare = durable(_rarest(unique))
    near = rare.join(unlike, "id").select(F.col("id").alias("x"), "run").join(rare.select(F.col("id").alias("y"), "run"), "run").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = near.join(unique.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(unique.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    return links.unionByName(near.where(jaccard(F.col("ra"), F.col("rb")) >= ALIKE).select("a", "b")).distinct()


def classes(unique: DataFrame, links: DataFrame) -> DataFrame:
    """id and its class: the smallest id reachable over links, by rounds that also follow the label found last."""
    edges = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = unique.select("id", F.col("id").alias("cls"))
    while True:
        near = edges.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cls").alias("near"))
        new = label.join(near, "id", "left").select("id", "cls", F.least("cls", F.coalesce("near", "cls")).alias("to"))
        # A label's own label may be smaller still.
        jump = label.select(F.col("id").alias("to"), F.col("cls").alias("further"))
        new = durable(new.join(jump, "to", "left").select("id", "cls", F.least("to", F.coalesce("further", "to")).alias("next")))
        if new.where("next <> cls").isEmpty():
            return new.select("id", F.col("next").alias("cls"))
        label = new.select("id", F.col("next").alias("cls"))


def opening_classes(pairs: DataFrame) -> DataFrame:
    """id of each unique opening with its class. pairs has opening."""
    unique = durable(pairs.where(F.col("opening").rlike(r"[\p{L}]")).select("opening").distinct().select(F.xxhash64("opening").alias("id"), shingles(F.col("opening")).alias("runs")))
    return classes(unique, verified_links(unique))


def _pairs_of_words(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " ")))


def refusal_openings(pairs: DataFrame) -> DataFrame:
    """id of the openings of refusals. pairs has question, opening, plain, evidence, foreign and expect_reject.

    A class counts if its answers recur across prompts, hardly ever hold evidence or another language, and mostly answer prompts
    that should not be rejected: what mostly answers the others says rightly that the material lacks the information.
    An opening without evidence that is too rare to recur counts if it is mostly made of the pairs of words of such classes.
    """
    # Prompts that are alike are one prompt: a question with and without its mark, or in other words of the same template and names.
    prompts = pairs.where("not plain").select(F.xxhash64("question").alias("q"), opening_of(F.col("question")).alias("opening")).distinct()
    prompts = prompts.withColumn("id", F.xxhash64("opening")).join(opening_classes(prompts), "id", "left").select("q", F.coalesce("cls", "id").alias("prompt"))
    keyed = pairs.where("not plain").withColumn("q", F.xxhash64("question")).join(prompts, "q").withColumn("id", F.xxhash64("opening"))
    # Openings by prompt: counted before any join.
    sums = [F.sum(F.col(c).cast("int")).alias(c) for c in ("evidence", "foreign", "expect_reject")]
    keyed = durable(keyed.groupBy("id", "prompt").agg(F.count("*").alias("n"), *sums, F.min("opening").alias("opening")))
    stats = keyed.join(opening_classes(pairs.where("not plain and not evidence")), "id")
    by_class = stats.groupBy("cls", "prompt").agg(*[F.sum(c).alias(c) for c in ("n", "evidence", "foreign", "expect_reject")])
    by_class = by_class.groupBy("cls").agg(F.count("*").alias("prompts"), *[F.sum(c).alias(c) for c in ("n", "evidence", "foreign", "expect_reject")])
    calm = (F.col("evidence") <= 0.1 * F.col("n")) & (F.col("foreign") <= 0.5 * F.col("n"))
    recurring = by_class.where((F.col("prompts") >= PROMPTS) & calm).withColumn("refuses", F.col("expect_reject") <= 0.5 * F.col("n"))
    by_id = durable(stats.select("id", "cls", "opening").distinct().join(recurring.select("cls", "refuses"), "cls", "left"))
    revealed = by_id.where("refuses").select("id")
    # What is typical of refusals: pairs of words that stand in more of their openings than in those of right answers.
    typical = by_id.where("refuses is not null").select("refuses", F.explode(_pairs_of_words(F.col("opening"))).alias("w"))
    typical = typical.groupBy("w").agg(F.sum(F.when(F.col("refuses"), 1).otherwise(-1)).alias("more")).where("more > 0").select("w")
    rare = stats.where((F.col("evidence") == 0) & (F.col("foreign") == 0) & (F.col("expect_reject") < F.col("n"))).select("id", "opening").distinct()
    rare = rare.join(by_id.where("refuses is not null").select("id"), "id", "left_anti").withColumn("ws", _pairs_of_words(F.col("opening")))
    known = rare.select("id", F.size("ws").alias("all"), F.explode("ws").alias("w")).join(typical, "w").groupBy("id", "all").agg(F.count("*").alias("met"))
    return revealed.unionByName(known.where(F.col("met") >= FAMILIAR * F.col("all")).select("id")).distinct()


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def own_words(text: Column) -> Column:
    """The answer's own wording: no quotations, brackets, citations, table lines, units behind numbers or capitalised names."""
    text = F.regexp_replace(without_marks(text), r"(?m)^\s*\|.*$", " ")
    text = F.regexp_replace(F.regexp_replace(text, _QUOTED, " "), _BRACKETS, " ")
    return F.regexp_replace(text, r"(?i)(?:rmb|cny)?\s?\d[\d,. ]*\s?(?:(?:thousand|million|billion|mn|bn|square|cubic|per|fen|kt|kg|tonnes|of|co2e|tco2e|yuan|share|cent|metres|megalitres|litres|hectares|minutes|hours|days|people|employees|bps|times|sqm|[kmg]wh|m²)(?![\p{L}])\s?)*", " ")


def script(text: Column) -> Column:
    """struct<name, amount, words>: the script that most of a text is in. Japanese has kana; `words` counts words of an alphabet, else characters."""

    def words_of(name: str) -> Column:
        return _count(text, rf"\p{{Is{name}}}[\p{{Is{name}}}\p{{M}}]*")

    def largest(counts: Column) -> Column:
        kana, han, latin = counts["kana"], counts["han"], counts["latin"]
        east = F.struct((han + kana).alias("amount"), (han + kana).alias("words"), F.when((kana >= 3) & (kana * 8 >= han), "Japanese").otherwise("Chinese").alias("name"))
        return F.greatest(east, F.struct((2 * latin).alias("amount"), latin.alias("words"), F.lit("Latin").alias("name")), counts["other"])

    # Few texts hold any letter of the other alphabets, which are counted there only.
    rest = F.array_max(F.array(*[F.struct(words_of(name).alias("words"), F.lit(name).alias("name")) for name in ALPHABETS if name != "Latin"]))
    none = F.struct(F.lit(0).alias("words"), F.lit("").alias("name"))
    rest = F.when(text.rlike("[" + "".join(rf"\p{{Is{name}}}" for name in ALPHABETS if name != "Latin") + "]"), rest).otherwise(none)
    other = F.element_at(F.transform(F.array(rest), lambda x: F.struct((2 * x["words"]).alias("amount"), x["words"].alias("words"), x["name"].alias("name"))), 1)
    counts = F.struct(_count(text, _HAN).alias("han"), _count(text, _KANA).alias("kana"), words_of("Latin").alias("latin"), other.alias("other"))
    # As a lambda's variable the counts are made once, not for each use.
    return F.element_at(F.transform(F.array(counts), largest), 1)


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))


def language_profiles(rows: DataFrame) -> dict[str, list[str]]:
    """The common words of questions and of answers in the same script, by script: at most PROFILE words for each alphabet.

    rows has question, own, asked and told (the scripts of both).
    """
    same = rows.where((F.col("asked.name") == F.col("told.name")) & F.col("asked.name").isin(*ALPHABETS))
    texts = same.select(F.col("asked.name").alias("name"), F.explode(F.array("question", "own")).alias("text")).distinct()
    words = texts.select("name", F.explode(F.array_distinct(text_words(F.col("text")))).alias("word")).groupBy("name", "word").agg(F.count("*").alias("n"))
    totals = texts.groupBy("name").agg(F.count("*").alias("total")).where(F.col("total") >= LEARNED)
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.col("n").desc(), "word"))
    words = words.where(F.col("n") >= COMMON_TEXTS).join(totals, "name").where(F.col("n") >= COMMON * F.col("total"))
    out: dict[str, list[str]] = {}
    for row in words.withColumn("place", place).where(F.col("place") <= PROFILE).select("name", "word").collect():  # a profile for each of a few alphabets
        out.setdefault(row.name, []).append(row.word)
    return out


def _share(text: Column, name: Column, profiles: dict[str, list[str]]) -> Column:
    """struct<words, share>: words of a text, and the share of them that its script's profile has; null without a profile."""
    known = F.lit(None).cast("array<string>")
    for script_name, profile in sorted(profiles.items()):
        known = F.when(name == script_name, F.array(*map(F.lit, sorted(profile)))).otherwise(known)

    def shared(words: Column) -> Column:
        return F.struct(F.size(words).alias("words"), (F.size(F.filter(words, lambda w: F.array_contains(known, w))) / F.nullif(F.size(words), F.lit(0))).alias("share"))

    return F.when(name.isin(*profiles), F.element_at(F.transform(F.array(text_words(text)), shared), 1)) if profiles else F.lit(None).cast("struct<words: int, share: double>")


def script_differs(asked: Column, told: Column) -> Column:
    """The answer's own wording is mostly in another script than the question."""
    return (asked["words"] > 0) & (told["name"] != asked["name"]) & (told["words"] >= F.when(told["name"].isin("Chinese", "Japanese"), 4).otherwise(3))


def words_differ(question: Column, own: Column, asked: Column, told: Column, profiles: dict[str, list[str]]) -> Column:
    """The answer is in the question's script without the words that the question's language has in common, or the other way
    round. Where the script has no profile nothing can be said."""

    def differ(x: Column) -> Column:
        asked_share, told_share = x["asked"]["share"], x["told"]["share"]
        enough = (x["asked"]["words"] >= 3) & (x["told"]["words"] >= 3)
        return enough & (((asked_share >= TYPICAL) & (told_share < TYPICAL)) | ((asked_share == 0) & (told_share >= TYPICAL)))

    both = F.struct(_share(question, asked["name"], profiles).alias("asked"), _share(own, told["name"], profiles).alias("told"))
    return F.coalesce((told["name"] == asked["name"]) & F.element_at(F.transform(F.array(both), differ), 1), F.lit(False))


_NUMERALS = "一二三四五六七八九十"


def breaks_off(answer: Column) -> Column:
    """Without an end, or with fewer points than were announced."""
    text = F.rtrim(answer)
    bare = F.rtrim(F.regexp_replace(text, rf"(?:\s*{_MARKS})+\s*$", ""))
    cited = bare != text
    ended = bare.rlike(r"[。！？!?.…][\"”’』」)）]*$") | bare.rlike(r"\|$")
    # A number cut after its point, or the number of a point without the point.
    cut = ~cited & bare.rlike(r"(?:^|[^0-9.])(?:[\p{IsHan}]\s?|of\s|to\s|at\s|was\s|reached\s|RMB\s?|CNY\s?)[\d,]*\d\.$")
    cut = cut | (~cited & (bare.rlike(r"(?:^|\n)\s*[(（]?(?:\d{1,2}|[一二三四五六七八九十])[.、)）]$") | bare.rlike(r"[:：,，、;；(（“‘\[]$")))
    bare_table = bare.rlike(r"\|[\s:|-]*-[\s:|-]*\|$")
    announced = F.regexp_extract(bare, rf"(?:以下|下列|如下)([{_NUMERALS}\d]{{1,2}})\s?(?:点|项|个|条|类|方面)", 1)
    spoken = F.regexp_extract(bare, r"(?i)(?:following|these)\s(two|three|four|five|six)\s", 1)
    wanted = F.when(announced.rlike(r"^\d+$"), announced.try_cast("int")).when(announced != "", F.array_position(F.array(*map(F.lit, _NUMERALS)), F.substring(announced, 1, 1)).cast("int"))
    wanted = F.coalesce(wanted, F.when(spoken != "", F.array_position(F.array(*[F.lit(x) for x in "one two three four five six".split()]), F.lower(spoken)).cast("int")))
    points = _count(bare, rf"(?m)^\s*(?:[(（]?(?:\d{{1,2}}|[{_NUMERALS}]{{1,2}})[.、)）]|第[{_NUMERALS}]|[-•*·])\s*\S")
    short = wanted.isNotNull() & (points < wanted) & ((points > 0) | bare.rlike(r"[:：]$"))
    return (~ended & ~cited) | cut | bare_table | short


def copies(question: Column, answer: Column) -> Column:
    """Nothing but the question, once or more, behind a label at most."""
    bare = without_marks(answer)
    wanted, given = _letters(question), _letters(bare)
    label = F.regexp_extract(bare, r"^\s*([^:“\"\n]{1,24}):", 1)
    # A label may not be the beginning of the question itself.
    stripped = F.when((label != "") & ~given.startswith(wanted), F.substring(given, F.length(_letters(label)) + F.lit(1), F.length(given))).otherwise(given)
    return (F.length(wanted) >= 4) & (F.replace(stripped, wanted, F.lit("")) == "") & (stripped != "")


def features(results: DataFrame) -> DataFrame:
    """One row for each result with its texts in one form and the checks that need no other row."""
    rows = results.select("result_id", F.coalesce("expect_reject", F.lit(False)).alias("expect_reject"), canonical(F.col("question")).alias("question"), canonical(F.col("answer")).alias("answer"))
    rows = rows.dropDuplicates(["result_id"])
    bare = without_marks(F.col("answer"))
    rows = rows.withColumn("empty", F.col("answer").isNull() | ~bare.rlike(r"[\p{L}\p{N}]"))
    rows = rows.withColumn("copy", ~F.col("empty") & F.coalesce(copies(F.col("question"), F.col("answer")), F.lit(False)))
    rows = rows.withColumn("plain", F.col("empty") | F.col("copy"))
    evidence = F.regexp_replace(bare, _QUOTED, "“”").rlike(r"^[^。！？!?\n]*(?:\d|“”)") | F.col("answer").rlike(rf"^[^。！？!?\n]*{_MARKS}")
    rows = rows.withColumn("own", own_words(F.col("answer")))
    rows = rows.withColumn("asked", script(F.coalesce("question", F.lit("")))).withColumn("told", script(F.coalesce("own", F.lit(""))))
    return rows.withColumn("opening", opening_of(F.col("answer"))).withColumn("evidence", F.coalesce(evidence, F.lit(False)))


def defects(results: DataFrame) -> DataFrame:
    """result_id and defect of every broken pair."""
    rows = durable(features(results)).withColumn("foreign", ~F.col("plain") & script_differs(F.col("asked"), F.col("told")))
    other_words = words_differ(F.col("question"), F.col("own"), F.col("asked"), F.col("told"), language_profiles(rows.where("not plain")))
    refused = refusal_openings(rows).withColumn("refused", F.lit(True))
    rows = rows.withColumn("id", F.xxhash64("opening")).join(refused, "id", "left")
    kind = (
        F.when(F.col("empty"), "empty")
        .when(F.col("copy"), "copy")
        .when(F.coalesce(F.col("refused"), F.lit(False)) & ~F.col("evidence"), "refusal")
        .when(F.col("foreign") | other_words, "other_language")
        .when(breaks_off(F.col("answer")), "truncated")
    )
    return rows.select("result_id", kind.alias("defect")).where("defect is not null")
