import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.functions.glyphs import LOOKALIKES, plain, spelled
from loamgrid.llm import canon


def slow(text):
    """Character by character, with the library's own composition."""
    return None if text is None else unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(spelled, text))))


odd = st.text(st.one_of(st.sampled_from("aeoAE \n" + "̧̣́̈̊가각각カｶﾞ゙ﬁ㎡⽤​　−ＡＢ，²½" + "".join(LOOKALIKES)), st.characters(exclude_categories=["Cs"])), max_size=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), odd), max_size=12))
def test_batches_equal_the_slow_way(texts):
    assert canon.fold_array(pa.array(texts, pa.string())).to_pylist() == [slow(t) for t in texts]


def test_what_is_one_and_what_isnt():
    form = lambda *x: canon.fold_array(pa.array(x)).to_pylist()
    a, b = form("Ｆоr thе уear，ofﬁce ㎡ café ⽤率", "For the year,office m² café 用率")
    assert a == b
    x = form("m²", "m2", "A", "a", "—", "-", "①", "1", "。", ".")
    assert len(set(x)) == len(x)
    assert form("a b", "\r\n") == ["a b", " \n"]


def test_sliced_arrays_and_blocks(monkeypatch):
    monkeypatch.setattr(canon, "BLOCK_BYTES", 10)
    texts = ["é" * k + "​" for k in range(30)] + [None, ""]
    assert canon.fold_array(pa.array(texts).slice(3, 29)).to_pylist() == [slow(t) for t in texts[3:]]
    assert canon.fold_array(pa.array([], pa.string())).to_pylist() == []


def test_column_keeps_other_columns(spark):
    rows = spark.createDataFrame([("Ａ", 1, None), (None, 2, "x"), ("", 3, "y")], "text string, f int, t string")
    got = canon.canonical_text(rows).orderBy("f").collect()
    assert [tuple(r) for r in got] == [("A", 1, None), (None, 2, "x"), ("", 3, "y")]
    assert canon.canonical_text(rows, to="t").columns == ["text", "f", "t"]


def test_plain_agrees_where_nothing_is_composed(spark):
    texts = ["Ｆоr ﬁｎｅ ㎡，−１", "⽤​　…", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in rows.select(plain(rows.t).alias("p")).collect()] == [slow(t) for t in texts]


def test_pairs(spark):
    rows = [("1", "ab c"), ("2", "ａb c"), ("3", "ab c"), ("3", "ab c"), ("4", "ab  c"), ("5", None), ("6", ""), ("7", "​"), ("8", "x")]
    data = spark.createDataFrame([(k, t, "z") for k, t in rows], "key string, text string, f1 string")
    want = [("1", "2"), ("2", "3"), ("6", "7")]
    for hot in (20_000, 1):  # salted or not
        assert sorted(tuple(r) for r in canon.lookalike_pairs(data, hot=hot).collect()) == want
    assert canon.lookalike_pairs(data.limit(0)).count() == 0
    got = {(r.key, r["class"], r.n_strings, r.n_rows) for r in canon.lookalike_classes(data).collect()}
    assert got == {("1", "1", 2, 3), ("2", "1", 2, 3), ("3", "1", 2, 3), ("6", "6", 2, 2), ("7", "6", 2, 2)}
    assert canon.lookalike_classes(data.limit(0)).count() == 0
