import hashlib

import pytest

from loamgrid import session
from loamgrid.operators import ports
from loamgrid.streaming import incremental


def test_retries_wait_longer_and_stop_at_refusals():
    waits, left = [], [ValueError(), ValueError()]

    def call():
        if left:
            raise left.pop()
        return 1

    assert ports.Retry().call(call, sleep=waits.append) == 1
    assert len(waits) == 2 and 1.05 <= waits[0] <= 1.95 and 2.1 <= waits[1] <= 3.9

    def refuse():
        raise ports.Refused

    with pytest.raises(ports.Refused):
        ports.Retry().call(refuse, sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        ports.Retry(tries=2).call(lambda: 1 / 0, sleep=waits.append)
    assert len(waits) == 3


def hashes():
    """The same text has the same vector, and nothing is meant by it."""

    class Hashes:
        dim = 16

        def embed(self, texts):
            return [[(b - 127.5) / 127.5 for b in hashlib.blake2b(t.encode(), digest_size=self.dim).digest()] for t in texts]

    return Hashes()


def test_each_text_is_embedded_once(spark):
    class Short:
        dim = 4

        def embed(self, texts):
            return [[0.0] * 4] * (len(texts) - 1)

    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", " "), ("d", None), ("e", "y")], "k string, t string")
    made = {r.content: r.embedding for r in ports.embed(rows, "k", "t", hashes(), batch=2).collect()}
    assert len(made) == 4 and sum(not any(v) for v in made.values()) == 2
    index = ports.embed(rows.where("k < 'c'"), "k", "t", hashes())
    assert sorted(r.k for r in ports.pending(rows, "t", index).collect()) == ["c", "d", "e"]
    with pytest.raises(Exception, match="another number"):
        ports.embed(rows, "k", "t", Short(), retry=ports.Retry(tries=1)).collect()


def test_a_failed_answer_is_an_error_not_an_end(spark):
    class Echo:
        def answer(self, prompt):
            if prompt == "bad":
                raise ports.Refused("no")
            return prompt.upper()

    rows = spark.createDataFrame([(1, "q"), (2, "bad"), (3, ""), (4, None)], "k int, p string")
    got = {r.key: (r.answer, r.error) for r in ports.answers(rows, "k", "p", Echo()).collect()}
    assert got == {"1": ("Q", None), "2": (None, "no"), "3": (None, "empty answer"), "4": (None, "empty answer")}


def test_stream_taken_up_again_changes_nothing(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    kind = "chunk_id string, code string, embed_text string"
    spark.createDataFrame([("c1", "a", "x"), ("c2", "a", "y")], kind).coalesce(1).write.parquet(f"{source}/1")
    schema = spark.read.parquet(f"{source}/1").schema
    first = {tuple(r) for r in incremental.run(spark, source, "*.parquet", schema, work).collect()}
    assert {r[1] for r in first} == {"c1", "c2"}
    assert {tuple(r) for r in incremental.run(spark, source, "*.parquet", schema, work).collect()} == first
    spark.createDataFrame([("c0", "a", "x"), ("c3", "a", "z"), ("c3", "a", "z")], kind).coalesce(1).write.parquet(f"{source}/2")
    # A second run writes only contents that the first hasn't written.
    rows = incremental.run(spark, source, "*.parquet", schema, work).collect()
    assert {r.chunk_id for r in rows} == {"c1", "c2", "c3"} and first < {tuple(r) for r in rows} and len(rows) == 3
    last = max(r.epoch for r in rows)
    assert [r.chunk_id for r in rows if r.epoch == last] == ["c3"]
    incremental.store_new(spark.createDataFrame([("c3", "a", "z"), ("c9", "a", "y")], kind), work, last)  # a batch that is repeated
    assert {tuple(r) for r in incremental.read_index(spark, work).collect()} == {tuple(r) for r in rows}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert session.shared_folder(Session()) == "hdfs://x/y/" and session.shared_folder(Session(), "stream").startswith("hdfs://x/y/stream-")
