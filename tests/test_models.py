"""Model calls from tasks: bounded requests, one client a worker, each text once, failures as rows."""

import pathlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import models as M
from quillspark.operators import plugins

VECTOR = T.ArrayType(T.DoubleType())


def test_requests_are_greedy():
    assert list(M.requests(["aa", "b", "cc", "d", "eeeeeeee", "f"], 2, 4)) == [["aa", "b"], ["cc", "d"], ["eeeeeeee"], ["f"]]
    assert list(M.requests([], 2, 4)) == []


def test_default_model_is_the_default_plugin(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text")
    got = {r.doc_id: r for r in M.call(docs, "text", "hashed", M.HashedVectors, VECTOR, out="v").collect()}
    want = {r.doc_id: r.v for r in docs.select("doc_id", plugins.hashed_embedding(F.col("text")).alias("v")).collect()}
    for k, v in want.items():
        assert (got[k].v_rejected == "blank") if got[k].v is None else np.allclose(got[k].v, v)


def failing(folder):
    """Refuses texts with ``bad``, fails in passing once a text with ``later``, answers with the length; notes every client and request."""

    def factory():
        import uuid

        home = pathlib.Path(folder)
        (home / f"client-{uuid.uuid4().hex}").touch()
        seen = set()

        def model(inputs):
            (home / f"request-{uuid.uuid4().hex}").write_text("\n".join(inputs))
            for x in inputs:
                if "later" in x and x not in seen:
                    seen.add(x)
                    raise M.Passing("busy")
            if any("bad" in x for x in inputs):
                raise ValueError("not this")
            return [len(x) for x in inputs]

        return model

    return factory


def test_failures_are_rows(spark, tmp_path):
    texts = [f"text {k % 50}" + (" bad" if k % 50 == 9 else " later" if k % 50 == 20 else "") for k in range(300)] + [None, "", "  "]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "id long, text string, output_rejected string").repartition(3)
    got = M.call(docs, "text", f"failing-{tmp_path}", failing(str(tmp_path)), T.LongType(), rows=8, characters=60, pause=0.0)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 303
    for k, t in enumerate(texts):
        want = (None, "blank") if not (t or "").strip() else (None, "ValueError: not this") if "bad" in t else (len(t), None)
        assert (rows[k].output, rows[k].output_rejected) == want
    sent = [p.read_text().split("\n") for p in tmp_path.glob("request-*")]
    assert all(len(s) <= 8 and sum(map(len, s)) <= 60 for s in sent)
    plain = [x for s in sent for x in s if "text 1" == x]
    assert 1 <= len(plain) <= 8  # once, or again with a request that was cut
    assert len(list(tmp_path.glob("client-*"))) <= 4
    assert {(r.reason, r.n) for r in M.rejected(got).collect()} == {("blank", 3), ("ValueError: not this", 6)}


def test_a_service_that_stays_away(spark):
    def factory():
        def model(inputs):
            raise M.Passing("gone")

        return model

    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    r = M.call(docs, "text", "away", factory, VECTOR, tries=2, pause=0.0).first()
    assert r.output is None and r.output_rejected == "Passing: gone"
    assert M.call(docs.limit(0), "text", "away", factory, VECTOR).count() == 0


def test_embed_unique_joins_by_text(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, "three four")], "id long, text string")
    got = {r.id: r.embedding for r in plugins.embed_unique(docs, "text").collect()}
    assert got[1] == got[2] != got[4] and got[3] is None and len(got) == 4
    assert "md5" in plugins.embed_unique(docs, "text")._jdf.queryExecution().analyzed().toString()
