"""Texts whose words cancel out in the default embedding have a vector all the same."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import models as M
from quillspark.operators import plugins


def test_words_that_cancel_out_have_a_vector(spark):
    model = M.HashedVectors()
    met, pair = {}, None
    for w in (f"w{i}" for i in range(1000)):
        place, sign = model.word(w)
        if (place, -sign) in met:
            pair = f"{met[place, -sign]} {w}"
            break
        met[place, sign] = w
    texts = [pair, f"{pair} {pair}", f"{pair} other", "x", ""]
    got = model(texts)
    assert [round(float(np.linalg.norm(v)), 6) for v in got] == [1.0, 1.0, 1.0, 0.0, 0.0]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", plugins.hashed_embedding(F.col("t")).alias("v")).collect()
    assert all(np.allclose(r.v, got[r.i]) for r in rows)
