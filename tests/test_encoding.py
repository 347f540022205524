import uuid

import numpy as np

from tidemark.functions import embedding, text
from pyspark.sql import functions as F


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b A a"), (3, ""), (4, None), (5, "x " * 10_000)], "i int, t string")
    got = {r.i: np.array(r.e) for r in df.select("i", embedding.encoder(embedding.hashed)("t").alias("e")).collect()}
    assert all(len(v) == embedding.DIM for v in got.values())
    assert np.allclose(got[1], got[2]) and not got[3].any() and not got[4].any()
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-5 for i in (1, 2, 5))


def test_name_uuid(spark):
    names = ["g1|2024-01-01", "", "私聊", "x" * 5000, *map(str, range(50))]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.name_uuid(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in got)
