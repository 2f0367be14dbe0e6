"""Correlations in one scan against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.gram import gram


def test_gram_equals_pandas(spark):
    r = np.random.default_rng(3)
    n = 3000
    x = r.normal(0, 1, (n, 5))
    v = pd.DataFrame({"a": 1e9 + x[:, 0], "b": x[:, 0] + x[:, 1], "c": np.where(r.random(n) < 0.4, np.nan, x[:, 1] * 1e-6), "d": np.full(n, 3.0), "e": np.arange(n) * 1e4 + x[:, 2], "f": np.full(n, np.nan)})
    v.loc[: n // 2, "c"] = np.nan
    df = spark.createDataFrame(v).repartition(7).select(*[F.when(~F.isnan(k), F.col(k)).alias(k) for k in v])
    got = {(g.a, g.b): (g.n, g.corr) for g in gram(df, list(v)).collect()}
    want = (v - v.bfill().iloc[0]).corr()  # the shift is exact, and the level no longer costs digits
    assert set(got) == {(a, b) for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]}
    for (a, b), (m, corr) in got.items():
        assert m == (v[a].notna() & v[b].notna()).sum()
        if "d" in (a, b):
            assert corr is None
        else:
            np.testing.assert_allclose(corr, want.loc[a, b], atol=1e-8)  # means carry 1e-7 at a level of 1e9
    assert gram(df.limit(0), list(v)).count() == 0
