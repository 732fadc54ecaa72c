"""Vectors that are null, zero, not finite or of other lengths."""

import numpy as np

from millrace.functions.vectors import cosine_pairs


def test_odd_vectors(spark):
    nan = float("nan")
    records = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, 0.0, 0.0]), (6, []), (7, [-3.0, -4.0]), (8, [None, 1.0])]
    questions = [(1, [2.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [1.0])]
    r, q = spark.createDataFrame(records, "row_idx long, vector array<double>"), spark.createDataFrame(questions, "qid long, vector array<double>")
    got = {(x["qid"], x["row_idx"]): x["score"] for x in cosine_pairs(q, r).collect()}
    want = {(1, 1): 1.0, (1, 3): 0.0, (1, 4): 0.0, (1, 7): -0.6, (1, 8): 0.0, (2, 5): 0.0}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)
    assert cosine_pairs(q.limit(0), r).count() == 0 and cosine_pairs(q, r.limit(0)).count() == 0
