"""Vector search where refinement takes several passes: clusters of thousands of near vectors, against brute force."""

import numpy as np

from quillon.llm import topk


def test_dense_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (8, 16))
    near = np.float32(np.repeat(centres, 3000, axis=0) + rng.normal(0, 0.02, (24_000, 16)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(df, every=100).orderBy("query_id", "rank").collect()]
    whole = np.floor(256 * near.astype(float))
    ids, want = np.arange(len(near)), []
    for q in range(0, len(near), 100):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(np.lexsort((ids, -scores))[:5])]
    assert got == want
