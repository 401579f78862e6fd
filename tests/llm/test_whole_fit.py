"""The quality model learns from every labelled document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planmatch.llm import quality_model


def test_score_quality_has_no_sample_by_default():
    import inspect

    assert inspect.signature(quality_model.score_quality).parameters["sample"].default is None


@pytest.mark.parametrize("good, bad", [(200, 150), (700, 3), (5, 400)])
def test_blocks_hold_every_document_in_pairs(spark, good, bad):
    rows = spark.range(good + bad).select(F.col("id").alias("doc_id"), (F.col("id") < good).cast("int").alias("quality"), *[F.col("id").cast("double").alias(k) for k in quality_model.FEATURES])
    dealt = [r for r in quality_model.blocks(rows, good, bad, 11).collect() if r["good"] and r["bad"]]
    assert {x[0] for r in dealt for x in r["good"] + r["bad"]} == set(map(float, range(good + bad)))
    assert max(len(r["good"]) * len(r["bad"]) for r in dealt) < 16_384


def test_whole_fit_by_plain_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(quality_model.FEATURES))) + np.repeat([1.0, 0.0], [350, 150])[:, None] * np.linspace(0, 1, len(quality_model.FEATURES))
    rows = spark.createDataFrame([(i, int(i < 350), *map(float, r)) for i, r in enumerate(x)], "doc_id long, quality int, " + ", ".join(f"{k} double" for k in quality_model.FEATURES))
    w, threshold = quality_model.fit_whole(rows, 1e-3, 11)
    d = np.concatenate([(np.array(r["good"])[:, None] - np.array(r["bad"])[None]).reshape(-1, x.shape[1]) for r in quality_model.blocks(rows, 350, 150, 11).collect()])
    z = d @ w
    # the gradient of the loss, ridge included, is zero where the fit ends
    spread = x.std(0) + 1e-9
    assert np.abs((d / spread).T @ (1 / (1 + np.exp(z))) / len(d) - 1e-3 * w * spread).max() < 1e-7
    assert threshold == pytest.approx(np.quantile(x @ w, 150 / 500))


def test_ranked_counts_out_each_place(spark):
    values = [3.0, -1.0, 3.0, 1e-300, 7.5, 1e9, 3.0000000000000004]
    found = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality_model.ranked(found, i) for i in range(7)] == sorted(values)
