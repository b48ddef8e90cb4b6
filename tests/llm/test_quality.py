import math

import pytest
from pyspark.sql import functions as F

from fjordquant.llm import quality

NAMES = ["a", "b"]
MODELS = [quality.LabelModel(0.9, (0.95, 0.8), (0.5, 0.6)),
          quality.LabelModel(0.7, (0.91, 0.85), (0.55, 0.3))]


def votes(spark):
    return spark.createDataFrame(
        [(x, y) for x in (-1, 0, 1, None) for y in (-1, 0, 1)], "a int, b int")


@pytest.mark.parametrize("model", MODELS)
def test_posterior_by_hand(spark, model):
    def weight(vote, a, b):
        return {1: math.log(a / (1 - b)), -1: math.log((1 - a) / b)}.get(vote, 0.0)

    found = votes(spark).withColumn("p", model.posterior([F.col(n) for n in NAMES])).collect()
    assert len(found) == 12
    for row in found:
        odds = math.log(model.fine / (1 - model.fine)) + sum(
            weight(row[n], a, b) for n, a, b in zip(
                NAMES, model.right_on_fine, model.right_on_poor))
        assert row["p"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-12)


def test_rounds_of_the_fit_share_their_code(spark, monkeypatch):
    sizes, real = [], quality.LabelModel.posterior
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_SOURCE_CODE_SIZE()

    def spy(self, columns):
        sizes.append(compiled.getCount())
        return real(self, columns)

    monkeypatch.setattr(quality.LabelModel, "posterior", spy)
    names = [f"v{i}" for i in range(7)]
    rows = spark.range(300).select(*[
        (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3)) - 1).cast("int").alias(n)
        for i, n in enumerate(names)])
    model = quality.fit(rows, names)
    assert 0 < model.fine < 1 and len(sizes) == quality.ROUNDS
    # the first rounds compile their code; the last ones find it
    assert sizes[-1] == sizes[quality.ROUNDS // 2]
