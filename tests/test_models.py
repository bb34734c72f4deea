import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression as SparkLogistic
from pyspark.ml.linalg import Vectors

from vastlin.models import LinearRegression, LinearRegressionModel, LocalLogisticRegression, LogisticRegression, LogisticRegressionModel, SoftmaxRegression, SoftmaxRegressionModel

# intercept, standardize, regParam, elasticNet, coefficients, intercept value: built-in pyspark.ml
LINEAR = [
    (False, False, 0.0, 0.0, (-3.727121, 3.009983), 0.0),
    (False, False, 2.3, 0.0, (-0.882402, 2.423297), 0.0),
    (False, False, 2.3, 0.5, (0.0, 2.23899), 0.0),
    (False, True, 0.0, 0.0, (-3.727121, 3.009983), 0.0),
    (False, True, 2.3, 0.0, (1.369781, 1.89463), 0.0),
    (False, True, 2.3, 0.5, (0.0, 2.17348), 0.0),
    (True, False, 0.0, 0.0, (6.08, -0.6), 18.08),
    (True, False, 2.3, 0.0, (0.728726, 1.199738), 10.065273),
    (True, False, 2.3, 0.5, (0.0, 1.338732), 10.077185),
    (True, True, 0.0, 0.0, (6.08, -0.6), 18.08),
    (True, True, 2.3, 0.0, (1.752154, 0.562908), 14.641454),
    (True, True, 2.3, 0.5, (1.451001, 0.403834), 16.89813),
]


@pytest.fixture(scope="module")
def linear_rows(spark):
    rows = [(17.0, 1.0, Vectors.sparse(2, [1], [5.0])), (19.0, 2.0, Vectors.dense(1.0, 7.0)), (23.0, 3.0, Vectors.dense(2.0, 11.0)), (29.0, 4.0, Vectors.dense(3.0, 13.0))]
    return spark.createDataFrame(rows, ["label", "weight", "features"]).repartition(2)


@pytest.mark.parametrize("intercept,standardize,reg,alpha,coefficients,value", [LINEAR[4], LINEAR[8], LINEAR[11]])
def test_linear_golden(linear_rows, intercept, standardize, reg, alpha, coefficients, value):
    m = LinearRegression(weightCol="weight", fitIntercept=intercept, standardization=standardize, regParam=reg, elasticNetParam=alpha, tol=1e-10, maxIter=200).fit(linear_rows)
    assert np.allclose(m.coefficients.toArray(), coefficients, rtol=1e-3, atol=1e-4)
    assert np.isclose(m.intercept, value, rtol=1e-3, atol=1e-6)


def test_linear_distributed_as_local(linear_rows):
    given = {"weightCol": "weight", "regParam": 2.3, "elasticNetParam": 0.5, "maxIter": 2}
    a = LinearRegression(**given).fit(linear_rows)
    b = LinearRegression(**given, layout="distributed", colsPerBlock=2, rowsPerBlock=3).fit(linear_rows)
    assert np.allclose(a.objectiveHistory, b.objectiveHistory) and np.allclose(a.coefficients.toArray(), b.coefficients.toArray()) and np.isclose(a.intercept, b.intercept)


def binary(spark, n=60, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.normal((1, -2, 0.5), (1, 3, 0.2), (n, 3))
    y = (x @ (1.2, -0.4, 2.0) - 2.5 + rnd.logistic(size=n) > 0).astype(float)
    return spark.createDataFrame([(float(a), float(w), Vectors.dense(*v)) for a, w, v in zip(y, rnd.uniform(0.5, 2, n), x, strict=True)], ["label", "weight", "features"])


@pytest.mark.parametrize("reg,alpha,standardize,intercept", [(0.1, 0.0, False, True), (0.1, 0.6, True, True), (0.1, 1.0, False, False)])
def test_logistic_as_spark(spark, reg, alpha, standardize, intercept):
    df = binary(spark)
    ours = LogisticRegression(weightCol="weight", regParam=reg, elasticNetParam=alpha, standardization=standardize, fitIntercept=intercept, tol=1e-9).fit(df)
    theirs = SparkLogistic(weightCol="weight", regParam=reg, elasticNetParam=alpha, standardization=standardize, fitIntercept=intercept, tol=1e-12, maxIter=200).fit(df)
    assert np.allclose(ours.coefficients.toArray(), theirs.coefficients.toArray(), rtol=1e-3, atol=1e-4)
    assert np.isclose(ours.intercept, theirs.intercept, rtol=1e-3, atol=1e-4)
    both = ours.transform(df.select("features")).select("prediction").toPandas()["prediction"].to_numpy()
    assert (both == theirs.transform(df.select("features")).select("prediction").toPandas()["prediction"].to_numpy()).all()


def test_logistic_edges(spark, tmp_path):
    df = binary(spark)
    ones = LogisticRegression().fit(df.withColumn("label", df["label"] * 0 + 1))
    assert ones.intercept == float("inf") and not ones.coefficients.toArray().any()
    assert {r[0] for r in ones.transform(df).select("prediction").collect()} == {1.0}
    with pytest.raises(ValueError):
        LogisticRegression().fit(df.withColumn("label", df["label"] + 1))
    with pytest.raises(TypeError):
        LogisticRegression(regularisation=1)
    with pytest.raises(ValueError):
        LogisticRegression().setColsPerBlock(0)
    m = LogisticRegression(regParam=0.1, maxIter=15).setThreshold(0.8).fit(df)
    m.save(str(tmp_path / "m"), spark)
    again = LogisticRegressionModel.load(str(tmp_path / "m"), spark)
    assert again.coefficients == m.coefficients and again.threshold() == 0.8
    warm = LocalLogisticRegression(regParam=0.1, maxIter=15).setInitialModel(m).fit(df)
    assert warm.summary["totalIterations"] <= 3 and warm.hasSummary
    assert 0.5 < m.evaluate(df)["auc"] <= 1


def test_weights_are_repeats(spark):
    df = binary(spark, 30)
    twice = df.unionAll(df.where("label = 1")).drop("weight")
    weighted = df.drop("weight").selectExpr("label", "features", "1 + label as w")
    a, b = LogisticRegression(standardization=False, regParam=0.1, tol=1e-9).fit(twice), LogisticRegression(standardization=False, regParam=0.1, tol=1e-9, weightCol="w").fit(weighted)
    assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), rtol=1e-3)


def test_softmax_as_spark(spark, tmp_path):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(50, 3))
    y = np.argmax(x @ rnd.normal(size=(3, 3)) + rnd.gumbel(size=(50, 3)), 1)
    df = spark.createDataFrame([(float(a), Vectors.dense(*v)) for a, v in zip(y, x, strict=True)], ["label", "features"])
    ours = SoftmaxRegression(regParam=0.1, tol=1e-9).fit(df)
    theirs = SparkLogistic(regParam=0.1, family="multinomial", fitIntercept=False, tol=1e-12).fit(df)
    assert np.allclose(ours.matrix, theirs.coefficientMatrix.toArray(), rtol=1e-4, atol=1e-5)
    p = ours.transform(df).select("prediction").toPandas()["prediction"]
    assert (p == theirs.transform(df).select("prediction").toPandas()["prediction"]).all()
    ours.save(str(tmp_path / "s"), spark)
    assert (SoftmaxRegressionModel.load(str(tmp_path / "s"), spark).matrix == ours.matrix).all()
    a, b = (SoftmaxRegression(regParam=0.1, maxIter=1, layout=layout, colsPerBlock=2, rowsPerBlock=20).fit(df) for layout in ("local", "distributed"))
    assert np.allclose(a.matrix, b.matrix)


def test_linear_model_file(spark, linear_rows, tmp_path):
    m = LinearRegression(weightCol="weight").fit(linear_rows)
    m.save(str(tmp_path / "l"), spark)
    again = LinearRegressionModel.load(str(tmp_path / "l"), spark)
    assert np.isclose(again.predict(Vectors.dense(1.0, 7.0)), m.predict(Vectors.dense(1.0, 7.0)))
    assert again.transform(linear_rows).select("prediction").count() == 4
