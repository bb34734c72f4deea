"""The baseline: logistic regression that always keeps its coefficients on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vastlin.models.logistic import LogisticRegression, LogisticRegressionModel


class LocalLogisticRegression(LogisticRegression):
    """Same objective and edge cases; ``setInitialModel`` warms the start, and the model keeps a training summary."""

    def __init__(self, **given):
        super().__init__(**given | {"layout": "local"})
        self.initial: LogisticRegressionModel | None = None

    def setInitialModel(self, model: LogisticRegressionModel) -> LocalLogisticRegression:
        self.initial = model
        return self

    def fit(self, df: DataFrame) -> LogisticRegressionModel:
        model = super().fit(df, self.initial)
        model.summary = {"objectiveHistory": model.objectiveHistory, "totalIterations": max(len(model.objectiveHistory) - 1, 0)}
        model.hasSummary = True
        return model
