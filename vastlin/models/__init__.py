"""Estimators and models."""

from vastlin.models.linear import LinearRegression, LinearRegressionModel
from vastlin.models.local_logistic import LocalLogisticRegression
from vastlin.models.logistic import LogisticRegression, LogisticRegressionModel
from vastlin.models.softmax import SoftmaxRegression, SoftmaxRegressionModel

__all__ = ["LinearRegression", "LinearRegressionModel", "LocalLogisticRegression", "LogisticRegression", "LogisticRegressionModel", "SoftmaxRegression", "SoftmaxRegressionModel"]
