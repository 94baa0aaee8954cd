"""Tree ensembles and hashed text models as Arrow functions: arrays are sent once per worker, rows in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Forest:
    """Node arrays [tree, node]; a leaf has feature -1. One output: logistic of the sum of leaves; several: softmax, tree t
    adding to class t modulo the number of classes. A missing value goes where ``missing_left`` says."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    baseline: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaves, rows by classes."""
        rows, classes = len(x), len(self.baseline)
        out = np.tile(self.baseline.astype(float), (rows, 1))
        at = np.arange(rows)
        for tree in range(len(self.feature)):
            node = np.zeros(rows, int)
            while True:
                feature = self.feature[tree, node]
                inner = feature >= 0
                if not inner.any():
                    break
                v = x[at, np.where(inner, feature, 0)]
                go_left = np.where(np.isnan(v), self.missing_left[tree, node].astype(bool), v <= self.threshold[tree, node])
                step = np.where(go_left, self.left[tree, node], self.right[tree, node])
                node = np.where(inner, step, node)
            out[:, tree % classes] += self.value[tree, node]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if raw.shape[1] == 1:
            p = 1 / (1 + np.exp(-raw[:, 0]))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def score(forest: Forest, *features: Column, raw: bool = False) -> Column:
    """Array of the classes' probabilities (``raw``: sums) of rows; a null feature is missing."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in cols])
        got = forest.raw(x) if raw else forest.probabilities(x)
        return pd.Series(list(got))

    return run(*[c.cast("double") for c in features])


@dataclass
class TextModel:
    """Weights [bucket, class] and biases over hashed tokens."""

    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, tokens: list[np.ndarray]) -> np.ndarray:
        """Softmax of the bias and the weights of each row's buckets by their counts, scaled to length 1."""
        raw = np.tile(self.bias.astype(float), (len(tokens), 1))
        for i, t in enumerate(tokens):
            if len(t):
                buckets, n = np.unique(t, return_counts=True)
                raw[i] += (n / np.sqrt((n * n).sum())) @ self.weights[buckets]
        e = np.exp(raw - raw.max(axis=1, keepdims=True, initial=-np.inf))
        return e / e.sum(axis=1, keepdims=True)


def text_probabilities(model: TextModel, tokens: Column) -> Column:
    """Array of the classes' probabilities of rows by their token buckets; null counts as no token."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(col: pd.Series) -> pd.Series:
        got = model.probabilities([np.asarray(t, int) if t is not None else np.zeros(0, int) for t in col])
        return pd.Series(list(got))

    return run(tokens)
