"""Learned models over feature tables, behind one small interface: fit(train) then score(rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip
from tidemark.session import require_columns


def _numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"n_{c}": F.col(c).cast("double") for c in cols} | {f"gap_{c}": F.col(c).isNull().cast("double") for c in cols})


class Model:
    """Features: medians for missing numbers plus a column that marks them, standardised; categories one-hot, unknown ones all zero."""

    def __init__(self, estimator, numeric: Sequence[str], categories: Sequence[str] = (), label: str = "label", balanced: bool = False, positive: bool = True):
        self.estimator, self.numeric, self.categories, self.label, self.balanced, self.positive = estimator, list(numeric), list(categories), label, balanced, positive
        self.fitted: PipelineModel | None = None

    def _prepared(self, df: DataFrame) -> DataFrame:
        require_columns(df, *self.numeric, *self.categories)
        return _numeric(df, self.numeric).withColumns({f"s_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.categories})

    def fit(self, train: DataFrame) -> Model:
        require_columns(train, self.label)
        t = self._prepared(train.where(F.col(self.label).isNotNull())).withColumn("label_", F.col(self.label).cast("double"))
        if self.balanced:
            n = {r.label_: r.n for r in t.groupBy("label_").agg(F.count("*").alias("n")).collect()}
            if len(n) < 2:
                raise ValueError("only one class is present")
            t = t.withColumn("weight_", F.when(F.col("label_") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0])))
        # a column without a single number has no median: it says nothing and is left out
        some = t.agg(*(F.count(f"n_{c}").alias(c) for c in self.numeric)).first()
        used = [c for c in self.numeric if some[c]]
        n_rows = t.count()
        gaps = [c for c in used if some[c] < n_rows]
        stages = [Imputer(strategy="median", inputCols=[f"n_{c}" for c in used], outputCols=[f"i_{c}" for c in used])]
        stages += [VectorAssembler(inputCols=[f"i_{c}" for c in used], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
        parts = ["scaled", *(f"gap_{c}" for c in gaps)]
        if self.categories:
            stages += [StringIndexer(inputCols=[f"s_{c}" for c in self.categories], outputCols=[f"x_{c}" for c in self.categories], handleInvalid="keep")]
            stages += [OneHotEncoder(inputCols=[f"x_{c}" for c in self.categories], outputCols=[f"o_{c}" for c in self.categories])]
            parts += [f"o_{c}" for c in self.categories]
        stages += [VectorAssembler(inputCols=parts, outputCol="features"), self.estimator(t, self.balanced)]
        self.fitted = Pipeline(stages=stages).fit(t)
        return self

    def score(self, df: DataFrame, id: Sequence[str]) -> DataFrame:
        """The id columns and score: the probability of label 1, or the forecast, at least 0."""
        if self.fitted is None:
            raise RuntimeError("score before fit")
        out = self.fitted.transform(self._prepared(df))
        if "probability" in out.columns:
            return out.select(*id, vector_to_array("probability")[1].alias("score"))
        return out.select(*id, (F.greatest("prediction", F.lit(0.0)) if self.positive else F.col("prediction")).alias("score"))


class Expression:
    """A model without a fit: the score is a column or expression of the features, held within 0 and 1 (not calibrated)."""

    def __init__(self, score: Column | str, *needs: str):
        self.needs = needs or ((score,) if isinstance(score, str) else ())
        self.column = F.col(score) if isinstance(score, str) else score

    def fit(self, train: DataFrame) -> Expression:
        require_columns(train, *self.needs)
        return self

    def score(self, df: DataFrame, id: Sequence[str]) -> DataFrame:
        return df.select(*id, clip(self.column.cast("double"), 0.0, 1.0).alias("score"))


def mark_best(table: DataFrame, metric: str, name: str, order: Sequence[str], more: bool = True) -> DataFrame:
    """Adds is_best: whether the row has the best value of the metric; of equal ones the first of ``order``. Null is never best."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    best = F.max_by if more else F.min_by
    value = F.struct(F.col(metric).alias("m"), (-place if more else place).alias("p"))
    one = table.where(F.col(metric).isNotNull() & ~F.isnan(metric)).agg(best(F.col(name), value).alias("__best"))
    return table.join(F.broadcast(one)).withColumn("is_best", F.col(name).eqNullSafe(F.col("__best"))).drop("__best")


def _weight(balanced: bool) -> dict:
    return {"weightCol": "weight_"} if balanced else {}


def logistic(c: float = 1.0):
    """Logistic regression with the penalty 1 / (c n), as sums over rows rather than means would have it."""
    return lambda t, b: LogisticRegression(featuresCol="features", labelCol="label_", regParam=1 / (c * max(t.count(), 1)), standardization=False, maxIter=50, tol=1e-4, **_weight(b))


def boosted_classifier(trees: int = 20, depth: int = 5, seed: int = 7):
    """Gradient-boosted trees in the place of a boosting library that isn't part of Spark: same role, other numbers."""
    return lambda t, b: GBTClassifier(featuresCol="features", labelCol="label_", maxIter=trees, maxDepth=depth, seed=seed, **_weight(b))


def boosted_regressor(trees: int = 20, depth: int = 5, seed: int = 7):
    return lambda t, b: GBTRegressor(featuresCol="features", labelCol="label_", maxIter=trees, maxDepth=depth, seed=seed)


def tweedie(power: float = 1.2):
    """Log-link Tweedie regression: the nearest built-in to trees with a Tweedie loss."""
    return lambda t, b: GeneralizedLinearRegression(featuresCol="features", labelCol="label_", family="tweedie", variancePower=power, linkPower=0.0, regParam=0.01, maxIter=25)
