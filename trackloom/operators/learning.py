"""Features, fitted weights and calibrators on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_counts(atoms: DataFrame, state: Column) -> DataFrame:
    """Bag-of-atoms counts per (example, feature): the predicate and its last argument."""
    names = F.explode(
        F.array(F.concat(F.lit("predicate::"), F.col("pred")), F.concat(F.lit("state::"), F.col("pred"), F.lit("::"), state))
    )
    return atoms.select("example_id", names.alias("feature")).groupBy("example_id", "feature").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """Features that occur in enough examples, numbered by name; the vocabulary is small by its nature."""
    from trackloom.operators.ordered import Ordered, row_number

    kept = counts.groupBy("feature").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)
    first = F.ascii("feature").cast("bigint")
    return Ordered([], ["feature"], first).scan(kept, n=row_number()).select("feature", "documents", (F.col("n") - 1).alias("index"))


def firing_vectors(examples: DataFrame, fired: DataFrame, size: int) -> DataFrame:
    """Sparse rule vectors of labelled examples; a vector lists the rules of one example, at most ``size``.

    ``fired`` has (example_id, position) with positions below ``size``.
    """
    lists = fired.groupBy("example_id").agg(F.collect_list(F.col("position").cast("string")).alias("rules"))
    joined = examples.join(lists, "example_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    index = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="rules", outputCol="features", minTF=1.0)
    return index.transform(joined.withColumn("target", F.col("label").cast("double"))).drop("rules")


def listed_vectors(rows: DataFrame, size: int) -> DataFrame:
    """``firing_vectors`` of rows that list the rules of an example, numbered from 1, in ``fired``."""
    index = CountVectorizerModel.from_vocabulary([str(i) for i in range(1, size + 1)], inputCol="rules", outputCol="features", minTF=1.0)
    listed = rows.withColumn("rules", F.col("fired").cast("array<string>")).withColumn("target", F.col("label").cast("double"))
    return index.transform(listed).drop("rules")


def fit_rule_weights(vectors: DataFrame, c: float, rows: int, weight: str | None = None):
    """L1 logistic regression over rule firings; ``c`` is the inverse strength, ``weight`` the number of examples of a row."""
    model = LogisticRegression(
        featuresCol="features", labelCol="target", elasticNetParam=1.0, regParam=1.0 / (c * max(1, rows)), maxIter=50, standardization=False
    )
    return (model.setWeightCol(weight) if weight else model).fit(vectors)


def scored(model, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def dense_vectors(wide: DataFrame, columns: list[str], label: Column) -> DataFrame:
    values = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in columns])
    return wide.withColumn("features", array_to_vector(values)).withColumn("target", label.cast("double"))


def fit_symbolic_classifier(vectors: DataFrame, inputs: int, hidden: int = 8, seed: int = 7):
    """Small feed-forward classifier on bag-of-atoms."""
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="target", layers=[inputs, hidden, 2], maxIter=30, seed=seed
    ).fit(vectors)


def fit_calibrator(vectors: DataFrame, strength: float = 1.0, rows: int = 1):
    """L2 logistic calibrator on standardised features."""
    return LogisticRegression(
        featuresCol="features", labelCol="target", elasticNetParam=0.0, regParam=1.0 / (strength * max(1, rows)), standardization=True, maxIter=50
    ).fit(vectors)


def subset_scores(fired: DataFrame, weights: DataFrame, intercept: float, subsets: dict[str, Column]) -> DataFrame:
    """Probability of each example under subsets of weighted rules: the sigmoid of the summed weights."""
    joined = fired.join(weights, "rule_id")
    sums = [F.sum(F.when(test, F.col("weight")).otherwise(0.0)).alias(name) for name, test in subsets.items()]
    total = joined.groupBy("example_id").agg(*sums)
    return total.select("example_id", *[(1 / (1 + F.exp(-(F.col(n) + intercept)))).alias(n) for n in subsets])


def listed_subset_scores(rows: DataFrame, weighted: str, intercept: float, subsets: dict) -> DataFrame:
    """``subset_scores`` of examples in rows that list their rules as (rule_id, weight); a subset tests such a rule."""
    total = lambda test: F.aggregate(F.filter(weighted, test), F.lit(0.0), lambda s, w: s + w["weight"])
    return rows.select("example_id", *[(1 / (1 + F.exp(-(total(test) + intercept)))).alias(n) for n, test in subsets.items()])
