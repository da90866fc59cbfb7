"""Random-forest regression on mixed predictors and its importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from visitlens.operators.sizing import durable, local_table, small_table
from visitlens.operators.skew import global_index

TREES = 500


@dataclass
class Forest:
    model: PipelineModel
    predictors: list[str]
    response: str
    holdout: DataFrame

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_forest(
    df: DataFrame,
    response: str,
    key: str,
    exclude: Sequence[str] = (),
    trees: int = TREES,
    depth: int = 8,
    seed: int = 3008,
    holdout: float = 0.2,
) -> Forest:
    """Forest on all other columns; a keyed hash sets a hold-out aside, as there are no out-of-bag rows.

    `exclude` names columns that are not predictors, such as the patient. Complete rows are made durable, and so are the
    sorted training rows: every pass of the learner and of the scoring reads these and runs nothing above them.
    """
    predictors = [c for c in df.columns if c not in {response, key, *exclude}]
    texts = [f.name for f in df.schema if f.name in predictors and isinstance(f.dataType, StringType)]
    rows = df.dropna(subset=[response, *predictors])
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000))
    rows = durable(rows.withColumn("_held", bucket < int(holdout * 1000)))
    names = [f"{c}_index" if c in texts else c for c in predictors]
    counted = rows.agg(*[F.count_distinct(c) for c in texts]).first() if texts else []
    levels = max([32, *counted])
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in texts]
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    stages.append(RandomForestRegressor(
        labelCol=response, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=5,
        featureSubsetStrategy="onethird", maxBins=levels + 2, seed=seed,
    ))
    # Sampling inside the learner depends on row order, so the training rows are fixed by key first.
    train = rows.filter(~F.col("_held")).select(key, response, *predictors)
    train = durable(train.repartitionByRange(key).sortWithinPartitions(key))
    model = Pipeline(stages=stages).fit(train)
    return Forest(model, predictors, response, rows.filter("_held").drop("_held"))


def forest_fit(forest: Forest) -> DataFrame:
    """One row: trees and hold-out error."""
    y = F.col(forest.response)
    scored = forest.score(forest.holdout)
    return scored.agg(
        F.lit(forest.model.stages[-1].getNumTrees).alias("trees"), F.count(F.lit(1)).alias("n_holdout"),
        F.avg(F.pow(F.col("prediction") - y, F.lit(2))).alias("mse"),
        (1 - F.avg(F.pow(F.col("prediction") - y, F.lit(2))) / F.var_pop(y)).alias("variance_explained"),
    )


def forest_importance(forest: Forest, key: str, seed: int = 3008) -> DataFrame:
    """(predictor, impurity, mse_increase): increase of the hold-out error when one column is permuted.

    One hashed order gives every row a partner half way round; each predictor is scored once with the
    partner's value. All predictors are scored in a single pass over exploded rows.
    """
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = global_index(forest.holdout.withColumn("_order", order), ["_order", key], "_place").drop("_order")
    n = rows.count()
    partner = rows.select(
        F.pmod(F.col("_place") + F.lit(n // 2 + 1), F.lit(max(n, 1))).alias("_place"),
        *[F.col(c).alias(f"_partner_{c}") for c in forest.predictors],
    )
    joined = rows.join(partner, "_place")
    variants = joined.withColumn("_variant", F.explode(F.array(F.lit(""), *[F.lit(c) for c in forest.predictors])))
    swapped = variants.withColumns({
        c: F.when(F.col("_variant") == c, F.col(f"_partner_{c}")).otherwise(F.col(c)) for c in forest.predictors
    })
    error = F.pow(F.col("prediction") - F.col(forest.response), F.lit(2))
    # One row per predictor, fetched once: the rows are scored for these only.
    errors = small_table(forest.score(swapped).groupBy("_variant").agg(F.avg(error).alias("mse")))
    base = errors.filter("_variant = ''").agg(F.max("mse")).scalar()
    impurity = forest.model.stages[-1].featureImportances.toArray()
    shares = local_table(
        forest.holdout.sparkSession, [(c, float(v)) for c, v in zip(forest.predictors, impurity)],
        "predictor string, impurity double",
    )
    increase = errors.filter("_variant <> ''").select(F.col("_variant").alias("predictor"), (F.col("mse") - base).alias("mse_increase"))
    return shares.join(increase, "predictor", "left")


def ranked_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("mse_increase"), "predictor")
