"""A small model beside the network: a logistic regression of Spark ML on pooled vectors, chosen by validation loss, with its checkpoints."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import features, metrics
from seqloom.sources import readers, sinks

#: Penalties tried, one an epoch; further epochs halve the last one.
PENALTIES = (0.1, 0.03, 0.01, 0.003, 0.001)
RESIDUE_WIDTH = 14
_CHECKPOINT = re.compile(r"epoch=(\d+)-step=(\d+)\.ckpt/?$")


@dataclass
class Checkpoint:
    """A fitted model with the statistics and settings that it was fitted with."""

    model: LogisticRegressionModel
    stats: DataFrame
    config: readers.Config


def pooled(featurised: DataFrame) -> DataFrame:
    """(uniprot_id, features, label): the protein features and the means of the residue features over positions."""
    rows, zero = F.col("residue_features"), F.array_repeat(F.lit(0.0), RESIDUE_WIDTH)
    total = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r, lambda a, b: a + b.cast("double")))
    means: Column = F.transform(total, lambda x: x / F.greatest(F.size(rows), F.lit(1)))
    values = F.concat(F.col("protein_features").cast("array<double>"), means)
    return featurised.select("uniprot_id", array_to_vector(values).alias("features"), F.col("gelation").cast("double").alias("label"))


def score(vectors: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """(uniprot_id, label, logit, probability)."""
    raw = model.transform(vectors)
    at = lambda c: vector_to_array(F.col(c))[1]
    return raw.select("uniprot_id", "label", at("rawPrediction").alias("logit"), at("probability").alias("probability"))


def train(training: DataFrame, validation: DataFrame, stats: DataFrame, config: readers.Config, patience: int | None = None) -> tuple[LogisticRegressionModel, list[dict]]:
    """The model of least validation loss among config.epochs ones, and the history (epoch, step, val_loss).

    Tables are in the integrated schema. An epoch fits with a smaller penalty; after `patience` epochs without a
    smaller loss no more are fitted. Training rows of one class only, or none in either table, raise.
    """
    if config.epochs < 1 or config.batch_size < 1 or (patience is not None and patience < 1):
        raise ValueError("epochs, batch_size and patience must be positive")
    fit, held = (pooled(features.featurised(t, stats)) for t in (training, validation))
    sizes = fit.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if sizes["k"] < 2:
        raise ValueError("the training rows lack a class")
    steps = -(-sizes["n"] // config.batch_size)
    best, history = None, []
    for epoch in range(config.epochs):
        penalty = PENALTIES[epoch] if epoch < len(PENALTIES) else PENALTIES[-1] / 2 ** (epoch - len(PENALTIES) + 1)
        model = LogisticRegression(maxIter=50, regParam=penalty).fit(fit)
        loss = score(held, model).agg(F.avg(metrics.bce(F.col("logit"), F.col("label")))).first()[0]
        if loss is None:
            raise ValueError("no validation rows")
        history.append({"epoch": epoch, "step": steps * (epoch + 1), "val_loss": loss})
        if best is None or loss < best[0]:
            best = (loss, model, epoch)
        elif patience is not None and epoch - best[2] >= patience:
            break
    return best[1], history


def save(checkpoint: Checkpoint, folder: str, epoch: int, step: int) -> str:
    """Writes folder/epoch=E-step=S.ckpt: the model, the statistics, the settings."""
    path = f"{folder.rstrip('/')}/epoch={epoch}-step={step}.ckpt"
    spark = checkpoint.stats.sparkSession
    # One row, taken before anything is overwritten: it may come from this very checkpoint.
    stats = spark.createDataFrame([checkpoint.stats.first()], checkpoint.stats.schema)
    checkpoint.model.write().overwrite().save(f"{path}/model")
    sinks.write_stats(stats, f"{path}/stats")
    spark.createDataFrame([asdict(checkpoint.config)]).coalesce(1).write.mode("overwrite").json(f"{path}/config")
    return path


def load(spark: SparkSession, path: str) -> Checkpoint:
    """What save() wrote; a missing or incomplete checkpoint raises."""
    if not _CHECKPOINT.search(path):
        raise ValueError(f"{path} isn't named epoch=E-step=S.ckpt")
    settings = spark.read.json(f"{path}/config").first()
    if settings is None:
        raise ValueError(f"{path} has no settings")
    return Checkpoint(LogisticRegressionModel.load(f"{path}/model"), readers.read_stats(spark, f"{path}/stats"), readers.Config(**settings.asDict()))


def evaluate(table: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """metrics.evaluate of the integrated table, batches dealt in the order of ids."""
    scored = score(pooled(features.featurised(table, checkpoint.stats)), checkpoint.model)
    return metrics.evaluate(readers.numbered(scored, ["uniprot_id"]), "logit", "label", "global_index", checkpoint.config.batch_size)


def predict(table: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """(uniprot_id, logit, probability) of the rows with a sequence."""
    return score(pooled(features.featurised(table, checkpoint.stats)), checkpoint.model).drop("label")
