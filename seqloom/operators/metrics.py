"""Losses and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.network import Network, predict, scored  # noqa: F401
from seqloom.storage import saved

def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def predicted(p: Column) -> Column:
    return F.when(p > 0.5, 1.0).otherwise(0.0)


def bce(z: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in its stable form."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc, positives, negatives): exact area under the ROC curve by mid-ranks; NULL if a class is missing.

    Scores are counted first, so ranks run over different scores only. These are ranked within ranges of about as many scores each, whose
    bounds Spark takes from a bounded sample, so that near scores don't meet in one task. Infinite scores rank first and last; rows of a NULL or NaN
    score or a NULL label are left out.
    """
    s, y = F.col(score).cast("double"), F.col(label)
    per = df.where(s.isNotNull() & ~F.isnan(s) & y.isNotNull()).groupBy(s.alias("s")).agg(F.count("*").alias("n"), F.sum(F.when(y > 0, 1).otherwise(0)).alias("p"))
    per = saved(per.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = per.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("first"))  # a row a range
    ranked = per.select("part", "n", "p", earlier(Window.partitionBy("part").orderBy("s")).alias("within")).join(F.broadcast(parts), "part")
    ranked = ranked.select("n", "p", (F.col("first") + F.col("within") + (F.col("n") + 1) / 2).alias("mid"))
    totals = ranked.agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("positives"), (F.sum("n") - F.sum("p")).alias("negatives"))
    value = (F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))
    return totals.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), value).alias("auc"), "positives", "negatives")


def evaluate(df: DataFrame, logit: str, label: str, index: str, batch: int = 64) -> DataFrame:
    """One row: rows, accuracy, loss_by_batch (mean of batch means), loss_by_row and auc."""
    z, y = F.col(logit), F.col(label)
    rows = df.select(bce(z, y).alias("loss"), (predicted(sigmoid(z)) == y).cast("double").alias("hit"), F.floor(F.col(index) / batch).alias("b"))
    whole = rows.agg(F.count("*").alias("rows"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("accuracy"), F.avg("loss").alias("loss_by_row"))
    by_batch = rows.groupBy("b").agg(F.avg("loss").alias("m")).agg(F.avg("m").alias("loss_by_batch"))
    return whole.crossJoin(by_batch).crossJoin(auc(df.select(sigmoid(z).alias("s"), y.alias("y")), "s", "y").select("auc"))


def best_so_far(history: DataFrame, epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """history with the running least loss and the epochs since it was set (patience)."""
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = history.withColumn("best", F.min(loss).over(w))
    set_at = F.max(F.when(F.col(loss) == F.col("best"), F.col(epoch))).over(w)
    return out.withColumn("waited", F.col(epoch) - set_at)


def embed(sequences: DataFrame, width: int = 64, k: int = 3) -> DataFrame:
    """(uniprot_id, embedding): signed counts of hashed k-letter pieces, divided by their number; the default where no encoder's vectors are at hand."""
    seq = F.col("sequence")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    rows = sequences.where("sequence <> ''").select("uniprot_id", F.explode(pieces).alias("p"))
    rows = rows.select("uniprot_id", F.pmod(F.xxhash64("p"), F.lit(width)).cast("int").alias("d"), F.when(F.pmod(F.xxhash64("p", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    per = rows.groupBy("uniprot_id", "d").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    lists = per.groupBy("uniprot_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "s"))).alias("m"), F.sum("n").alias("n"))
    value = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n")).cast("float"))
    return lists.select("uniprot_id", value.alias("embedding"))


def mean_pooled(states: DataFrame) -> DataFrame:
    """(uniprot_id, embedding): mean over positions 1 to sequence_length of hidden states (uniprot_id, sequence_length, states array<array<double>>).

    Position 0 is the start mark; later ones are the end mark and padding. Empty sequences give zeros.
    """
    inside = F.slice("states", 2, F.greatest(F.col("sequence_length").cast("int"), F.lit(0)))
    zero = F.transform(F.get("states", F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(inside, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return states.select("uniprot_id", F.transform(total, lambda x: F.when(F.size(inside) > 0, x / F.size(inside)).otherwise(0.0)).alias("embedding"))
