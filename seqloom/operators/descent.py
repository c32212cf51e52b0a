"""Training of the network by synchronous mini-batch descent, and checkpoints that a run goes on from.

Weights are sent to the tasks once a step. Each task sums the gradients of its rows of the batch, and a tree of aggregates adds the tasks' sums; the driver
only sees one vector of weights a step, whose norm it clips and whose moments it updates. Sums are of integers (gradients in steps of 2**-30), so
that the order in which tasks end changes nothing: the same rows, settings and seed give the same weights.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import features, metrics
from seqloom.operators.network import Network, columns, predict
from seqloom.sources import readers
from seqloom.storage import folder as folder_of
from seqloom.storage import forget, saved, ship

CLIP, DECAY, DECAY_SQUARES, TINY = 1.0, 0.9, 0.999, 1e-8
#: Steps in which gradients are summed, and the largest sum of a task: thousands of tasks fit in 64 bits.
UNIT, LARGEST = 2.0**30, 2.0**20
_NAME = re.compile(r"epoch=(\d+)-step=(\d+)\.ckpt/?$")


@dataclass
class Run:
    """What a run is made of: weights, the moments of their gradients, how far it got, and what it started from."""

    config: readers.Config
    stats: dict[str, list[float]]
    seed: int
    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    epoch: int = 0
    step: int = 0
    history: list[dict] = field(default_factory=list)

    def network(self) -> Network:
        return _shape(self.config, self.seed).with_flat(self.weights)


def _shape(config: readers.Config, seed: int) -> Network:
    return Network.random(seed, config.embed_dim, config.num_filters, tuple(config.kernel_sizes), config.protein_encode_dim)


def start(config: readers.Config, stats: DataFrame, seed: int = 0) -> Run:
    """A run before its first step."""
    row = stats.first()
    weights = _shape(config, seed).flat()
    return Run(config, {k: list(row[k]) for k in readers.STATS_KEYS}, seed, weights, np.zeros_like(weights), np.zeros_like(weights))


def _stats_row(spark: SparkSession, run: Run) -> DataFrame:
    return spark.createDataFrame([tuple(run.stats[k] for k in readers.STATS_KEYS)], ", ".join(f"{k} array<double>" for k in readers.STATS_KEYS))


def _deals(table: DataFrame, run: Run) -> tuple[DataFrame, int, int, int]:
    """The featurised rows in small deals by a seeded order, written once; their number, deals a batch, and the number of rows."""
    batch = run.config.batch_size
    each = min(16, max(2, batch // 512)) if batch > 1 else 1
    size = -(-batch // each)
    rows = saved(features.featurised(table, _stats_row(table.sparkSession, run)), "featurised")
    placed = features.shuffled(rows, "uniprot_id", run.seed).withColumn("deal", F.floor(F.col("place") / size).cast("long"))
    n = rows.count()
    path = folder_of(table.sparkSession, "deals")
    placed.repartition("deal").sortWithinPartitions("deal", "place").write.partitionBy("deal").parquet(path)  # a batch reads its own folders alone
    out = table.sparkSession.read.schema(placed.schema).parquet(path)
    out._saved_at = path
    forget(rows)
    return out, -(-n // size), each, n


def masks_of(ids: list[str], seed: int, step: int, rate: float, width: int = 128) -> np.ndarray | None:
    """Dropout of each row's hidden units, by seed, step and id alone."""
    if rate <= 0:
        return None
    return np.stack([(np.random.default_rng((seed, step, zlib.crc32((i or "").encode()))).random(width) >= rate) / (1 - rate) for i in ids])


def summed_gradient(rows: DataFrame, network: Network, seed: int = 0, step: int = 0, dropout: float = 0.0) -> tuple[float, np.ndarray, int]:
    """Cross-entropy and gradient, summed over featurised rows, and the number of rows."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(network)

    def gradients(batches):
        net = sent.value
        total, loss, n = np.zeros(net.parameters()), 0.0, 0
        for b in batches:
            y = b.column("gelation").to_numpy(zero_copy_only=False).astype(np.float64)
            one, g = net.gradient(*columns(b), y, masks_of(b.column("uniprot_id").to_pylist(), seed, step, dropout))
            total, loss, n = total + g, loss + one, n + len(y)
        vector = np.append(total, loss)
        if not np.isfinite(vector).all() or np.abs(vector).max() >= LARGEST:
            raise OverflowError("a gradient isn't finite or too large; a smaller learning rate or batch may help")
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.rint(vector * UNIT).astype("<i8").tobytes()], pa.binary())], ["n", "sums"])

    parts = rows.select("uniprot_id", "sequence", "residue_features", "protein_features", "gelation").mapInArrow(gradients, "n long, sums binary").rdd
    add = lambda a, b: b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])
    got = parts.treeAggregate(None, lambda a, r: add(a, (r["n"], np.frombuffer(bytes(r["sums"]), dtype="<i8").astype(np.int64))), add)
    sent.destroy()
    if got is None:
        return 0.0, np.zeros(network.parameters()), 0
    sums = got[1] / UNIT
    return float(sums[-1]), sums[:-1], got[0]


def updated(run: Run, gradient: np.ndarray) -> Run:
    """The run one step on: the mean gradient clipped to a norm of CLIP, its moments, and the weights moved by them."""
    norm = float(np.sqrt((gradient * gradient).sum()))
    g = gradient * (CLIP / norm) if norm > CLIP else gradient
    step = run.step + 1
    mean, square = DECAY * run.mean + (1 - DECAY) * g, DECAY_SQUARES * run.square + (1 - DECAY_SQUARES) * g * g
    move = (mean / (1 - DECAY**step)) / (np.sqrt(square / (1 - DECAY_SQUARES**step)) + TINY)
    return replace(run, weights=run.weights - run.config.lr * move, mean=mean, square=square, step=step)


def _loss(rows: DataFrame, network: Network) -> float | None:
    return predict(rows, network, ("gelation",)).agg(F.avg(metrics.bce(F.col("logit"), F.col("gelation").cast("double")))).first()[0]


def fit(training: DataFrame, validation: DataFrame, run: Run, folder: str | None = None, patience: int | None = None) -> Run:
    """The run of least validation loss, this one taken on to config.epochs epochs. Its history has what every epoch gave (epoch, step, train_loss, val_loss).

    Tables are in the integrated schema. The order of batches and their rows differ from epoch to epoch. With a folder each
    epoch is saved there. After `patience` epochs without a smaller loss it ends. Training rows of one class only, or none in either table, raise.
    """
    c = run.config
    if c.epochs < 1 or c.batch_size < 1 or not 0 <= c.dropout < 1 or (patience is not None and patience < 1):
        raise ValueError("epochs, batch_size and patience must be positive, dropout from 0 to below 1")
    spark = training.sparkSession
    deals, n_deals, each, n = _deals(training, run)
    held = saved(features.featurised(validation, _stats_row(spark, run)), "validation")
    if held.isEmpty():
        raise ValueError("no validation rows")
    if deals.agg(F.count_distinct("gelation")).first()[0] < 2:
        raise ValueError("the training rows lack a class")
    best = None
    while run.epoch < c.epochs:
        order = np.random.default_rng((run.seed, run.epoch)).permutation(n_deals)
        total = 0.0
        for at in range(0, n_deals, each):
            rows = deals.where(F.col("deal").isin(order[at : at + each].tolist()))
            loss, gradient, size = summed_gradient(rows, run.network(), run.seed, run.step, c.dropout)
            total += loss
            run = updated(run, gradient / max(1, size))
        loss = _loss(held, run.network())
        entry = {"epoch": run.epoch, "step": run.step, "train_loss": total / n, "val_loss": loss}
        run = replace(run, epoch=run.epoch + 1, history=[*run.history, entry])
        if folder:
            save(spark, run, folder)
        if loss == min(h["val_loss"] for h in run.history):
            best = run
        least = min(run.history, key=lambda h: (h["val_loss"], h["epoch"]))
        if patience is not None and run.epoch - 1 - least["epoch"] >= patience:
            break
    forget(deals)
    forget(held)
    return replace(best, history=run.history) if best else run


def path_of(folder: str, run: Run) -> str:
    return f"{folder.rstrip('/')}/epoch={run.epoch - 1}-step={run.step}.ckpt"


def save(spark: SparkSession, run: Run, folder: str) -> str:
    """Writes the run and claims folder/epoch=E-step=S.ckpt for it, in one step: a reader sees all of it or nothing. A name that is taken raises FileExistsError."""
    path, data = path_of(folder, run), f"{folder.rstrip('/')}/data/{uuid.uuid4().hex}"
    rows = [(name, getattr(run, name).tolist()) for name in ("weights", "mean", "square")]
    spark.createDataFrame(rows, "name string, values array<double>").coalesce(1).write.parquet(data)
    facts = {"data": data, "config": asdict(run.config), "stats": run.stats, "seed": run.seed, "epoch": run.epoch, "step": run.step, "history": run.history}
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    from py4j.protocol import Py4JJavaError

    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        kind = e.java_exception.getClass().getName()
        files.delete(hadoop.Path(data), True)
        if kind.endswith("FileAlreadyExistsException"):
            raise FileExistsError(path) from None
        raise
    try:
        out.write(bytearray(json.dumps(facts).encode()))
    finally:
        out.close()
    return path


def load(spark: SparkSession, path: str) -> Run:
    """The run that save() wrote at path; a missing or incomplete one raises."""
    if not _NAME.search(path):
        raise ValueError(f"{path} isn't named epoch=E-step=S.ckpt")
    facts = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
    rows = {r["name"]: np.array(r["values"], dtype=np.float64) for r in spark.read.parquet(facts["data"]).collect()}
    config = readers.Config(**facts["config"])
    if any(len(rows.get(k, ())) != _shape(config, 0).parameters() for k in ("weights", "mean", "square")):
        raise ValueError(f"{path} lacks weights")
    return Run(config, facts["stats"], facts["seed"], rows["weights"], rows["mean"], rows["square"], facts["epoch"], facts["step"], facts["history"])


def is_run(spark: SparkSession, path: str) -> bool:
    """Whether path is a run's checkpoint: one file, where those of the pooled model are folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isFile()


def evaluate(table: DataFrame, run: Run) -> DataFrame:
    """metrics.evaluate of the integrated table, batches dealt in the order of ids."""
    rows = features.featurised(table, _stats_row(table.sparkSession, run))
    scored = predict(rows, run.network(), ("gelation",)).withColumn("label", F.col("gelation").cast("double"))
    return metrics.evaluate(readers.numbered(scored, ["uniprot_id"]), "logit", "label", "global_index", run.config.batch_size)


def scores(table: DataFrame, run: Run) -> DataFrame:
    """(uniprot_id, logit, probability) of the rows with a sequence."""
    return predict(features.featurised(table, _stats_row(table.sparkSession, run)), run.network())
