"""Commands over datasets in the integrated schema: python -m seqloom.cli COMMAND --help."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import descent, encoding, features, integrate, metrics, spatial, structures, training
from seqloom.sources import readers, sinks
from seqloom.storage import saved


def write_integrated(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records, domain hits and structures as one partitioned dataset."""
    volume = readers.read_weights(spark, a.volume) if a.volume else None
    shapes = structures.read_structures(spark, a.structures, a.residues)
    table = integrate.integrate(readers.read_records(spark, a.records), readers.read_domains(spark, a.domains), shapes, readers.read_weights(spark, a.weights), volume)
    sinks.write_partitioned(table, a.output)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    """Counts of a dataset, and its first rows by id."""
    table = readers.read_dataset(spark, a.input)
    integrate.summary(table).show()
    readers.head(table.select("uniprot_id", "sequence_length", "gelation"), a.rows, ["uniprot_id"]).show(a.rows, truncate=False)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """The paths of structure files whose names hold an id of a FASTA file, as text."""
    files = readers.list_files(spark, a.folder, a.suffix)
    readers.matching_files(files, readers.read_fasta_ids(spark, a.fasta)).select(F.col("path").alias("value")).write.mode("overwrite").text(a.output)


def calculate_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_stats(features.stats(readers.read_dataset(spark, a.input)), a.output)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whole clusters of similar sequences go to the training or the test dataset."""
    if min(a.max_len, a.min_samples) < 1 or a.eps <= 0:
        raise ValueError("max-len, eps and min-samples must be positive")
    table = readers.read_dataset(spark, a.input)
    if a.encoder:
        made = saved(encoding.encode(table, encoding.find(a.encoder), longest=a.max_len), "encoded")
        failed = made.where("error IS NOT NULL").select("uniprot_id", "error")
        if a.errors:
            failed.write.mode("overwrite").json(a.errors)
        elif not failed.isEmpty():
            raise ValueError(f"the encoder failed: {failed.first()['error']}; with --errors the other sequences are split")
        made = made.where("error IS NULL").select("uniprot_id", "embedding")
    else:
        made = metrics.embed(table.select("uniprot_id", F.substring("sequence", 1, a.max_len).alias("sequence")))
    vectors = saved(readers.numbered(made, ["uniprot_id"], "vec_id"), "vectors")
    if a.embeddings:
        sinks.write_embeddings(vectors, a.embeddings)
    sides = spatial.cluster_split(spatial.dbscan(vectors, a.eps, a.min_samples), a.test_ratio, a.seed)
    sides = saved(vectors.select(F.col("vec_id").alias("id"), "uniprot_id").join(sides, "id"), "sides")
    for side, path in (("train", a.train), ("test", a.test)):
        sinks.write_subset(table, sides.where(F.col("split") == side).select("uniprot_id"), path)


def train(spark: SparkSession, a: argparse.Namespace) -> str:
    """Fits, writes checkpoints and returns the path of the best one.

    --kind network: the network, each epoch a checkpoint; with --model the run of that checkpoint goes on from its epoch, to the epochs of --config if given.
    --kind pooled: a logistic regression on pooled vectors; with --model that checkpoint's settings and statistics are taken up again.
    """
    if not (a.model or a.stats):
        raise ValueError("train needs --stats or --model")
    tables: list[DataFrame] = [readers.read_dataset(spark, p) for p in (a.train, a.val)]
    given = readers.load_config(a.config) if a.config else None
    if a.kind == "network":
        if a.model:
            run = descent.load(spark, a.model)
            run = replace(run, config=replace(run.config, epochs=given.epochs)) if given else run
        else:
            run = descent.start(given or readers.Config(), readers.read_stats(spark, a.stats), a.seed)
        best = descent.fit(*tables, run, a.output, a.patience or None)
        return descent.path_of(a.output, best)
    if a.kind != "pooled":
        raise ValueError("kind is network or pooled")
    if a.model:
        old = training.load(spark, a.model)
        stats, config = old.stats, old.config
    else:
        stats, config = readers.read_stats(spark, a.stats), given or readers.Config()
    model, history = training.train(*tables, stats, config)
    best = min(history, key=lambda h: (h["val_loss"], h["epoch"]))
    return training.save(training.Checkpoint(model, stats, config), a.output, best["epoch"], best["step"])


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    table = readers.read_dataset(spark, a.test)
    scores = descent.evaluate(table, descent.load(spark, a.model)) if descent.is_run(spark, a.model) else training.evaluate(table, training.load(spark, a.model))
    sinks.write_report(scores, a.results)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    table = readers.read_dataset(spark, a.input)
    scores = descent.scores(table, descent.load(spark, a.model)) if descent.is_run(spark, a.model) else training.predict(table, training.load(spark, a.model))
    sinks.write_predictions(scores, a.results)


#: command: (function, required flags, optional flags with their defaults)
COMMANDS = {
    "integrate": (write_integrated, ("records", "domains", "structures", "residues", "weights", "output"), {"volume": ""}),
    "check": (check, ("input",), {"rows": 5}),
    "extract": (extract, ("folder", "fasta", "output"), {"suffix": ".pdb.gz"}),
    "stats": (calculate_stats, ("input", "output"), {}),
    "split": (split, ("input", "train", "test"), {"encoder": "", "errors": "", "embeddings": "", "max_len": 1022, "eps": 0.01, "min_samples": 10, "test_ratio": 0.2, "seed": 42}),
    "train": (train, ("train", "val", "output"), {"stats": "", "config": "", "model": "", "kind": "network", "seed": 0, "patience": 0}),
    "evaluate": (evaluate, ("test", "model", "results"), {}),
    "predict": (predict, ("input", "model", "results"), {}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seqloom")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, required, optional) in COMMANDS.items():
        c = commands.add_parser(name)
        for flag in required:
            c.add_argument(f"--{flag.replace('_', '-')}", required=True)
        for flag, default in optional.items():
            c.add_argument(f"--{flag.replace('_', '-')}", default=default, type=type(default))
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(arguments)
    return COMMANDS[a.command][0](spark or SparkSession.builder.appName(f"seqloom-{a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
