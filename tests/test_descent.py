"""The network's gradients, training by descent, and runs that go on from a checkpoint."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_commands import dataset

from seqloom import cli
from seqloom.operators import descent, features, network
from seqloom.sources import readers

SMALL = readers.Config(embed_dim=4, num_filters=4, kernel_sizes=[2, 3], protein_encode_dim=4, dropout=0.2, lr=0.02, batch_size=16, epochs=4)


def rows(n=7, seed=2):
    r = np.random.default_rng(seed)
    tokens = [r.integers(0, 22, k) for k in [0, 1, 2, *r.integers(3, 30, n - 3)]]
    return tokens, [r.standard_normal((len(t), 14)) for t in tokens], r.standard_normal((n, 13)), (r.random(n) > 0.5).astype(float)


def naive(net, t, x, p):
    """One row, place by place."""
    least = max(c[0].shape[0] for c in net.convolutions)
    n = max(len(t), least)
    a = np.zeros((n, net.embedding.shape[1] + 14))
    for i in range(n):
        a[i] = np.concatenate([net.embedding[t[i] if i < len(t) else 0], x[i] if i < len(t) else np.zeros(14)])
    pooled = [np.max([np.maximum(np.einsum("kc,kcf->f", a[i : i + len(k)], k) + b, 0) * s + h for i in range(n - len(k) + 1)], axis=0) for k, b, s, h in net.convolutions]
    for w, b, s, h in net.protein:
        p = np.maximum(p @ w + b, 0) * s + h
    (w1, b1), (w2, b2) = net.head
    return float((np.maximum(np.concatenate([*pooled, p]) @ w1 + b1, 0) @ w2 + b2)[0])


def shaken(seed=1):
    net = network.Network.random(seed, 3, 5, (2, 3), 4)
    return net.with_flat(net.flat() + 0.3 * np.random.default_rng(seed).standard_normal(net.parameters()))


@pytest.mark.parametrize("cells", [8, 64, 1 << 15])
def test_batches_score_as_rows_alone(monkeypatch, cells):
    monkeypatch.setattr(network, "CELLS", cells)
    net = shaken()
    tokens, x, p, _ = rows(20)
    assert np.allclose(net.logits(tokens, x, p), [naive(net, *r) for r in zip(tokens, x, p, strict=True)], atol=1e-12)


@pytest.mark.parametrize("masked", [False, True])
def test_gradient_equals_finite_differences(monkeypatch, masked):
    monkeypatch.setattr(network, "CELLS", 40)
    net, (tokens, x, p, y) = shaken(), rows()
    masks = descent.masks_of([f"r{i}" for i in range(len(y))], 3, 1, 0.4) if masked else None
    loss, g = net.gradient(tokens, x, p, y, masks)
    flat = net.flat()
    assert np.array_equal(net.with_flat(flat).flat(), flat)
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (net.with_flat(flat + d).gradient(tokens, x, p, y, masks)[0] for d in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5 * max(1, abs(g[i])), i
    if not masked:
        z = np.array([naive(net, *r) for r in zip(tokens, x, p, strict=True)])
        assert abs(loss - (np.maximum(z, 0) - z * y + np.log1p(np.exp(-abs(z)))).sum()) < 1e-9


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("training")
    for seed, side in enumerate(("train", "val")):
        dataset(spark, str(folder / side), 48, seed)
    train, val = (readers.read_dataset(spark, str(folder / s)) for s in ("train", "val"))
    return train, val, features.stats(train)


def test_summed_gradient_is_that_of_all_rows(spark, tables):
    train, _, stats = tables
    run = descent.start(SMALL, stats, 5)
    f = features.featurised(train, stats)
    loss, g, n = descent.summed_gradient(f.repartition(5), run.network())
    one = descent.summed_gradient(f.coalesce(1), run.network())
    assert n == one[2] == 48
    assert abs(loss - one[0]) < 1e-6
    assert np.abs(g - one[1]).max() < 1e-6


def test_loss_falls_and_a_restart_changes_nothing(spark, tables, tmp_path):
    train, val, stats = tables
    whole = descent.fit(train, val, descent.start(SMALL, stats, 1), str(tmp_path / "whole"))
    losses = [h["val_loss"] for h in whole.history]
    assert len(losses) == 4
    assert losses[-1] < losses[0]
    assert whole.history[whole.epoch - 1]["val_loss"] == min(losses)
    half = descent.fit(train, val, descent.start(replace(SMALL, epochs=2), stats, 1), str(tmp_path / "half"))
    last = descent.load(spark, str(tmp_path / "half" / f"epoch=1-step={half.history[-1]['step']}.ckpt"))
    assert (last.epoch, len(last.history)) == (2, 2)
    on = descent.fit(train, val, replace(last, config=SMALL), str(tmp_path / "half"))
    assert [h["val_loss"] for h in on.history] == losses
    end = f"epoch=3-step={whole.history[-1]['step']}.ckpt"
    a, b = (descent.load(spark, str(tmp_path / side / end)) for side in ("whole", "half"))
    for name in ("weights", "mean", "square"):
        assert np.array_equal(getattr(a, name), getattr(b, name))
    assert np.array_equal(on.weights, whole.weights)
    with pytest.raises(FileExistsError):
        descent.save(spark, a, str(tmp_path / "whole"))
    other = descent.fit(train, val, descent.start(replace(SMALL, epochs=1), stats, 2))
    assert not np.array_equal(other.weights, a.weights)


def test_guards(spark, tables, tmp_path):
    train, val, stats = tables
    run = descent.start(SMALL, stats)
    with pytest.raises(ValueError, match="positive"):
        descent.fit(train, val, replace(run, config=replace(SMALL, epochs=0)))
    with pytest.raises(ValueError, match="lack a class"):
        descent.fit(train.where("gelation = 'yes'"), val, run)
    with pytest.raises(ValueError, match="no validation rows"):
        descent.fit(train, val.limit(0), run)
    with pytest.raises(ValueError, match="isn't named"):
        descent.load(spark, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)path"):
        descent.load(spark, str(tmp_path / "epoch=0-step=1.ckpt"))
    huge = replace(run, weights=run.weights * 1e9)
    with pytest.raises(Exception, match="too large"):
        descent.summed_gradient(features.featurised(train, stats), huge.network())


def test_commands_train_and_go_on(spark, tables, tmp_path):
    train, val, _ = tables
    at = {k: str(tmp_path / k) for k in ("train", "val", "stats", "out", "report", "results")}
    train.write.parquet(at["train"])
    val.write.parquet(at["val"])
    cli.main(["stats", "--input", at["train"], "--output", at["stats"]], spark)
    for epochs in (1, 6):
        (tmp_path / f"{epochs}.yaml").write_text(f"embed_dim: 4\nnum_filters: 4\nprotein_encode_dim: 4\nlr: 0.02\ndropout: 0.1\nbatch_size: 12\nepochs: {epochs}\n")
    first = cli.main(["train", "--train", at["train"], "--val", at["val"], "--output", at["out"], "--stats", at["stats"], "--config", str(tmp_path / "1.yaml")], spark)
    assert first.endswith("epoch=0-step=4.ckpt")
    best = cli.main(["train", "--train", at["train"], "--val", at["val"], "--output", at["out"], "--model", first, "--config", str(tmp_path / "6.yaml")], spark)
    run = descent.load(spark, best)
    assert run.epoch > 1
    assert run.config.epochs == 6
    scores = descent.evaluate(val, run).first()
    assert scores["rows"] == 48
    assert scores["auc"] > 0.9
    cli.main(["evaluate", "--test", at["val"], "--model", best, "--results", at["report"]], spark)
    cli.main(["predict", "--input", at["val"], "--model", best, "--results", at["results"]], spark)
    assert spark.read.csv(at["results"], sep="\t", header=True).count() == 48


def test_shuffled_is_a_permutation_of_any_partitioning(spark):
    ids = [f"k{random.Random(i).random()}" for i in range(3_000)]
    df = spark.createDataFrame([(i, "x") for i in ids], "id string, n string")
    order = lambda d, *a, **k: [r["id"] for r in features.shuffled(d, "id", *a, **k).orderBy("place").collect()]
    one = order(df.coalesce(1), 7)
    assert sorted(one) == sorted(ids)
    assert one == order(df.repartition(9), 7) == order(df.repartition(4), 7, dealt=256)
    assert one != order(df, 8) != order(df, 7, 1)
    got = features.shuffled(df, "id", 7, dealt=256)
    assert {r["place"] for r in got.collect()} == set(range(3_000))
    assert got.columns == ["id", "n", "place"]
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    sizes = got.groupBy(F.floor(F.col("place") / 256)).count()
    assert sizes.count() == 12
    assert features.shuffled(df.limit(0), "id", 1).count() == 0
