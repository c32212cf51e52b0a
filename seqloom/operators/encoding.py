"""Sequences to vectors by a user's own encoder, which takes a list of sequences and gives a row of numbers each."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.storage import ship

#: Positions that an encoder gets at a time, padding to the longest of them included.
CELLS = 1 << 16

Encoder = Callable[[list[str]], np.ndarray]


def packs(lengths: list[int], cells: int = CELLS) -> list[list[int]]:
    """Places of sequences that go to the encoder together: of like length, at most `cells` positions with their padding, or one sequence."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    out: list[list[int]] = []
    for i in order:
        if out and max(1, lengths[i]) * (len(out[-1]) + 1) <= cells:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def encode(sequences: DataFrame, encoder: Encoder, cells: int = CELLS, longest: int = S.MAX_LENGTH) -> DataFrame:
    """(uniprot_id, embedding array<float>, truncated, error) of rows (uniprot_id, sequence), in any order.

    The encoder gets the first `longest` residues, in packs of like length of at most `cells` positions. If it fails on a pack, or gives other than a
    row of finite numbers a sequence, the rows of that pack have no embedding and say why in error; all others are kept. Null and
    empty sequences are left out. A sequence's vector is the encoder's; which sequences share its pack is for the encoder not to show.
    """
    ship(sequences.sparkSession)
    rows = sequences.select(F.col("uniprot_id").cast("string").alias("uniprot_id"), *(c.alias(n) for c, n in zip(S.truncate(F.col("sequence"), longest), ("sequence", "truncated"), strict=True))).where("sequence <> ''")

    def run(batches):
        for b in batches:
            ids, texts = b.column("uniprot_id").to_pylist(), b.column("sequence").to_pylist()
            vectors, errors = [None] * len(texts), [None] * len(texts)
            for pack in packs(list(map(len, texts)), cells):
                try:
                    got = np.asarray(encoder([texts[i] for i in pack]), dtype=np.float32)
                    if got.ndim != 2 or len(got) != len(pack) or not np.isfinite(got).all():
                        raise ValueError(f"the encoder gave {got.shape} for {len(pack)} sequences, or numbers that aren't finite")
                except Exception as e:  # noqa: BLE001 - the encoder is the user's: what it raises is said in the rows
                    for i in pack:
                        errors[i] = f"{type(e).__name__}: {e} (pack of {len(pack)} from {ids[pack[0]]})"
                    continue
                for i, v in zip(pack, got, strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([b.column("uniprot_id"), pa.array(vectors, pa.list_(pa.float32())), b.column("truncated"), pa.array(errors, pa.string())], ["uniprot_id", "embedding", "truncated", "error"])

    return rows.mapInArrow(run, "uniprot_id string, embedding array<float>, truncated boolean, error string")


def find(name: str) -> Encoder:
    """The function that module:function names. Its module is sent to the executors with it."""
    module, colon, function = name.partition(":")
    if not colon:
        raise ValueError(f"{name} isn't module:function")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)
