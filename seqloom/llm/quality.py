"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown here, on histograms, with monotonic constraints on chosen features, and flattened
into numpy node arrays; scoring walks all rows of a batch down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.llm.common import column, free_name, table
from seqloom.llm.shingles import mixed, word_hashes

#: Labelled rows that the model is fitted on, at most, chosen by a hash of the id.
FIT_ROWS = 8_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 5.0
#: A document is kept if its probability of good quality is at least this.
KEEP = 0.2
SEED = 17

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, and how the score may move as they grow: 1 only up, -1 only down, 0 freely.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_part": -1, "repeat_part": -1, "digit_part": 0, "upper_part": 0, "distinct_part": 0, "ends_per_word": 0, "letters_part": 0}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES for one text; null and empty texts have zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    h = word_hashes(raw)
    n = len(h)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines, dup, seen = text.split("\n"), 0, set()
    with_word = 0
    for line in lines:
        if line.strip(" \t\v\f\r"):
            with_word += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n >= 3:
        w = mixed(h[:-2]) + mixed(h[1:-1] ^ np.uint64(0x51ED270B)) * np.uint64(3) + h[2:] * np.uint64(5)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        again = np.zeros(n - 2, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        inside = np.zeros(n, dtype=bool)
        inside[:-2] |= again
        inside[1:-1] |= again
        inside[2:] |= again
        repeat = int(inside.sum())
    b = np.frombuffer(raw, dtype=np.uint8)
    size, words = max(1, chars), max(1, n)
    digits = int(((b >= 48) & (b <= 57)).sum())
    upper = int(((b >= 65) & (b <= 90)).sum())
    lower = int(((b >= 97) & (b <= 122)).sum())
    ends = sum(map(text.count, ".!?"))
    features = [np.log1p(n), chars / words, symbols / words, dup / max(1, with_word), repeat / words, digits / size, upper / size, len(np.unique(h)) / words, ends / words, (lower + upper) / size]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """Node arrays (trees, nodes) of full binary trees: feature, threshold, and at leaves the value; base score."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of x."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += v[node]
        return 1.0 / (1.0 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...]) -> Trees:
    """Newton-boosted trees for the log-loss. A constrained split that goes the wrong way is not taken, and its middle value bounds both sides below it."""
    n, width = x.shape
    part = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    base = float(np.log(part / (1 - part)))
    nodes = 2 ** (DEPTH + 1) - 1
    feature = np.zeros((TREES, nodes), dtype=np.int64)
    threshold = np.full((TREES, nodes), np.inf)
    value = np.zeros((TREES, nodes))
    if not n or y.min() == y.max():
        return Trees(feature, threshold, value, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(n, base)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for at in range(nodes):
            mine = np.flatnonzero(node == at)
            gs, hs = g[mine].sum(), h[mine].sum()
            value[tree, at] = np.clip(gs / (hs + RIDGE), low[at], high[at])
            if at >= nodes // 2:
                continue
            best = (1e-6, None)
            for j in range(width):
                size = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(bins[mine, j], g[mine], size))[:-1]
                hl = np.cumsum(np.bincount(bins[mine, j], h[mine], size))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(gl / (hl + RIDGE), low[at], high[at]), np.clip(gr / (hr + RIDGE), low[at], high[at])
                gain = gl * vl - 0.5 * (hl + RIDGE) * vl**2 + gr * vr - 0.5 * (hr + RIDGE) * vr**2
                gain -= gs * value[tree, at] - 0.5 * (hs + RIDGE) * value[tree, at] ** 2
                gain[(hl < 2) | (hr < 2) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (j, k, vl[k], vr[k]))
            left, right = 2 * at + 1, 2 * at + 2
            low[[left, right]], high[[left, right]] = low[at], high[at]
            if best[1] is None:
                node[mine] = left
                continue
            j, k, vl, vr = best[1]
            feature[tree, at], threshold[tree, at] = j, cuts[j][k]
            node[mine] = np.where(bins[mine, j] > k, right, left)
            if monotone[j]:
                middle = (vl + vr) / 2
                if monotone[j] > 0:
                    high[left], low[right] = min(high[left], middle), max(low[right], middle)
                else:
                    low[left], high[right] = max(low[left], middle), min(high[right], middle)
        value[tree] *= RATE
        score += value[tree][node]
    return Trees(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most fit_rows labelled documents (labels: doc_id, quality), whose statistics reach the driver.

    Null labels and ids are left out; repeated labels of an id count once, the largest. Of several rows of one id the text that is
    smallest by hash is taken, so that never more than fit_rows rows are fitted on. Without both kinds of label the trees say the share of good ones everywhere.
    """
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_rows)
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    rows = rows.groupBy("doc_id", "quality").agg(one.alias("text"))

    def scan(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["quality"], "x": [statistics(t)[1] for t in b["text"]]})

    got = rows.mapInPandas(scan, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].to_list(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, (got["y"].to_numpy(dtype=np.float64) > 0).astype(np.float64), tuple(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with the counts of COUNTS, base_failed, quality_score and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: not
    base_failed and a score of at least keep. Null and empty texts have no words and fail. Clashing
    columns of docs stay; ours get a leading underscore.
    """
    new = (*COUNTS, "base_failed", "quality_score", "kept")
    names = dict(zip(new, (free_name(docs, c) for c in new), strict=True))
    kinds = ["long"] * len(COUNTS) + ["boolean", "double", "boolean"]
    schema = StructType(list(docs.schema.fields))
    for c, kind in zip(new, kinds, strict=True):
        schema = schema.add(names[c], kind)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def scan(batches):
        for b in batches:
            got = [statistics(t) for t in b[text_col]]
            counts = np.array([c for c, _ in got], dtype=np.int64).reshape(-1, len(COUNTS))
            score = sent.value.score(np.array([f for _, f in got], dtype=np.float64).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield b.assign(**{names[c]: counts[:, i] for i, c in enumerate(COUNTS)}, **{names["base_failed"]: failed, names["quality_score"]: score, names["kept"]: ~failed & (score >= keep)})

    return docs.mapInPandas(scan, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; see judged for nulls and empty texts, train for missing labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, table(spark, sf_dir, "labels"))
    return judged(docs, trees).drop("text")
