"""The sequence network: forward pass and gradients in numpy, over batches packed by length.

Rows are scored alone: padding that a batch adds takes part in nothing. Only sequences shorter than the widest kernel are padded to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from seqloom.operators import features as features_of
from seqloom.storage import ship

#: Positions of a pack, padding included, at a time; longer rows are passed over in parts of this size.
CELLS = 1 << 15
RESIDUES = 14
#: Windows worked on at a time where residues are of kinds, kinds whose products with the kernels are held at once, and runs of kinds.
WINDOWS, KINDS, RUNS = 1 << 12, 1 << 12, 1 << 17


@dataclass
class Network:
    """Weights: embedding, convolutions and protein layers, each with weights, bias, and the scale and shift of its normalisation, and the head's dense layers."""

    embedding: np.ndarray
    convolutions: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    protein: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    head: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def random(cls, seed: int = 0, embed: int = 64, filters: int = 64, kernels: tuple[int, ...] = (3, 5, 7), protein: int = 32) -> Network:
        r = np.random.default_rng(seed)
        w = lambda *shape: r.standard_normal(shape) / np.sqrt(np.prod(shape[:-1]))
        layer = lambda *shape: (w(*shape), np.zeros(shape[-1]), np.ones(shape[-1]), np.zeros(shape[-1]))
        convolutions = [layer(k, embed + RESIDUES, filters) for k in kernels]
        wide = filters * len(kernels) + protein
        return cls(w(22, embed), convolutions, [layer(13, 64), layer(64, protein)], [(w(wide, 128), np.zeros(128)), (w(128, 1), np.zeros(1))])

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, *[a for layer in (*self.convolutions, *self.protein, *self.head) for a in layer]]

    def parameters(self) -> int:
        return sum(a.size for a in self.arrays())

    def flat(self) -> np.ndarray:
        """All weights as one vector."""
        return np.concatenate([a.ravel() for a in self.arrays()])

    def with_flat(self, vector: np.ndarray) -> Network:
        """A network of the same shapes with the weights of vector."""
        cuts = np.cumsum([a.size for a in self.arrays()])[:-1]
        parts = iter([x.reshape(a.shape) for a, x in zip(self.arrays(), np.split(vector, cuts), strict=True)])
        take = lambda layers: [tuple(next(parts) for _ in layer) for layer in layers]
        return Network(next(parts), take(self.convolutions), take(self.protein), take(self.head))

    @property
    def _least(self) -> int:
        return max(c[0].shape[0] for c in self.convolutions)

    def packs(self, lengths: np.ndarray):
        """Places of rows that are worked on together: of like length, at most CELLS positions with their padding, or one row."""
        order = np.argsort(lengths, kind="stable")
        size = np.maximum(lengths[order], self._least)
        start = 0
        for i in range(1, len(order) + 1):
            if i == len(order) or size[i] * (i + 1 - start) > CELLS:
                yield order[start:i]
                start = i

    def _padded(self, tokens: list, residues: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.maximum(np.array([len(t) for t in tokens]), self._least)
        t, r = np.zeros((len(n), n.max()), dtype=np.int64), np.zeros((len(n), n.max(), RESIDUES))
        for i, (a, b) in enumerate(zip(tokens, residues, strict=True)):
            t[i, : len(a)] = a
            if len(a):
                r[i, : len(a)] = b
        return t, r, n

    def _pooled(self, t: np.ndarray, r: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each convolution the maxima over positions, and where they are first."""
        rows, length = t.shape
        best = [(np.full((rows, c[1].size), -np.inf), np.zeros((rows, c[1].size), dtype=np.int64)) for c in self.convolutions]
        step = max(1, CELLS // rows)
        for s in range(0, length, step):
            e = min(length, s + step + self._least - 1)
            x = np.concatenate([self.embedding[t[:, s:e]], r[:, s:e]], axis=2)
            for (k, bias, scale, shift), (most, at) in zip(self.convolutions, best, strict=True):
                m = min(step, e - s - k.shape[0] + 1)
                if m < 1:
                    continue
                y = bias + sum(np.ascontiguousarray(x[:, j : j + m]).reshape(-1, x.shape[2]) @ k[j] for j in range(k.shape[0]))
                y = (np.maximum(y, 0) * scale + shift).reshape(rows, m, -1)
                y[(s + np.arange(m))[None, :] > (n - k.shape[0])[:, None]] = -np.inf
                where = y.argmax(axis=1)
                value = np.take_along_axis(y, where[:, None, :], axis=1)[:, 0]
                more = value > most
                most[more], at[more] = value[more], (s + where)[more]
        return best

    def _top(self, pooled: list[np.ndarray], protein: np.ndarray, mask: np.ndarray | float):
        """Logits, and what the way back needs."""
        h, inner = protein, []
        for w, b, scale, shift in self.protein:
            z = np.maximum(h @ w + b, 0)
            inner.append((h, z))
            h = z * scale + shift
        wide = np.concatenate([*pooled, h], axis=1)
        (w1, b1), (w2, b2) = self.head
        hidden = np.maximum(wide @ w1 + b1, 0)
        return ((hidden * mask) @ w2 + b2)[:, 0], inner, wide, hidden

    def logits(self, tokens: list, residues: list, protein: np.ndarray) -> np.ndarray:
        """Of rows: lists of tokens, their residue values (length x 14 each), and protein values (rows x 13)."""
        out = np.zeros(len(tokens))
        for rows in self.packs(np.array([len(t) for t in tokens], dtype=np.int64)):
            t, r, n = self._padded([tokens[i] for i in rows], [residues[i] for i in rows])
            out[rows] = self._top([p for p, _ in self._pooled(t, r, n)], protein[rows], 1.0)[0]
        return out

    def logits_of_kinds(self, place: np.ndarray, tokens: np.ndarray, residues: np.ndarray, sizes: np.ndarray, protein: np.ndarray) -> np.ndarray:
        """logits of rows that stand one after another, of these sizes: each position's kind, and of each kind its token and residue values.

        A kind is multiplied by the kernels once; where kinds are few, so are runs of up to three. Windows add up what their runs have.
        """
        short, pad = np.maximum(self._least - sizes, 0), len(tokens)
        place = np.insert(place, np.repeat(np.cumsum(sizes), short), pad) if short.any() else place
        ends = np.cumsum(sizes + short)
        values = np.concatenate((np.append(tokens, 0)[:, None], np.concatenate((residues, np.zeros((1, RESIDUES))))), axis=1)
        seen = np.flatnonzero(np.bincount(place, minlength=pad + 1))
        tables = None
        if len(seen) <= KINDS:
            values, of = np.unique(values[seen], axis=0, return_inverse=True)
            at = np.zeros(pad + 1, dtype=np.intp)
            at[seen] = of.ravel()
            place, tables = at[place], self._tables(values)
        best = [np.full((len(sizes), c[1].size), -np.inf) for c in self.convolutions]
        for i, (start, end) in enumerate(zip(ends - sizes - short, ends, strict=True)):
            for s in range(start, end - min(c[0].shape[0] for c in self.convolutions) + 1, WINDOWS):
                self._most(place[s : min(end, s + WINDOWS + self._least - 1)], values, tables, [b[i] for b in best])
        # Units rise with their sums, or fall where the scale is below 0.
        pooled = [np.maximum(b * np.where(c[2] < 0, -1.0, 1.0) + c[1], 0) * c[2] + c[3] for b, c in zip(best, self.convolutions, strict=True)]
        return self._top(pooled, protein, 1.0)[0]

    def _tables(self, values: np.ndarray) -> list[list[np.ndarray]]:
        """Of each kernel, for runs of its offsets: the summed products of each run of kinds. Signs are turned where the scale is below 0."""
        x = np.concatenate((self.embedding[values[:, 0].astype(np.intp)], values[:, 1:]), axis=1)
        run = next(n for n in (3, 2, 1) if n == 1 or len(x) ** n <= RUNS)
        out = []
        for k, _, scale, _ in self.convolutions:
            products = [x @ (k[j] * np.where(scale < 0, -1.0, 1.0)) for j in range(k.shape[0])]
            runs = [products[j : j + run] for j in range(0, len(products), run)]
            for r in runs:
                while len(r) > 1:
                    r[:2] = [(r[0][:, None, :] + r[1][None, :, :]).reshape(-1, r[0].shape[1])]
            out.append([r[0] for r in runs])
        return out

    def _most(self, at: np.ndarray, values: np.ndarray, tables: list | None, best: list[np.ndarray]) -> None:
        """Raises best, of each kernel, to the greatest sums of the windows of some positions of one row."""
        if tables is None:
            seen, at = np.unique(at, return_inverse=True)
            values, tables = values[seen], self._tables(values[seen])
        kinds, codes = len(values), [at]
        run = next(n for n in (3, 2, 1) if n == 1 or kinds**n <= RUNS)
        for n in range(1, run):
            codes.append(codes[-1][:-1] * kinds + at[n:])
        for (k, *_), parts, b in zip(self.convolutions, tables, best, strict=True):
            m = min(WINDOWS, len(at) - k.shape[0] + 1)
            if m < 1:
                continue
            y = None
            for j, table in zip(range(0, k.shape[0], run), parts, strict=True):
                more = table.take(codes[min(run, k.shape[0] - j) - 1][j : j + m], axis=0)
                y = more if y is None else np.add(y, more, out=y)
            even = m // 8 * 8  # eight windows side by side, which numpy compares faster
            if even:
                np.maximum(b, y[:even].reshape(even // 8, -1).max(axis=0).reshape(8, -1).max(axis=0), out=b)
            if even < m:
                np.maximum(b, y[even:].max(axis=0), out=b)

    def logit(self, tokens: np.ndarray, residues: np.ndarray, protein: np.ndarray) -> float:
        """Of one row."""
        return float(self.logits([tokens], [residues], np.asarray(protein, dtype=float)[None, :])[0])

    def gradient(self, tokens: list, residues: list, protein: np.ndarray, labels: np.ndarray, masks: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Summed cross-entropy of rows and its gradient by all weights, as flat() orders them. masks: factors of the head's hidden units by row (dropout)."""
        loss, total = 0.0, np.zeros(self.parameters())
        for rows in self.packs(np.array([len(t) for t in tokens], dtype=np.int64)):
            one, g = self._gradient([tokens[i] for i in rows], [residues[i] for i in rows], protein[rows], labels[rows], 1.0 if masks is None else masks[rows])
            loss, total = loss + one, total + g
        return loss, total

    def _gradient(self, tokens: list, residues: list, protein: np.ndarray, y: np.ndarray, mask) -> tuple[float, np.ndarray]:
        t, r, n = self._padded(tokens, residues)
        pooled = self._pooled(t, r, n)
        z, inner, wide, hidden = self._top([p for p, _ in pooled], protein, mask)
        loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
        d = (1 / (1 + np.exp(-z)) - y)[:, None]
        (w1, _), (w2, _) = self.head
        head2 = ((hidden * mask).T @ d, d.sum(axis=0))
        d = (d @ w2.T) * mask * (hidden > 0)
        head1 = (wide.T @ d, d.sum(axis=0))
        d = d @ w1.T
        filters = [c[1].size for c in self.convolutions]
        parts = np.split(d, np.cumsum(filters), axis=1)
        protein_back, g = [], parts[-1]
        for (w, _, scale, _), (h, a) in zip(reversed(self.protein), reversed(inner), strict=True):
            through = g * scale * (a > 0)
            protein_back.append((h.T @ through, through.sum(axis=0), (g * a).sum(axis=0), g.sum(axis=0)))
            g = through @ w.T
        embedding, convolutions = np.zeros_like(self.embedding), []
        wide_e = self.embedding.shape[1]
        for (k, bias, scale, _), (_, at), g in zip(self.convolutions, pooled, parts[:-1], strict=True):
            width = k.shape[0]
            place = at[:, :, None] + np.arange(width)  # rows x filters x kernel
            row = np.arange(len(t))[:, None, None]
            token = t[row, place]
            x = np.concatenate([self.embedding[token], r[row, place]], axis=3)
            a = np.maximum(np.einsum("bfkc,kcf->bf", x, k) + bias, 0)  # the unit before its normalisation
            through = g * scale * (a > 0)
            convolutions.append((np.einsum("bf,bfkc->kcf", through, x), through.sum(axis=0), (g * a).sum(axis=0), g.sum(axis=0)))
            # How much of each token stands at each place of each filter's window, times the filter.
            by = np.zeros((len(self.embedding), width, g.shape[1]))
            np.add.at(by, (token, np.arange(width)[None, None, :], np.arange(g.shape[1])[None, :, None]), through[:, :, None])
            embedding += np.einsum("tkf,kef->te", by, k[:, :wide_e])
        out = [embedding, *[x for c in convolutions for x in c], *[x for c in reversed(protein_back) for x in c], *head1, *head2]
        return loss, np.concatenate([x.ravel() for x in out])


def columns(batch: pa.RecordBatch) -> tuple[list, list, np.ndarray]:
    """Tokens, residue values and protein values of a batch of featurised rows."""
    tokens = [np.asarray(x) for x in batch.column("sequence").to_pandas()]
    residues = []
    rows = batch.column("residue_features")
    for i in range(batch.num_rows):
        part = rows.slice(i, 1).flatten().flatten()
        residues.append(part.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, RESIDUES))
    protein = batch.column("protein_features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return tokens, residues, protein


def predict(features: DataFrame, network: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """(uniprot_id, logit, probability, and the columns of keep) of featurised rows; every row is scored alone, so batches don't matter."""
    ship(features.sparkSession)
    sent = features.sparkSession.sparkContext.broadcast(network)
    wanted = features.select("uniprot_id", "sequence", "residue_features", "protein_features", *keep)

    def scan(batches):
        net = sent.value
        for b in batches:
            z = net.logits(*columns(b))
            yield pa.RecordBatch.from_arrays([b.column("uniprot_id"), pa.array(z), pa.array(1 / (1 + np.exp(-z))), *[b.column(c) for c in keep]], ["uniprot_id", "logit", "probability", *keep])

    schema = StructType([StructField("uniprot_id", StringType()), StructField("logit", DoubleType()), StructField("probability", DoubleType()), *[wanted.schema[c] for c in keep]])
    return wanted.mapInArrow(scan, schema)


def scored(table: DataFrame, stats_row: DataFrame, network: Network, volume: dict[str, float] | None = None) -> DataFrame:
    """predict of features.featurised, in one pass: (uniprot_id, logit, probability) of the integrated table, or integrate.joined's.

    Features of residues stay in the task that makes them.
    """
    ship(table.sparkSession)
    sent, scales = table.sparkSession.sparkContext.broadcast(network), features_of.scales_of(table, volume)

    def scan(batches):
        net = sent.value
        for b, sizes in features_of.parts(batches):
            protein = b.column("protein_features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            z = net.logits_of_kinds(*features_of.kinds_of_residues(b, sizes, scales), sizes, protein)
            yield pa.RecordBatch.from_arrays([b.column("uniprot_id"), pa.array(z), pa.array(1 / (1 + np.exp(-z)))], ["uniprot_id", "logit", "probability"])

    return features_of.flat(table, stats_row).drop("gelation").mapInArrow(scan, "uniprot_id string, logit double, probability double")
