"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the lower-cased text from both ends, labels every byte position with language probabilities, and a
document's probabilities are the mean over all its positions. Texts are read in windows of CORE bytes that reach MARGIN bytes into their
neighbours on either side, cut at characters: a state starts anew only at a window's edge, so each counted position has seen at least
MARGIN bytes (or the text's edge) on both sides, across blanks and marks. Windows of a few MB of texts advance together, position by
position. Training is plain numpy: backpropagation through time with Adam, on the whole texts of a bounded sample of labelled documents
(DOCS_PER_LANGUAGE of each label, fewer where there are so many labels that they would be more than SAMPLE, but one at least), those with
the least hashes of id and text, so a re-run learns the same weights, and a row that is there a million times is one document.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text where nothing can be learned; every
label of a usable document is learned, however many there are; equal probabilities go to the first label in order; very
long texts are read whole, in windows; equal texts get equal predictions, and repeated rows are predicted each; an empty table gives no
row. Only the id, the text and, for learning, the label are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, in_slices, read

HIDDEN, CORE, MARGIN = 16, 448, 32
#: Windows that advance together.
TOGETHER = 1024
#: Bounds of the training sample, in documents of a label and in all.
DOCS_PER_LANGUAGE, SAMPLE = 50, 20_000
#: Bound of the probabilities that are held at once, in windows times labels.
PROBABILITIES = 1 << 15
#: exp of numbers within this can be summed over a million labels as 32-bit numbers.
LARGEST = 60
#: Training reads shorter windows.
TRAIN_CORE, EPOCHS, BATCH, RATE, SEED = 96, 4, 64, 0.01, 5
UNKNOWN = "und"


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def windows(raw: np.ndarray, core: int = CORE, margin: int = MARGIN) -> np.ndarray:
    """Rows (from, first counted, end of the counted, to) that cut bytes at characters; each byte is counted once."""

    if not len(raw):
        return np.zeros((0, 4), np.int64)
    inside = np.append((raw & 0xC0) == 0x80, False)

    def at_characters(places: np.ndarray) -> np.ndarray:
        places = np.clip(places, 0, len(raw))
        for _ in range(3):  # a character has at most three bytes after its first
            places = places - inside[places]
        return places

    first = at_characters(np.arange(0, len(raw), core))
    last = np.append(first[1:], len(raw))
    start, end = at_characters(np.concatenate([first - margin, last + margin])).reshape(2, -1)
    return np.stack([start, first, last, end], axis=1)


@dataclass
class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over both states at each position.

    Weights of a side: x (byte, 3 * hidden) and h (hidden, 3 * hidden), for the update gate, the reset gate and the new state.
    """

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        weights: dict[str, np.ndarray] = {}
        for side in "fb":
            weights[f"{side}x"] = rng.normal(0, 0.3, (256, 3 * hidden))
            weights[f"{side}h"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        weights["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages)))
        weights["bias"] = np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in weights.items()})

    def states(self, x: np.ndarray, there: np.ndarray, side: str, keep: list | None = None, room: dict | None = None) -> np.ndarray:
        """States (positions, windows, hidden) of one direction. x: bytes (positions, windows); there: which of these a window has, from
        its first on; where it has none the state is zero. keep takes what backpropagation needs of each step. room keeps the memory of
        the states from call to call: fresh pages for each would take a tenth of the time."""
        n = self.weights["fh"].shape[0]
        # both gates are 1 / (1 + exp(-a)) and tanh(a) is 2 / (1 + exp(-2 a)) - 1, so the weights carry the factors; exp is much faster than
        # tanh, and where it overflows the quotient is 0, as it should be
        factor = np.repeat(np.array([-1, -1, -2], np.float32), n)
        (xz, xr, xn), (hz, hr, hn) = (
            [np.ascontiguousarray((self.weights[f"{side}{k}"] * factor)[:, i * n : (i + 1) * n]) for i in range(3)] for k in "xh"
        )
        if room is None or len(room.get(side, ())) < x.size * n:
            held = np.empty(x.size * n, np.float32)
            if room is not None:
                room[side] = held
        else:
            held = room[side]
        out = held[: x.size * n].reshape(*x.shape, n)
        h = np.zeros((x.shape[1], n), np.float32)
        full = there.all(axis=1)
        with np.errstate(over="ignore"):
            for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
                z = xz.take(x[t], axis=0)
                z += h @ hz
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                r = xr.take(x[t], axis=0)
                r += h @ hr
                np.exp(r, out=r)
                r += 1
                held = h @ hn
                new = held / r
                new += xn.take(x[t], axis=0)
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                if keep is not None:
                    keep.append((t, h, z, 1 / r, new, held / -2))
                h = h - new
                h *= z
                h += new
                if not full[t]:
                    h *= there[t][:, None]
                out[t] = h
        return out

    def positions(self, x: np.ndarray, there: np.ndarray, keep: dict | None = None, room: dict | None = None) -> np.ndarray:
        """Probabilities (positions, windows, languages)."""
        steps: dict[str, list | None] = {side: [] if keep is not None else None for side in "fb"}
        states = [self.states(x, there, side, steps[side], room) for side in "fb"]
        n = self.weights["fh"].shape[0]
        scores = states[0] @ self.weights["out"][:n]
        scores += states[1] @ self.weights["out"][n:]
        scores += self.weights["bias"]
        # states lie within -1 and 1: where no score can be large, nothing needs to be taken off before exp
        if not np.abs(self.weights["out"]).sum(axis=0).max() + np.abs(self.weights["bias"]).max() < LARGEST:
            scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= (scores @ np.ones(scores.shape[2], scores.dtype))[:, :, None]
        if keep is not None:
            keep |= {"steps": steps, "states": np.concatenate(states, axis=2)}
        return scores

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time. y: a label for each window."""
        keep: dict = {}
        p = self.positions(x, there, keep)
        right = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), axis=2)[:, :, 0]
        count = there.sum()
        loss = float(-(np.log(right + 1e-9) * there).sum() / count)
        d = p * there[:, :, None]
        d[:, np.arange(len(y)), y] -= there
        d /= count
        d = d.astype(np.float32)
        states, n = keep["states"], self.weights["fh"].shape[0]
        grads = {"out": np.tensordot(states, d, ((0, 1), (0, 1))), "bias": d.sum((0, 1))}
        d_states = d @ self.weights["out"].T
        hot = np.zeros((x.size, 256), np.float32)
        hot[np.arange(x.size), x.ravel()] = 1
        for k, side in enumerate("fb"):
            wh = self.weights[f"{side}h"]
            gh, dh, given = np.zeros_like(wh), np.zeros((x.shape[1], n), np.float32), np.zeros((*x.shape, 3 * n), np.float32)
            for t, h, z, r, new, held in reversed(keep["steps"][side]):
                dh = (dh + d_states[t, :, k * n : (k + 1) * n]) * there[t][:, None]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * held * r * (1 - r)
                given[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_held = np.concatenate([d_z, d_r, d_new * r], axis=1)
                gh += h.T @ d_held
                dh = dh * z + d_held @ wh.T
            grads[f"{side}x"], grads[f"{side}h"] = hot.T @ given.reshape(-1, 3 * n), gh
        return loss, grads

    def train(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
        """Adam over batches of windows of like length, in random order; every window of every text is read in each epoch."""
        rng = np.random.default_rng(seed)
        raws = [bytes_of(t) for t in texts]
        cut = [(i, a, b) for i, raw in enumerate(raws) for a, _, _, b in windows(raw, TRAIN_CORE, MARGIN // 2).tolist()]
        cut.sort(key=lambda w: w[2] - w[1])
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = sorted(range(len(cut)), key=lambda i, noise=rng.random(len(cut)): ((cut[i][2] - cut[i][1]) // 8, noise[i]))
            batches = [order[at : at + batch] for at in range(0, len(order), batch)]
            for k in rng.permutation(len(batches)):
                part = [cut[i] for i in batches[k]]
                x, there = laid_out([raws[i][a:b] for i, a, b in part])
                _, grads = self.gradients(x, there, np.array([labels[i] for i, _, _ in part]))
                step += 1
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    pace = rate * 0.5**epoch / (1 - 0.9**step)
                    self.weights[name] = (
                        self.weights[name] - pace * first[name] / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    ).astype(np.float32)
        return self


def laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows side by side as (positions, windows), and which positions a window has."""
    lengths = np.array([len(p) for p in parts])
    x = np.zeros((len(parts), int(lengths.max())), np.intp)
    for row, p in zip(x, parts, strict=True):
        row[: len(p)] = p
    return np.ascontiguousarray(x.T), np.arange(x.shape[1])[:, None] < lengths


class Predictor:
    """Documents' languages by their positions' mean probabilities."""

    def __init__(self, network: Network):
        self.network = network
        self.room: dict[str, np.ndarray] = {}

    def sums(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): probabilities summed over each text's bytes."""
        raws = [bytes_of(t) for t in texts]
        places = [windows(raw) for raw in raws]
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        cut = np.concatenate([np.zeros((0, 4), np.int64), *places])
        out = np.zeros((len(texts), len(self.network.languages)))
        order = np.argsort(cut[:, 3] - cut[:, 0], kind="stable")
        together = max(1, min(TOGETHER, PROBABILITIES // len(self.network.languages)))
        for at in range(0, len(order), together):
            mine = order[at : at + together]
            x, there = laid_out([raws[doc[i]][cut[i, 0] : cut[i, 3]] for i in mine])
            step = np.arange(len(x))[:, None]
            counted = (step >= cut[mine, 1] - cut[mine, 0]) & (step < cut[mine, 2] - cut[mine, 0])
            np.add.at(out, doc[mine], np.einsum("twl,tw->wl", self.network.positions(x, there, room=self.room), counted.astype(np.float32)))
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        told = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.network.languages or not told:
            return out
        for i, sums in zip(told, self.sums([texts[i] for i in told]), strict=True):
            best = int(sums.argmax())
            out[i] = (self.network.languages[best], min(1.0, float(sums[best] / sums.sum())))
        return out


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Network:
    """Learns from labelled documents outside the held-out fold."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (fold_of(id_col) != 2)).select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label")
    )
    keyed = known.select("label", "text", F.xxhash64(F.lit(SEED), "id", "text").alias("h"))
    labels = known.select("label").distinct().count()
    most = max(1, min(docs_per_language, SAMPLE // max(labels, 1)))
    # equal rows have one rank; Spark cuts each task's rows to the least of each label before it shuffles them
    rank = F.dense_rank().over(Window.partitionBy("label").orderBy("h"))
    least = keyed.select("label", "h", rank.alias("rank")).where(F.col("rank") <= most).select("label", "h").distinct()
    chosen = keyed.join(F.broadcast(least), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text"))
    sample = sorted((r["label"], r["text"]) for r in chosen.collect())  # at most SAMPLE documents, or one a label
    languages = sorted({label for label, _ in sample})
    if not languages:
        return Network([], {})
    place = {x: i for i, x in enumerate(languages)}
    return Network.fresh(languages).train([t for _, t in sample], [place[x] for x, _ in sample])


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; only the text is read for the prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for batch in in_slices(batches, 2):
            found = predictor(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(fold_of(id_col), F.lit(0)) == 2).alias("held_out"), F.col(text).alias("text")
    )
    return rows.transform(bounded).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
