"""Language-model scores: masked pseudo-likelihood of a two-sided window network.

Every word is predicted from the two words before and the two after it; the score of a
document is the sum of the log-probabilities of all its words. Words fold to 4,096 slots by hash, read as three digits
of base 16. The hidden layer is ``tanh`` of the sum of one vector per window place; it predicts the first digit, and
each digit adds a vector of its own to the layer that predicts the next. So a word costs 48 outputs and its
probabilities add up to 1 over all slots.

Training is numpy inside the tasks: each task goes over all documents of its partition, from
the parameters that all share, in steps of ``BATCH`` words (Adagrad). Every word of every document is a training example (a ``stride`` above 1 takes every so many words only). The
parameters of all tasks are averaged, weighed by their words, slice by slice in two further Spark stages, ``FAN``
groups of tasks first; what is gathered grows with the number of partitions.
Only the averaged parameters (``SIZE`` numbers, whatever the corpus) reach the driver.

Defined results: a null or empty text has no words and a score of 0; its mean is null. Places outside the text
are slot 0. Repeated rows are trained on and scored each time. Without any word the model is
the shared start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cellweft.llm.common import tune
from cellweft.llm.words import split_words

BASE = 16
DIGITS = 3
SLOTS = BASE**DIGITS
WIDTH = 16
PLACES = (-2, -1, 1, 2)
SHAPES = {"window": (len(PLACES), SLOTS, WIDTH), "hidden": (WIDTH,), "digit": (DIGITS - 1, WIDTH, BASE),
          "out": (DIGITS, WIDTH, BASE), "bias": (DIGITS, BASE)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
SLICE = 16_384
BATCH = 4096
MEMORY = 200_000
FAN = 32
RATE = 0.1


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one flat array of parameters."""
    found, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        found[name], at = flat[at:at + size].reshape(shape), at + size
    return found


def start(seed: int) -> np.ndarray:
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    model = unpack(flat)
    for name in ("hidden", "bias"):
        model[name][...] = 0
    return flat


class _Slots(dict):
    """Slot of a word, worked out once per worker; forgotten when the worker knows ``MEMORY`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        slot = self[word] = int(xxhash.xxh64_intdigest(word) % (SLOTS - 1)) + 1
        return slot


_slots = _Slots()


def slots_of(words: list[bytes]) -> np.ndarray:
    """Slot of every word, 1 to SLOTS - 1; 0 stands outside the text."""
    return np.fromiter(map(_slots.__getitem__, words), np.int32, len(words))


def examples(texts, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, words, row) of all texts, one row of ``windows`` per place; with a stride, every so many words from a
    place given by the text."""
    split = [split_words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    row = np.repeat(np.arange(len(split)), sizes)
    slots = slots_of([w for words in split for w in words])
    # Texts stand one after the other, with two empty places before and after each.
    at = np.arange(len(slots)) + 2 * (row + 1)
    padded = np.zeros(len(slots) + 2 * len(split) + 2, np.int32)
    padded[at] = slots
    if stride > 1:
        totals = np.bincount(row, slots, minlength=len(split)).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        chosen = (np.arange(len(slots)) - begins[row]) % stride == totals[row] % stride
        at, slots, row = at[chosen], slots[chosen], row[chosen]
    return np.stack([padded[at + p] for p in PLACES]), slots, row


def _normal(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log-probability of the chosen row) of every column; ``x`` is overwritten."""
    x -= x.max(0)
    picked = x[chosen, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(0)
    x /= total
    return x, picked - np.log(total)


def forward(model, windows, words):
    """(layers, probabilities per digit, digits, log-probability), one column per word: sums then run along whole rows."""
    digits = [words // BASE ** (DIGITS - 1 - k) % BASE for k in range(DIGITS)]
    summed = sum(model["window"][p].take(windows[p], axis=0) for p in range(len(PLACES)))
    layers, outputs, total = [np.tanh(np.ascontiguousarray(summed.T) + model["hidden"][:, None])], [], 0.0
    for k, digit in enumerate(digits):
        probabilities, told = _normal(model["out"][k].T @ layers[k] + model["bias"][k][:, None], digit)
        outputs.append(probabilities)
        total = total + told
        if k < DIGITS - 1:
            layers.append(np.tanh(layers[k] + model["digit"][k].take(digit, axis=1)))
    return layers, outputs, digits, total


def log_probs(model, windows: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(words))
    for a in range(0, len(words), BATCH):
        out[a:a + BATCH] = forward(model, windows[:, a:a + BATCH], words[a:a + BATCH])[-1]
    return out


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """For every row of ``values``: its sum over the words of each slot or digit."""
    at = at.astype(np.intp)
    return np.stack([np.bincount(at, row, minlength=size) for row in values])


def gradients(model, windows, words) -> np.ndarray:
    """Gradient of the mean negative log-probability, flat."""
    layers, outputs, digits, _ = forward(model, windows, words)
    flat = np.zeros(SIZE, np.float32)
    g = unpack(flat)
    n, at, back = len(words), np.arange(len(words)), 0.0
    for k in reversed(range(DIGITS)):
        error = outputs[k]
        error[digits[k], at] -= 1
        error /= n
        g["out"][k], g["bias"][k] = layers[k] @ error.T, error.sum(1)
        back = (model["out"][k] @ error + back) * (1 - layers[k] ** 2)
        if k:
            g["digit"][k - 1] = _sums(digits[k - 1], back, BASE)
    g["hidden"][...] = back.sum(1)
    for p in range(len(PLACES)):
        g["window"][p] = _sums(windows[p], back, SLOTS).T
    return flat


def train(texts: DataFrame, stride: int = 1, rounds: int = 1, seed: int = 5) -> np.ndarray:
    """Averaged parameters after ``rounds`` passes over all rows (text)."""
    context = texts.sparkSession.sparkContext
    flat = start(seed)

    def fit(shared):
        def run(batches):
            own, seen = shared.value.copy(), 0
            model, squares = unpack(own), np.full(SIZE, 1e-6, np.float32)
            held = [np.empty((len(PLACES), 0), np.int32), np.empty(0, np.int32)]

            def step(windows, words):
                g = gradients(model, windows, words)
                squares[...] += g * g
                own[...] -= RATE * g / np.sqrt(squares)

            for pdf in batches:
                windows, words, _ = examples(pdf["text"], stride)
                held = [np.concatenate([held[0], windows], axis=1), np.concatenate([held[1], words])]
                seen += len(words)
                whole = len(held[1]) // BATCH * BATCH
                for a in range(0, whole, BATCH):
                    step(held[0][:, a:a + BATCH], held[1][a:a + BATCH])
                held = [held[0][:, whole:], held[1][whole:]]
            if len(held[1]):
                step(*held)
            if seen:
                yield pd.DataFrame([(k, seen, own[a:a + SLICE].tobytes()) for k, a in enumerate(range(0, SIZE, SLICE))],
                                   columns=["slice", "words", "numbers"])
        return run

    def mean(batches):
        sums: dict[int, np.ndarray] = {}
        words: dict[int, int] = {}
        for pdf in batches:
            for k, n, numbers in zip(pdf["slice"], pdf["words"], pdf["numbers"]):
                sums[k] = sums.get(k, 0.0) + n * np.frombuffer(numbers, np.float32).astype(float)
                words[k] = words.get(k, 0) + n
        for k in sums:
            yield pd.DataFrame([(k, words[k], (sums[k] / words[k]).astype(np.float32).tobytes())], columns=["slice", "words", "numbers"])

    schema = "slice int, words long, numbers binary"
    for _ in range(rounds):
        parts = texts.select("text").mapInPandas(fit(context.broadcast(flat)), schema)
        # Means of means: a task reads one copy of its slice from a share of the training tasks, then from each share.
        for keys in (["slice", F.pmod(F.xxhash64("numbers"), F.lit(FAN))], ["slice"]):
            parts = parts.repartition(*keys).sortWithinPartitions("slice", "words", "numbers").mapInPandas(mean, schema)
        rows = parts.collect()
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in sorted(rows, key=lambda r: r["slice"])])
    return flat


def score_documents(docs: DataFrame, id_col="doc_id", text_col="text", stride: int = 1, rounds: int = 1) -> DataFrame:
    """(id, n_words, score, mean_score): sum and mean of the log-probabilities of all words."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, stride, rounds))

    def run(batches):
        model = unpack(shared.value)
        for pdf in batches:
            n, score = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for a in range(0, len(pdf), 64):
                part = pdf["text"].iloc[a:a + 64]
                windows, words, row = examples(part)
                n[a:a + 64] = np.bincount(row, minlength=len(part))
                score[a:a + 64] = np.bincount(row, log_probs(model, windows, words), minlength=len(part))
            yield pdf[["id"]].assign(n_words=n, score=score)

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInPandas(run, f"id {kind}, n_words long, score double")
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
