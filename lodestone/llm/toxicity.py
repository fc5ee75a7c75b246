"""Toxicity: a subsequence string-kernel support vector machine on Nystroem landmarks.

A text is read as words; words lose everything but letters, runs of single letters
are joined, a single letter also with its neighbours, and each is cut into half-overlapping windows of
8 letters. The kernel sums the common subsequences of three letters, weighted by
DECAY for every letter they span, so a gap or an inserted letter only weakens a
match. A linear machine on the kernel's values at a few landmarks scores
windows; a text's score is that of its worst window, calibrated on labelled
texts. Training labels windows through their texts: those that explain the
toxic texts and occur in no clean one are the witnesses, WITNESSES stems at most.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, read_table

WIDTH, STRIDE, ORDER, DECAY = 8, 4, 3, 0.6
#: Labelled documents that training takes at most, and landmarks: witnesses and clean windows.
SAMPLE_ROWS, WITNESSES, OTHERS = 6000, 24, 20
THRESHOLD, FOLDS, HELD_OUT_FOLD = 0.7, 3, 1
#: Windows whose values a task remembers.
CACHE = 400_000

_DROP = re.compile(r"[\x00-`{-\x7f\x80-\xbf]+")


def windows(text: str | None, heads: bool = False) -> set[str]:
    """The windows of a whole text, or the first of each word only; words of fewer than three letters have none."""
    plain = [x for x in (word if word.isalpha() else _DROP.sub("", word) for word in (text or "").lower().split()) if x]
    words, run = {x for x in plain if len(x) > 1}, 0
    for i, x in enumerate(plain):
        run = run + 1 if len(x) == 1 else 0
        if run > 2:
            words.add("".join(plain[i - run + 1 : i + 1]))
        if run and not heads:  # a word that a spaced letter cuts
            before, after = plain[i - 1] if i else "", plain[i + 1] if i + 1 < len(plain) else ""
            words.update((before + x, x + after, before + x + after))
    out = set()
    for word in words:
        if heads or len(word) <= WIDTH:
            if len(word) >= ORDER:
                out.add(word[:WIDTH])
        else:
            out.update(word[at : at + WIDTH] for at in range(0, len(word) - STRIDE, STRIDE))
    return out


def codes(strings: list[str]) -> np.ndarray:
    return np.array(strings, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(strings), WIDTH)


def _kernel(s: np.ndarray, t: np.ndarray, paired: bool) -> np.ndarray:
    """The kernel of every row of s with every row of t, or row by row where paired."""
    s, t = (s, t) if paired else (s[:, None], t[None, :])
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    width, decay = s.shape[-1], np.float32(DECAY)
    # inner[i][b]: K'_i of the letters of s so far and the first b letters of t
    inner = [[np.ones(shape, np.float32)] * (width + 1)] + [[np.zeros(shape, np.float32) for _ in range(width + 1)] for _ in range(ORDER - 1)]
    total = np.zeros(shape, np.float32)
    for a in range(width):
        if not s[..., a].any():
            break
        meet = [((s[..., a] == t[..., b]) & (s[..., a] > 0)).astype(np.float32) * decay * decay for b in range(width)]
        for b in range(width):
            total += meet[b] * inner[ORDER - 1][b]
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(shape, np.float32)
            for b in range(width):
                run = run * decay + meet[b] * inner[i - 1][b]
                inner[i][b + 1] = inner[i][b + 1] * decay + run
    return total


def kernel(strings: list[str], landmarks: np.ndarray, block: int = 512) -> np.ndarray:
    """Normalised kernel values, a row a string and a column a landmark."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    own = np.sqrt(np.maximum(_kernel(landmarks, landmarks, True), 1e-12))
    order = np.array([len(x) for x in strings]).argsort(kind="stable")
    coded = codes(strings)[order]
    for at in range(0, len(coded), block):
        part = coded[at : at + block]
        self_ = np.sqrt(np.maximum(_kernel(part, part, True), 1e-12))
        out[order[at : at + block]] = _kernel(part, landmarks, False) / self_[:, None] / own
    return out


def _witness_stems(bags: list[set[str]], toxic: list[int], most: int) -> list[str]:
    """Prefixes of windows that many toxic texts share, or that explain those left, and that clean texts nearly never hold."""
    held, clean = defaultdict(set), Counter()
    stems = lambda bag: {w[:n] for w in bag for n in range(4, len(w) + 1)}
    for i, (bag, y) in enumerate(zip(bags, toxic, strict=True)):
        if y:
            for stem in stems(bag):
                held[stem].add(i)
    held = {k: v for k, v in held.items() if len(v) >= 3}
    for bag, y in zip(bags, toxic, strict=True):
        if not y:
            clean.update(stems(bag) & held.keys())
    rate = sum(toxic) / max(1, len(toxic))
    held = {k: v for k, v in held.items() if clean[k] <= 0.02 * len(v) / max(rate, 1e-9) * 0.1}
    chosen, left = [], {i for i, y in enumerate(toxic) if y}
    # first what many toxic texts share, then what explains those left
    for stem in sorted((k for k in held if not clean[k] and len(held[k]) >= max(5, 0.02 * len(left))), key=lambda k: (-len(held[k]), -len(k), k)):
        if len(chosen) < most * 3 // 4 and not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen.append(stem)
    for stem in chosen:
        left -= held.pop(stem)
    least = max(3, 0.01 * sum(toxic))
    while len(chosen) < most and held:
        best = max(held, key=lambda k: (len(held[k] & left) - 5 * clean[k], len(k), k))
        if len(held[best] & left) < least:
            break
        chosen.append(best)
        left -= held.pop(best)
    return chosen


def fit(texts: list[str], toxic: list[int]) -> dict:
    """Landmarks, weights, bias and calibration; without both labels every text scores the labels' share."""
    share = min(max(sum(toxic) / max(1, len(toxic)), 0.01), 0.99)
    model = {"landmarks": [], "beta": [], "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    bags = [windows(t) for t in texts]
    stems = _witness_stems([windows(t, heads=True) for t in texts], toxic, WITNESSES)
    if not stems:
        return model
    of = tuple(stems)
    positive = sorted({w for bag, y in zip(bags, toxic, strict=True) if y for w in bag if w.startswith(of)})
    negative = sorted({w for bag, y in zip(bags, toxic, strict=True) if not y for w in bag} - set(positive))
    rng = np.random.Generator(np.random.PCG64(11))
    # witnesses weigh by the texts that hold them; with a letter put in they stay witnesses, of less weight
    letters = "abcdefghijklmnopqrstuvwxyz"
    held = Counter(w for bag, y in zip(bags, toxic, strict=True) if y for w in bag)
    weight = [float(min(held[w], 50)) for w in positive]
    for w in [x for x in positive if len(x) >= 4]:
        at = int(rng.integers(1, len(w)))
        positive.append((w[:at] + letters[int(rng.integers(26))] + w[at:])[:WIDTH])
        weight.append(0.1 * min(held[w], 50))
    others = [negative[i] for i in rng.choice(len(negative), min(OTHERS, len(negative)), replace=False)] if negative else []
    landmarks = codes([*stems, *others])
    values, vectors = np.linalg.eigh(kernel([*stems, *others], landmarks).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    x1 = kernel(positive, landmarks) @ whiten
    x0 = kernel(negative, landmarks) @ whiten if negative else np.zeros((0, len(landmarks)))
    picked = rng.choice(len(x0), min(20_000, len(x0)), replace=False) if len(x0) else np.zeros(0, np.int64)
    w = np.zeros(len(landmarks) + 1)
    for _ in range(3):
        x = np.column_stack([np.concatenate([x1, x0[picked]]), np.ones(len(x1) + len(picked))])
        y = np.concatenate([np.ones(len(x1)), -np.ones(len(picked))])
        c = 200 * np.concatenate([np.array(weight) / sum(weight), np.full(len(picked), 4.0 / max(1, len(picked)))])
        for _ in range(25):  # Newton steps on the squared hinge loss
            active = y * (x @ w) < 1
            xa, ca = x[active], c[active]
            hessian = xa.T * ca @ xa + np.diag([*np.full(len(w) - 1, 0.01), 1e-6])
            new = np.linalg.solve(hessian, xa.T @ (ca * y[active]))
            if np.allclose(new, w, atol=1e-7):
                break
            w = new
        if len(x0):
            picked = np.unique(np.concatenate([picked, np.argsort(-(x0 @ w[:-1]))[:5000]]))
    model |= {"landmarks": [*stems, *others], "beta": (whiten @ w[:-1]).tolist(), "bias": float(w[-1])}
    table = dict(zip([*positive, *negative], np.concatenate([x1, x0]) @ w[:-1] + w[-1], strict=True))
    missing = sorted({v for bag in bags for v in bag} - table.keys())
    table |= dict(zip(missing, kernel(missing, landmarks) @ np.array(model["beta"]) + model["bias"], strict=True)) if missing else {}
    worst = np.array([max((table[v] for v in bag), default=-2.0) for bag in bags])
    # the calibration also sees each toxic text's worst window with a letter put in
    put = [max(bag, key=lambda v: (table[v], v)) for bag, y in zip(bags, toxic, strict=True) if y and bag]
    put = [(w[: (at := int(rng.integers(1, len(w))))] + letters[int(rng.integers(26))] + w[at:])[:WIDTH] for w in put]
    gapped = kernel(put, landmarks) @ np.array(model["beta"]) + model["bias"] if put else np.zeros(0)
    y, a, b = np.concatenate([np.array(toxic, float), np.ones(len(gapped))]), 1.0, 0.0
    worst, mass = np.concatenate([worst, gapped]), np.concatenate([np.ones(len(toxic)), np.full(len(gapped), 0.3)])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):  # logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
        r, v = mass * (p - target), mass * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * worst * worst).sum() + 1e-3, (v * worst).sum()], [(v * worst).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * worst).sum(), r.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return model | {"slope": float(max(a, 0.0)), "offset": float(b)}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model of at most sample_rows labelled rows, those of the smallest hash; null ids, labels and texts teach nothing."""
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    sample = rows.join(F.broadcast(ids), "_id").repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += batch.column("_text").to_pylist()
            ys += batch.column("_y").to_pylist()
        model = fit(texts, ys)
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.string()) if k == "landmarks" else pa.list_(pa.float64()) if k == "beta" else pa.float64()) for k, v in model.items()})

    found = sample.mapInArrow(run, "landmarks array<string>, beta array<double>, bias double, slope double, offset double").collect()
    return found[0].asDict() if found else fit([], [])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row: whole texts; null, empty and wordless ones as a text of no likeness.

    Equal texts have equal scores, repeated rows one each, and an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = codes(model["landmarks"]) if model["landmarks"] else None
        beta, known = np.array(model["beta"], np.float32), {}
        for batch in batches:
            bags = [windows(t) for t in batch.column("_text").to_pylist()]
            if landmarks is None:
                worst = np.zeros(len(bags))
            else:
                new = list({v for bag in bags for v in bag if v not in known})
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list({v for bag in bags for v in bag})
                if new:
                    known.update(zip(new, (kernel(new, landmarks) @ beta + model["bias"]).tolist(), strict=True))
                worst = np.array([max((known[v] for v in bag), default=-2.0) for bag in bags], np.float64)
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * worst + model["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    kept = docs.select("doc_id", F.col("text").alias("_text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null doc_id counts as held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT_FOLD, F.lit(True))
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
