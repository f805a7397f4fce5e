"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Texts are folded to letters and single spaces: other marks vanish, equal letters in a row count once, and the spaces
inside three or more letters that stand alone go, so characters put between letters do no harm. The kernel of two
windows sums over all subsequences of four symbols that span at most six, each weighted by ``decay`` per symbol skipped;
it tolerates gaps and inserted letters. Landmarks are the commonest words of toxic sentences' witness windows and of clean
windows; the machine is linear in the whitened kernel values at them. As each kernel value is linear in the window's
subsequence weights, the machine folds into one weight per subsequence, and a whole text is scored in one pass: its raw
score is that of its worst window.

Training takes a bounded sample of labelled rows (``sample`` doc_ids of each class, texts of up to ``most_chars``), splits
texts into sentences, and learns which sentences of toxic rows bear the label (multiple instances): it starts from letter
runs that toxic rows have and clean ones lack, and repeats with the machine's own worst windows. Every text also comes
disguised: a letter put inside its words, or no spaces. The model is the mean of three machines; rows that none of them
has seen turn raw scores into probabilities at the labels' base rate.

Defined cases: null and empty texts get the score of a window without letters; very long texts are scored whole, in blocks
that overlap by a window; labels that are null or of both classes for one doc_id are ignored; of repeated rows of a
sampled doc_id the least text is learned from; without labels of both classes every score is the base rate (0 without
labels); repeated rows, equal texts and rows with a null doc_id are scored each (``held_out`` is null for a null doc_id);
no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast, documents, slices, tidied, tidy

#: Symbols: a break, the space, then letters; all other letters share the last one.
LETTERS, GAP = 46, 12
A = LETTERS + 2
#: Start positions in a window; steps between the four symbols of a subsequence.
W, REACH = 6, 5
STEPS = [(a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) if a + b + c <= REACH]
#: Symbols scored at once.
_MOST = 300_000
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass
class Model:
    symbols: np.ndarray  # by code point; 255: vanishes
    weight: np.ndarray  # by subsequence
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        raw = raw_scores(texts, self.symbols, self.weight) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbols by code point, for the commonest letters of these texts beside a to z."""
    count: dict[str, int] = {}
    for t in texts:
        codes, n = np.unique(np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32), return_counts=True)
        for c, k in zip(codes.tolist(), n.tolist(), strict=True):
            if chr(c).isalpha():
                count[chr(c)] = count.get(chr(c), 0) + k
    own = [chr(97 + i) for i in range(26)]
    own += sorted((c for c in count if c not in own), key=lambda c: (-count[c], c))[: LETTERS - 27]
    table = np.full(0x3000, 255, np.uint8)
    for c in range(0x3000):
        if chr(c).isspace():
            table[c] = 1
        elif chr(c).isalpha():
            table[c] = A - 1
    table[0] = 0
    for k, c in enumerate(own):
        if ord(c) < len(table):
            table[ord(c)] = 2 + k
    return table


def fold(text: str, table: np.ndarray) -> np.ndarray:
    """The symbols of a text: no marks, single spaces, and no spaces inside three or more letters that stand alone, but
    where three spaces or more in a row mark a word's end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if len(codes) == 0 or codes.max() < len(table):
        s = table[codes]
    else:
        s = table[np.minimum(codes, len(table) - 1)]
        high, which = np.unique(codes[codes >= len(table)], return_inverse=True)
        s[codes >= len(table)] = np.array([1 if chr(c).isspace() else A - 1 if chr(c).isalpha() else 255 for c in high.tolist()], np.uint8)[which]
    s = s[s != 255]
    if len(s) < 3:
        return s
    first = np.concatenate(([True], s[1:] != s[:-1]))
    wide = s == 1
    wide[:-2] &= wide[1:-1] & wide[2:]
    wide[-2:] = False
    s, wide = s[first], wide[first]
    blank = np.concatenate(([True], s == 1, [True]))
    alone = ~blank[1:-1] & blank[:-2] & blank[2:]
    # a space between two lone letters, next to another such space
    inner = np.zeros(len(s) + 4, bool)
    inner[3:-3] = blank[2:-2] & alone[:-2] & alone[2:]
    inner[2:-2] &= inner[:-4] | inner[4:]
    s = s[~inner[2:-2] | wide]
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def subsequences(s: np.ndarray) -> list[np.ndarray]:
    """For each way to step, the subsequence number from each position on; s ends in at least ``REACH`` breaks."""
    c = s.astype(np.int32)
    n = len(c) - REACH
    c3, c2, c1 = c * (A * A * A), c * (A * A), c * A
    return [c3[:n] + c2[x : x + n] + c1[x + y : x + y + n] + c[x + y + z : x + y + z + n] for x, y, z in STEPS]


_DECAY = 0.6
_WEIGHTS = np.array([_DECAY ** (sum(x) - 3) for x in STEPS], np.float32)


def silent(weight: np.ndarray) -> np.ndarray:
    """Subsequences with a break in them weigh nothing."""
    w = weight.reshape(A, A, A, A)
    w[0], w[:, 0], w[:, :, 0], w[:, :, :, 0] = 0, 0, 0, 0
    return weight


def window_sums(s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Score of the window that starts at each position, without bias."""
    codes = subsequences(s)
    g = weight[codes[0]] * _WEIGHTS[0]
    for k in range(1, len(codes)):
        g += weight[codes[k]] * _WEIGHTS[k]
    total = np.concatenate(([0.0], np.cumsum(g, dtype=np.float64)))
    return total[W:] - total[:-W]


def raw_scores(texts: list[str], table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each text its worst window's score, at least that of an empty window (0)."""
    out = np.zeros(len(texts))
    parts: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        ends = np.cumsum([len(p) + GAP for p in parts])
        s = np.zeros(ends[-1], np.uint8)
        for p, e in zip(parts, ends, strict=True):
            s[e - GAP - len(p) : e - GAP] = p
        sums = window_sums(s, weight)
        starts = np.minimum(np.concatenate(([0], ends[:-1])), len(sums) - 1)
        np.maximum.at(out, rows, np.maximum.reduceat(sums, starts))
        parts.clear()
        rows.clear()

    size = 0
    for i, text in enumerate(texts):
        s = fold(text, table)
        for a in range(0, max(1, len(s)), _MOST):
            parts.append(s[a : a + _MOST + W + REACH])
            rows.append(i)
            size += len(parts[-1])
            if size >= _MOST:
                flush()
                size = 0
    if parts:
        flush()
    return out


def _padded(s: np.ndarray, at: int) -> np.ndarray:
    x = np.zeros(W + REACH, np.uint8)
    own = s[at : at + W + REACH]
    x[: len(own)] = own
    return x


def _features(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights (windows, starts * ways)."""
    c = windows.astype(np.int32)
    codes, weights = [], []
    for k, (x, y, z) in enumerate(STEPS):
        four = [c[:, :W], c[:, x : x + W], c[:, x + y : x + y + W], c[:, x + y + z : x + y + z + W]]
        codes.append(((four[0] * A + four[1]) * A + four[2]) * A + four[3])
        weights.append(np.minimum.reduce(four).clip(0, 1) * _WEIGHTS[k])
    return np.concatenate(codes, 1), np.concatenate(weights, 1).astype(np.float32)


class Marks:
    """Landmark windows by the subsequences that any of them has."""

    def __init__(self, windows: np.ndarray) -> None:
        codes, w = _features(windows)
        self.codes = np.unique(codes)
        self.dense = np.zeros((len(windows), len(self.codes)), np.float32)
        at = np.searchsorted(self.codes, codes)
        for i in range(len(windows)):
            np.add.at(self.dense[i], at[i], w[i])

    def kernel(self, windows: np.ndarray, white: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of windows at the landmarks, times ``white``."""
        out = np.empty((len(windows), len(self.dense) if white is None else white.shape[1]), np.float32)
        flip = np.ascontiguousarray(self.dense.T)
        for a in range(0, len(windows), 1000):
            codes, w = _features(windows[a : a + 1000])
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            row, col = np.nonzero((self.codes[at] == codes) & (w > 0))
            part = np.zeros((len(codes), flip.shape[1]), np.float32)
            for b in range(0, len(row), 200_000):
                r, k = row[b : b + 200_000], col[b : b + 200_000]
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                part[r[cut]] += np.add.reduceat(flip[at[r, k]] * w[r, k][:, None], cut, axis=0)
            out[a : a + 1000] = part if white is None else part @ white
        return out


def _words(windows: np.ndarray, most: int) -> np.ndarray:
    """The commonest words of these windows, each between spaces, as windows."""
    count: dict[bytes, int] = {}
    for x in windows:
        for part in x.tobytes().replace(b"\0", b"\1").split(b"\1"):
            if len(part) >= 3:
                count[part] = count.get(part, 0) + 1
    best = sorted(count, key=lambda k: (-count[k], k))[:most]
    return np.stack([_padded(np.frombuffer(b"\1" + k + b"\1", np.uint8), 0) for k in best]) if best else windows[:most]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps."""
    rank = z.shape[1]
    ridge = np.ones(rank + 1)
    ridge[-1] = 1e-6
    w = np.zeros(rank + 1)
    margin = lambda v: 1 - y * (z @ v[:-1].astype(np.float32) + v[-1])
    obj = lambda v: 0.5 * (ridge * v * v).sum() + c * (weight * np.maximum(0, margin(v)) ** 2).sum()
    for _ in range(30):
        m = margin(w)
        own = np.flatnonzero(m > 0)
        grad, hess = ridge * w, np.diag(ridge)
        for a in range(0, len(own), 8000):
            k = own[a : a + 8000]
            z1 = np.concatenate([z[k], np.ones((len(k), 1), np.float32)], 1).astype(np.float64)
            grad -= 2 * c * (z1.T @ (weight[k] * y[k] * m[k]))
            hess += 2 * c * (z1.T * weight[k]) @ z1
        step, size, now = np.linalg.solve(hess, grad), 1.0, obj(w)
        while size > 1e-4 and obj(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-5:
            break
    return w[:-1], float(w[-1])


def _distinct(folded: list[np.ndarray]) -> list[int]:
    """Places of texts that share little with an earlier one, by their least hashes of 24 symbols."""
    mult = np.array([31**k % 2**64 for k in range(24)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen: dict[int, int] = {}
    out = []
    for i, s in enumerate(folded):
        if len(s) < 24:
            out.append(i)
            continue
        h = np.lib.stride_tricks.sliding_window_view(s.astype(np.uint64) + np.uint64(1), 24) @ mult
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low = np.unique(h)[:16].tolist()
        if sum(x in seen for x in low) < max(1, len(low) // 3):
            out.append(i)
        for x in low:
            seen[x] = i
    return out


def disguise(s: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, callable]]:
    """Copies of a folded text and where a symbol went: a letter put inside each word, two words in three, and no spaces."""
    out = []
    blank = np.concatenate(([True], s == 1, [True]))
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    size = np.flatnonzero(blank[1:] & ~blank[:-1]) - first
    for share in (1.0, 0.67):
        own = (size >= 3) & (rng.random(len(size)) < share)
        at = (first[own] + 1 + rng.random(own.sum()) * (size[own] - 1)).astype(np.int32)
        out.append((np.insert(s, at, rng.integers(2, 28, len(at)).astype(np.uint8)), lambda k, at=at: k + int(np.searchsorted(at, k, "right"))))
    keep = s != 1
    out.append((s[keep], lambda k: int(keep[:k].sum())))
    return out


def _machine(texts: list[str], folded: list[np.ndarray], y: np.ndarray, keep: np.ndarray, table: np.ndarray, landmarks: int, rounds: int, cost: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """(weights, bias) of a machine from the rows in ``keep``; None where they don't tell the classes apart."""
    toxic, clean = keep[y[keep] == 1], keep[y[keep] == 0]
    # letter runs of four that toxic rows have and clean rows lack
    have = [np.zeros(A**4, np.int32), np.zeros(A**4, np.int32)]
    runs: dict[int, np.ndarray] = {}
    for i in keep:
        c = folded[i].astype(np.int32)
        if len(c) >= 4:
            runs[i] = ((c[:-3] * A + c[1:-2]) * A + c[2:-1]) * A + c[3:]
            have[y[i]][np.unique(runs[i])] += 1
    often = np.flatnonzero(have[1] >= 3)
    n1, n0 = have[1][often], have[0][often]
    del have
    odds = np.zeros(A**4, np.float32)
    odds[often] = np.log((n1 + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (n0 + 0.5)) * np.sqrt(n1)

    def sentences(i: int) -> list[np.ndarray]:
        return [f for f in (fold(x, table) for x in _SENTENCE.findall(texts[i])) if len(f) >= 3]

    copies = {i: disguise(folded[i], rng) for i in keep if len(folded[i]) >= 4}

    def witnesses(i: int, at: int) -> list[np.ndarray]:
        """The window of a toxic text and the same place in its copies."""
        return [_padded(folded[i], at), *(_padded(s, where(at)) for s, where in copies.get(i, ()))]

    witness = []
    for i in toxic:
        if i in runs:
            at = int(odds[runs[i]].argmax())
            if odds[runs[i][at]] > 0:
                witness += witnesses(i, max(0, at - 2))
    runs.clear()
    del odds
    tidy()
    easy = []
    for i in clean:
        own_s = sentences(i)
        for _ in range(min(8, len(own_s))):
            s = own_s[rng.integers(len(own_s))]
            easy.append(_padded(s, int(rng.integers(max(1, len(s) - 3)))))
    if not witness or not easy:
        return None
    hard: dict[bytes, None] = {}
    easy = np.stack(easy)
    weight, bias = np.zeros(A**4, np.float32), 0.0
    for _ in range(rounds):
        pos = np.stack(witness)
        worst = np.frombuffer(b"".join(hard), np.uint8).reshape(-1, W + REACH)
        neg = np.concatenate([easy, worst])
        marks = np.unique(np.concatenate([_words(pos, landmarks * 2 // 3), _words(worst if hard else easy, landmarks // 3)]), axis=0)
        held = Marks(marks)
        val, vec = np.linalg.eigh((held.dense @ held.dense.T).astype(np.float64))
        ok = val > 1e-4 * val.max()
        white = vec[:, ok] / np.sqrt(val[ok])
        x = np.concatenate([pos, neg])
        sign = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        each = np.where(sign > 0, 0.5 * len(sign) / len(pos), 0.5 * len(sign) / len(neg))
        v, bias = _svm(held.kernel(x, white.astype(np.float32)), sign, each, cost)
        weight = np.zeros(A**4, np.float32)
        weight[held.codes] = held.dense.T @ (white @ v)
        silent(weight)
        scored = lambda s: window_sums(np.concatenate([s, np.zeros(GAP, np.uint8)]), weight)
        witness = []
        for i in toxic:
            s = scored(folded[i])
            if s.max() + bias > -0.5:
                witness += witnesses(i, min(int(s.argmax()), max(0, len(folded[i]) - 1)))
        witness = witness or list(pos)
        for i in clean:
            for text in (folded[i], *(x for x, _ in copies.get(i, ()))):
                s = scored(text)
                for _ in range(3):
                    at = int(s.argmax())
                    if s[at] + bias <= -1:
                        break
                    hard[_padded(text, at).tobytes()] = None
                    s[max(0, at - W) : at + W] = -np.inf
    return weight, bias


def train(texts: list[str], labels: list[int], base_rate: float, landmarks: int = 240, rounds: int = 4, cost: float = 0.3, parts: int = 3, seed: int = 7) -> Model:
    """The mean of ``parts`` machines, each fitted without a part of the rows, and probabilities from rows that none has seen."""
    rng = np.random.default_rng(seed)
    table = alphabet(texts)
    y = np.array(labels)
    base = min(max(base_rate, 1e-6), 1 - 1e-6)
    prior = float(np.log(base / (1 - base)))
    folded = [fold(t, table) for t in texts]
    own = np.array(_distinct(folded), int)
    part = rng.permutation(len(own)) * (parts + 1) // max(1, len(own))
    weight, bias, back = np.zeros(A**4, np.float32), 0.0, own[part == parts]
    for k in range(parts):
        keep = own[(part != k) & (part != parts)]
        fits = min((y[keep] == 1).sum(), (y[keep] == 0).sum()) >= 5
        found = _machine(texts, folded, y, keep, table, landmarks, rounds, cost, rng) if fits else None
        if found is None:
            return Model(table, np.zeros(A**4, np.float32), 0.0, 0.0, prior if len(texts) else -30.0)
        weight += found[0] / parts
        bias += found[1] / parts
        tidy()
    # probabilities at the base rate
    if min((y[back] == 1).sum(), (y[back] == 0).sum()) < 3:
        back = own
    x, t = raw_scores([texts[i] for i in back], table, weight) + bias, y[back]
    share = np.where(t == 1, base / max((t == 1).mean(), 1e-9), (1 - base) / max((t == 0).mean(), 1e-9))
    target = np.where(t == 1, ((t == 1).sum() + 1) / ((t == 1).sum() + 2), 1 / ((t == 0).sum() + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * x + ab[1], -30, 30)))
        f = np.stack([x, np.ones_like(x)], 1)
        grad = f.T @ (share * (p - target)) + 1e-3 * ab
        hess = (f.T * (share * p * (1 - p))) @ f + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(table, weight, bias, float(max(ab[0], 0.0)), float(ab[1]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, most_chars: int = 12_000) -> Model:
    """Learn from the labelled rows that aren't held out; ``sample`` rows of each class at most, the same ones each time."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    rate = known.agg(F.avg("toxic").alias("r")).first()["r"]
    picked = [r for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not picked:
        return Model(alphabet([]), np.zeros(A**4, np.float32), 0.0, 0.0, -30.0)
    few = docs.sparkSession.createDataFrame(pa.table({c: [r[c] for r in picked] for c in ("doc_id", "toxic")}), known.schema)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, most_chars)).join(F.broadcast(few), "doc_id")
    rows = sorted(tuple(r) for r in texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return train([r[2] for r in rows], [r[1] for r in rows], rate or 0.0)


def _score(shared) -> callable:
    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(model.scores(texts), pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, text, score (0 to 1); one per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(broadcast(docs.sparkSession, model)), f"doc_id {kind}, text string, score double")


def keep_below(shared, at: int, limit: float) -> callable:
    """For mapInArrow: the rows, whole, whose text (column ``at``) scores below the limit."""

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in slices(batches):
            keep = model.scores([t or "" for t in batch.column(at).to_pylist()]) < limit
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a machine fitted to the labelled rows that aren't held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
