"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes ratios.

A text's features are the character n-grams (n = 3 to 6, lower-cased) that it has, and
those that it has at least 2 and at least 4 times. Each is scaled by its log-count ratio
r = log((p / |p|) / (q / |q|)), p and q being its smoothed
document counts among toxic and other texts. Logistic regression on the scaled features
gives weights, which are blended with their mean; a logistic curve, fitted on margins of
texts that were held out in turn, makes the score.

All features whose counts differ between the classes beyond chance (G2 statistic) are kept, however
many they are and whichever class they speak for; one of fewer than three texts is not looked at.
The fit takes ``per_class`` labelled texts of each class and ``fit_bytes`` in all at
most, both parameters; whole texts, chosen by a hash of doc_id. Scoring reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosea.llm._common import crc_mod, give_back, read_table, sliced
from mnemosea.llm.langid import code_points
from mnemosea.llm.near_dup import BUCKETS, shingle_sets, sketch

ORDERS = (3, 4, 5, 6)
#: A feature is an n-gram that a text has at least so many times.
LEVELS = (1, 2, 4)
#: Parts of the n-grams, by hash, that the fit counts one after another.
COUNTED_IN = 16
#: Parts of which the n-grams are held at once; the texts are read again for the next ones.
HELD = 4
#: Characters of text whose features are looked up together, unless one text has more.
TOGETHER = 1 << 18
_SIFT_BITS = 21
#: Bits of the slots by which the fit leaves out n-grams that are too rare to count.
_SLOT_BITS = 24


def _grams(points: np.ndarray):
    """For each n, the hashes of the n-grams that begin at each place."""
    h = points.astype(np.uint64)
    for n in range(2, ORDERS[-1] + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            yield n, h


class Features:
    """Which n-grams count, by hash, and the number of the feature that each is at each level (-1: none)."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.hashes, own = np.unique(hashes, return_inverse=True)
        self.number = np.full((len(self.hashes), len(LEVELS)), -1, np.int32)
        self.number[own, levels] = np.arange(len(hashes))
        self.size = len(hashes)
        self.sift = np.zeros(1 << _SIFT_BITS, bool)
        self.sift[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SIFT_BITS)

    def present(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the features of each text, each once."""
        out = []
        for i, j in _together(texts):
            out += self._present(texts[i:j])
        return out

    def _present(self, texts: list[str]) -> list[np.ndarray]:
        points, begin = code_points(texts)
        place, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.hashes):
            for n, h in _grams(points):
                at = np.flatnonzero(self.sift[self._slot(h)])
                k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                hit = self.hashes[k] == h[at]
                at, k = at[hit], k[hit]
                # An n-gram must end in the text in which it begins.
                own = np.searchsorted(begin, at, side="right") - 1
                inside = at + n <= begin[own + 1]
                place.append(own[inside])
                found.append(k[inside])
        pair, times = np.unique(np.concatenate(place) * max(1, len(self.hashes)) + np.concatenate(found), return_counts=True)
        own, k = np.divmod(pair, max(1, len(self.hashes)))
        number = np.where(times[:, None] >= np.array(LEVELS), self.number[k], -1)
        row, level = np.nonzero(number >= 0)
        number, own = number[row, level].astype(np.int64), own[row]
        edge = np.searchsorted(own, np.arange(len(texts) + 1))
        return [number[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _together(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts of about TOGETHER characters."""
    out, i, room = [], 0, TOGETHER
    for j, t in enumerate(texts):
        if j > i and len(t) > room:
            out.append((i, j))
            i, room = j, TOGETHER
        room -= len(t)
    return [*out, (i, len(texts))] if texts else out


def _unlike(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The rows without those whose words are half those of an earlier row: copies would make
    whatever words they share look like signs of their class."""
    kept, seen = [], np.zeros((0, BUCKETS), np.uint16)
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        for row, s in zip(part, shingle_sets(pa.array([t for _, t in part], pa.string()), 3), strict=True):
            if len(s):
                own = sketch(s)
                if len(seen) and (seen == own).mean(1).max() >= 0.5:
                    continue
                seen = np.concatenate([seen, own[None]])
            kept.append(row)
    return kept


class Model:
    def __init__(self, rows: list[tuple[int, str]], *, g2: float, blend: float = 0.75, cost: float = 1.0):
        rows = _unlike(sorted(set(rows)))
        y = np.array([label for label, _ in rows], bool)
        self.constant = None
        if not y.any() or y.all():
            self.constant = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.0
            return
        texts = [t for _, t in rows]
        self.features = Features(*_select(texts, y, g2))
        x = self.features.present(texts)
        margins = np.zeros(len(y))
        fold = np.empty(len(y), np.int64)
        fold[y], fold[~y] = np.arange(y.sum()) % 4, np.arange((~y).sum()) % 4
        for k in range(4):
            own = fold != k
            if y[own].any():
                w, b = _train([x[i] for i in np.flatnonzero(own)], y[own], self.features.size, blend, cost)
                margins[~own] = [w[x[i]].sum() + b for i in np.flatnonzero(~own)]
        self.slope, self.shift = _logistic_curve(margins, y)
        self.weights, self.bias = _train(x, y, self.features.size, blend, cost)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        margin = np.array([self.weights[k].sum() + self.bias for k in self.features.present(texts)])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of a text, sorted, and how often each occurs."""
    h = [h for _, h in _grams(code_points([text])[0])]
    return np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _select(texts: list[str], y: np.ndarray, g2: float) -> tuple[np.ndarray, np.ndarray]:
    """Hash and level of the features whose document counts tell the classes apart."""
    # N-grams are kept only if their slot is that of n-grams of three texts or more; most n-grams' slots are not.
    often = np.zeros(1 << _SLOT_BITS, np.uint8)
    slot = lambda h: h >> np.uint64(64 - _SLOT_BITS)
    for t in texts:
        own = np.unique(slot(_counted(t)[0]))
        often[own] += often[own] < 3
    lows = np.array([-(-(k << 64) // COUNTED_IN) for k in range(COUNTED_IN)], np.uint64)
    hashes, levels = [], []
    for part in range(COUNTED_IN):
        first = part % HELD
        if first == 0:
            grams = []
            for t in texts:
                h, times = _counted(t)
                cut = slice(np.searchsorted(h, lows[part]), np.searchsorted(h, lows[part + HELD]) if part + HELD < COUNTED_IN else len(h))
                h, times = h[cut], times[cut]
                kept = often[slot(h)] >= 3
                grams.append((h[kept], np.minimum(times[kept], LEVELS[-1]).astype(np.uint8)))
            edges = [np.append(np.searchsorted(h, lows[part : part + HELD]), len(h)) for h, _ in grams]
        cut = [slice(e[first], e[first + 1]) for e in edges]
        h = np.concatenate([g[0][c] for g, c in zip(grams, cut, strict=True)])
        times = np.concatenate([g[1][c] for g, c in zip(grams, cut, strict=True)])
        toxic = np.repeat(y, [c.stop - c.start for c in cut])
        distinct, own = np.unique(h, return_inverse=True)
        before = None
        for k, level in enumerate(LEVELS):
            at = times >= level
            p, q = (np.bincount(own[at & label], minlength=len(distinct)) for label in (toxic, ~toxic))
            good = (p + q >= 3) & (_g2(p, q, y.sum(), (~y).sum()) >= g2)
            if before is not None:
                good &= (p != before[0]) | (q != before[1])  # a level that the same texts reach says nothing new
            before = p, q
            hashes.append(distinct[good])
            levels.append(np.full(int(good.sum()), k))
    return np.concatenate(hashes), np.concatenate(levels)


def _g2(p: np.ndarray, q: np.ndarray, n: int, m: int) -> np.ndarray:
    """How much better two rates, p of n and q of m, explain the counts than one rate for both."""
    with np.errstate(divide="ignore", invalid="ignore"):
        e = (p + q) / (n + m)
        term = lambda o, x: np.where(o > 0, o * np.log(o / x), 0)
        return np.nan_to_num(2 * (term(p, e * n) + term(q, e * m) + term(n - p, (1 - e) * n) + term(m - q, (1 - e) * m)), posinf=0.0, neginf=0.0)


def log_count_ratios(x: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of each feature, p and q being one more than the toxic and the other texts that
    have it, |p| and |q| one more than the texts of either class."""
    p, q = (1.0 + np.bincount(np.concatenate([k for k, own in zip(x, y, strict=True) if own == label] or [np.zeros(0, np.int64)]), minlength=size) for label in (True, False))
    return np.log((p / (y.sum() + 1)) / (q / ((~y).sum() + 1)))


def _train(x: list[np.ndarray], y: np.ndarray, size: int, blend: float, cost: float, epochs: int = 25, step: int = 32) -> tuple[np.ndarray, float]:
    """Weights on plain presence (ratios multiplied in) and the bias: logistic regression by
    adaptive gradients over a few texts at a time, in an order that is fixed."""
    ratio = log_count_ratios(x, y, size)
    sizes = np.array([len(k) for k in x])
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    z = np.where(y, 1.0, -1.0)
    w, b = np.zeros(size), 0.0
    g_w, g_b = np.full(size, 1e-8), 1e-8
    order = np.random.default_rng(5)
    for _ in range(epochs):
        turn = order.permutation(len(x))
        for i in range(0, len(turn), step):
            own = turn[i : i + step]
            k = np.concatenate([x[j] for j in own])
            row = np.repeat(np.arange(len(own)), sizes[own])
            margin = np.bincount(row, w[k] * ratio[k], len(own)) + b
            s = -z[own] * weight[own] / (1 + np.exp(np.minimum(50.0, z[own] * margin)))
            g = np.bincount(k, s[row], size) * ratio + w * (len(own) / (cost * len(x)))
            g_w += g * g
            g_b += s.sum() ** 2
            w -= 0.5 * g / np.sqrt(g_w)
            b -= 0.5 * s.sum() / np.sqrt(g_b)
    mean = np.abs(w).mean() if size else 0.0
    w = (1 - blend) * mean + blend * w
    return w * ratio, b * blend


def _logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margin to probability, with smoothed targets."""
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones(len(y))], 1)
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
    return w[0] / spread, w[1]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = 2000, fit_bytes: int = 12 << 20, g2: float = 20.0) -> Model:
    """A model of the labelled rows (doc_id, toxic) where ``learn``, an expression on doc_id, holds. A doc_id
    with labels of both kinds is left out; of one with several texts, one counts."""
    rows = labels.select("doc_id", "toxic").filter(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    place = F.xxhash64(F.lit(5), "doc_id")
    some = [rows.filter(F.col("toxic") == t).orderBy(place, "doc_id").limit(per_class) for t in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col("doc_id").alias("labelled"), "toxic")  # per_class of each at most
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    found = texts.select("doc_id", "hash", "size").join(F.broadcast(some), F.col("doc_id") == F.col("labelled"))
    found = found.groupBy("labelled").agg(F.min(F.struct("hash", "size")).alias("of"), F.first("toxic").alias("toxic")).select("labelled", "of.hash", "of.size", "toxic", F.xxhash64(F.lit(5), "labelled").alias("place"))
    chosen, room = [], {0: fit_bytes // 2, 1: fit_bytes // 2}
    for r in sorted(found.collect(), key=lambda r: (r["place"], r["labelled"])):
        if r["size"] <= room[r["toxic"]]:
            chosen.append((r["labelled"], r["hash"], r["toxic"]))
            room[r["toxic"]] -= r["size"]
    picked = docs.sparkSession.createDataFrame(chosen, "labelled long, own long, toxic int")
    rows = texts.join(F.broadcast(picked), (F.col("doc_id") == F.col("labelled")) & (F.col("hash") == F.col("own")))
    rows = rows.groupBy("labelled").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))  # copies of a row count once
    model = Model([(r["toxic"], r["text"]) for r in rows.collect()], g2=g2)  # fit_bytes bounds it
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: toxic likelier).

    Null and empty texts are scored too, as texts without features. With labels of one
    class only, or none, every text gets the share of toxic labels. Repeated rows stay, equal
    texts get equal scores, an empty table gives no rows. Only doc_id and text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # its n-grams are those of ``fit_bytes`` of text at most

    def run(batches):
        model = held.value
        for batch in sliced(batches, "text", 4 << 20):
            out = model.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


#: A score from here on counts as toxic.
TOXIC = 0.7


def drop_toxic(docs: DataFrame, model: Model, *, limit: float = TOXIC) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in sliced(batches, "text", 4 << 20):
            yield batch.filter(pa.array(model.score([t or "" for t in batch.column("text").to_pylist()]) < limit))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir):
    """All documents; the model learns from labels whose crc32(doc_id) mod 3 is not 1."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
