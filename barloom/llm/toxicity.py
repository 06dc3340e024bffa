"""Abusive, hateful and sexual content: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 20
#: Words a window holds; a document scores as its highest window.
WINDOW, STRIDE = 20, 10
#: At most so many labelled documents, and so many characters of them, are read for fitting.
MOST_LABELLED, MOST_CHARS = 12_000, 12_000_000
#: Fewer marked documents than this teach nothing: no model then, and the reason is given.
LEAST_MARKED = 5
KINDS = ("abusive", "hateful", "sexual")

_HAN = "\u3005\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
_SPELT = re.compile(r"(?<![^\W_])[a-z](?:(?:[^\w\n]|_)[a-z]){2,}(?![^\W_])")
_GAP = re.compile(r"[\W_]+")
_TOKEN = re.compile(rf"[{_HAN}]|\d[\d.,:%]*(?![a-z@$*])|(?:[^\W_{_HAN}]|[@$*])+(?:[!|*'](?:[^\W_{_HAN}]|[@$*])+)*")
_REPEAT = re.compile(r"(\D)\1+")
#: Signs and digits that stand for letters, and Cyrillic and Greek letters that look like Latin ones.
_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l"})
_LOOKALIKE = str.maketrans("авекмнорстухіѕјαεικνορτυχ", "abekmhopctyxisjaeiknoptux")


def _even(token: str) -> str:
    if token[0].isdigit() and not any("a" <= c <= "z" for c in token):
        return "#"
    if not token.isalpha():
        token = token.translate(_LEET).replace("'", "")
    return _REPEAT.sub(r"\1", token)


def _tokens(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).lower()
        text = _INVISIBLE.sub("", text).translate(_LOOKALIKE)
    return _TOKEN.findall(_SPELT.sub(lambda m: _GAP.sub("", m.group()), text))


def words(text: str) -> list[str]:
    """Words for scoring: case, width, invisible signs, look-alike letters, spelt-out and stretched words and digits for letters evened out; numbers become '#'; a Han character is a word; of repeated words one stays."""
    out: list[str] = []
    for token in map(_even, _tokens(text)):
        if not out or token != out[-1]:
            out.append(token)
    return out


class Hasher:
    """Hashes of the words of a text, with a memory of tokens."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        for token in _tokens(text or ""):
            h = known.get(token)
            if h is None:
                h = zlib.crc32(_even(token).encode("utf-8", "surrogatepass"))
                if len(known) < 300_000:
                    known[token] = h
            out.append(h)
        hashes = np.array(out, dtype=np.uint64)
        return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(h: np.ndarray) -> np.ndarray:
    """(6, n) feature numbers by start position: words, pairs, triples, pairs with one and two words skipped, triples around a gap; -1 where the text ends first."""
    n = len(h)
    out = np.full((6, n), -1, dtype=np.int32)
    kinds = (((0,), 1), ((0, 1), 2), ((0, 1, 2), 3), ((0, 2), 4), ((0, 3), 5), ((0, 1, 3), 6))
    for row, (offsets, salt) in enumerate(kinds):
        m = n - offsets[-1]
        if m <= 0:
            continue
        x = np.full(m, np.uint64(salt) * _C)
        for o in offsets:
            x = (x ^ (h[o : o + m] * _A)) * _B
            x ^= x >> np.uint64(29)
        out[row, :m] = (x >> np.uint64(64 - BITS)).astype(np.int32)
    return out


@dataclass(frozen=True)
class Model:
    """Sparse weights and bias per kind of content and for any of them, and the threshold on the score of 'any'; or the reason why there are none."""

    index: dict[str, np.ndarray]
    value: dict[str, np.ndarray]
    bias: dict[str, float]
    threshold: float
    reason: str | None = None

    def dense(self, kinds: Sequence[str]) -> np.ndarray:
        """(features, kinds) weights; the last row, for -1, is zero."""
        w = np.zeros(((1 << BITS) + 1, len(kinds)), dtype=np.float32)
        for k, kind in enumerate(kinds):
            w[self.index[kind], k] = self.value[kind]
        return w


def window_scores(f: np.ndarray, w: np.ndarray, bias: np.ndarray | float) -> np.ndarray:
    """Score of the window starting at each position, the last ones cut short by the end of the text; w may hold a column per kind."""
    per_position = w[f].sum(axis=0, dtype=np.float64)
    n = len(per_position)
    total = np.zeros((n + 1, *per_position.shape[1:]))
    np.cumsum(per_position, axis=0, out=total[1:])
    return total[np.minimum(np.arange(n) + WINDOW, n)] - total[:-1] + bias


class Ftrl:
    """FTRL-proximal with per-coordinate rates, on small batches of instances given as feature lists."""

    def __init__(self, alpha: float, l1: float, l2: float, beta: float = 1.0):
        size = (1 << BITS) + 1  # the last slot is for -1, no feature
        self.z, self.n, self.g = np.zeros(size), np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0
        self.bias = 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def weights(self) -> np.ndarray:
        w = self._weights(self.z, self.n).astype(np.float32)
        w[-1] = 0.0
        return w

    def update(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """rows: (batch, features) numbers, padded with -1. A feature that stands several times is computed as often, with the same outcome."""
        at = rows.ravel()
        n, z = self.n[at], self.z[at]
        w = self._weights(z, n)
        w[at < 0] = 0.0
        score = w.reshape(rows.shape).sum(axis=1) + self.bias
        error = (1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))) - y) * weight
        np.add.at(self.g, at, np.repeat(error, rows.shape[1]))
        g = self.g[at]
        self.g[at] = 0.0
        g[at < 0] = 0.0
        squared = g * g
        self.z[at] = z + g - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + squared
        gb = float(error.sum())
        sigma = (np.sqrt(self.bias_n + gb * gb) - np.sqrt(self.bias_n)) / self.alpha
        self.bias_z += gb - sigma * self.bias
        self.bias_n += gb * gb
        self.bias = -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)


class Corpus:
    """The features of several documents end to end, each followed by a window's length of none, so that a window is a plain slice."""

    def __init__(self, hashes: Sequence[np.ndarray]):
        self.lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + WINDOW)]).astype(np.int64)
        self.rows = np.full((int(self.starts[-1]), 6), -1, dtype=np.int32)
        for h, a in zip(hashes, self.starts):
            self.rows[a : a + len(h)] = features(h).T

    def document(self, doc: int) -> np.ndarray:
        return self.rows[self.starts[doc] : self.starts[doc] + self.lengths[doc]].T

    def windows(self, places: np.ndarray) -> np.ndarray:
        """Features of the windows at places (document, start)."""
        begin = self.starts[places[:, 0]] + places[:, 1]
        return self.rows[begin[:, None] + np.arange(WINDOW)].reshape(len(places), -1)


def top_score(f: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, int]:
    """Score and place of the highest window; the bias alone for a text without words."""
    if not f.shape[1]:
        return bias, 0
    scores = window_scores(f, weights, bias)
    at = int(scores.argmax())
    return float(scores[at]), at


def fit(corpus: Corpus, docs: np.ndarray, labels: np.ndarray, rounds: int = 3, epochs: int = 2, alpha: float = 0.15, l1: float = 0.6, l2: float = 0.5, seed: int = 7, batch: int = 64) -> Ftrl:
    """Fit on the documents docs of corpus, labelled one by one: windows of clean documents count as clean, of a marked document the highest-scoring one as marked.

    In the first round every window of a marked document counts, weighted down; later rounds re-choose. Of clean documents
    every window of the grid counts in every round, in later ones the highest-scoring one too.
    """
    random = np.random.default_rng(seed)
    model = Ftrl(alpha, l1, l2)
    for turn in range(rounds):
        weights, bias = model.weights(), model.bias
        places, ys, ws = [], [], []
        for doc, y in zip(docs.tolist(), labels, strict=True):
            f = corpus.document(doc)
            n = f.shape[1]
            if not n:
                continue
            grid = list(range(0, max(1, n - STRIDE), STRIDE))
            if y and turn:
                grid = [top_score(f, weights, bias)[1]]
            elif turn:
                grid += [top_score(f, weights, bias)[1]]
            places += [(doc, s) for s in grid]
            ys += [float(y)] * len(grid)
            ws += [1.0 / len(grid) if y else 1.0] * len(grid)
        if not places:
            break
        at, target, weight = np.array(places), np.array(ys), np.array(ws)
        model = Ftrl(alpha, l1, l2)
        for _ in range(epochs):
            order = random.permutation(len(at))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                model.update(corpus.windows(at[pick]), target[pick], weight[pick])
    return model


#: Settings of the fits that clean the labels (strong sparsity) and of the fit that is kept.
CAUTIOUS = {"alpha": 0.2, "l1": 0.4, "l2": 0.3, "rounds": 3, "epochs": 2}
KEEN = {"alpha": 0.3, "l1": 0.3, "l2": 0.1, "rounds": 3, "epochs": 3}
FOLDS = 3


def _parallel(spark: SparkSession, data: list, jobs: list[dict]) -> list[dict]:
    """Run fits side by side, one task each, on the broadcast, bounded sample. A job names its training rows, target and settings, and the rows to score."""
    sent = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for j in batch.id:
                job, corpus = jobs[j], Corpus(sent.value)
                model = fit(corpus, job["train"], job["y"][job["train"]], **job["settings"])
                w = model.weights()
                at = np.flatnonzero(w)
                scores = [top_score(corpus.document(i), w, model.bias)[0] for i in job["score"]]
                yield pd.DataFrame({"job": [j], "at": [at.tolist()], "w": [w[at].tolist()], "bias": [model.bias], "scores": [scores]})

    schema = "job long, at array<int>, w array<float>, bias double, scores array<double>"
    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, schema).collect()
    sent.unpersist()
    return [{"at": np.array(r["at"], dtype=np.int64), "w": np.array(r["w"], dtype=np.float32), "bias": r["bias"], "scores": np.array(r["scores"])} for r in sorted(rows, key=lambda r: r["job"])]


def _held_out(spark: SparkSession, data: list, y: np.ndarray, keep: np.ndarray, settings: dict) -> np.ndarray:
    fold = np.arange(len(y)) % FOLDS
    jobs = [{"train": np.flatnonzero((fold != k) & keep), "score": np.flatnonzero(fold == k), "y": y, "settings": settings} for k in range(FOLDS)]
    out = np.zeros(len(y))
    for job, got in zip(jobs, _parallel(spark, data, jobs), strict=True):
        out[job["score"]] = got["scores"]
    return out


def best_threshold(scores: np.ndarray, y: np.ndarray, slack: float = 0.003) -> float:
    """The middle of the thresholds whose F1 on held-out scores is within slack of the best."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    if not len(s) or not hits[-1]:
        return 0.0
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + hits[-1])
    f1[:-1][s[:-1] == s[1:]] = -1.0
    good = np.flatnonzero(f1 >= f1.max() - slack)
    low = s[good[-1] + 1] if good[-1] + 1 < len(s) else s[good[-1]] - 1e-6
    return float((s[good[0]] + low) / 2)


def fit_model(documents: DataFrame, labels: DataFrame, *, row_id: str = "doc_id", text: str = "text", kinds: Sequence[str] = KINDS, by_kind: bool = True, most_labelled: int = MOST_LABELLED, most_chars: int = MOST_CHARS, least_marked: int = LEAST_MARKED) -> Model:
    """Fit on the labelled documents, at most most_labelled of them and most_chars characters (those of the smallest hashed ids, whole texts).

    A document read by several annotators is marked where at least half of them mark it. Annotators err, so the labels
    are first checked with models that did not see them: marked documents that score like the mass of clean ones and
    clean ones that score like marked ones are left out, however few there are; only where no clean document would stay,
    all of them do. The threshold comes from held-out scores of the rest. Labels
    without a document, null texts and null labels count for nothing; of a repeated document one text is read. With fewer
    than least_marked marked documents, or none that is not, there is no model: nothing scores or is flagged, and the
    reason is given. With by_kind there are weights per kind too, not only for any of them.
    """
    spark = documents.sparkSession
    mark = F.coalesce(F.greatest(*[F.col(k) for k in kinds]), F.lit(0))
    votes = labels.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("long").alias("id")).agg(F.avg(mark).alias("any"), *[F.avg(F.coalesce(F.col(k), F.lit(0))).alias(f"v_{k}") for k in kinds])
    chosen = votes.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    texts = documents.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "id")  # most_labelled narrow rows at most
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), *[F.first(F.col(n)).alias(n) for n in ("any", *(f"v_{k}" for k in kinds))])
    # Few rows with their lengths decide which texts are read; a running sum over at most most_labelled rows.
    so_far = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    read = sample.select("id", F.sum(F.length("text")).over(so_far).alias("chars")).where(F.col("chars") <= most_chars).select("id")
    sample = sample.join(F.broadcast(read), "id")
    names = ["any", *[f"v_{k}" for k in kinds]]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            yield batch[["id", *names]].assign(h=[hasher(t).astype(np.uint32).tobytes() for t in batch.text])

    schema = "id long, " + ", ".join(f"`{n}` double" for n in names) + ", h binary"
    rows = sample.mapInPandas(hashed, schema).toPandas().sort_values("id", kind="stable").reset_index(drop=True)
    data = [np.frombuffer(h, dtype=np.uint32).astype(np.uint64) for h in rows.h]
    y = (rows["any"].to_numpy() >= 0.5).astype(int)
    if y.sum() < least_marked or y.all():
        every = ["any", *(kinds if by_kind else ())]
        empty = np.zeros(0)
        why = f"{int(y.sum())} marked and {int((y == 0).sum())} other documents with a text: at least {least_marked} and 1 are needed"
        return Model({k: empty.astype(np.int64) for k in every}, {k: empty for k in every}, {k: -10.0 for k in every}, 0.0, why)
    keep = np.ones(len(y), dtype=bool)
    blind = _held_out(spark, data, y, keep, CAUTIOUS)
    if (y == 0).any():
        believed = (y == 1) & (blind > best_threshold(blind, y))
        clean = (y == 0) & (blind < np.median(blind[believed]))
        keep = believed | (clean if clean.any() else y == 0)
    checked = _held_out(spark, data, y, keep, KEEN)
    threshold = best_threshold(checked[keep], y[keep])
    targets = {"any": y, **{k: (y == 1) & (rows[f"v_{k}"].to_numpy() >= 0.5) for k in kinds if by_kind}}
    none = np.zeros(0, dtype=np.int64)
    jobs = [{"train": np.flatnonzero(keep), "score": none, "y": np.asarray(t).astype(int), "settings": KEEN} for t in targets.values()]
    got = dict(zip(targets, _parallel(spark, data, jobs), strict=True))
    return Model({k: g["at"] for k, g in got.items()}, {k: g["w"] for k, g in got.items()}, {k: g["bias"] for k, g in got.items()}, threshold)


def score_documents(documents: DataFrame, model: Model, *, row_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, score, flagged, <kind>, reason): every document with its score and the probability of each kind.

    score is the highest window's log-odds of any kind, over the whole text; flagged says whether it exceeds the model's
    threshold. A null text, or one without words, scores the bias alone and is not flagged. Repeated rows are scored each.
    Where the labels made no model, scores and kinds are null, nothing is flagged and reason says why; else reason is null.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kinds = [k for k in model.index if k != "any"]
    narrow = documents.select(F.col(row_id).cast("long").alias("__id"), F.col(text).alias("__text"), *[F.col(c) for c in keep])
    if model.reason:
        none = F.lit(None).cast("double")
        return narrow.select(F.col("__id").alias("doc_id"), *keep, none.alias("score"), F.lit(False).alias("flagged"), *[none.alias(k) for k in kinds], F.lit(model.reason).alias("reason"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hasher = sent.value, Hasher()
        names = ["any", *kinds]
        weights, bias = m.dense(names), np.array([m.bias[k] for k in names])
        for batch in batches:
            top = np.tile(bias, (len(batch), 1))
            some = np.zeros(len(batch), dtype=bool)
            for r, body in enumerate(batch["__text"]):
                f = features(hasher(body))
                if f.shape[1]:
                    some[r] = True
                    top[r] = window_scores(f, weights, bias).max(axis=0)
            yield pd.DataFrame(
                {"doc_id": batch["__id"], **{c: batch[c] for c in keep}, "score": top[:, 0], "flagged": some & (top[:, 0] > m.threshold), **{k: 1.0 / (1.0 + np.exp(-top[:, i + 1])) for i, k in enumerate(kinds)}}
            )

    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = ["doc_id long", *(f"`{k}` {types[k]}" for k in keep), "score double", "flagged boolean", *(f"`{k}` double" for k in kinds)]
    return narrow.mapInPandas(score, ", ".join(schema)).withColumn("reason", F.lit(None).cast("string"))


def rates_by(scored: DataFrame, group: str) -> DataFrame:
    """Per group (null included): documents, flagged ones and their share."""
    flagged = F.count_if("flagged")
    return scored.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), flagged.alias("flagged"), (flagged / F.count(F.lit(1))).alias("rate"))
