"""Quality classification by co-training of a text view and a metadata view.

The text view sees the whole text: its runs of GRAM bytes, hashed into GRAM_CELLS cells of
signed counts, and shape statistics.  The metadata view sees only the document's
source, language and recorded length.  Both start from the labelled rows; in
each round either view labels the rows of an unlabelled pool it is surest of, and those
join the other view's training set.  Each view is then calibrated (Platt) on held-out
labelled rows that never trained it, and the calibrated log-odds are combined: evidence
of the views adds up over the prior.

Fitting reads a bounded sample: at most LABELLED labelled rows and POOL unlabelled ones,
those with the smallest hash of their id.  Of rows that repeat an id the one with the
smallest hash of its text fits.  Scoring covers all documents.

Defined results.  Null text is empty and has neutral statistics.  Very long texts are
read whole.  Null ids, repeated rows and null metadata are scored like all others;
metadata columns that are missing count as null.  Labels with null ids or quality are
ignored, contradicting ones are averaged.  Without labels of both classes nothing can be
learned: scores are null and every document is kept.  An empty table gives an empty
table.  Extra columns are kept, but for the output's names, which are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slabs
from .common import released, ship, tidy
from .probminhash import U

LABELLED, POOL = 20_000, 20_000
#: Rounds, half the pseudo-labels that a view gives in a round, and the confidence they need.
ROUNDS, GIVEN, SURE = 4, 500, 0.97
#: Documents whose combined probability of being good is below this are rejected.
KEEP = 0.5
HASHED = 32
#: Bytes of a gram, and cells of the hashed grams of a text.
GRAM, GRAM_CELLS = 6, 128
OUT = ("text_score", "meta_score", "score", "kept")

PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _CLASS[_b] = 1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 or _b >= 128 else 3 if 48 <= _b <= 57 else 4 if _b in b".,;:'" else 5 if _b in PUNCTUATION else 6 if _b == 10 else 0


#: Number of shape statistics.
SHAPE = 28


def shape_features(text: str | None) -> list[float]:
    """Shape statistics: character classes, repetition, lengths of words, lines and sentences."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_CLASS[raw], minlength=7) / n
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    top = max(counts.values(), default=0) / m
    odd = sum(1 for w in words if not w[-1:].isalnum() and w[-1:] not in ".,;:?!\"')") / m
    shout = sum(1 for w in words if len(w) > 1 and w.isupper()) / m
    bang = text.count("!!") / m
    bar = text.count("|") / m
    lines = text.split("\n")
    repeated = 1 - len(set(lines)) / len(lines)
    sentences = max(1, text.count(".") + text.count("!") + text.count("?"))
    parts = [share[1], share[3], share[5], share[6], again, top if m > 20 else 0.0, 1 - len(counts) / m, odd, shout, bang, bar, repeated]
    return [*parts, *(np.sqrt(parts)).tolist(), np.log1p(m), np.log1p(m / sentences), len(text) / m / 10, float(m < 20)]


def gram_features(text: str | None) -> np.ndarray:
    """Signed counts of hashed runs of GRAM bytes, damped, and scaled to unit length."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    code = np.zeros(n, np.uint64)
    for j in range(GRAM):
        code |= raw[j : j + n] << U(8 * j)
    code *= U(0x9E3779B97F4A7C15)
    sign = 1.0 - 2.0 * (code >> U(63)).astype(float)
    x = np.bincount(((code >> U(40)) % U(GRAM_CELLS)).astype(np.int64), sign, GRAM_CELLS)
    x = np.sign(x) * np.log1p(np.abs(x))
    return x / max(1e-9, float(np.sqrt(x @ x)))


def text_features(text: str | None) -> list[float]:
    return [*shape_features(text), *gram_features(text).tolist()]


def text_view(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SHAPE + GRAM_CELLS), np.float32)
    for i, t in enumerate(texts):
        out[i, :SHAPE], out[i, SHAPE:] = shape_features(t), gram_features(t)
    return out


def meta_features(source, lang, n_chars) -> list[float]:
    """Hashed source and language, and the recorded length."""
    out = [0.0] * (2 * HASHED)
    for at, value in ((0, source), (HASHED, lang)):
        out[at + zlib.crc32(str(value).encode()) % HASHED] = 1.0
    size = float(n_chars) if n_chars is not None and n_chars == n_chars else -1.0
    return [*out, np.log1p(max(size, 0.0)), float(size < 0), float(0 <= size < 100), float(size > 20_000)]


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return text + meta - self.prior


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and intercept by Newton steps; the intercept is not penalised."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T @ x
        step = np.linalg.solve(curve.astype(float) + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def train_view(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    x = x - mean
    x /= scale
    return View(mean, scale, logistic(np.clip(x, -8, 8, out=x), y, ridge))


def calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling on held-out rows, with targets drawn in by one row of either class."""
    good, bad = float(y.sum()), float((1 - y).sum())
    if good and bad:
        w = logistic(view.raw(x)[:, None], np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2)), 1e-3)
        view.a, view.b = max(0.0, float(w[0])), float(w[1])
    return view


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, fold: np.ndarray) -> Model:
    """Co-training rounds, then calibration on the rows with `fold` set."""
    views, pools = (text, meta), (pool_text, pool_meta)
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # pseudo-labels that each view received
    free = np.ones(len(pool_text), bool)

    def fit(v: int) -> View:
        x = np.concatenate([views[v][~fold], *(pools[v][at] for at, _ in given[v])])
        return train_view(x, np.concatenate([y[~fold], *(label for _, label in given[v])]))

    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    for _ in range(ROUNDS):
        fresh = []
        for v in (0, 1):
            view = calibrated(fit(v), views[v][fold], y[fold])
            p = 1 / (1 + np.exp(-np.clip(view.log_odds(pools[v]), -30, 30)))
            found = [np.flatnonzero(free & (sure >= SURE)) for sure in (1 - p, p)]
            share = [1 - rate, rate]  # classes are given in their labelled proportion
            n = min(2 * GIVEN, *(len(found[c]) / share[c] for c in (0, 1)))
            for c, sure in ((0, 1 - p), (1, p)):
                at = found[c][np.argsort(-sure[found[c]], kind="stable")[: round(n * share[c])]]
                fresh.append((1 - v, at, np.full(len(at), float(c))))
        for to, at, label in fresh:
            given[to].append((at, label))
            free[at] = False
    done = [calibrated(fit(v), views[v][fold], y[fold]) for v in (0, 1)]
    return Model(done[0], done[1], float(np.log(rate / (1 - rate))))


def _columns(df: DataFrame, text: str) -> list[Column]:
    have = {c: F.col(c) for c in ("source", "lang", "n_chars") if c in df.columns}
    null = F.lit(None)
    return [F.col(text).cast("string"), have.get("source", null).cast("string"), have.get("lang", null).cast("string"), have.get("n_chars", null).cast("double")]


def _features(batches):
    """doc_id, the text's features as bytes, and the raw metadata."""
    for batch in batches:
        at = 0
        for slab in slabs(batch.column(1)):
            x = text_view(slab)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(slab)), pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(i).slice(at, len(slab)) for i in (2, 3, 4))], names=["doc_id", "x", "s", "g", "n"])
            at += len(slab)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """Model from bounded samples; None where labels do not hold both classes."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    drawn = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).filter("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(LABELLED)
    told: dict[int, list[float]] = {}
    for r in drawn.collect():
        told.setdefault(r.doc_id, []).append(r.quality)
    pool = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(POOL).collect()
    wanted = set(told) | {r.doc_id for r in pool}
    ids = F.broadcast(spark.createDataFrame([(i,) for i in sorted(wanted)], "__wanted long"))  # LABELLED + POOL rows at most
    t, s, g, n = _columns(docs, text)
    row = F.struct(F.xxhash64(t).alias("h"), t.alias("t"), s.alias("s"), g.alias("g"), n.alias("n"))
    drawn = docs.select(F.col(id_col).cast("long").alias("__wanted"), row.alias("r")).join(ids, "__wanted", "left_semi").groupBy("__wanted").agg(F.min("r").alias("r"))
    rows = drawn.select("__wanted", "r.t", "r.s", "r.g", "r.n").mapInArrow(tidy(_features), "doc_id long, x binary, s string, g string, n double").collect()
    rows.sort(key=lambda r: r.doc_id)
    own = [r for r in rows if r.doc_id in told]
    rest = [r for r in rows if r.doc_id not in told]
    y = np.array([float(np.mean(told[r.doc_id]) >= 0.5) for r in own])
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 0 for r in own], bool)
    if any(len(set(part.tolist())) < 2 for part in (y, y[~fold] if len(y) else y)):
        return None
    texts = lambda part: np.frombuffer(b"".join([r.x for r in part]), np.float32).reshape(len(part), -1)
    metas = lambda part: np.array([meta_features(r.s, r.g, r.n) for r in part]).reshape(len(part), -1)
    shape = lambda part, like: part if part.size else np.zeros((0, like.shape[1]), like.dtype)
    t, m = texts(own), metas(own)
    return cotrain(t, m, y, shape(texts(rest) if rest else t[:0], t), shape(metas(rest), m), fold)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """`docs` with the views' and the combined probability of being good, and `kept`."""
    docs = docs.drop(*(c for c in OUT if c != text))
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"text_score": none, "meta_score": none, "score": none, "kept": F.lit(True)})
    ship(docs.sparkSession)

    @F.arrow_udf("struct<text_score:double,meta_score:double,score:double>")
    def judged(t: pa.Array, s: pa.Array, g: pa.Array, n: pa.Array) -> pa.Array:
        a = np.concatenate([np.zeros(0), *(model.text.log_odds(text_view(slab)) for slab in slabs(t))])
        b = model.meta.log_odds(np.array([meta_features(*x) for x in zip(s.to_pylist(), g.to_pylist(), n.to_pylist())]).reshape(len(t), -1)) if len(t) else a
        released()
        p = lambda z: pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
        return pa.StructArray.from_arrays([p(a), p(b), p(model.combined(a, b))], names=list(OUT[:3]))

    out = docs.withColumn("__judged", judged(*_columns(docs, text)))
    return out.withColumns({c: F.col(f"__judged.{c}") for c in OUT[:3]}).withColumn("kept", F.col("score") >= keep).drop("__judged")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Result of the registered query: the scores of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", *OUT)
