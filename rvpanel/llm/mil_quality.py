"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  A passage is encoded from the mean of
hashed embeddings of its words and of their shapes (case, digits, punctuation) and from a few
measures (share of distinct and of repeated words, word length), by a layer with tanh.  Gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and the weighted sum is scored by a
logistic layer.  Only document labels are known; the weights are learned from them in numpy (Adam),
on a bounded sample of labelled documents and of their passages.

Every passage of every document is encoded and scored.  Words are worked out once per distinct
word and process; passages are sums over vectors of their words.

Edge cases: a null or empty text (or one of white space) is one empty passage and gets the score of
it; documents without a label are scored alike; without any label of both kinds all scores are
the share of label 1 (0.5 without labels).  Repeated rows get equal scores.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.samples import held_out, sample_by_label
from rvpanel.llm.tasks import on_executors, sent, text_slices

PASSAGE_WORDS = 48
WORD_BUCKETS = 1 << 12
SHAPE_BUCKETS = 1 << 9
DIM, HIDDEN, GATE = 12, 16, 8
MEASURES = 4
#: Bounds of the training sample: labelled documents per label, passages of one document.
DOCS_PER_LABEL = 2500
PASSAGES = 24
MEMO_WORDS = 400_000

_LETTERS = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _LETTERS[_b] = ord("A") if _c.isupper() else ord("a") if _c.islower() else ord("9") if _c.isdigit() else _b
for _b in range(128, 256):
    _LETTERS[_b] = ord("a")
_LETTERS = bytes(_LETTERS)
_RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Word with characters replaced by their kind and runs of one kind shortened."""
    return _RUN.sub(rb"\1", word.translate(_LETTERS))[:12]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its shape, scaled length."""
    n = len(words)
    a = np.fromiter((xxhash.xxh32_intdigest(w.lower()) % WORD_BUCKETS for w in words), np.int64, n)
    b = np.fromiter((xxhash.xxh32_intdigest(shape(w)) % SHAPE_BUCKETS for w in words), np.int64, n)
    return a, b + WORD_BUCKETS, np.fromiter((min(len(w), 40) / 10 for w in words), np.float32, n)


def passages(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each passage (at least one passage a document), and document of each passage."""
    counts, owner = [], []
    for i, ws in enumerate(lists):
        full, rest = divmod(len(ws), PASSAGE_WORDS)
        sizes = [PASSAGE_WORDS] * full + ([rest] if rest or not full else [])
        counts += sizes
        owner += [i] * len(sizes)
    return np.array(counts, np.int64), np.array(owner, np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over runs of ``counts`` rows; empty runs give 0."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    on = np.flatnonzero(counts)
    if len(on):
        out[on] = np.add.reduceat(values, (np.cumsum(counts) - counts)[on])
    return out


def measures(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Share of distinct words, of words like the one before, mean length and fill of each passage."""
    owner = np.repeat(np.arange(len(counts)), counts)
    distinct = np.zeros(len(counts))
    if len(ids):
        keys = np.unique(owner * (int(ids.max()) + 1) + ids)
        distinct = np.bincount(keys // (int(ids.max()) + 1), minlength=len(counts))
    again = np.zeros(len(counts))
    if len(ids) > 1:
        same = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=len(counts))
    n = np.maximum(counts, 1)
    return np.stack([distinct / n, again / n, _sums(lengths, counts) / n, counts / PASSAGE_WORDS], axis=1).astype(np.float32)


def _softmax_by(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, x)
    e = np.exp(x - top[owner])
    return e / np.bincount(owner, e, n)[owner]


class Model:
    """Parameters: ``emb`` (word and shape rows), encoder, gated attention, output."""

    def __init__(self, seed: int = 5, share: float = 0.5):
        rng = np.random.default_rng(seed)
        near = lambda *size: rng.normal(0, 1 / np.sqrt(size[0]), size)
        self.share, self.trained = share, False
        self.p = {
            "emb": rng.normal(0, 0.1, (WORD_BUCKETS + SHAPE_BUCKETS, DIM)),
            "enc": near(DIM + MEASURES, HIDDEN), "enc_b": np.zeros(HIDDEN),
            "v": near(HIDDEN, GATE), "u": near(HIDDEN, GATE), "w": near(GATE, 1),
            "out": near(HIDDEN, 1), "out_b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
        p = self.p
        h = np.tanh(x @ p["enc"] + p["enc_b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = _softmax_by(owner, ((t * g) @ p["w"])[:, 0], n)
        z = np.zeros((n, HIDDEN))
        np.add.at(z, owner, a[:, None] * h)
        logit = np.clip((z @ p["out"] + p["out_b"])[:, 0], -30, 30)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "prob": 1 / (1 + np.exp(-logit))}

    def backward(self, x: np.ndarray, owner: np.ndarray, f: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the layers, and of the passage vectors ``x``."""
        p, grad = self.p, {}
        grad["out"], grad["out_b"] = f["z"].T @ dlogit[:, None], dlogit.sum(keepdims=True)
        dz = dlogit[:, None] @ p["out"].T
        da = (dz[owner] * f["h"]).sum(axis=1)
        dh = f["a"][:, None] * dz[owner]
        mean = np.bincount(owner, f["a"] * da, len(dlogit))
        ds = f["a"] * (da - mean[owner])
        tg = f["t"] * f["g"]
        grad["w"] = tg.T @ ds[:, None]
        dtg = ds[:, None] @ p["w"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
        dpre = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        grad["enc"], grad["enc_b"] = x.T @ dpre, dpre.sum(axis=0)
        return grad, dpre @ p["enc"].T


def fit(bags: list[tuple[int, list[list[bytes]]]], epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 5) -> Model:
    """Train on (label, passages as lists of words)."""
    labels = np.array([b[0] for b in bags], float)
    model = Model(seed, float(labels.mean()) if len(bags) else 0.5)
    if len(set(labels.tolist())) < 2:
        return model
    model.trained = True
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ps in bags for ws in ps for w in ws}))}
    word, form, length = word_features(list(vocabulary))
    made = []
    for _, ps in bags:
        counts = np.array([len(ws) for ws in ps], np.int64)
        ids = np.fromiter((vocabulary[w] for ws in ps for w in ws), np.int64, int(counts.sum()))
        made.append((ids, counts, measures(ids, length[ids], counts)))
    # Documents of the rarer label count as much in all as those of the other, then the bias is set back.
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * (len(bags) // batch + 1)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), len(bags) // batch + 1):
            ids = np.concatenate([made[i][0] for i in part])
            counts = np.concatenate([made[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(made[i][1]) for i in part])
            n = np.maximum(counts, 1)[:, None]
            emb = model.p["emb"]
            mean = _sums(emb[word[ids]] + emb[form[ids]], counts) / n
            x = np.concatenate([mean, np.concatenate([made[i][2] for i in part])], axis=1)
            f = model.forward(x, owner, len(part))
            grad, dx = model.backward(x, owner, f, (f["prob"] - labels[part]) * weight[part] / len(part))
            back = np.repeat(dx[:, :DIM] / n, counts, axis=0)
            rows = np.concatenate([word[ids], form[ids]])
            grad["emb"] = np.stack([np.bincount(rows, np.tile(back[:, d], 2), len(emb)) for d in range(DIM)], axis=1)
            step += 1
            now = rate * (1 - (step - 1) / total)
            for k, g in grad.items():
                g = g + 1e-5 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(rows: DataFrame) -> list[tuple[int, list[list[bytes]]]]:
    """Sampled passages of the sampled documents, in the order of a hash of their ids."""
    on_executors(rows.sparkSession)

    def run(batches):
        for batch in batches:
            keys, labels, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for start, texts in text_slices(batch):
                for i, t in enumerate(texts, start):
                    words = t.split() if t else []
                    cut = [words[j : j + PASSAGE_WORDS] for j in range(0, len(words), PASSAGE_WORDS)] or [[]]
                    seed = int.from_bytes(hashlib.blake2b(str(keys[i]).encode(), digest_size=8).digest(), "little")
                    if len(cut) > PASSAGES:
                        cut = [cut[j] for j in sorted(np.random.default_rng(seed).choice(len(cut), PASSAGES, replace=False))]
                    out.append((seed >> 1, labels[i], cut))
            yield pa.record_batch(
                {
                    "seed": pa.array([s for s, _, _ in out], pa.int64()),
                    "label": pa.array([y for _, y, _ in out], pa.int32()),
                    "passages": pa.array([c for _, _, c in out], pa.list_(pa.list_(pa.binary()))),
                }
            )

    found = rows.mapInArrow(run, "seed long, label int, passages array<array<binary>>").collect()
    ordered = sorted(found, key=lambda r: (r["seed"], r["label"]))
    return [(r["label"], [[bytes(w) for w in ws] for ws in r["passages"]]) for r in ordered]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", per_label: int = DOCS_PER_LABEL) -> Model:
    """Model from the documents that ``labels`` marks 0 or 1.

    The sample is drawn from the narrow label table first, so only the sampled texts are read further.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    picked = sample_by_label(marks, "label", per_label, "id").dropDuplicates(["id"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(picked, "id").select("text", F.col("id").cast("string"), "label")
    return fit(_bags(rows))


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.rows = np.zeros((1024, DIM + 1))

    def learn(self, lists):
        if len(self.index) > MEMO_WORDS:
            self.index.clear()
        fresh = set()
        for ws in lists:
            fresh.update(ws)
        fresh = [w for w in fresh if w not in self.index]
        if not fresh:
            return
        first, n = len(self.index), len(self.index) + len(fresh)
        if n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((2 * n, DIM + 1))])
        word, form, length = word_features(fresh)
        emb = self.model.p["emb"]
        self.rows[first:n, :DIM] = emb[word] + emb[form]
        self.rows[first:n, DIM] = length
        self.index.update(zip(fresh, range(first, n), strict=True))

    def __call__(self, lists) -> np.ndarray:
        if not self.model.trained:
            return np.full(len(lists), self.model.share)
        self.learn(lists)
        counts, owner = passages(lists)
        ids = np.fromiter((i for ws in lists for i in map(self.index.__getitem__, ws)), np.int64, int(counts.sum()))
        mean = _sums(self.rows[ids, :DIM], counts) / np.maximum(counts, 1)[:, None]
        x = np.concatenate([mean, measures(ids, self.rows[ids, DIM], counts)], axis=1)
        return self.model.forward(x, owner, len(lists))["prob"]


_scorers: dict[str, _Scorer] = {}


def _scorer(mark: str, shipped) -> _Scorer:
    """The process's scorer.  Tasks reach it through this function, so that they share the module's state."""
    W.claim("mil_quality", _scorers)
    if mark not in _scorers:
        _scorers.clear()
        _scorers[mark] = _Scorer(pickle.loads(shipped.value))
    return _scorers[mark]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    on_executors(docs.sparkSession)
    raw = pickle.dumps(model)
    shipped, mark = sent(docs.sparkSession, raw), hashlib.sha256(raw).hexdigest()

    def run(batches):
        scorer = _scorer(mark, shipped)
        for batch in batches:
            found = [np.zeros(0)]
            for _, texts in text_slices(batch):
                found.append(scorer([t.split() if t else [] for t in texts]))
            p = np.concatenate(found)
            yield pa.record_batch({"id": batch.column(0), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def rate_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """Train on labels outside the held-out class and score every document."""
    marked = held_out("doc_id", modulus, remainder)
    return score(docs, train(docs, labels.where(~marked))).withColumn("held_out", marked)
