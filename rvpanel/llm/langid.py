"""Language of texts: averaged hashed subword embeddings with a linear softmax.

A word is its lower-cased letters between marks; its subwords are the byte n-grams of the marked
word.  Subwords hash into ``BUCKETS`` embedding rows, a text is the mean of its rows, and a
linear softmax gives the language.  Training is stochastic gradient descent in numpy on
segments of a bounded sample of labelled documents.  Because averaging and the linear layer commute,
a text is scored by summing one logit vector per word, worked out once per distinct word.

A part of the sample calibrates: a temperature scales the logits, and the threshold under which a
prediction is rejected leaves all but ``REJECT_GOOD`` of the rightly labelled segments.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected.  Without any
labelled row every text is ``und``.  Equal scores go to the first language in sorted
order.  Repeated rows get equal results; texts are scored whole.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.samples import held_out, sample_by_label
from rvpanel.llm.tasks import on_executors, sent, text_slices

BUCKETS = 1 << 15
DIM = 12
NGRAMS = (1, 2, 3, 4, 5)
#: Bounds of the training sample: documents per language, segments of a document, words of a segment.
DOCS_PER_LANGUAGE = 1500
SEGMENTS = 3
SEGMENT_WORDS = 48
REJECT_GOOD = 0.001
#: Distinct words a worker keeps logits for.
MEMO_WORDS = 400_000

_KEEP = bytearray(range(256))
for _b in range(128):
    _KEEP[_b] = ord(chr(_b).lower()) if chr(_b).isalpha() else 32
_KEEP = bytes(_KEEP)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs without ASCII characters other than letters."""
    if not text:
        return []
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_KEEP).split()


def has_letter(words: list[bytes]) -> bool:
    return any(any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in words)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the words, and the number of subwords of each word."""
    n = len(words)
    marked = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, n)
    ends = np.repeat(np.cumsum(lengths), lengths)
    place, owner = np.arange(len(marked)), np.repeat(np.arange(n), lengths)
    buckets, owners = [], []
    rolled = np.zeros(len(marked), np.uint32)
    for k in NGRAMS:
        shifted = marked[k - 1 :]
        rolled = rolled[: len(shifted)] * np.uint32(0x01000193) + shifted + np.uint32(k)
        inside = place[: len(rolled)] + k <= ends[: len(rolled)]
        mixed = rolled[inside]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1)
        buckets.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
        owners.append(owner[: len(rolled)][inside])
    bucket, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order].astype(np.int64), np.bincount(own, minlength=n)


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _segments(docs: DataFrame, label: str, text: str, key: str) -> list[tuple[str, int, list[bytes]]]:
    """(label, hash, words) of segments spread over the whole of each sampled document."""
    on_executors(docs.sparkSession)

    def run(batches):
        for batch in batches:
            labels, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for start, texts in text_slices(batch):
                for i, t in enumerate(texts, start):
                    words = words_of(t)
                    seed = int.from_bytes(hashlib.blake2b(str(keys[i]).encode(), digest_size=8).digest(), "little")
                    rng = np.random.default_rng(seed)
                    for _ in range(SEGMENTS if words else 0):
                        size = int(rng.integers(1, SEGMENT_WORDS + 1))
                        at = int(rng.integers(0, max(1, len(words) - size + 1)))
                        out.append((labels[i], seed, words[at : at + size]))
            yield pa.record_batch(
                {
                    "label": pa.array([x for x, _, _ in out], pa.string()),
                    "seed": pa.array([s >> 1 for _, s, _ in out], pa.int64()),
                    "words": pa.array([w for _, _, w in out], pa.list_(pa.binary())),
                }
            )

    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).cast("string").alias("key"))
    found = rows.mapInArrow(run, "label string, seed long, words array<binary>").toArrow()
    # Equal words are one object: the driver holds the distinct words, and references.
    known: dict[bytes, bytes] = {}
    out = []
    for batch in found.to_batches(max_chunksize=1024):
        for name, seed, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append((name, seed, [known.setdefault(w, w) for w in words]))
    return sorted(out)


def _bags(segments: list[list[bytes]]) -> list[np.ndarray]:
    """The buckets of all subwords of each segment, in 16 bits each: a few tens of MB for the largest sample."""
    distinct = {w: i for i, w in enumerate(sorted({w for ws in segments for w in ws}))}
    words, found, sizes = list(distinct), [], []
    for at in range(0, len(words), 4096):
        bucket, per_word = subwords(words[at : at + 4096])
        found.append(bucket.astype(np.uint16))
        sizes.append(per_word)
    bucket = np.concatenate(found)
    start = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).tolist()
    return [np.concatenate([bucket[start[i] : start[i + 1]] for i in map(distinct.__getitem__, ws)]) for ws in segments]


def fit(segments: list[tuple[str, int, list[bytes]]], steps: int = 500, rate: float = 2.0, seed: int = 7) -> Model | None:
    """Train on segments, for ``steps`` batches of 64 and twice through them all at least; a fifth of the
    documents (by their hash) calibrates."""
    if not segments:
        return None
    labels = sorted({s[0] for s in segments})
    target = np.array([labels.index(s[0]) for s in segments])
    bags = _bags([ws for _, _, ws in segments])
    calib = np.array([s[1] % 5 == 0 for s in segments])
    if calib.all() or not calib.any():
        calib = np.zeros(len(segments), bool)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    train = np.flatnonzero(~calib)
    batches = len(train) // 64 + 1
    epochs, step = max(2, -(-steps // batches)), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), batches):
            if not len(part):
                continue
            now = rate * (1 - step / (epochs * batches))
            step += 1
            sizes = np.array([len(bags[i]) for i in part])
            ids = np.concatenate([bags[i] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            mean = np.add.reduceat(table[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            p /= len(part)
            back = (p @ out.T) / sizes[:, None]
            order = np.argsort(ids, kind="stable")
            rows, first = np.unique(ids[order], return_index=True)
            # Rows occur in few of the texts, so the embedding step is larger than that of the layer.
            table[rows] -= 50 * now * np.add.reduceat(back[owner[order]], first)
            out -= now * mean.T @ p
            bias -= now * p.sum(axis=0)
    model = Model(labels, table @ out, bias, 1.0, 0.0)
    held = np.flatnonzero(calib) if calib.any() else train
    sums = np.stack([model.logits[bags[i]].sum(axis=0) for i in held])
    counts = np.array([len(bags[i]) for i in held])
    fits = []
    for t in np.exp(np.linspace(-3, 2, 41)):
        model.temperature = float(t)
        p = model.scores(sums, counts)
        fits.append((-float(np.log(p[np.arange(len(held)), target[held]] + 1e-12).mean()), float(t)))
    model.temperature = min(fits)[1]
    p = model.scores(sums, counts)
    good = p.max(axis=1)[p.argmax(axis=1) == target[held]]
    model.threshold = float(min(0.5, np.quantile(good, REJECT_GOOD))) if len(good) else 0.0
    return model


def train(
    docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE
) -> Model | None:
    """Model from labelled documents (null labels are left out)."""
    rows = docs.select(key, F.col(label).alias(label), F.col(text).alias(text)).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    return fit(_segments(sample_by_label(rows, label, per_language, key), label, text, key))


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.rows = np.zeros((1024, len(model.labels) + 1), np.float32)

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
            self.rows = np.concatenate([self.rows, np.zeros((2 * n, self.rows.shape[1]), np.float32)])
        bucket, per_word = subwords(fresh)
        starts = np.concatenate([[0], np.cumsum(per_word)[:-1]])
        self.rows[first:n, :-1] = np.add.reduceat(self.model.logits[bucket], starts)
        self.rows[first:n, -1] = per_word
        self.index.update(zip(fresh, range(first, n), strict=True))

    def __call__(self, lists):
        """Sums of logits and numbers of subwords of texts that have words."""
        sizes = [len(ws) for ws in lists]
        ids = np.fromiter((i for ws in lists for i in map(self.index.__getitem__, ws)), np.int64, sum(sizes))
        sums = np.add.reduceat(self.rows[ids].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
        return sums[:, :-1], sums[:, -1]


_scorers: dict[str, _Scorer] = {}


def _scorer(mark: str, model: Model) -> _Scorer:
    """The process's scorer.  Tasks reach it through this function, so that they share the module's state."""
    W.claim("langid", _scorers)
    if mark not in _scorers:
        _scorers.clear()
        _scorers[mark] = _Scorer(model)
    return _scorers[mark]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` and the columns of ``keep`` as they are."""
    spark = docs.sparkSession
    on_executors(spark)
    raw = pickle.dumps(model)
    shipped, mark = sent(spark, raw), hashlib.sha256(raw).hexdigest()
    keep = [c for c in keep or [] if c != id_col]

    def run(batches):
        fitted = pickle.loads(shipped.value)
        scorer = None if fitted is None else _scorer(mark, fitted)
        for batch in batches:
            pred, score, rejected = [], [], []
            for _, texts in text_slices(batch):
                lists = [words_of(t) for t in texts]
                known = [i for i, ws in enumerate(lists) if scorer and has_letter(ws)]
                p_all, s_all, r_all = ["und"] * len(lists), [0.0] * len(lists), [True] * len(lists)
                if known:
                    scorer.learn([lists[i] for i in known])
                    p = fitted.scores(*scorer([lists[i] for i in known]))
                    for i, best, top in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                        p_all[i], s_all[i], r_all[i] = fitted.labels[best], top, top < fitted.threshold
                pred, score, rejected = pred + p_all, score + s_all, rejected + r_all
            columns = {f"k{i}": batch.column(i + 1) for i in range(len(keep) + 1)}
            columns |= {"lang_pred": pa.array(pred), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.record_batch(columns)

    given = docs.select(F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate([id_col, *keep])])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    found = given.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate([id_col, *keep])], "lang_pred", "score", "rejected")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Train on documents outside the held-out class and predict all of them."""
    marked = held_out("doc_id", modulus, remainder)
    model = train(docs.where(~marked))
    return predict(docs, model).withColumn("held_out", marked)
