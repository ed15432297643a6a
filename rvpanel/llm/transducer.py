"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Words (runs without ASCII white space) are counted over all documents.  The most frequent
ones are compiled into an automaton whose equal suffixes are shared.  Its arcs carry numbers;
their sum along a word is the word's place in the table of id sequences, so that every
word has its own output although suffixes are shared.  Workers map the compiled bytes into
memory and look up all new words of a slice together; words it lacks are merged exactly
by the tokenizer library, and each worker keeps what it has seen in a bounded memo.

Edge cases: a null or empty text, or one of white space only, has no ids: ``n_tokens`` 0 and
the digests of the empty string.  Repeated rows give repeated results; an empty table gives
none; a null ``doc_id`` stays null.  Texts are encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.tasks import most_frequent, on_executors, sent, text_slices
from rvpanel.sources.store import materialize

#: Words in the automaton: bounds what the driver compiles and broadcasts (a few MB).
LEXICON_WORDS = 1 << 16
#: Longer words are not put into the lexicon.
LONGEST = 48
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000

_MAGIC = b"MATL0001"


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def key(self):
        return (self.final, tuple((b, id(s)) for b, s in self.arcs.items()))


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Bytes of the automaton for distinct (word, ids); empty words are left out."""
    ranked = sorted((w, ids) for w, ids in entries if w)
    root, register, path = _State(), {}, []
    previous = b""

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            kept = register.setdefault(child.key(), child)
            parent.arcs[byte] = kept

    for word, _ in ranked:
        shared = len(os.path.commonprefix([word, previous]))
        settle(shared)
        state = path[-1][2] if path else root
        for byte in word[shared:]:
            fresh = _State()
            state.arcs[byte] = fresh
            path.append((state, byte, fresh))
            state = fresh
        state.final = True
        previous = word
    settle(0)

    order, stack = [], [(root, False)]
    while stack:  # children before parents
        state, done = stack.pop()
        if done:
            state.words = state.final + sum(s.words for s in state.arcs.values())
            order.append(state)
        elif state.number == -1:
            state.number = -2
            stack.append((state, True))
            stack += [(s, False) for s in state.arcs.values() if s.number == -1]
    for i, state in enumerate(reversed(order)):  # the root is 0
        state.number = i
    keys, targets, outputs = [], [], []
    for state in reversed(order):
        before = int(state.final)
        for byte in sorted(state.arcs):
            target = state.arcs[byte]
            keys.append(state.number << 8 | byte)
            targets.append(target.number)
            outputs.append(before)
            before += target.words
    final = np.zeros(len(order), np.uint8)
    for state in order:
        final[state.number] = state.final
    starts = np.cumsum([0, *(len(ids) for _, ids in ranked)]).astype("<u4")
    ids = np.array([i for _, seq in ranked for i in seq], "<u4")
    longest = max((len(w) for w, _ in ranked), default=0)
    arrays = [np.array(keys, "<u8"), np.array(targets, "<u4"), np.array(outputs, "<u4"), starts, ids, final]
    head = _MAGIC + struct.pack("<7Q", longest, *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled automaton, mapped into memory from a file of this process."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:  # gone once mapped: nothing is left behind
            f.write(compiled)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if view[:8] != _MAGIC:
            raise ValueError("not a compiled lexicon")
        self.longest, *sizes = struct.unpack("<7Q", view[8:64])
        at, arrays = 64, []
        for n, kind in zip(sizes, ("<u8", "<u4", "<u4", "<u4", "<u4", "u1"), strict=True):
            arrays.append(np.frombuffer(view, kind, n, at))
            at += arrays[-1].nbytes
        self.keys, self.targets, self.outputs, self.starts, self.ids, self.final = arrays

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the output table, -1 where the automaton lacks it."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        out = np.full(n, -1, np.int64)
        alive = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        if not len(self.keys) or not len(alive):
            return out
        text = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state, total = np.zeros(len(alive), np.uint64), np.zeros(len(alive), np.int64)
        for step in range(int(self.longest)):
            ended = lengths[alive] == step
            if ended.any():
                good = ended & (self.final[state.astype(np.int64)] == 1)
                out[alive[good]] = total[good]
                alive, state, total = alive[~ended], state[~ended], total[~ended]
            if not len(alive):
                return out
            wanted = state << np.uint64(8) | text[offsets[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            alive, at, total = alive[found], at[found], total[found]
            total = total + self.outputs[at]
            state = self.targets[at].astype(np.uint64)
        good = self.final[state.astype(np.int64)] == 1
        out[alive[good]] = total[good]
        return out

    def output(self, rank: int) -> list[int]:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()


def word_counts(docs: DataFrame, text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(word, n) over all documents, words of one occurrence and long ones left out: neither
    can repay a place in the lexicon.  With a tokenizer, words are as :func:`encode_decode` looks them up."""

    on_executors(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.record_batch({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    if t:
                        held.update((W.folded(tokenizer_path, t) if tokenizer_path else t).split())
                if len(held) > FLUSH:
                    yield rows()
        if held:
            yield rows()

    each = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long")
    kept = each.where(F.length("word") <= LONGEST)
    return kept.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def build_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """Compiled automaton of the ``size`` most frequent words of the documents."""
    top = [bytes(r["word"]) for r in most_frequent(materialize(word_counts(docs, text, tokenizer_path)), "word", "n", size)]
    return compile_lexicon(zip(top, W.library_ids(tokenizer_path, top), strict=True))


class _Coder:
    """Per process: words to their ids, and ids to their decimals and their tokens."""

    def __init__(self, compiled: bytes, path: str):
        self.lexicon, self.path = Lexicon(compiled), path
        known = W.tokenizer(path)
        size = known.get_vocab_size(with_added_tokens=True)
        self.token = [known.id_to_token(i) for i in range(size)]
        self.number = [str(i) for i in range(size)]
        self.plain = known.decoder is None
        self.memo = W.IdMemo(path, W.id_type(size))

    def words(self, texts: list[bytes | None]) -> list[list[bytes]]:
        return [W.folded(self.path, t).split() if t else [] for t in texts]

    def learn(self, lists: list[list[bytes]]) -> None:
        """Takes the new words that the automaton holds from it; the memo has the library encode others when they are met."""
        self.memo.room()
        fresh = W.missing(self.memo, lists)
        ranks = self.lexicon.rank(fresh)
        held = np.flatnonzero(ranks >= 0).tolist()
        self.memo.put_all([fresh[i] for i in held], [self.memo.bytes_of(self.lexicon.output(r)) for r in ranks[held].tolist()])

    def encode(self, words: list[bytes]) -> list[int]:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), self.memo.dtype).tolist()


_coders: dict[tuple, _Coder] = {}


def _coder(mark: str, path: str, shipped) -> _Coder:
    """The process's coder.  Tasks reach it through this function, so that they share the module's state."""
    W.claim("transducer", _coders)
    if (mark, path) not in _coders:
        _coders.clear()
        _coders[mark, path] = _Coder(shipped.value, path)
    return _coders[mark, path]


def encode_decode(
    docs: DataFrame, tokenizer_path: str, lexicon: bytes, id_col: str = "doc_id", text: str = "text", outputs: bool = False
) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``outputs``
    also ``ids array<int>`` and ``decoded``.

    ``lexicon`` comes from :func:`build_lexicon`; any lexicon gives the same results.
    Tokenizers whose decoder is absent (tokens joined by a space) are supported.
    """
    on_executors(docs.sparkSession)
    shipped = sent(docs.sparkSession, lexicon)
    mark = hashlib.sha256(lexicon).hexdigest()

    def run(batches):
        coder = _coder(mark, tokenizer_path, shipped)
        if not coder.plain:
            raise ValueError("only tokenizers without a decoder join their tokens word by word")
        for batch in batches:
            counts, ids_hash, text_hash, ids_out, text_out = [], [], [], [], []
            for _, texts in text_slices(batch):
                lists = coder.words(texts)
                coder.learn(lists)
                for ws in lists:
                    ids = coder.encode(ws)
                    a, b = " ".join(map(coder.number.__getitem__, ids)), " ".join(map(coder.token.__getitem__, ids))
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(a.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(b.encode()).hexdigest())
                    if outputs:
                        ids_out.append(ids)
                        text_out.append(b)
            columns = {
                id_col: batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(ids_hash, pa.string()),
                "decoded_sha256": pa.array(text_hash, pa.string()),
            }
            if outputs:
                columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
            yield pa.record_batch(columns)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, schema + (", ids array<int>, decoded string" if outputs else ""))
