"""Exact encoding of words with a public tokenizer, one library call per distinct word.

The word tokenizer drops white space and never lets a token cross it, so the ids of a text
are those of its runs without ASCII white space, one after another.  (Other white space
stays inside a run and is left to the library.)  Each worker process keeps a bounded memo of
runs it has seen; the library is asked once per distinct run.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import filterfalse

import numpy as np

#: Bytes of words and outputs a memo may hold before it starts anew.
MEMO_BYTES = 80 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def letters_alone(path: str) -> bool:
    """Whether lower-case composed letters reach the model unchanged and apart from all else:
    the tokenizer composes, folds white space, lower-cases, and splits runs of letters.  What is neither letter,
    digit nor white space is then a run of its own, too."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    steps = (known.get("normalizer") or {}).get("normalizers", [])
    parts = (known.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = parts[0].get("pattern", {}).get("Regex", "") if parts else ""
    byte_level = len(parts) == 2 and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and r"|[\p{L}]+|" in split and split.endswith(r"|[^\s\p{L}\p{N}]+") and byte_level


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Characters by which byte-level models name bytes: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def folded(path: str, text: bytes) -> bytes:
    """A-Z in lower case where the tokenizer does so too and no special token is in the text."""
    return text.lower() if letters_alone(path) and b"<|" not in text else text


def _plain(word: bytes) -> str:
    """A word of lower-case letters as the model takes it; empty if the word is anything else."""
    # isalpha and islower of bytes are those of ASCII.
    if word.isalpha():
        return word.decode() if word.islower() else ""
    if word.isascii():
        return ""
    t = word.decode("utf-8", "replace")
    if not (t.isalpha() and t.lower() == t and unicodedata.is_normalized("NFC", t)):
        return ""
    names = _byte_letters()
    return "".join([names[b] for b in word])


def plain_ids(path: str, words: list[bytes]) -> list[list[int]]:
    """As :func:`library_ids`; words of lower-case letters go to the library's model directly."""
    if not letters_alone(path):
        return library_ids(path, words)
    model, out, rest = tokenizer(path).model.tokenize, [], []
    for w in words:
        t = _plain(w)
        if t:
            out.append([x.id for x in model(t)])
        else:
            rest.append(len(out))
            out.append([])
    for i, ids in zip(rest, library_ids(path, [words[i] for i in rest]), strict=True):
        out[i] = ids
    return out


def library_ids(path: str, words: list[bytes]) -> list[list[int]]:
    """Ids of each word by the library, in batches."""
    known, out = tokenizer(path), []
    for i in range(0, len(words), 4096):
        texts = [w.decode("utf-8", "replace") for w in words[i : i + 4096]]
        out += [e.ids for e in known.encode_batch_fast(texts, add_special_tokens=False)]
    return out


_held: dict[str, tuple] = {}


def claim(owner: str, *caches) -> None:
    """Tasks call this before they use their operator's caches: what other operators left in the
    process is dropped, so that a worker holds the memos of one operator at a time."""
    if owner not in _held:
        for other in list(_held):
            for cache in _held.pop(other):
                cache.clear()
        _held[owner] = caches


class Memo(dict):
    """A dict of what words map to, cleared when it has taken more than its share."""

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.most, self.held = most, 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def room(self) -> None:
        """Called between slices, when nothing refers to the entries."""
        if self.held > self.most:
            self.clear()

    def put(self, word: bytes, value, size: int) -> None:
        self[word] = value
        self.held += size + 160

    def put_all(self, words: list[bytes], values: list[bytes]) -> None:
        self.update(zip(words, values, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, values)) + 160 * len(words)


#: ASCII marks that stand in one run behind letters; an apostrophe may begin an ending, and "<|" a special token.
_MARKS = b'!"#$%&()*+,-./:;=>?@[\\]^_`{}~'


def _letters(word: bytes) -> bool:
    """Whether the word is letters only, also once composed and in lower case (which may split marks off)."""
    if word.isascii():
        return word.isalpha()
    return unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower().isalpha()


def id_type(vocabulary: int) -> str:
    """The narrowest of numpy's types for the ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class IdMemo(Memo):
    """Words to the bytes of their ids.  A word that is looked up and lacks is encoded then, so that every word of a
    text is looked up once."""

    def __init__(self, path: str, dtype: str, most: int = MEMO_BYTES):
        super().__init__(most)
        self.path, self.dtype, self.apart = path, dtype, letters_alone(path)
        self.kind = ("H" if dtype == "<u2" else "I") if sys.byteorder == "little" else ""
        self.model = tokenizer(path).model.tokenize

    def bytes_of(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes() if self.kind else np.array(ids, self.dtype).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = self._coded(word)
        self.held += len(word) + len(value) + 160
        return value

    def _coded(self, word: bytes) -> bytes:
        if self.apart:
            t = _plain(word)
            if t:
                return self.bytes_of([x.id for x in self.model(t)])
            # Letters with marks behind are the letters' ids and those of the run of marks.
            head = word.rstrip(_MARKS)
            if len(head) < len(word) and _letters(head):
                return self[head] + self[word[len(head) :]]
        return self.bytes_of(library_ids(self.path, [word])[0])


def missing(memo: dict, lists: list[list[bytes]]) -> list[bytes]:
    """Distinct words of the lists that the memo lacks."""
    fresh: set[bytes] = set()
    for words in lists:
        fresh.update(words)
    return list(filterfalse(memo.__contains__, fresh))
