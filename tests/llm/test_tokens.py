"""Token operators against the tokenizer library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rvpanel.llm import rans, token_counts, transducer
from rvpanel.llm import words as W
from tests.llm.data import ODD, documents, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    plain = [" ".join(prose(rng, rng.randint(1, 80))).capitalize() + "." for _ in range(40)]
    return [*ODD, *plain, plain[0], " ".join(prose(rng, 30_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts, ids=[None, *range(1, len(texts))])


def library(path, text):
    return W.tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_transducer_matches_library(spark, docs, texts):
    lexicon = transducer.build_lexicon(docs, WORD, size=200)
    got = transducer.encode_decode(docs, WORD, lexicon, outputs=True).collect()
    want = []
    for i, t in zip([None, *range(1, len(texts))], texts, strict=True):
        ids = library(WORD, t)
        shown = W.tokenizer(WORD).decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), shown)]
        want.append((i, len(ids), *sha, ids, shown))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_lexicon_and_tables(spark, docs):
    assert transducer.Lexicon(transducer.compile_lexicon([])).rank([b"a", b""]).tolist() == [-1, -1]
    none = docs.limit(0)
    assert transducer.encode_decode(none, WORD, transducer.build_lexicon(none, WORD)).count() == 0
    assert token_counts.count_tokens(none, BYTE).count() == 0
    assert rans.read(spark, rans.write(none, WORD, 2)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=4), max_size=40), st.lists(st.binary(max_size=7), max_size=30))
def test_automaton(entries, others):
    lexicon = transducer.Lexicon(transducer.compile_lexicon(entries.items()))
    words = [*entries, *others]
    for word, rank in zip(words, lexicon.rank(words).tolist(), strict=True):
        assert (rank >= 0) == (word in entries)
        if rank >= 0:
            assert lexicon.output(rank) == entries[word]


def test_automaton_shares_suffixes():
    words = [a + b"ation" for a in (b"n", b"st", b"rel", b"gr")]
    shared = transducer.Lexicon(transducer.compile_lexicon((w, [1]) for w in words))
    assert len(shared.keys) < sum(map(len, words)) - 2 * len(b"ation")


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 300), st.integers(0, 99))
def test_rans_round_trip(n, kinds, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint32) - np.uint32(1)
    table = rans.Table(np.bincount(rng.integers(0, kinds, 50), minlength=kinds))
    payload = rans.encode(ids, table, block=512)
    blocks = rans.decode(payload, table)
    assert np.array_equal(np.concatenate(blocks), ids)
    last = len(blocks) - 1
    assert np.array_equal(rans.decode(payload, table, [last])[0], blocks[last])


def test_rans_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 50
    table = rans.Table(np.bincount(ids))
    payload = bytearray(rans.encode(ids, table, block=512))
    payload[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(bytes(payload), table)


def test_rans_files(spark, docs, texts):
    path = rans.write(docs, WORD, end_id=2)
    got = [tuple(r) for r in rans.read(spark, path, outputs=True).collect()]
    start, want = 0, []
    for i, t in zip([None, *range(1, len(texts))], texts, strict=True):
        ids = [*library(WORD, t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_rans_repeated_ids(spark):
    docs = documents(spark, ["b b", "a", "a", "c"], ids=[3, 3, 3, 1])
    got = sorted(tuple(r)[:3] for r in rans.read(spark, rans.write(docs, WORD, 2)).collect())
    assert got == [(1, 0, 2), (3, 2, 2), (3, 4, 2), (3, 6, 3)]


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_token_counts(spark, docs, texts, head):
    got = token_counts.count_tokens(docs, BYTE, limit=60, head=head).collect()
    want = []
    for i, t in zip([None, *range(1, len(texts))], texts, strict=True):
        n = len(library(BYTE, t))
        want.append((i, len((t or "").encode()), n, n > 60))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab'sé.,1  \x1c", max_size=30))
def test_parts_of_texts(text):
    split = token_counts._Splitter(BYTE)
    first, rest = token_counts.parts(text.encode())
    pieces = split(first.decode()) + [p for w in rest for p in split(" " + w.decode())]
    assert "".join(pieces) == text
    assert sum(len(library(BYTE, p)) for p in pieces) == len(library(BYTE, text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAZéÉßİ.,'<|> 1́ſK", max_size=20))
def test_direct_words(text):
    raw = W.folded(WORD, text.encode()).split()
    memo, learn = rans._encoder(WORD, "<u2")
    learn([raw])
    got = [i for w in raw for i in np.frombuffer(memo[w], "<u2").tolist()]
    assert got == library(WORD, text)
    assert [i for ids in W.plain_ids(WORD, raw) for i in ids] == got


def test_words_with_a_run_of_marks_are_learned_from_their_parts(monkeypatch):
    """Letters and the marks behind them are asked for once each, with the library's ids; other words go to it whole."""
    asked = []
    real = W.library_ids
    monkeypatch.setattr(W, "library_ids", lambda path, words: asked.extend(words) or real(path, words))
    memo, learn = rans._encoder(WORD, "<u2")
    memo.clear()
    words = [w.encode() for w in ("zebra&&&", "quux.$$$", "\u00e9t\u00e9!!", "quux...", "it's", "a'", "b<|", "(517)", "x2!!")] + ["e\u0301&&".encode()]
    learn([words])
    for w in words:
        assert memo[w] == np.array(real(WORD, [w])[0], "<u2").tobytes()
    assert not set(words[:4]) & set(asked) and set(words[4:-1]) <= set(asked)


def test_runs_of_marks_are_split_off_without_the_library():
    """Pre-tokens equal the library's; letters with marks behind them do not need it."""
    known, split = W.tokenizer(BYTE), token_counts._Splitter(BYTE)
    asked = []
    real = split.split
    split.split = lambda text: asked.append(text) or real(text)
    words = ["zebra&&&", "quux.$$$", "\u00e9t\u00e9!!", "a.\nb\nc!", "it's", "a'", "b<|", "(517)", "x2!!", "e\u0301&&", "...", "'s", "a\tb", "a\n\nb", "a\n", "a.\n'b"]
    for lead in ("", " "):
        for w in words:
            want = [(lead + w)[a:b].encode() for _, (a, b) in known.pre_tokenizer.pre_tokenize_str(lead + w)]
            assert split.encoded(lead.encode(), w.encode()) == want
    assert not {lead + w for w in words[:4] for lead in ("", " ")} & set(asked)
    for text in ("a b", "a  b", "a \nb", "a\n b", "a\nb", "a\t b", "a\u00a0b", "\u00e9 b", " a", "a\x1fb"):
        assert token_counts._odd(text.encode()) == (text not in ("a b", "a\nb", "\u00e9 b"))


def test_new_words_are_encoded_when_they_are_looked_up():
    memo = rans._encoder(WORD, "<u2")[0]
    memo.clear()
    words = [w.encode() for w in ("zebra", "quux...", "x2!!", "\u00e9t\u00e9", "(517)", "Zebra")]
    got = b"".join(map(memo.__getitem__, words))
    assert np.frombuffer(got, "<u2").tolist() == [i for w in words for i in library(WORD, w.decode())]
    assert memo.held > 0


def test_transducer_takes_marks_apart(monkeypatch):
    """Words the lexicon lacks cost the library what their letters and marks cost, whatever their case."""
    asked = []
    real = W.library_ids
    monkeypatch.setattr(W, "library_ids", lambda path, words: asked.extend(words) or real(path, words))
    coder = transducer._Coder(transducer.compile_lexicon([(b"zebra", library(WORD, "zebra"))]), WORD)
    texts = ["Zebra zebra&&& QUUX&&& \u00e9t\u00e9&&&", "zebra", None, ""]
    lists = coder.words([t and t.encode() for t in texts])
    coder.learn(lists)
    assert [coder.encode(ws) for ws in lists] == [library(WORD, t or "") for t in texts]
    assert set(asked) <= {b"&&&"}
