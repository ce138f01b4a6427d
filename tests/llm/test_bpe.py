import hashlib
import random
import struct

import pytest
from edge import docs, odd_rows, soup
from hypothesis import given, settings
from hypothesis import strategies as st

from lapse.llm import bpe
from lapse.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    v = bpe.load_vocabulary(PATH)
    words = sorted({w.encode() for w in [" the", "ing", " word", "s", " it", "'s", " ", ".", " of", " a", "é", " 12"]})
    return bpe.Codec(v, bpe.compile_lexicon((w, bpe.merge(w, v)) for w in words))


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want
    assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "word", "it's", ".", ",", "!", "1", "23", "é", "ß", "日本", "🙂", " ", "\x1c", "\x85", "'", "’",
         "²", "ª", "ǅ", "​", "<|endoftext|>", "A" * 70, "x y", "ſ", "Ⅷ", "́", "don't", " 's"]


def test_random_parts(codec, library):
    rnd = random.Random(5)
    for _ in range(3000):
        same(codec, library, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(codec, library, text):
    same(codec, library, text)


def test_long_pieces(codec, library):
    for t in ("ab" * 5000, " " * 3000, "=" * 4000, "ñ" * 2000, soup(1, 20_000)):
        same(codec, library, t)


def test_lexicon_is_minimal_and_exact():
    rnd = random.Random(2)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 7))) for _ in range(400)})
    block = bpe.compile_lexicon((w, [k, k + 1]) for k, w in enumerate(words))
    lexicon = bpe.Lexicon(block)
    for k, w in enumerate(words):
        assert lexicon.get(w) == [k, k + 1]
    for _ in range(1000):
        w = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 8)))
        assert (lexicon.get(w) is None) == (w not in set(words))
    prefixes = {w[:n] for w in words for n in range(len(w) + 1)}
    languages = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert struct.unpack_from("<I", block)[0] == len(languages)  # as many states as different rests


def test_empty_lexicon(library):
    v = bpe.load_vocabulary(PATH)
    same(bpe.Codec(v, bpe.compile_lexicon([])), library, "some words, and more")


def test_counts_and_round_trip(spark, library):
    rows = [(50, "the the <|endoftext|> the"), (51, " lead  two\n\n x "), *odd_rows()]
    df = docs(spark, rows, clash=True)
    got = bpe.digests(bpe.round_trip(df, PATH, 500)).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert bpe.digests(bpe.round_trip(docs(spark, []), PATH)).count() == 0
    counts = {r["piece"]: r["n"] for r in bpe.piece_counts(docs(spark, [(1, "a b a  b"), (2, "a b"), (3, None)])).collect()}
    assert counts == {"a": 2, " b": 3, " a": 1, " ": 1}
    n = bpe.frequent(bpe.piece_counts(df), 40)
    assert 0 < len(n) <= 40


def test_merge_looks_up_two_pairs_a_merge(library):
    """Pairs of bytes come from a table; each merge then asks for its two new neighbours, by small keys."""
    v, asked = bpe.load_vocabulary(PATH), []

    class Asked(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    v["ranks"] = [Asked(x) for x in v["ranks"]]
    for word in ("a", " the", " retention", " unforeseeable", " zxqv", "日本語"):
        asked.clear()
        ids = bpe.merge(word.encode(), v)
        assert ids == library.encode(word, add_special_tokens=False).ids
        assert len(asked) <= 2 * (len(word.encode()) - len(ids)) and all(k < len(v["ranks"]) for k in asked)


def test_a_small_memo_gives_the_same_ids(library):
    v = bpe.load_vocabulary(PATH)
    small = bpe.Codec(v, bpe.compile_lexicon([]), memo=40)
    for k in range(20):
        same(small, library, soup(k, 200) + " a.b-c 12 x7, y!")
        assert len(small._new) <= 40 and len(small._old) <= 40 and len(small._pieces) <= 10
