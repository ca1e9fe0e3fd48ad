import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from fieldwarden.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def same(coder, text):
    ids = coder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text), text
    assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a", "The quick brown fox's 123 jumps", "  \n\n  x ", "<|endoftext|>", "naïve über façade", "中文 тест 😀😀", "a" * 5000, "ab" * 3000, "=-" * 2000, " " * 999])
def test_as_the_library(coder, text):
    same(coder, text)


def test_as_the_library_on_random_texts(coder):
    random.seed(5)
    parts = [*"aaab eöüñ\n\t 12!?é中😀\x1c\x85 ", "the ", "ing", "aaaaaaa", "      ", "===="]
    for _ in range(1500):
        same(coder, "".join(random.choices(parts, k=random.randint(0, 60))))


def test_merges_that_enable_lower_ranks():
    """A vocabulary in which a merge's result has a pair of a lower rank: the replay must go back as the library does."""
    base = {bytes([b]): 1000 + b for b in range(256)}
    random.seed(11)
    for _ in range(60):
        extra = {bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(25)}
        ranks = base | {t: r for r, t in enumerate(random.sample(sorted(extra), len(extra)))}
        library = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        coder = bpe.Encoder(ranks, r"\S+|\s+")
        for _ in range(40):
            text = "".join(random.choices("abc", k=random.randint(1, 24)))
            assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text), (text, ranks)


def test_small_cache_changes_nothing(coder):
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN, cache=3)
    for t in ("one two three four five", "six seven eight", "one two"):
        assert small.encode([t]) == coder.encode([t])


def test_rows(spark):
    docs = spark.createDataFrame([(1, "abc def", "x"), (2, None, "y"), (3, "", "z"), (1, "abc def", "x")], "doc_id long, text string, n_tokens string")
    rows = bpe.tokens(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r.n_tokens for r in rows) == [0, 0, len(LIBRARY.encode_ordinary("abc def"))] + [len(LIBRARY.encode_ordinary("abc def"))]
    for r in rows:
        text = "abc def" if r.doc_id == 1 else ""
        assert list(r.ids) == LIBRARY.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == (hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() if text else empty)
    assert bpe.tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
