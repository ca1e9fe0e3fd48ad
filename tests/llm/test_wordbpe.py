import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldwarden.llm import queries, wordbpe
from fieldwarden.session import table
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return wordbpe.Encoder(wordbpe.load(PATH))


def same(coder, text, library=LIBRARY):
    (got,), (decoded,) = coder.encode([text])
    ids = library.encode(text, add_special_tokens=False).ids
    assert got == " ".join(map(str, ids)), text
    assert decoded == library.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "The Quick brown FOX's 123 jumps", "it'LL we've I'm 'tis", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|start<|startoftext|>oftext|>", "é é ﬁ ΣΊΣΥΦΟΣ Σ", "İstanbul ǅ ẞ",
     "中文字符 тест 😀😀", "a" * 5000, "ab" * 3000, "=-" * 2000, "\x00\x1c\x85 x", "՘a\U00010d50b\U00016ea0", "x" + "é" * 4001],
)
def test_as_the_library(coder, text):
    same(coder, text)


def test_as_the_library_on_random_texts(coder):
    draw = random.Random(5)
    parts = [*"aaab eöüñ\n\t 12!?é中😀\x1c\x85'Σ́", "the ", "ing", "aaaaaaa", "      ", "====", "<|endoftext|>", "'s", "'LL", "\U00016ea0"]
    for _ in range(1500):
        same(coder, "".join(draw.choices(parts, k=draw.randint(0, 60))))
    for _ in range(400):
        same(coder, "".join(chr(draw.choice([draw.randrange(32, 0x3000), draw.randrange(0x3000, 0xD800), draw.randrange(0xE000, 0x20000)])) for _ in range(30)))


@pytest.mark.parametrize("seed", range(12))
def test_merges_that_go_back_to_lower_ranks(seed, coder):
    """Random merges over few letters: a merge's result often takes part in one of a lower rank, and tokens are made in several ways."""
    draw = random.Random(seed)
    spec = json.loads(wordbpe.load(PATH))
    letters = wordbpe.byte_letters().values()
    vocab, merges = [*letters, *(x + "</w>" for x in letters)], []
    for _ in range(40):
        a, b = (draw.choice(["a", "b", "c", *(x for x in vocab[512:] if "<" not in x)]) for _ in "12")
        b += draw.choice(["", "</w>"]) if b + "</w>" in vocab else ""
        if (a, b) not in merges and b in vocab:
            merges.append((a, b))
            vocab += [a + b] if a + b not in vocab else []
    draw.shuffle(merges)
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(vocab)}, "merges": [list(m) for m in merges]}
    for k, x in enumerate(spec["added_tokens"]):
        x["id"] = len(vocab) + k
    text = json.dumps(spec)
    own, library = wordbpe.Encoder(text), Tokenizer.from_str(text)
    for _ in range(150):
        same(own, "".join(draw.choices("aaabbc ", k=draw.randint(1, 40))), library)


def test_small_cache_changes_nothing(coder):
    small = wordbpe.Encoder(wordbpe.load(PATH), limit=3)
    for t in ("one two three four five", "six seven <|endoftext|> eight", "one two"):
        assert small.encode([t]) == coder.encode([t])


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError)):
        wordbpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_rows(spark):
    docs = spark.createDataFrame([(1, "abc Def", "x"), (2, None, "y"), (3, "", "z"), (1, "abc Def", "x"), (None, "<|endoftext|>", "")], "doc_id long, text string, n_tokens string")
    rows = wordbpe.tokens(docs, wordbpe.load(PATH), with_ids=True).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: "abc Def", None: "<|endoftext|>"}.get(r.doc_id, "")
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert wordbpe.tokens(docs.limit(0), wordbpe.load(PATH)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    found = queries.op12_word_bpe(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
