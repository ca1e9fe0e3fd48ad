import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldwarden.llm import alignment, queries
from fieldwarden.llm.wordbpe import byte_letters
from fieldwarden.session import table
from tests.conftest import SF

V = alignment.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
A = Tokenizer.from_str(V.a)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=V.b)
LETTERS = {c: b for b, c in byte_letters().items()}


def tokens(text):
    """Ids and bytes of both sides by the libraries over whole texts."""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    pieces = [B.id_to_piece(i) for i in b]
    raw = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
        return [], [], [], []
    return a, b, np.cumsum([len(x) for x in raw[0]]).tolist(), np.cumsum([len(x) for x in raw[1]]).tolist()


def brute(texts):
    links, rows = [], []
    for text in texts:
        a, b, ends_a, ends_b = tokens(text or "")
        spans = lambda ends: list(zip([0, *ends], ends))
        own, j = [], 0
        for i, (x, y) in enumerate(spans(ends_a)):
            own += [(a[i], b[j]) for j, (p, q) in enumerate(spans(ends_b)) if p < y and x < q]
        common = sorted(set(ends_a) & set(ends_b))
        groups, last = [], 0
        for end in common:
            groups.append("|".join(",".join(str(k) for k, e in zip(ids, ends) if last < e <= end) for ids, ends in ((a, ends_a), (b, ends_b))))
            last = end
        links.append(own)
        rows.append([len(a), len(b), len(common), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    counts = collections.Counter(x for own in links for x in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(*r[:4], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), r[4]) for r, own in zip(rows, links)], counts, best


def test_ids_as_the_libraries():
    coder, draw = alignment.Coder(V, limit=300), random.Random(2)
    parts = [*"aaab eöüñ\n\t 12!?é中😀▁\x00\x1c\x85", "the ", "ing", "       ", "====", "<|endoftext|>", "<s>", "<0x41>", " 's", "\U00016ea0", "՘"]
    texts = ["", " ", "  ", "x ", " x", "a  b", "\n", "the ▁ x", "é" * 900, "ab" * 2000] + ["".join(draw.choices(parts, k=draw.randint(0, 50))) for _ in range(1200)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 0x3000), draw.randrange(0x3000, 0xD800), draw.randrange(0xE000, 0x20000)])) for _ in range(30)) for _ in range(300)]
    for k in range(0, len(texts), 100):
        for text, a, b in zip(texts[k : k + 100], *coder.encode(texts[k : k + 100])):
            assert (np.frombuffer(a, "<i4").tolist(), np.frombuffer(b, "<i4").tolist()) == tokens(text)[:2], text


@pytest.mark.parametrize("small", [False, True])
def test_rows_as_by_loops(spark, small, monkeypatch):
    draw = random.Random(9)
    words = ["the", "naïve", "<|endoftext|>", "Überraschung", "中文", "a\tb", "12.5", "once  more", "\n", "ing"]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 30))) for _ in range(60)] + [None, "", "the ▁ x", " ", "the", "the"]
    if small:  # many chunks, stripes of two ids, several runs and splits
        for name, value in {"CHARACTERS": 300, "PART": 100, "DOCS": 3, "BLOCK": 16 * 50257}.items():
            monkeypatch.setattr(alignment, name, value)
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, stripe int").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in alignment.align(frame, V, **({"counted": 5, "scored": 4} if small else {})).collect()}
    plain, counts, best = brute(texts)
    assert len(found) == len(texts)
    for k in found:
        assert found[k] == plain[k], texts[k]
    pairs = alignment.pair_counts(frame, V).collect()
    assert {(r.a_id, r.b_id): r.links for r in pairs} == counts
    assert all(r.best == (r.links == best[r.b_id]) for r in pairs)


def test_edges(spark):
    rows = [("x", "Hello"), (None, "Hello"), ("x", "Hello"), ("y", None)]
    found = alignment.align(spark.createDataFrame(rows, "doc_id string, text string"), V).collect()
    plain = brute([t for _, t in rows])[0]
    assert sorted(map(str, ((r.doc_id, *tuple(r)[1:]) for r in found))) == sorted(str((i, *p)) for (i, _), p in zip(rows, plain))
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(nothing, V).count() == 0 and alignment.pair_counts(nothing, V).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align(blank, V).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query(spark):
    docs = [r for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    short = [r for r in docs if len(r.text or "") < 3000]
    found = {r.doc_id: r for r in queries.op13_tokenizer_alignment(spark, SF).collect()}
    assert len(found) == len(docs)
    for r in short:
        a, b, ends_a, ends_b = tokens(r.text or "")
        assert (found[r.doc_id].n_a, found[r.doc_id].n_b, found[r.doc_id].n_groups) == (len(a), len(b), len(set(ends_a) & set(ends_b)))
