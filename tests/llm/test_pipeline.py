import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from fieldwarden.llm import bpe, mixing, pii, simhash, toxicity
from fieldwarden.session import with_checkpoint_dir
from tests.llm.test_similar import brute_roots

SF, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, predicted string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_toxic_rows_go_and_columns_stay(spark):
    model = toxicity.Model(np.sort(toxicity.features(["bad"])[0]), np.array([9.0], np.float32), -4.0)
    docs = spark.createDataFrame([(1, "bad", "en", "s", 3, "p"), (2, "good", None, None, 4, "p"), (3, None, "en", "s", 0, "p"), (3, None, "en", "s", 0, "p")], SCHEMA)
    assert rows(toxicity.keep(docs, model)) == rows(docs.where("doc_id > 1"))


def test_one_of_each_group_stays(spark):
    docs = [(5, "one two three four five", "en", "b", 1, ""), (3, "one two three four five", "de", "a", 1, ""), (3, "one two three four five", "de", "a", 1, ""), (9, "something else altogether here", "en", "a", 1, "")]
    docs += [(None, "a text without an id", "en", "a", 1, "")] * 2 + [(11, None, "en", "a", 0, ""), (10, "", "en", "a", 0, "")]
    kept = rows(simhash.keep_one(spark.createDataFrame(docs, SCHEMA)))
    assert kept == sorted([docs[1], docs[3], docs[4], docs[7]], key=str)


def test_copies_follow_the_mix(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 40), None, f"s{k % 4}", 0, "x") for k in range(800)] + [(900, None, None, "s0", 0, "x")], SCHEMA)
    got = mixing.copies(docs)
    assert got.columns == docs.columns and rows(got) == rows(mixing.copies(docs.repartition(3)))
    taken = {}
    for r in got.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    want = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] for s in want)
    assert got.where("doc_id = 900").count() == 1


def plain(spark):
    """The pipeline by loops; the model and the mix are the operators' own, which have tests of theirs."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").where(P.fold(3) != 1).selectExpr("doc_id", "toxic as label")
    score = toxicity.scorer(toxicity.train(docs, labels))
    kept = [r for r in docs.collect() if score([r.text or ""])[0] < toxicity.THRESHOLD]
    label = brute_roots([r.text for r in kept])
    least = {}
    for r, root in sorted(zip(kept, label, strict=True), key=lambda x: x[0].doc_id):
        least.setdefault(root, r)
    names = pii.Pseudonyms(P.PII_KEY)
    mixed = [(r.doc_id, names.replace(r.text)[0], r.lang, r.source, r.n_chars) for r in least.values()]
    frame = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string, n_chars long")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(P.RANKS)), special_tokens={})
    return sorted((r.doc_id, tuple(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixing.copies(frame).collect())


def test_run_as_by_loops(spark):
    """On the tables that have labels enough for each stage to act."""
    got = [(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in P.run(spark, BIG).collect()]
    assert len(got) > 500 and sorted(got) == plain(spark)


@pytest.mark.parametrize("sf", [SF, BIG])
def test_every_stage_has_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    with_checkpoint_dir(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf).checkpoint()
        sizes.append(docs.count())
    assert 0.7 * sizes[0] < sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and min(sizes) > 0.4 * sizes[0]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_no_python_in_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", mixing.copies(docs)._jdf.queryExecution().toString())


def test_stages_keep_clashing_columns_and_ids_of_text(spark, tmp_path):
    names = ["_id", "_null", "_text", "_row", "a.b", "row", "key", "score", "label", "size", "taken"]
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("doc_id", "text", "lang", "source", "n_chars", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    docs = documents.selectExpr("concat('d', doc_id) as doc_id", *(f"`{c}`" for c in documents.columns[1:]))
    want = {tuple(r[2:]) for r in docs.collect()}
    for name, stage in P.STAGES[1:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert got.count() and {tuple(r[2:]) for r in got.collect()} <= want, name
    assert P.STAGES[0][1](spark, documents, SF).columns == documents.columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == 60
