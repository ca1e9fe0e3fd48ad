import numpy as np
from pyspark.sql import functions as F

from fieldwarden.llm import langid as L
from fieldwarden.llm import queries


def brute(scores, switch):
    """Viterbi of one text by plain loops; the value of the best labelling."""
    best = list(scores[0])
    for row in scores[1:]:
        best = [max(best[k] if k == j else best[k] - switch for k in range(len(best))) + row[j] for j in range(len(row))]
    return max(best)


def value(scores, label, switch):
    return sum(scores[i][label[i]] for i in range(len(label))) - switch * sum(a != b for a, b in zip(label[:-1], label[1:], strict=True))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(8)
    lengths = [1, 7, 2, 2, 30, 1, 13]
    scores = rng.normal(0, 3, (sum(lengths), 3))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    label = L.viterbi(scores, doc, 2.0)
    for d in range(len(lengths)):
        own = doc == d
        assert abs(value(scores[own], label[own], 2.0) - brute(scores[own].tolist(), 2.0)) < 1e-9


def test_blocks_of_a_long_text():
    rng = np.random.default_rng(9)
    for n, m in ((1000, 3), (129, 5), (128, 2), (77, 4)):
        scores = rng.normal(0, 2, (n, m))
        label = L.viterbi(scores, np.zeros(n, np.int64), 3.0, long=20, block=16)
        assert abs(value(scores, label, 3.0) - brute(scores.tolist(), 3.0)) < 1e-9


def test_a_very_long_text(spark):
    model = L.train(spark.createDataFrame([(i * 3 + k, t, lang) for i in range(20) for k, (lang, t) in enumerate(sorted(TEXTS.items()))], "doc_id long, text string, lang string"))
    text = (TEXTS["en"] + " ") * 12_000 + (TEXTS["de"] + " ") * 8_000
    row = L.identify(spark.createDataFrame([(9007199254740993, text), (None, "собака")], "doc_id long, text string"), model, with_spans=True).where("doc_id is not null").first()
    assert (row.doc_id, row.lang_pred) == (9007199254740993, "en") and [s.lang for s in row.spans] == ["en", "de"]


TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the weather was nice with all these things there",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann war das wetter schön mit allen dingen",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом была хорошая погода со всеми вещами",
}


def test_spans_scripts_and_edge_cases(spark):
    rows = [(i * 3 + k, t, lang, 1.0) for i in range(20) for k, (lang, t) in enumerate(sorted(TEXTS.items()))]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"))
    assert model.names == ["de", "en", "ru"]
    mixed = TEXTS["en"] + ". " + TEXTS["ru"] + ". " + TEXTS["de"]
    asked = [(1, mixed), (2, None), (3, ""), (4, "123 !?"), (5, "собака"), (6, TEXTS["de"]), (6, TEXTS["de"])]
    got = L.identify(spark.createDataFrame(asked, "doc_id long, text string"), model, with_spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert [(s.lang, mixed[s.start : s.end]) for s in by[1].spans] == [("en", TEXTS["en"]), ("ru", TEXTS["ru"]), ("de", TEXTS["de"])]
    assert [(by[k].lang_pred, by[k].score) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert by[5].lang_pred == "ru" and by[6].lang_pred == "de" and by[6].score == 1.0
    assert len(got) == 7


def test_the_most_frequent_languages_are_learned(spark):
    """However many values lang has, the table is as large as the bound allows; of equally frequent values the first by code point count."""
    often = [(None, f"{TEXTS[lang]} {k}", lang) for lang in ("de", "en") for k in range(5)]
    rare = [(None, f"word{k} only", f"x{k:03}") for k in range(300)]
    docs = spark.createDataFrame(often + rare, "doc_id long, text string, lang string")
    assert L.train(docs, languages=4).names == ["de", "en", "x000", "x001"]
    model = L.train(docs, per_language=10**9, languages=20)
    assert model.grams.dtype == np.float32 and model.grams.shape == (1 << L.BITS, 20)
    assert L.identify(spark.createDataFrame([(1, TEXTS["de"])], "doc_id long, text string"), model).first().lang_pred == "de"


def test_scores_by_plain_counting(spark):
    """Languages and scores of all documents against counts, log-likelihoods and labellings that loops make."""
    docs = [(k, " ".join(TEXTS[lang].split()[k % 7 :] + TEXTS[other].split()[: k % 5 * 2]) + "!" * (k % 3), None if k % 4 == 0 else lang) for k, (lang, other) in enumerate([(a, b) for a in TEXTS for b in TEXTS] * 3)]
    docs += [(90, None, "en"), (91, "", "de"), (92, "12 3", "de"), (93, "x", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = L.train(frame)

    def words(text):
        out, word = [], ""
        for c in (text or "") + " ":
            if c.isalpha():
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    def grams(word):
        low = f"\0{word.lower()}\0"
        return [int(L.mix(np.array([ord(low[i]) << 42 | ord(low[i + 1]) << 21 | ord(low[i + 2])], np.uint64))[0]) >> 64 - L.BITS for i in range(len(word))]

    counts, scripts = {}, {}
    for _, text, lang in docs:
        if lang and text is not None:
            c, s = counts.setdefault(lang, {}), scripts.setdefault(lang, {"Latin": 0, "Cyrillic": 0})
            for w in words(text):
                s["Latin" if ord(w[0]) < 0x250 else "Cyrillic"] += len(w)
                for g in grams(w):
                    c[g] = c.get(g, 0) + 1
    names = sorted(counts)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame, model).collect()}
    for doc_id, text, _ in docs:
        found = words(text)
        if not found:
            assert got[doc_id] == ("und", 0.0)
            continue
        scores = []
        for w in found:
            script = "Latin" if ord(w[0]) < 0x250 else "Cyrillic"
            row = [sum(np.log((counts[a].get(g, 0) + 0.05) / (sum(counts[a].values()) + 0.05 * (1 << L.BITS))) for g in grams(w)) for a in names]
            scores.append([x - L.FOREIGN * (scripts[a][script] < 0.01 * sum(scripts[a].values())) for x, a in zip(row, names, strict=True)])
        best, ways = scores[0], []
        for row in scores[1:]:
            came = [max(range(len(names)), key=lambda k: (best[k] - L.SWITCH * (k != j), k == j)) for j in range(len(names))]
            best, ways = [best[came[j]] - L.SWITCH * (came[j] != j) + row[j] for j in range(len(names))], [*ways, came]
        label = [max(range(len(names)), key=best.__getitem__)]
        for came in reversed(ways):
            label.append(came[label[-1]])
        letters = [sum(len(w) for w, k in zip(found, reversed(label), strict=True) if k == j) for j in range(len(names))]
        top = max(range(len(names)), key=letters.__getitem__)
        assert got[doc_id][0] == names[top] and abs(got[doc_id][1] - letters[top] / sum(letters)) < 1e-12


def test_nothing_to_learn(spark):
    model = L.train(spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert L.identify(docs, model).first().lang_pred == "und"
    assert L.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language_id(spark, sf).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
