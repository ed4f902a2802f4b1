"""Quality, toxicity and language: exact counts against brute force, constraints, and accuracy on held-out rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from frames import DOCS, awkward_docs, prose

from leafgrain.llm import language, quality, toxicity
from leafgrain.llm.trees import fit_isotonic, fit_trees, sigmoid

ROOT = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").repartition(4), spark.read.parquet(f"{ROOT}/labels.parquet")


def test_counts_are_exact(spark, real):
    docs, rows = awkward_docs(spark)
    model = fit_trees(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    out = quality.score_quality(docs, model).toPandas()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, out[names].values.tolist())) == sorted(brute_counts(t) for _, t in rows)
    assert out.base_failed.tolist() == [n < 20 or 100 * r > 30 * n for n, r in zip(out.n_words, out.n_repeat_words)]
    assert not (out.kept & out.base_failed).any()
    some = real[0].where("doc_id % 25 = 3").select("doc_id", "text")
    counted = quality.score_quality(some, model).toPandas().set_index("doc_id")
    for r in some.collect():
        assert tuple(counted.loc[r.doc_id, names]) == brute_counts(r.text)


def test_quality_agrees_with_held_out_labels(real):
    docs, labels = real
    out = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2 and not base_failed").toPandas()
    assert (out.kept == (out.quality == 1)).mean() > 0.98
    kept = quality.keep_good(docs, quality.fit_quality(docs, labels))
    assert kept.columns == docs.columns


def test_monotone_trees_and_isotonic():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(8 * x[:, 1]) + 0.2 * r.standard_normal(3000) > 0.7).astype(float)
    model = fit_trees(x, y, {0: 1}, trees=40)
    assert ((model.margin(x) > 0) == (y > 0.5)).mean() > 0.85
    for row in x[:20]:
        line = np.tile(row, (50, 1))
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(model.margin(line)) >= -1e-9).all()
    slow = [model.base + sum(walk(model, t, row) for t in range(len(model.feature))) for row in x[:50]]
    assert np.allclose(model.margin(x[:50]), slow)
    knots, values = fit_isotonic(sigmoid(model.margin(x)), y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and 0 <= values.min() <= values.max() <= 1


def walk(model, tree, row):
    at = 0
    while at < model.feature.shape[1]:
        at = 2 * at + 1 + (row[model.feature[tree, at]] > model.threshold[tree, at])
    return model.leaf[tree, at - model.feature.shape[1]]


def test_toxicity_on_held_out_labels(real):
    docs, labels = real
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0) & (out.score <= 1)).all() and (out.predicted == (out.score >= 0.3)).all()
    toxic = out.toxic == 1
    assert out.predicted[toxic].mean() > 0.85 and out.predicted[~toxic].mean() < 0.02
    pure = toxicity.keep_clean(docs, model)
    assert pure.columns == docs.columns and pure.count() < docs.count()


def test_disguised_words_are_spelled_back():
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64), toxicity.spelled(toxicity.SEED), toxicity.spelled(toxicity.SECOND_PERSON))
    x = toxicity.features(pa.array(["you 1d10t, really", "an idiot there", "IDIOT!!! you", "a clean 10th line", None]), lexicon)
    f = dict(zip(toxicity.FEATURES, x.T))
    assert f["any_hit"].tolist() == [1, 1, 1, 0, 0] and f["disguised_density"][0] > 0 and f["near_second_person"].tolist()[:3] == [1 / 3, 0, 1 / 2]


def test_language_on_held_out_rows(real):
    docs, _ = real
    out = language.predict_language(docs, language.learn_dictionaries(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.985 and out.score.between(0, 1).all()
    assert (out[~out.rejected].lang_pred == out[~out.rejected].lang).mean() > 0.985


def test_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    known = language.Dictionaries({"aa": b"abc def " * 50, "bb": b"word und " * 50})
    out = language.predict_language(docs, known).toPandas()
    letters = [bool(regex.search(r"\p{L}", t or "")) for _, t in rows]
    unlettered = spark.createDataFrame([(1, "²½"), (2, "١٢ ½_"), (3, "Ⅷ 12"), (4, "\u0301 \u0300"), (5, "🙂 !")], "doc_id int, text string")
    assert {r.lang_pred for r in language.predict_language(unlettered, known).collect()} == {"und"}
    assert (out.lang_pred == "und").sum() == letters.count(False) and set(out.lang_pred) <= {"aa", "bb", "und"}
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).where("score = 0 and predicted = 0").count() == len(rows)
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).count() == len(rows)
    for frame in (language.predict_language(none, language.learn_dictionaries(none)), toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)),
                  quality.score_quality(none, quality.fit_quality(none, labels)), quality.keep_good(none, quality.fit_quality(none, labels))):
        assert frame.count() == 0
    assert language.predict_language(docs, language.learn_dictionaries(docs)).where("lang_pred <> 'und'").count() == 0
    bad = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, None), (9, 1, 1), (9, 0, 1)], LABELS)
    assert toxicity.fit_toxicity(docs, bad) and quality.fit_quality(docs, bad)


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, prose(i, 30), "l" + str(i % 2), None, None) for i in range(60)], DOCS)
    import zlib

    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2}
    changed = docs.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, held))}), 'nothing else', text) as text", "lang", "source", "n_chars")
    assert language.learn_dictionaries(docs).content == language.learn_dictionaries(changed).content


def test_any_punctuation_is_stripped_and_long_disguises_are_spelled_back():
    import numpy as np
    import pyarrow as pa

    from leafgrain.llm import toxicity as tox

    none = np.array([], np.uint64)
    lexicon = tox.Lexicon(tox.spelled(["incomprehensible"]), none, tox.spelled(["idiot"]), tox.spelled(["you"]))
    texts = ["idiot!!!!!", "(((((((idiot", "?" * 1001 + "idiot" + "!" * 1000, "i-n-c-o-m-p-r-e-h-e-n-s-i-b-l-e", "id.i0t.id", "!!!!!", "", "----- a"]
    x = tox.features(pa.array(texts), lexicon)
    seed, disguised = (x[:, tox.FEATURES.index(n)] > 0 for n in ("seed_density", "disguised_density"))
    assert seed.tolist() == [True, True, True, False, False, False, False, False]
    assert disguised.tolist() == [False, False, False, True, False, False, False, False]
    assert tox.Tokens(pa.array(["!!!!!!!!!!!!"])).length.tolist() == [1]
