"""Scalar functions against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from leafgrain.functions import meta
from leafgrain.functions import text as tx
from leafgrain.operators import retrieval


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("v")).first()["v"]


TEXTS = ["", "  a\t b\n\nc ", "x  y\x1fz", "one two", " 　 ", "tab\tend\n", "a  b   c"]


def test_normalize_ws_and_tokens_match_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], ["t"]).select(
        "t", tx.normalize_ws(F.col("t")).alias("n"), tx.count_tokens(F.col("t")).alias("k"),
        tx.strip(F.col("t")).alias("s"),
    ).collect()
    for row in rows:
        normal = re.sub(r"\s+", " ", row["t"]).strip()
        assert row["n"] == normal
        assert row["s"] == row["t"].strip()
        assert row["k"] == (max(len(normal.split()), -(-len(normal) // 4)) if normal else 0)


def test_dehyphenate(spark):
    assert one(spark, tx.dehyphenate(F.col("t")), t="a con- \ntinued\n\n line ") == "a continued line"


def test_summary_tokens_cjk(spark):
    tokens = one(spark, tx.summary_tokens(F.col("t")), t="The Graph's 图神经 network of 网")
    assert tokens == ["graph's", "network", "图神", "神经", "经网"]
    assert one(spark, tx.summary_tokens(F.col("t")), t="网") == ["网"]


def test_evidence_norm_folds_compatibility_forms(spark):
    text = "Ｆｉｎｅ ﬁle – Straße co­op"
    want = unicodedata.normalize("NFKC", text).casefold().replace("­", "").replace("–", "-")
    assert one(spark, tx.evidence_norm(F.col("t")), t=text) == want


def test_table_cell_and_labels(spark):
    assert one(spark, meta.table_cell_text(F.col("t")), t="240ms") == "240 ms"
    assert one(spark, meta.table_cell_text(F.col("t")), t="123 .") == "12.3"
    assert one(spark, meta.section_label(F.col("t")), t=" 3.1) Results: ") == "results"
    assert one(spark, meta.detect_section_header(F.col("t")), t="2. Future  Work") == "limitation"
    assert one(spark, meta.detect_section_header(F.col("t")), t="Abstract of it") is None


def test_identifiers(spark):
    text = "DOI: https://doi.org/10.2222/regex. arXiv:2401.01234v2"
    assert one(spark, meta.first_doi(F.col("t")), t=text) == "10.2222/regex"
    assert one(spark, meta.first_arxiv(F.col("t")), t=text) == "2401.01234v2"
    assert one(spark, meta.filename_title(F.col("t")), t="a/b/my_paper-one.v2.pdf") == "my paper one.v2"


def snippet_of(spark, text, terms):
    df = spark.createDataFrame([(1, text, terms)], "id int, t string, k array<string>")
    return retrieval.best_snippets(df, ["id"], "t", "k").first().snippet


def test_highlight_window(spark):
    words = [f"w{i}" for i in range(60)]
    words[40] = "Tränsformer,"
    shown = snippet_of(spark, " ".join(words), ["transformer"])
    assert "<mark>Tränsformer,</mark>" in shown
    assert shown.startswith("...") and not shown.endswith("...")
    assert len(shown.strip(".").split()) == 32
    assert snippet_of(spark, "attransformer x transformer", ["transformer"]) == "attransformer x <mark>transformer</mark>"


def test_best_window_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["a", "b-c", "c", "d", "x", "y", "z", "É,"]) for _ in range(r.randrange(0, 120))), r.sample(["a", "b", "c", "d", "e"], r.randrange(5))) for i in range(60)]
    rows += [(100, None, ["a"]), (101, "", ["a"]), (102, "a a a", []), (103, "  a\n b ", ["b", "b"])]
    df = spark.createDataFrame(rows, "id int, t string, k array<string>")
    got = {x.id: x.snippet for x in retrieval.best_snippets(df, ["id"], "t", "k", 7).collect()}
    fold = lambda w: re.findall(r"\w+", w.lower().replace("é", "e"))
    for i, text, terms in rows:
        words = (text or "").split()
        hit = [set(fold(w)) & set(terms) for w in words]
        scores = [(-len(set().union(*hit[p:p + 7])), p) for p in range(len(words)) if hit[p]]
        first = max(min(min(scores)[1] if scores else 0, len(words) - 7), 0)
        body = " ".join(f"<mark>{w}</mark>" if h else w for w, h in zip(words[first:first + 7], hit[first:first + 7]))
        want = ("..." if first else "") + body + ("..." if first + 7 < len(words) else "")
        assert got[i] == (None if text is None else want)
