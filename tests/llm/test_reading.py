"""Reading levels: held-out accuracy and edges."""

import pytest

from tarnwell.llm import reading
from tarnwell.tables import read_table

EASY = "The cat saw a dog. We had a big red ball. He ran to the park and she hid the hat. " * 6
HARD = "The multidimensional provenance of the jurisdiction exacerbates the institutional heterogeneity, notwithstanding the epistemological ambiguity of the reconciliation. " * 6


def test_units():
    assert reading.units(None)[0] is None and reading.units("")[0] is None
    language, words, lengths = reading.units("<p>The cat saw the dog.</p>\nISO: 100\nGPS 4.5, 3\nThe cat hid!")
    assert language == "en" and words["the"] == 3 and "iso" not in words and dict(lengths) == {6: 1, 0: 1}
    assert reading.units("Le chat est dans le jardin et il voit la maison.")[0] == "fr"
    assert reading.units("El gato vio el perro y la casa en el parque con mi tía.")[0] == "es"
    assert reading.units("Der Hund und die Katze sind nicht in dem Haus auf der Wiese.")[0] == "de"
    assert reading.units("写真をとりました。公園で猫を見た。" * 20)[0] is None
    assert reading.units('{"name": "urn", "when": {"class": "cow"}}\n' * 30)[0] is None


@pytest.mark.parametrize("text", [
    '{\n    "name": "as",\n    "when": {\n        "class": "the",\n        "min_count": 3\n    }\n}\n', "857d57bf2fca7e76  the/and/of-100.HEIC\t1,997,640\n", "I.0;n1r.' |1.~l:b ;b' m O .Ir~~0I~~l:: nO |vb\n",
    "2020-01-02 03:04:05,678 WARN [io-3] scan.c:31 to=/a/b is=1\n", "for (i = 0; i < n; i++) { do(a[i], &b); } // as is\n", "Camera Model Name : Canon EOS\nExposure Program : Manual\n", "the_path = /to/the/photos # or not\n",
])
def test_what_is_no_prose(text):
    assert reading.units(text * 40)[1].total() < reading.LEAST_WORDS


def test_runs_and_tags_of_any_length_are_no_part_of_prose():
    text = "The cat " + "=" * 900 + " saw the dog <img src='" + "a" * 5000 + "'> and it &CounterClockwiseContourIntegral; hid."
    assert dict(reading.units(text)[1]) == {"the": 2, "cat": 1, "saw": 1, "dog": 1, "and": 1, "it": 1, "hid": 1}


def test_formula_without_labels(spark):
    rows = [(1, EASY), (2, HARD), (3, None), (4, ""), (5, "Too short."), (6, "x = urn(3) # lid\n" * 40), (7, EASY * 300), (1, EASY)]
    df = spark.createDataFrame(rows, "words long, text string")
    labels = spark.createDataFrame([(9, 3), (None, 2), (1, 77), (2, None)], "words long, grade int")
    models = reading.fit(df, labels, "words", "text", "grade")
    got = {r["words_"]: r["grade"] for r in reading.reading_levels(df, models, "words", "text").collect()}
    assert got == {1: 1, 2: 5, 3: None, 4: None, 5: None, 6: None, 7: 1}
    assert reading.reading_levels(df.where("false"), models, "words", "text").count() == 0


def test_fitted_models_follow_labels(spark):
    rows = [(i, EASY if i % 2 else HARD) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2 if i % 2 else 4) for i in range(10)] + [(1, 2)], "doc_id long, grade int")
    models = reading.fit(df, labels, "doc_id", "text", "grade")
    assert {(r["doc_id"] % 2, r["grade"]) for r in reading.reading_levels(df, models, "doc_id", "text").collect()} == {(0, 4), (1, 2)}


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    pytest.importorskip("os").path.exists(folder) or pytest.skip("no data")
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "reading_labels")
    models = reading.fit(documents, labels.where("doc_id % 4 <> 0"), "doc_id", "text", "grade")
    held = labels.where("doc_id % 4 = 0").groupBy("doc_id").agg({"grade": "min"}).withColumnRenamed("min(grade)", "label")
    rows = reading.reading_levels(documents.join(held.select("doc_id"), "doc_id", "left_semi"), models, "doc_id", "text").join(held, "doc_id").collect()
    right = sum((r["grade"] or 0) >= 4 for r in rows if r["label"] >= 4) / max(1, sum(r["label"] >= 4 for r in rows))
    kept = sum(r["label"] >= 4 for r in rows if (r["grade"] or 0) >= 4) / max(1, sum((r["grade"] or 0) >= 4 for r in rows))
    assert right > 0.88 and kept > 0.88
