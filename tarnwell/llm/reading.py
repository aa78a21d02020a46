"""Reading level of each document, by smoothed unigram language models per grade.

The prose of a text is what is left without markup and without lines that are no sentences: those made of letters only in
part (listings, logs, code, settings, noise) and those that hold hardly any function words (header dumps). Its units are its words, rare ones replaced by their length class, and for
every sentence its class: how long it is and what share of its words is long. For each language and grade a unigram model with additive smoothing is trained on
labelled documents; a document gets the grade under whose model and prior its units are most likely. A language without
labels is graded by the readability formula LIX instead.

The models are fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their ids. That bounds the models,
which are broadcast; every document is graded, over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from tarnwell.session import materialize
from tarnwell.tables import own_name, read_table

#: At most so many labelled documents are used for fitting.
SAMPLE = 20_000
GRADES = (1, 2, 3, 4, 5)
#: Prose has at least so many words.
LEAST_WORDS = 30
#: Least share of function words in a line of prose and in a document of a language.
FUNCTION_SHARE = 0.12
#: Least share of letters in words among what a line of prose shows.
LETTER_SHARE = 0.8
#: A word is a unit of its own if so many labelled documents have it.
LEAST_DOCUMENTS = 5
SMOOTHING = 0.1
#: A sentence's class counts like so many words.
SENTENCE_WEIGHT = 10
#: A word of so many letters is long.
LONG_WORD = 9

# Function words of the languages that count, the closed classes of their grammars: articles, pronouns,
# prepositions, conjunctions, auxiliaries.
FUNCTION_WORDS = {
    "en": "the a an and or but if of in on at to from by with for as i you he she it we they my his her its our their this that is are was were be have had not then so because while when who which",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn weil dass ich du er sie es wir ihr mein sein im an am auf aus bei mit nach von zu zum zur für ist war hat wird nicht auch als dann",
    "fr": "le la les l un une des de du d et ou mais que qu qui je j il elle nous vous ils se s lui leur mon ma mes son sa ce cette à au aux en dans sur avec pour par est a ne n pas quand",
    "es": "el la los las un una unos y e o pero si que de del en a al con por para sin sobre desde yo él ella nosotros ellos me se nos le lo mi mis su sus este esta es son era ha no cuando porque",
}
# Upper bounds of LIX for the grades but the last, after its usual scale.
LIX_BOUNDS = (25, 35, 45, 55)

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARKUP = re.compile(r"<[^<>]+>|&[a-z][a-z0-9]{1,31};|&#x?[0-9a-f]{1,8};")
_RUN = re.compile(r"([^\w\s])\1{3,}")
_LINE_END = re.compile(r"[\r\n\v\f\x85  ]+")
_SENTENCE_END = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s|$)")
_FUNCTION = {w: frozenset(words.split()) for w, words in FUNCTION_WORDS.items()}
_ANY_FUNCTION = frozenset().union(*_FUNCTION.values())


#: Words and sentences longer than this are classed like those of this length; sentences have a class for every four
#: words and every fifth of long words.
LONGEST, LONGEST_SENTENCE, FIFTHS = 24, 60, 5


def sentence_class(words: list[str]) -> int:
    """The class of a sentence, from its number of words and the share of long ones."""
    n = len(words)
    long = sum(map((LONG_WORD - 1).__lt__, map(len, words)))
    return min(n, LONGEST_SENTENCE) // 4 * (FIFTHS + 1) + round(FIFTHS * long / n)


def prose(text: str) -> tuple[list[str], list[int]]:
    """The words of a text's lines of prose, in lower case and without markup, and the class of each of their sentences."""
    known, find, split = _ANY_FUNCTION.__contains__, _WORD.findall, _SENTENCE_END.split
    kept: list[str] = []
    classes: list[int] = []
    text = text.lower()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    for line in _LINE_END.split(_RUN.sub(" ", text)):
        sentences = [x for s in split(line) if (x := find(s))]
        words = sentences[0] if len(sentences) == 1 else list(chain.from_iterable(sentences))
        if len(words) < 2 or sum(map(len, words)) < LETTER_SHARE * sum(map(len, line.split())):
            continue
        if sum(map(known, words)) >= FUNCTION_SHARE * len(words):
            kept += words
            classes += map(sentence_class, sentences)
    return kept, classes


def units(text: str | None) -> tuple[str | None, Counter, Counter]:
    """A text's language (None if it is none that counts), its prose words and its sentences' classes, both counted."""
    if not text:
        return None, Counter(), Counter()
    found, sentences = prose(text)
    words, total = Counter(found), len(found)
    if not total:
        return None, words, Counter()
    shares = {k: sum(words[w] for w in v if w in words) for k, v in _FUNCTION.items()}
    language = max(shares, key=shares.get)
    if shares[language] < FUNCTION_SHARE * total:
        return None, words, Counter()
    return language, words, Counter(sentences)


def lix_grade(words: Counter, lengths: Counter) -> int:
    """The grade by LIX: words a sentence plus the percentage of words of more than six letters."""
    total, sentences = words.total(), max(1, lengths.total())
    lix = total / sentences + 100 * sum(n for w, n in words.items() if len(w) > 6) / max(1, total)
    return 1 + sum(lix >= bound for bound in LIX_BOUNDS)


def _length_class(letters: int) -> str:
    return f"#{min(letters, LONGEST) // 3}"


LENGTH_CLASSES = sorted({_length_class(n) for n in range(LONGEST + 1)})
SENTENCE_CLASSES = [f"§{c}" for c in range((LONGEST_SENTENCE // 4 + 1) * (FIFTHS + 1))]


class GradeModels:
    """The models of all languages: for each, its units' rows in a matrix of log probabilities by grade."""

    def __init__(self, counts: list[tuple[str, int, str, float]], priors: dict[tuple[str, int], float]) -> None:
        """``counts``: language, grade, unit and weight, rare words already replaced by their length class."""
        self.languages: dict[str, tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]] = {}
        for language in sorted({k[0] for k in priors}):
            grades = sorted(g for k, g in priors if k == language)
            rows = {c: i for i, c in enumerate([*LENGTH_CLASSES, *SENTENCE_CLASSES])}
            own = [(rows.setdefault(unit, len(rows)), grades.index(grade), weight) for k, grade, unit, weight in counts if k == language]
            matrix = np.full((len(rows), len(grades)), SMOOTHING)
            for row, column, weight in own:
                matrix[row, column] += weight
            prior = np.array([priors[(language, g)] for g in grades])
            rare = np.array([rows[_length_class(n)] for n in range(LONGEST + 1)])
            sentence = np.array([rows[c] for c in SENTENCE_CLASSES])
            self.languages[language] = (rows, np.log(matrix / matrix.sum(axis=0)), np.log(prior / prior.sum()), rare, sentence, grades)

    def grade(self, language: str, words: Counter, lengths: Counter) -> int:
        """The most likely grade of a document."""
        known = self.languages.get(language)
        if known is None:
            return lix_grade(words, lengths)
        rows, matrix, prior, rare, sentence, grades = known
        at = [rows.get(w, -1) for w in words]
        at = [rare[min(len(w), LONGEST)] if r < 0 else r for r, w in zip(at, words)]
        at += [sentence[c] for c in lengths]
        weight = np.array([*words.values(), *(n * SENTENCE_WEIGHT for n in lengths.values())], float)
        return grades[int(np.argmax(prior + weight @ matrix[at]))]


_UNITS = StructType([StructField("language", StringType()), StructField("words", MapType(StringType(), IntegerType())), StructField("lengths", MapType(IntegerType(), IntegerType()))])


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, grade: str, sample: int = SAMPLE) -> GradeModels:
    """Models fitted on labelled documents. Several labels of one document share its weight; labels outside 1 to 5, null
    and without document are left out. Without labels the models are empty and LIX grades everything."""
    marks = labels.where(F.col(key).isNotNull() & F.col(grade).isin(*GRADES)).groupBy(key, F.col(grade).cast("int").alias("grade")).count()
    chosen = marks.select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample)
    marks = marks.join(F.broadcast(chosen), key)  # at most ``sample`` keys
    shares = marks.groupBy(key).agg(F.sum("count").alias("all"), F.collect_list(F.struct("grade", "count")).alias("marks"))
    texts = documents.select(key, F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(shares), key)

    @F.arrow_udf(_UNITS)
    def taken(column: pa.Array) -> pa.Array:
        found = [units(value.as_py()) for value in column]
        kept = [language if words.total() >= LEAST_WORDS else None for language, words, _ in found]

        def as_map(counters: list[Counter], kind: pa.DataType) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum([len(c) for c in counters])]).astype(np.int32)
            keys = pa.array([k for c in counters for k in c], kind)
            return pa.MapArray.from_arrays(pa.array(ends), keys, pa.array([n for c in counters for n in c.values()], pa.int32()))

        words, lengths = as_map([f[1] for f in found], pa.string()), as_map([f[2] for f in found], pa.int32())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), words, lengths], ["language", "words", "lengths"])

    share = F.col("m.count") / F.col("all")
    graded = texts.withColumn("u", taken("text")).select("u.*", "all", F.explode("marks").alias("m"))
    graded = materialize(graded.select("language", "m.grade", share.alias("share"), "words", "lengths"), "labelled")
    graded = graded.where("language is not null")  # not earlier: it would run the function on all documents, before the join
    words = graded.select("language", "grade", "share", F.explode("words").alias("unit", "n"))
    often = words.groupBy("unit").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS)
    length_class = F.concat(F.lit("#"), F.floor(F.least(F.length("unit"), F.lit(LONGEST)) / 3).cast("string"))
    named = words.join(often, "unit", "left").withColumn("unit", F.when(F.col("documents").isNull(), length_class).otherwise(F.col("unit")))
    lengths = graded.select("language", "grade", "share", F.explode("lengths").alias("length", "n"))
    lengths = lengths.select("language", "grade", "share", F.concat(F.lit("§"), F.col("length").cast("string")).alias("unit"), (F.col("n") * SENTENCE_WEIGHT).alias("n"))
    units_of = named.select("language", "grade", "share", "unit", "n").unionByName(lengths)
    counts = units_of.groupBy("language", "grade", "unit").agg(F.sum(F.col("n") * F.col("share")).alias("weight"))
    priors = graded.groupBy("language", "grade").agg(F.sum("share").alias("share"))
    rows = counts.orderBy("language", "grade", "unit").toArrow()  # the models; the sample bounds them
    return GradeModels(
        list(zip(*[rows.column(c).to_pylist() for c in ("language", "grade", "unit", "weight")])),
        {(r["language"], r["grade"]): r["share"] for r in priors.collect()},
    )


def reading_levels(documents: DataFrame, models: GradeModels, key: str, text: str) -> DataFrame:
    """``key, language, words, grade`` of every document; language and grade are null where it isn't prose that counts.

    Null, empty and blank texts, other languages and fewer than ``LEAST_WORDS`` words of prose give a null grade. Repeated
    rows are graded alike; a key named like a column of the result gets an underscore.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    result = "language string, words int, grade int"

    @F.arrow_udf(StructType.fromDDL(result))
    def graded(column: pa.Array) -> pa.Array:
        languages, totals, grades = [], [], []
        for value in column:
            language, words, lengths = units(value.as_py())
            total = words.total()
            counts = language is not None and total >= LEAST_WORDS
            languages.append(language)
            totals.append(total)
            grades.append(shared.value.grade(language, words, lengths) if counts else None)
        return pa.StructArray.from_arrays(
            [pa.array(languages, pa.string()), pa.array(totals, pa.int32()), pa.array(grades, pa.int32())], ["language", "words", "grade"]
        )

    rows = documents.select(F.col(key).alias("__key"), graded(F.col(text)).alias("__level"))
    return rows.select(F.col("__key").alias(own_name(key, ("language", "words", "grade"))), "__level.*")


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Query p9_levels: language, words of prose and grade of every document."""
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "reading_labels")
    return reading_levels(documents, fit(documents, labels, "doc_id", "text", "grade"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Query p9_found."""
    return p9_levels(spark, folder).where("grade >= 4").select("doc_id")
