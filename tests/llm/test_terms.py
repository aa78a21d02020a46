"""Term counts by deltas, co-occurrence."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tarnwell.llm.cooccurrence import cooccurrence
from tarnwell.llm.term_counts import TermCounts, p1_counts, signed_changes
from tarnwell.session import new_table_path

RECORD = "field string, record_id long, image_id long, term string"


def brute(records):
    occurrences, images, members = Counter(), defaultdict(set), defaultdict(set)
    for f, _, i, t in records:
        if t is not None:
            occurrences[(f, t)] += 1
            images[(f, t)] |= {i} - {None}
            members[f] |= {i} - {None}
    return {(f, t, n, len(images[(f, t)])) for (f, t), n in occurrences.items()}, {f: len(m) for f, m in members.items()}


def test_increments_equal_recount(spark):
    rng = random.Random(3)
    counts = TermCounts(spark, new_table_path(spark, "test"), segments=2)
    assert counts.terms().count() == 0 and counts.marked().count() == 0
    old, rows = None, []
    for step in range(4):
        kept = [r for r in rows if rng.random() > 0.3]
        changed = [(f, k, i, rng.choice("abcde")) if rng.random() < 0.3 else (f, k, i, t) for f, k, i, t in kept]
        rows = changed + [(rng.choice("xy"), step * 100 + k, rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None]), rng.choice(["a", "b", "c", None])) for k in range(40)]
        new = spark.createDataFrame(rows, RECORD)
        counts.update(signed_changes(new, old, ["field", "record_id"]))
        want, fields = brute(rows)
        assert {tuple(r) for r in counts.terms().select("field", "term", "occurrences", "images").collect()} == want
        assert {r["field"]: r["images"] for r in counts.fields().collect()} == fields
        old = new
    again = TermCounts(spark, counts.path)  # another process finds the same state
    assert {tuple(r) for r in again.terms().collect()} == {tuple(r) for r in counts.terms().collect()}
    marks = {(r["field"], r["term"]): r["marks"] for r in again.marked().collect()}
    for f, t, _, n in want:
        assert marks[(f, t)] == (["rare"] if n < 5 else []) + (["common"] if n * 4 > fields[f] else [])
    counts.update(signed_changes(new.where("false"), old, ["field", "record_id"]))
    assert counts.terms().count() == 0 and {r["images"] for r in counts.fields().collect()} <= {0}
    counts.update(signed_changes(new.where("false"), None, ["field", "record_id"]))


def test_updates_append_and_readers_are_kept(spark):
    counts = TermCounts(spark, new_table_path(spark, "test"), segments=3)
    rows = [("f", k, k % 9, chr(97 + k % 20)) for k in range(60)]
    counts.update(signed_changes(spark.createDataFrame(rows, RECORD), None, ["record_id"]))
    before, first = counts.terms(), counts._state["postings"][0]
    want_before = brute(rows)[0]
    for step in range(5):
        old, rows = rows, rows[:-1] + [("f", 1000 + step, step, "z")]
        counts.update(signed_changes(spark.createDataFrame(rows, RECORD), spark.createDataFrame(old, RECORD), ["record_id"]))
        assert {tuple(r) for r in counts.terms().select("field", "term", "occurrences", "images").collect()} == brute(rows)[0]
        assert {r["field"]: r["images"] for r in counts.fields().collect()} == brute(rows)[1]
        assert len(counts._state["postings"]) <= 3
        if step < 3:  # merged in the third update, removed in the fourth
            assert (first in counts._state["postings"]) == (step < 2)
            assert {tuple(r) for r in before.select("field", "term", "occurrences", "images").collect()} == want_before
    counts.drop()
    assert TermCounts(spark, counts.path).terms().count() == 0


def test_lookup_of_many_buckets(spark, monkeypatch):
    from tarnwell.llm import term_counts

    monkeypatch.setattr(term_counts, "NAMED_BUCKETS", 2)
    counts = TermCounts(spark, new_table_path(spark, "test"))
    rows = [("f", k, k, "abc"[k % 3]) for k in range(30)]
    counts.update(signed_changes(spark.createDataFrame(rows, RECORD), None, ["record_id"]))
    more = [("f", 100 + k, k, "a") for k in range(20)]
    counts.update(signed_changes(spark.createDataFrame(more, RECORD), None, ["record_id"]))
    assert {tuple(r) for r in counts.terms().select("field", "term", "occurrences", "images").collect()} == brute(rows + more)[0]


def test_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.choice("abcdefgh")) for _ in range(400)] + [(7, c) for c in "abcdefgh" * 30] + [(None, "a"), (1, None)]
    df = spark.createDataFrame([(b, i, 1, 2) for b, i in rows], "image long, t string, n_ab int, basket int")
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n, total = Counter(i for s in baskets.values() for i in s), len(baskets)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence(df, "image", "t").collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == both
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["baskets"]) == (n[a], n[b], total) and abs(r["lift"] - both[(a, b)] * total / n[a] / n[b]) < 1e-9 and abs(2 ** r["pmi"] - r["lift"]) < 1e-9
    some = {(r["item_a"], r["item_b"]) for r in cooccurrence(df, "image", "t", 20, 400, 1).collect()}
    assert some == {p for p, k in both.items() if k >= 20 and 1000 * k >= 400 * total and k * total >= n[p[0]] * n[p[1]]}
    assert cooccurrence(df.where("false"), "image", "t").count() == 0


def test_records_without_id_are_told_apart_by_content(spark, tmp_path):
    rows = [(None, 1, "cat"), (None, 1, "cat"), (None, 2, "cat"), (None, 2, "dog"), (5, 3, "dog"), (5, 3, "dog")]
    spark.createDataFrame(rows, "id long, image_id long, class string").withColumn("created_at", F.lit(1.0)).write.parquet(f"{tmp_path}/detections.parquet")
    spark.createDataFrame([(None, 1, "yes"), (None, 2, "no")], "id long, image_id long, verdict string").withColumn("created_at", F.lit(None).cast("double")).write.parquet(f"{tmp_path}/adjudications.parquet")
    spark.createDataFrame([], "id long, category string, updated_at double").write.parquet(f"{tmp_path}/images.parquet")
    got = {(r["field"], r["term"]): (r["occurrences"], r["images"]) for r in p1_counts(spark, str(tmp_path)).collect()}
    assert got == {("detections.class", "cat"): (2, 2), ("detections.class", "dog"): (2, 2), ("adjudications.verdict", "yes"): (1, 1), ("adjudications.verdict", "no"): (1, 1)}
