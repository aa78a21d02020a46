"""Encoding against the tokenizer's own library, and packing."""

import math
import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import packing
from tarnwell.llm.tokenize import LONG_BYTES, TOKENIZERS, VOCABULARY, Decoder, Encoder, encoded, load_vocabulary, token_count

PATH = os.path.join(TOKENIZERS, VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return Encoder(vocabulary)


@pytest.fixture(scope="module")
def library():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


rng = random.Random(1)
TEXTS = [
    "", " ", "a", "Hello  world", "<|endoftext|> x", "it's we'll I'VE", "tail   ", "\r\n\r\n \t\n", "\x1c\x1d a\x85b​ c\x00", "漢字かな交じり文" * 50, "👨‍👩‍👧 ok", "ﬁ ①② ½ ́́",
    "a" * 5000, "=" * 3001, "aaa aaaa aaaaa", "".join(rng.choice("abcdefgh") for _ in range(3000)), "".join(rng.choice("aeinorst") for _ in range(80)), "ab" * 400, "퟿￿", "日本語 mixed — text…",
]


def test_equals_library(encoder, library, vocabulary):
    got = encoder.encode(TEXTS).to_pylist()
    assert got == library(TEXTS)
    assert encoder.sizes(TEXTS).tolist() == list(map(len, got))
    assert Decoder(vocabulary).decode(pa.array(got, pa.list_(pa.int32()))) == TEXTS
    assert encoder.encode([None, "", "x"]).to_pylist()[:2] == [[], []]
    assert encoder.encode([]).to_pylist() == []


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab ", min_size=65, max_size=300), st.text("etao", min_size=65, max_size=300), st.text("一丁七万a", min_size=30, max_size=150)))
def test_any_text(encoder, library, text):
    assert encoder.encode([text]).to_pylist() == library([text])


def test_steps_on_arrays_equal_queries(encoder, library):
    encoder._prepare_long()
    for text in ("a" * 999, "".join(rng.choice("aab") for _ in range(2000)), "".join(rng.choice("etaoin") for _ in range(2000))):
        assert encoder._contract_array(text.encode()).tolist() == library([text])[0]
    assert len(encoder.encode(["a" * (LONG_BYTES * 3)]).to_pylist()[0]) > 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "x" * 200_000)], "ids long, text string")
    rows = encoded(df, "ids", "text").collect()
    assert sorted(len(r["ids"]) for r in rows)[:4] == [0, 0, 0, 2] and set(rows[0].asDict()) == {"ids_", "ids"}
    assert [r[0] for r in df.where("ids < 4").select(token_count(spark, df["text"])).collect()] == [2, 0, 0, 0]
    assert encoded(df.where("false"), "ids", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=30))
def test_plan_places_all(histogram):
    runs = packing.plan(histogram, 64)
    placed, used = defaultdict(list), Counter()
    for n, first, container, count, per, slot in runs:
        placed[n] += range(first, first + count * per)
        for c in range(container, container + count):
            used[c] += n * per
    assert {n: sorted(p) for n, p in placed.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    assert all(v <= 64 for v in used.values()) and sorted(used) == list(range(len(used)))
    # At most as many containers as plain harmonic classes need.
    assert len(used) <= sum(math.ceil(c / (64 // n)) for n, c in histogram.items() if c) + 1


def test_containers(spark):
    gen = random.Random(6)
    rows = [(i, gen.choice([0, None, -3, 7, 7, 7, 64, 65, 128, 300, gen.randrange(1, 64)])) for i in range(500)] + [(7, 7), (7, 7), (None, 5)]
    df = spark.createDataFrame([(k, n, 1) for k, n in rows], "slot long, n int, part long")
    got = packing.containers(df, "slot", "n", 64, group=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["container_id"]].append((r["slot"], r["length"]))
    for parts in by.values():
        at = 0
        for slot, length in sorted(parts):
            assert slot == at
            at += length
        assert at <= 64
    sizes = Counter()
    for r in got:
        sizes[r["slot_"]] += r["length"]
    want = Counter()
    for k, n in rows:
        want[k] += max(0, n or 0)
    assert +sizes == +want
    assert all(r["length"] == 64 or n_parts == 1 or r["part_no"] == n_parts - 1 for r in got for n_parts in [sum(1 for q in got if q["slot_"] == r["slot_"])] if r["slot_"] not in (7, None))
    total = sum(want.values())
    assert len(by) <= 1.05 * total / 64 + 1
    assert packing.containers(df.where("false"), "slot", "n", 64).count() == 0


def test_decoding(vocabulary, library, monkeypatch):
    decoder = Decoder(vocabulary)
    one = lambda text: library([text])[0]
    lists = [None, [], one("a b"), [10**6], one("é" * 50), None, one("x" * 999)]
    want = [None, "", "a b", None, "é" * 50, None, "x" * 999]
    for most in (500_000, 10):
        monkeypatch.setattr("tarnwell.llm.tokenize.DECODED_TOKENS", most)
        assert decoder.decode(pa.array(lists, pa.list_(pa.int32()))) == want
        assert decoder.decode(pa.array(lists, pa.list_(pa.int32())).slice(2, 3)) == want[2:5]


def test_violations_are_found(spark):
    schema = "container_id long, slot long, k long, part_no long, first long, length long"
    sizes = spark.createDataFrame([(1, 5), (2, 12), (3, 0), (4, None), (5, 3)], "k long, n long")
    good = [(0, 0, 2, 0, 0, 10), (1, 0, 1, 0, 0, 5), (1, 5, 2, 1, 10, 2), (1, 7, 5, 0, 0, 3)]
    count = lambda rows: packing.violations(spark.createDataFrame(rows, schema), sizes, "k", "n", 10).head().asDict()
    assert count(good) == {"items": 3, "parts": 4, "lost": 0, "divided": 0, "overfull": 0, "overlapping": 0}
    assert count(good[:3])["lost"] == 1
    assert count([*good, good[-1]])["lost"] == 1 and count([*good, (2, 0, 3, 0, 0, 1)])["lost"] == 1
    assert count([*good[:3], (0, 10, 5, 0, 0, 3)])["overfull"] == 1
    assert count([*good[:3], (1, 6, 5, 0, 0, 3)])["overlapping"] == 1
    assert count([good[0], (1, 0, 1, 0, 0, 3), (3, 0, 1, 1, 10, 2), *good[2:]])["divided"] == 1
