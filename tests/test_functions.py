"""Terms and hashes."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import hashes
from tarnwell.functions.terms import fold, term


@pytest.mark.parametrize("text,want", [
    ("Lamp_Post", "lamp post"), (" lamp - post\n", "lamp post"), ("la​mp­ post", "lamp post"), ("ｌａｍｐ　post", "lamp post"), ("CRÈME", "crème"),
    ("__", None), ("​﻿", None), ("", None), (None, None), ("lamp‑post", "lamp post"), ("ﬁsh", "fish"), ("yes", "yes"), ("a" * 50_000, "a" * 50_000),
])
def test_fold(text, want):
    assert fold(text) == want
    assert want is None or fold(want) == want


def test_term_column(spark):
    rows = [("Cat",), (None,), (" ",), ("cat",), ("ｃat ",)]
    df = spark.createDataFrame(rows, "c string").select(term("c").alias("t"))
    assert [r["t"] for r in df.collect()] == ["cat", None, None, "cat", "cat"]


@pytest.mark.parametrize("text,want", [
    ("00000000000000ff", 255), ("0xFF", 255), ("0XfF", 255), ("dhash:00000000000000ff", 255), ("phash=ff", 255), (" ff\n", 255), ("00:00:00:00:00:00:00:ff", 255), ("89-e1-fd-db-e1-5f-2e-b8", 0x89E1FDDBE15F2EB8),
    ("15 d1 0c 9f 6c f3 0e f5", 0x15D10C9F6CF30EF5), ("ffffffffffffffff", 2**64 - 1), ("", None), (None, None), ("n/a", None), ("unreadable", None), ("ff" * 16, None), ("efc97c8d63abe9dg", None), ("????????????????", None), ("0x", None),
])
def test_perceptual_bits(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(hashes.perceptual_bits("t")).head()[0]
    assert got == (want if want is None or want < 2**63 else want - 2**64)


def test_digest(spark):
    h = "ab" * 32
    rows = [(h,), (h.upper(),), ("sha256:" + h,), (f" SHA256:{h.upper()} \n",), (h[:-1],), (None,), ("",), (h + "0",)]
    got = spark.createDataFrame(rows, "t string").select(hashes.content_digest("t").alias("d")).collect()
    assert [r["d"] for r in got] == [h, h, h, h, None, None, None, None]


def test_hamming_and_similarity(spark):
    rows = [(0, (1 << n) - 1 if n < 64 else -1) for n in range(65)]
    rows = [(a, b if b < 2**63 else b - 2**64) for a, b in rows]
    got = spark.createDataFrame(rows, "a long, b long").select(hashes.hamming("a", "b").alias("d"), hashes.similarity("a", "b").alias("s"), hashes.hex16("b").alias("x")).collect()
    assert [(r["d"], r["s"]) for r in got] == [(n, round((64 - n) * 100 / 64, 1)) for n in range(65)]
    assert got[5]["x"] == "000000000000001f"


def test_difference_hash(spark):
    rng = random.Random(1)
    pixels = [rng.randrange(256) for _ in range(72)]
    bits = [pixels[r * 9 + c] > pixels[r * 9 + c + 1] for r in range(8) for c in range(8)]
    want = int("".join("1" if b else "0" for b in bits), 2)
    df = spark.createDataFrame([(pixels,), (pixels[:-1],), (None,)], "p array<int>").select(hashes.hex16(hashes.difference_hash(F.col("p"))).alias("h"))
    assert [r["h"] for r in df.collect()] == [f"{want:016x}", None, None]
