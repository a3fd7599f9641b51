"""Strings whose short names clash are told apart by their second hashes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import suffix_dedup


@pytest.mark.parametrize(("group_bytes", "string_bits"), [(1000, 11), (1 << 20, 11), (1000, 3), (3000, 64)])
def test_clashing_names_remove_nothing(spark, group_bytes, string_bits):
    # 45 common bytes make candidates, but no 50 are equal.
    draw, common = random.Random(5), "the common passage of forty-five bytes, no mo"
    rows = [(i, "".join(draw.choices("abcdefghij", k=80)) + common + "".join(draw.choices("klmnopqrst", k=80))) for i in range(60)]
    rows += [(60, rows[7][1][:70] + "!"), (61, rows[60 - 1][1][:60] + "?")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=group_bytes, string_bits=string_bits).collect()}
    assert got == {i: {60: 70, 61: 60}.get(i, 0) for i in range(62)}


@pytest.mark.parametrize("tail_bytes", [0, 2, 8])
def test_names_pack_and_unpack(tail_bytes):
    draw = np.random.default_rng(3)
    for names in (np.array([7], np.uint64), np.unique(draw.integers(0, 2**63, 1000, dtype=np.uint64)), np.arange(5, dtype=np.uint64), *([np.zeros(4, np.uint64)] if tail_bytes else [])):
        tails = draw.integers(0, 2 ** (8 * tail_bytes) - 1, len(names), dtype=np.uint64, endpoint=True)
        a, b = suffix_dedup.unpack(suffix_dedup.pack(names, tails, tail_bytes), tail_bytes)
        assert (a == names).all() and (b == tails).all()


def test_places_pack_and_unpack():
    for places in ([], [0], [5, 6, 7, 9, 100, 101], list(range(40))):
        assert suffix_dedup.unpack_places(suffix_dedup.pack_places(np.array(places, np.int64))).tolist() == places


def test_equal_numbers_in_a_group_are_compared_by_bytes():
    g = object.__new__(suffix_dedup.Group)
    texts = [b"a" * 50, b"b" * 50, b"a" * 50, b"c" * 50]
    g.data, g.offsets, g.least = np.frombuffer(b"".join(texts), np.uint8), np.arange(5) * 50, np.array([4, 2, 9, 9])
    assert g.repeated(np.arange(4) * 50, np.zeros(4, np.int64), 1).tolist() == [False, False, True, False]


def test_rows_may_come_in_another_order_in_each_step(spark):
    # As a cluster's shuffles bring them: without reuse, each step reads the rows anew.
    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdefghij ", k=draw.randrange(60, 200))) for _ in range(200)]
    for i in range(20, 200, 3):
        texts[i] += texts[i - 20][:55]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def shuffled(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(len(b))))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digests(rows.mapInArrow(shuffled, rows.schema)).collect()}
        kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(rows.mapInArrow(shuffled, rows.schema)).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {i: 55 if i in range(20, 200, 3) else 0 for i in range(200)}
    assert kept == {i: t[:-55] if i in range(20, 200, 3) else t for i, t in enumerate(texts)}
