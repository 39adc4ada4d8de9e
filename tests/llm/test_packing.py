"""Packing against item-by-item best fit, and the promises of a packing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import packing, tokens


def best_fit(lengths, capacity):
    """Number of containers of item-by-item best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(0, c), st.integers(1, 40), max_size=12))))
def test_plan_is_valid_and_as_good_as_best_fit(case):
    capacity, counts = case
    used, ranks = {}, {}
    for length, a, b, first, per, start in packing.plan_slots(counts, capacity):
        for rank in range(a, b):
            step = rank - a
            used.setdefault(first + step // per, []).append((start + step % per * length, length))
            ranks.setdefault(length, []).append(rank)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if k}
    for slots in used.values():
        end = 0
        for start, length in sorted(slots):
            assert start >= end
            end = start + length
        assert end <= capacity
    items = [k for k, n in counts.items() if k for _ in range(n)]
    assert len(used) == best_fit(items, capacity)
    assert sorted(used) == list(range(len(used)))


def test_plan_refuses_long_items():
    with pytest.raises(ValueError):
        packing.plan_slots({9: 1}, 8)


def check(spark, lengths, capacities):
    docs = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    targets = spark.createDataFrame(list(enumerate(capacities, 1)), "target_id int, capacity int")
    got = packing.pack(docs, targets, salts=4).collect()
    for t, capacity in enumerate(capacities, 1):
        per, text = {}, {}
        for r in got:
            if r.target_id != t:
                continue
            text.setdefault(r.doc_id, []).append((r.piece, r.offset, r.length))
            if r.length:
                per.setdefault(r.container_id, []).append((r.start, r.length))
        for slots in per.values():
            end = 0
            for start, n in sorted(slots):
                assert start >= end
                end = start + n
            assert end <= capacity
        want = {}
        for d, n in lengths:
            want.setdefault(d, []).append(n or 0)
        for d, parts in text.items():
            assert sum(n for _, _, n in parts) == sum(want[d])
            if len(want[d]) == 1 and want[d][0] <= capacity:
                assert [p[0] for p in parts] == [0]
        assert set(text) == set(want)
    return got


def test_pack(spark):
    check(spark, [(i, i * 13 % 97) for i in range(400)] + [(1000, 1234), (1001, 0), (1002, None), (1003, 50), (1003, 50)], [50, 100, 64])


def test_pack_one_hot_length(spark):
    got = check(spark, [(i, 30) for i in range(500)] + [(1000 + i, 40) for i in range(20)], [100])
    assert len({r.container_id for r in got}) == best_fit([30] * 500 + [40] * 20, 100)


def test_pack_odd_tables(spark):
    assert check(spark, [], [10]) == []
    docs = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long")
    targets = spark.createDataFrame([(1, 0), (None, 5), (2, 5), (2, 5)], "target_id int, capacity int")
    assert [r.target_id for r in packing.pack(docs, targets).collect()] == [2]


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 200_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] > 1000 and got[5] > 1
    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        enc = tokens.encoding(f.read())
    text = "Größe 123 — ok\n\n\tZeile"
    assert enc.decode(enc.encode_ordinary(text)) == text
