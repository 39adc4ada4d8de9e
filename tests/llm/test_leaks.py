"""Leaks against a brute-force search, Myers' distance against the plain table."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import leaks
from rillwork.llm.texts import decode, is_broken, words

LETTERS = st.lists(st.sampled_from(list("abcde")), max_size=12)


def plain_distance(p, t):
    """Least edit distance of p to any stretch of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for w in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(LETTERS.filter(len), LETTERS)
def test_myers(p, t):
    assert leaks.myers_distance(leaks.masks(p), len(p), t) == plain_distance(p, t)


def test_myers_long_patterns():
    rng = random.Random(1)
    p = [rng.choice("abcdefgh") for _ in range(150)]
    t = [rng.choice("abcdefgh") for _ in range(60)] + p[:70] + ["x"] + p[72:] + ["a"] * 20
    assert leaks.myers_distance(leaks.masks(p), 150, t) == plain_distance(p, t)


def brute(doc, item):
    """(longest common run, words of the item in runs of eight or more)"""
    covered, longest = set(), 0
    for i in range(len(item)):
        for p in range(len(doc)):
            n = 0
            while i + n < len(item) and p + n < len(doc) and item[i + n] == doc[p + n]:
                n += 1
            longest = max(longest, n)
            if n >= 8:
                covered |= set(range(i, i + n))
    return longest, len(covered)


@pytest.mark.parametrize("seed", range(60))
def test_examine_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12 if seed % 3 else 300)]
    items = tuple((k, tuple(rng.choice(vocabulary) for _ in range(rng.randint(8, 110)))) for k in range(4))
    doc = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 5)):
        item = rng.choice(items)[1]
        a = rng.randrange(len(item))
        at = rng.randint(0, len(doc))
        doc[at:at] = item[a : a + rng.choice([5, 7, 8, 9, 10, 11, 15, 19, 20, 25, 60])]
    got = {k: (run, covered) for k, _, run, covered, _, _, _, leaked in leaks.examine(doc, items) if leaked}
    for k, (_, item) in enumerate(items):
        longest, covered = brute(doc, item)
        case = longest >= 20 or covered * 2 >= len(item) and covered > 0
        assert (k in got) == case, (seed, k, longest, covered, len(item))
        if case:
            assert got[k] == (longest, covered)


def near(doc, item):
    """Words of the item in passages of eight that stand in the text with one edit at most."""
    covered = set()
    for w in range(len(item) - 7):
        if plain_distance(item[w : w + 8], doc) <= 1:
            covered |= set(range(w, w + 8))
    return len(covered)


@pytest.mark.parametrize("seed", range(25))
def test_edited_copies_equal_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = tuple((k, tuple(rng.choice(vocabulary) for _ in range(rng.randint(20, 70)))) for k in range(3))
    doc = [rng.choice(vocabulary) for _ in range(60)]
    copy = list(rng.choice(items)[1])
    for _ in range(rng.randint(0, 9)):
        at = rng.randrange(len(copy))
        copy[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["x"], ["y"]])
    doc[30:30] = copy
    got = {r[0]: r[5] for r in leaks.examine(doc, items)}
    for k, (_, item) in enumerate(items):
        want = near(doc, item)
        assert got.get(k, 0) == want if 2 * want >= len(item) else k not in got or got[k] == want


def test_every_seventh_word_changed():
    item = tuple(f"w{i}" for i in range(60))
    doc = ["z"] * 30 + [f"x{i}" if i % 7 == 6 else f"w{i}" for i in range(60)] + ["z"] * 30
    ((_, distance, longest, covered, near_run, near_words, m, leaked),) = leaks.examine(doc, ((1, item),))
    assert (distance, longest, covered, near_run, near_words, m, leaked) == (8, 0, 0, 60, 60, 60, False)
    # pieces alone prove nothing: the distance rejects hits whose surroundings differ
    scattered = [w for i in range(0, 60, 8) for w in (*item[i : i + 4], *(f"q{j}" for j in range(i, i + 4)))]
    assert leaks.examine(scattered, ((1, item),)) == []


def test_only_words_count():
    assert words("The <b>Qu</b>ick&nbsp;br­own​ FOX&#8217;s<br>end") == ["the", "quick", "brown", "fox", "s", "end"]
    assert words("is <5 cm wide, weighs >3 g") == ["is", "5", "cm", "wide", "weighs", "3", "g"]
    assert words(None) == words("") == []
    assert words("&amp;lt;p&amp;gt; a_b") == ["a", "b"]


def test_broken_texts():
    assert is_broken("fÃ¼r") and is_broken("f�r") and is_broken("f?r") and not is_broken("für wen?") and not is_broken("plain? yes")
    assert decode("<p>für</p>".encode("cp1252")) == "für" == decode("für".encode())
    assert decode("접근 권한이 없습니다".encode("cp949")) == "접근 권한이 없습니다"
    assert decode(b"It\x92s a plan") == "It’s a plan"


def test_find_leaks(spark):
    item = " ".join(f"Word{i}" for i in range(40))
    rows = [
        (1, "Intro. " + item.upper() + " end", b"x"), (2, " ".join(f"word{i}" for i in range(19)), None), (3, " ".join(f"<i>word{i}</i>," for i in range(5, 25)), None),
        (4, None, None), (5, "", None), (6, "x " * 50_000 + item, None), (1, item, None), (7, " ".join(f"word{i}" for i in [*range(10), 99, *range(20, 30)]), None),
        (8, "f�r", ("für " + item).encode()),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, raw_bytes binary").selectExpr("*", "1 as item_id", "2 as raw")
    items = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, item), (10, item), (13, "a b " * 10)], "item_id long, item_text string")
    for block in (20_000, 1):
        got = sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items, block=block).where("leaked").collect())
        assert got == [(1, 10), (1, 10), (3, 10), (6, 10), (7, 10), (8, 10)]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 == leaks.find_leaks(docs, items.limit(0)).count()
