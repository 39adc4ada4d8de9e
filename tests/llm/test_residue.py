"""Residue: kinds of pages, recurrence across sources, and odd rows."""

import pyarrow as pa

from rillwork.llm import residue

PROSE = "In 1876, the council of the town repaired the heavy bridge and finally examined the 565 granaries of the harbour, which took them three weeks and more money than planned."

PAGES = {
    1: ("a.example", "Home | About | Help\nPage not found\nSorry, we couldn’t find what you were looking for.\n© 2020 a.example", True),
    2: ("b.example", f"Home | About | Help\n{PROSE.replace('bridge', 'bridge')}\n{PROSE.replace('bridge', 'bridge')}\nPlease enable JavaScript to view this page.\n© 2020 b.example", False),
    3: ("c.example", "Please enable JavaScript to view this page.", True),
    4: ("d.example", "Dear {{ name }}, thank you for your order #order.id# of %%city%%.\nWelcome to {{ shop_name }}!", True),
    5: ("e.example", f"In this lesson we write {{{{ title }}}} in the template, and the engine prints the value in its place. {PROSE.replace('bridge', 'mill')}\n{PROSE.replace('bridge', 'mill')}", False),
    6: ("f.example", "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed tempor aliqua nulla enim culpa.", True),
    7: ("g.example", f"How to fix “Access denied” on a bridge: ask the office. {PROSE.replace('bridge', 'tower')}", False),
    8: ("h.example", "Home | About\n© 2020 h.example", False),
    9: ("i.example", "", False),
    10: ("j.example", None, False),
    11: ("k.example", "Open on weekdays from 9 to 5; the gate is repaired in winter.", False),
    12: ("l.example", "Fehler 404: Diese Adresse gibt es nicht.\nDer Inhalt wurde verschoben oder gelöscht.", True),
    13: ("m.example", "The set {1, 2, 3} of orchards is <5 cm wide, weighs >3 g, costs $7$ and has code #12# [room 2].", False),
    14: (None, "페이지를 찾을 수 없습니다\n접근 권한이 없습니다", True),
    15: ("n.example", "Replace this paragraph with your own words.\nasdf qwer blah xxx abc", True),
}


def judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, raw_bytes binary").selectExpr("*", "7 as lines", "1 as row", "2 as kind")
    return {r.doc_id: r for r in residue.judge_residue(df, **options).collect()}


#: Messages count where they recur: each stands on three more sites, beside a sentence of their own.
OTHERS = [(100 + 10 * k + i, f"other{i}.example", f"{text}\n{own} of the {k} sites.", None) for i, own in enumerate(("Oaks are the pride", "Elms are the best", "Limes are the shame")) for k, text in enumerate(PAGES[j][1] for j in (1, 3, 12, 14, 15))]


def test_kinds(spark):
    rows = [(i, s, t, None) for i, (s, t, _) in PAGES.items()]
    got = judged(spark, rows + OTHERS)
    assert {i: r.is_residue for i, r in got.items() if i < 100} == {i: want for i, (_, _, want) in PAGES.items()}
    assert (got[4].kind, got[6].kind, got[1].kind, got[2].kind) == ("template", "filler", "message", None)
    # what recurs nowhere is no message: fields and filler are left
    alone = judged(spark, rows + OTHERS, wide=10**6)
    assert {i for i, r in alone.items() if r.is_residue and i < 100} == {4, 6, 15}


def test_recurrence_decides(spark):
    page = "Something like a failure, code 77."
    few = judged(spark, [(i, "one.example", page, None) for i in range(5)])
    many = judged(spark, [(i, f"s{i}.example", page.replace("77", str(i)), None) for i in range(5)])
    assert not any(r.is_residue for r in few.values()) and all(r.is_residue for r in many.values())


def test_messages_that_differ_in_a_word_are_one(spark):
    subjects = ("page", "shop", "viewer", "app")
    got = judged(spark, [(i, f"s{i}.example", f"This {w} relies on scripts, which are switched off here.", None) for i, w in enumerate(subjects)])
    assert all(r.is_residue for r in got.values())
    clauses = judged(spark, [(i, f"s{i}.example", f"{w}: the text that was wanted could not be found.".replace("could not be found", "has gone offline"), None) for i, w in enumerate(("Sorry", "Oh dear me", "Alas", "What bad luck"))])
    assert all(r.is_residue for r in clauses.values())


def test_copies_of_one_page_are_no_recurrence(spark):
    page = f"The error of the year\nA server failure made the town dark. {PROSE} The session of the council was long."
    got = judged(spark, [(i, f"mirror{i}.example", f"{page}\n© 202{i} mirror{i}.example", None) for i in range(6)])
    assert not any(r.is_residue for r in got.values()) and {r.residue_chars for r in got.values()} == {0}


def test_odd_rows(spark):
    rows = [(9, f"o{i}.example", f"Page not found\nSeite nicht gefunden\n{w} trees grow in the town.", None) for i, w in enumerate(("Oak", "Elm", "Ash"))]
    rows += [(1, "a.example", "Page not found", None), (1, "a.example", PROSE, None), (None, "a.example", "Page not found", None), (3, "b.example", "x" * 3_000_000, None), (4, "c.example", "S�ite nicht gefunden", "Seite nicht gefunden".encode())]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, raw_bytes binary")
    out = residue.judge_residue(df)
    assert sorted((r.doc_id or 0, r.is_residue) for r in out.collect() if r.doc_id != 9) == [(0, True), (1, False), (1, True), (3, False), (4, True)]
    assert residue.without_residue(df.where("doc_id <> 9 or doc_id is null"), out).count() == 2
    assert residue.judge_residue(df.limit(0)).count() == 0
    assert residue.judge_residue(df.drop("raw_bytes"), raw_col=None).count() == 8


def test_masks():
    assert residue.mask("Error 404 at /a/b.html on 2024-01-02, see www.x.example or a@b.de", "www.x.example") == residue.mask("Error 500 at /c on 2023-11-12, see y.example or q@r.org", "y.example")
    assert residue.mask("Dear {{ name }}, x", "") == residue.mask("Dear {{ city }}, x", "")
    (one,), (two,) = (list(residue.sentences(residue.mask(t, ""))) for t in ("Dear {{ name }}, x.", "Dear <%= nobody %>, x."))
    assert one[1] == two[1] == residue.FIELD


APACHE = "The server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the administrator to inform them of the time. More information about this error may be available in the server error log."
FORM = "Dear {{ name }}, we thank you for the order that you have sent to our house in {{ city }} and hope that the goods reach you well. Our people of {{ shop }} will write to you as soon as the parcel is on its way to the harbour."


SCRIPTS = "This house of many rooms and doors asks all of its guests that come along the road from the harbour to allow the scripts in their browser, as the rooms of the house cannot be shown to them in any other way."


def test_lines_of_any_length_are_judged_alike(spark):
    article = " ".join(f"{PROSE} Sentence {c * 5} tells what the council of the town did." for c in "abcd")
    rows = [(2, "b.example", FORM, None), (3, "c.example", f"{PROSE} {PROSE} They read that the page was not found. {PROSE}", None)]
    rows += [(20 + i, f"x{i}.example", APACHE, None) for i in range(3)] + [(30 + i, f"y{i}.example", SCRIPTS, None) for i in range(3)]
    rows += [(10 + i, f"m{i}.example", f"{article}\nPlease enable JavaScript to comment on this long page of ours.", None) for i in range(4)]
    got = judged(spark, rows)
    assert {i for i, r in got.items() if r.is_residue} == {2, 20, 21, 22, 30, 31, 32}
    assert got[2].kind == "template"


def test_paragraphs_that_recur_on_different_pages_are_no_content(spark):
    notice = "This house keeps the addresses of its guests for thirty days and then throws them away. Whoever does not like this may write a letter to the office of the house, which is open on all days."
    message = "Internal server error, please be patient and come back in a while."
    words = "oak elm ash fir".split()
    got = judged(spark, [(i, f"s{i}.example", f"{message}\n{notice} {w.title()} trees were planted along the whole of the long road that leads from the house to the harbour and back.", None) for i, w in enumerate(words)])
    assert {r.content_chars for r in got.values()} == {len("Oak trees were planted along the whole of the long road that leads from the house to the harbour and back.")}


def test_only_the_first_line_can_be_a_heading():
    verse = ["The river below the hill", "The miller beside the wheel", "The geese in the night"]
    row = [pa.array([1]), pa.array(["a.example"]), pa.array(["\n".join([*verse, "Please enable JavaScript to comment"])]), pa.array([None], pa.binary())]
    (made,) = residue._cut(iter([pa.RecordBatch.from_arrays(row, names=["doc_id", "source", "text", "raw"])]))
    assert [x["kind"] for x in made.column(4)[0].as_py() if x["kind"] != residue.VARIANT] == [residue.HEADING, residue.CONTENT, residue.CONTENT, residue.PHRASE]
