"""Cut texts: endings, limits by hazards, planted cuts."""

import random

import pytest

from foldspan.llm import truncation as T

WORDS = "the old river mill stands near a quiet village where boats carry grain every autumn".split()


def prose(rnd, n):
    out = ""
    while len(out) < n:
        s = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(5, 14)))
        out += s[0].upper() + s[1:] + ". "
    return out[: out.rindex(".", 0, n + 60) + 1] if "." in out[:n] else out


@pytest.mark.parametrize(
    ("text", "ending"),
    [
        ("A sentence ends. Another one goes on and sto", "broken"), ("A sentence ends. It ends too.", "complete"), ("It was „so“, he said. „Wir haben 3.“", "complete"), ("Text.\n\n[[Category:Abc", "broken"), ("Text.\n\n[[Category:Abc]]", "complete"),
        ("Text here. More{{convert|3|km", "broken"), ("Text.<ref>Some Book, p. 3.</ref>", "complete"), ("Text.<ref>Some Book, p. 3", "broken"), ("TEXT.<REF>SOME BOOK, P. 3.</REF>", "complete"), ("TEXT.<REF>SOME BOOK, P. 3", "broken"), ("One. Two is here...", "marked"), ("One. Two is [...]", "marked"), ("Intro.\n\n* [[A]]\n* Bc Def", "item"), ("Intro.\n\n* [[A]]\n* Bc (17", "broken"),
        ("hahahahahahahaha", "complete"), ("my goat wrote this", "complete"), ("name: Abc\nid: 55", "complete"), ("#REDIRECT [[Abc]]", "complete"), ("{{Infobox\n| a = 1\n| b = ", "broken"), ("{|\n|-\n| 1 || 2", "broken"), ("{|\n|-\n| 1 || 2\n|}", "complete"),
        ("Text is here. And th \r\n ", "broken"), ("Das ist so. Und w�", "broken"), ("これは文です。次の文はここで切", "broken"), ("これは文です。", "complete"), ("", "complete"), (None, "complete"), ("  \n", "complete"), ("== Head", "broken"), ("Text.\n\n== Head ==", "complete"), ("Talk here. [[User:X]] 03:20 (UTC)", "complete"),
    ],
)
def test_endings(spark, text, ending):
    df = spark.createDataFrame([(text, 1)], "text string, ending int")
    assert T.ended(df.drop("ending")).first().ending == ending


def planted(rnd):
    rows, cut = [], set()
    for i in range(3000):
        source = ("limit", "bytes", "free", None)[i % 4]
        text = prose(rnd, int(rnd.lognormvariate(5.6, 0.6)) + 30)
        if source == "limit" and len(text) > 300:
            text = text[:300]
        if source == "bytes":
            text = text.replace("a", "ä")
            if len(text.encode()) > 280:
                text = text.encode()[:280].decode(errors="ignore")
        if source == "free" and i % 60 == 2 and len(text) > 60:
            text = text[: rnd.randrange(40, len(text) - 12)]
        if len(text) > 5 and not text.rstrip().endswith("."):
            cut.add(i)
        rows.append((i, text, source, "x", 1))
    return rows, cut


def test_planted(spark):
    rows, cut = planted(random.Random(5))
    df = spark.createDataFrame(rows + [(9001, None, "limit", None, None), (9002, "", "free", None, None)], "doc_id bigint, text string, source string, ending string, n int")
    limits = {(r.source, r.unit, r.len) for r in T.significant(T.lengths(df)).collect()}
    assert ("limit", "chars", 300) in limits and any(s == "bytes" and u == "bytes" and 277 <= n <= 280 for s, u, n in limits) and not any(s in ("free", None) for s, _, _ in limits)
    got = [r.doc_id for r in T.found(df).collect()]
    assert len(got) == len(set(got)) and len(cut & set(got)) >= 0.97 * len(cut) and len(set(got) - cut) <= 0.01 * len(cut)
    by = {r.source: r for r in T.by_source(df).collect()}
    assert by["limit"].cut_at_limit > 100 and by[None].cut == 0 and by["free"].docs == 751


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "One is here. Two is he", "a")] * 4, "doc_id bigint, text string, source string")
    assert T.found(df.limit(0)).count() == 0 and T.found(df).count() == 4


@pytest.mark.parametrize(
    ("text", "ending"),
    [
        ("Text.<ref>" + "Some Book, and more of it. " * 20 + "It ends.", "broken"), ("Text.<ref>" + "Some Book, and more of it. " * 20 + "It ends.</ref>", "complete"),
        ("Text.\n[[File:A.jpg|thumb|" + "A caption of the picture. " * 20 + "It ends.", "broken"), ("Text {{quote|" + "Something was said. " * 20 + "It ends.", "broken"),
        ("Text.\n{{quote|\nSomething was said.\nIt ends.", "broken"), ("Text.\n{{quote|\nSomething was said.\n}}\nIt ends.", "complete"),
        ("{|\n|-\n| 1\nA cell goes on. It ends.", "broken"), ("{|\n|-\n| 1\n\nThe page goes on. It ends.", "complete"), ("{|\n|-\n| 1\n== More ==\nIt goes on. It ends.", "complete"),
    ],
)
def test_markup_opened_far_before_the_end(spark, text, ending):
    assert T.ended(spark.createDataFrame([(text,)], "text string")).first().ending == ending


def test_routes_and_kinds(spark):
    rows = [(i, "Word " + "word " * 20 + f"and number {i:03d} goes o", "limit") for i in range(30)]
    rows += [(100 + i, "Some text. " * (2 + i % 40) + "It ends." + " It does." * (i % 7), "limit") for i in range(200)] + [(500, "Whole. Here it stops in the mid", "free"), (501, None, "free"), (502, "Done.", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    route = {r.doc_id: r.route for r in T.judged(df).collect()}
    assert {route[i] for i in range(30)} == {"limit"} and route[500] == "elsewhere" and route[501] is None and route[502] is None
    kinds = {(r.source, r.kind): r for r in T.endings(T.placed(df)).collect()}
    assert kinds["limit", "sentence"].at_limit == 30 and kinds["free", "sentence"].lift is None
    assert all(r.agree for r in T.agreed(df).collect()) and T.agreed(df).count() == 3
