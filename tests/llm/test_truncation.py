import random
from collections import Counter

import pyarrow as pa
import pytest

from epiloom.llm.truncation import MEASURES, ending, measures, phrase, storage_limits, truncation_evidence, units

WHOLE = [
    "The cup is on the mat.",
    'He said: "Done."',
    "二回目の動作は合図の前に開いてしまう。",
    '{"a": [1, {"b": "x"}]}',
    '```json\n{"a": "}"}\n```',
    "| a | b |\n| 1 | 2 |\n",
    "001 cam frame=1 speed=2.0 crc=ab12cd34\n002 cam frame=2 speed=3.0 crc=ab12cd35",
    "It carries the tag v54.",
    "speed=1.5 was 29.7.",
]
CUT = [
    "It is approx.",
    "The lid is closed, i.",
    "The lid is closed, i.…",
    "The end came at t=25.",
    '{"a": [1, {"b": "x"}',
    '{"a": "x',
    '```json\n{"a": 1}',
    "| a | b |\n| 1 | 2",
    "| a | b |\n| 1 |",
    "001 cam frame=1 speed=2.0 crc=ab12cd34\n002 cam frame=2 spe",
    "001 cam frame=1 speed=2.0 crc=ab12cd34\n002 cam frame=2 speed=3.0 crc=ab1",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert ending(text)[0] == "whole"


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert ending(text)[0] == "cut"


def test_units_cut_by_a_marker_are_not_ended():
    unit, ended = units(pa.array(["One  two. Three fo...", "", "- a\r\n- b 42", "\u3000二つ。三つ"]))
    assert unit.to_pylist() == ["one  two.", "three fo...", "- a", "- b 9", "二つ。", "三つ"]
    assert ended.tolist() == [True, False, True, False, True, False]


def test_phrases():
    assert phrase("(see", "clip") == "see clip" and phrase("the", None) == "the" and phrase("この場面では手首が", None) == "この場面では手首"


@pytest.mark.parametrize("text", ["The lid is closed, i.e", "Seen at 4.1 s,"])
def test_a_sentence_that_goes_on(text):
    verdict, _, last = ending(text)
    assert verdict == "cut" or last == "s,"


@pytest.mark.parametrize("text", ["", " \n", "​", "…"])
def test_blank(text):
    assert ending(text)[0] == "none"


def corpus(n=1200):
    rng = random.Random(8)
    nouns, ends = ["cup", "ladle", "bin", "spool", "crate"], ["near the mat", "with both hands", "after the start"]
    sentence = lambda: f"The {rng.choice(nouns)} stays {rng.randrange(1, 90)} mm from the {rng.choice(nouns)} {rng.choice(ends)}."
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence() for _ in range(rng.randrange(1, 9)))
        source = rng.choice(["notes", "notes", "log", None])
        if source == "notes" and len(text) > 200:
            text = text[:200]
        elif i % 25 == 0:
            text = text[: rng.randrange(5, len(text) - 1)]
        elif i % 17 == 0:
            text += " Thanks"
        body = text.rstrip()
        if not body.endswith(("Thanks", ".")):
            cut.add(i)
        rows.append((i, text, source, "x"))
    return rows, cut


def test_corpus(spark):
    rows, cut = corpus()
    extra = [(5000, None, "notes", "x"), (5001, "", "notes", "x"), (5002, "   ", None, "x"), (5003, "The cup stays there. " * 4000 + "The cup st", "log", "x")]
    df = spark.createDataFrame(rows + extra, "doc_id BIGINT, text STRING, source STRING, tail STRING")
    got = truncation_evidence(df, "doc_id", "text", "source").collect()
    assert len(got) == len(rows) + 3
    assert {r["doc_id"] for r in got if r["cut"]} == cut | {5003}
    at = Counter(r["at_limit"] for r in got if r["cut"] and r["at_limit"])
    assert at.most_common(1)[0][0] == "chars 200"


def test_copies_do_not_vouch_for_their_ending(spark):
    rows, cut = corpus()
    text = "The spool stays near the mat. The crate moves besi"
    copies = [(6000 + i, text, ["log", "notes", None][i % 3], "x") for i in range(120)]
    df = spark.createDataFrame(rows + copies, "doc_id BIGINT, text STRING, source STRING, tail STRING")
    got = truncation_evidence(df, "doc_id", "text", "source").collect()
    assert len(got) == len(rows) + len(copies)
    assert {r["doc_id"] for r in got if r["cut"]} == cut | {c[0] for c in copies}


def test_empty(spark):
    assert truncation_evidence(spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING"), "doc_id", "text", "source").count() == 0


def test_measures():
    import html
    import json

    texts = ['a&<"é\r\n二\n👍', "", "\t\\ plain", "\n", "\r"]
    for text, row in zip(texts, measures(pa.array(["x", *texts])[1:])):
        got = dict(zip(MEASURES, row.tolist()))
        crlf = text.replace("\r\n", "\n").replace("\n", "\r\n")
        assert got["chars"] == len(text) and got["utf8"] == len(text.encode()) and got["utf16"] == len(text.encode("utf-16-le")) // 2
        assert got["entities"] == len(html.escape(text, quote=False).replace('"', "&quot;")) and got["json"] == len(json.dumps(text)) - 2
        assert got["crlf"] == len(crlf) and got["lf"] == len(text.replace("\r\n", "\n"))
    assert measures(pa.array([], pa.string())).shape == (0, len(MEASURES))


def test_limits_decide(spark):
    # "box" ends sentences more often than not, so only the limit tells that the texts of that length were cut.
    rng = random.Random(4)
    sentence = lambda: f"The {rng.choice(['cup', 'bin', 'spool'])} is {'very ' * rng.randrange(6)}near the box."
    rows = [(i, " ".join(sentence() for _ in range(rng.randrange(2, 9))), "notes") for i in range(400)]
    cut = [(1000 + i, (c * 12 + " is near the box. The cup is near the box." * 9)[:188] + " at this box", "notes") for i, c in enumerate("abcdefghijkl")]
    df = spark.createDataFrame(rows + cut, "doc_id BIGINT, text STRING, source STRING")
    found = lambda **how: {r["doc_id"] for r in truncation_evidence(df, "doc_id", "text", "source", **how).where("cut").collect()}
    assert found() == {c[0] for c in cut}
    assert found(at_limits=False) == set()


def test_unrelated_documents_change_no_verdict(spark):
    rows, cut = corpus()
    other = [(10_000 + i, f"Wholly other words número {i} stand aquí.", f"other {i % 3}", "x") for i in range(3000)]
    df = spark.createDataFrame(rows + other, "doc_id BIGINT, text STRING, source STRING, tail STRING")
    assert {r["doc_id"] for r in truncation_evidence(df, "doc_id", "text", "source").where("cut").collect()} == cut


def test_limits(spark):
    rows = [("a", "chars", n, 3) for n in range(50, 150)] + [("a", "chars", 120, 40), ("b", "chars", 80, 5)]
    got = storage_limits(spark.createDataFrame(rows, "source STRING, measure STRING, length INT, n BIGINT"))
    assert [(r["source"], r["length"]) for r in got.collect()] == [("a", 120)]
