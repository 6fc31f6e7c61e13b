import itertools

from epiloom.llm.formatting import collapsed, copies

SCHEMA = "id BIGINT, text STRING, verb STRING, noun STRING, key STRING, n INT, t STRING"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in copies(df, "id", "text", ("verb", "noun")).collect()}


def same(spark, a, b):
    return run(spark, [a, b]) == {(0, 1)}


def test_formatting_makes_copies(spark):
    base = ("Grasp the flat cup (2.5 cm) with both hands", "grasp", "flat cup")
    forms = [
        base,
        ("GRASP_THE_FLAT_CUP (2.5 CM) WITH BOTH HANDS!", "Grasp", "Flat-Cup"),
        ("“Grasp the flat　cup – (2.5 cm) with\r\nboth hands…”", "flat cup.", "grasp"),
        ("grasp the flat cup 2.5 cm with both hands", " grasp\t", "FLAT CUP"),
    ]
    assert run(spark, forms) == {(0, i) for i in range(1, 4)}


def test_field_order(spark):
    parts = ["action: push", "object: tea cup", "where: under the bin"]
    forms = [("; ".join(p), "push", "tea cup") for p in itertools.permutations(parts)]
    forms += [("Where=Under the bin | object = TEA CUP / action : push.", "tea cup", "push"), ("- object:_tea_cup\n- action:_push\n- where:_under_the\tbin", "push", "tea cup")]
    assert run(spark, forms) == {(0, i) for i in range(1, len(forms))}


def test_content_is_not_formatting(spark):
    a = ("Put cup 2.5 on mat", "put", "cup")
    for b in (("Put cup 25 on mat", "put", "cup"), ("Put cup 2,5 on mat", "put", "cup"), ("Put mat 2.5 on cup", "put", "cup"), ("Put cup 2 5 on mat", "put", "cup"), ("Put cup 2.5 on mat", "put", None), (None, "put", "cup"), ("Put cup 2.5 on mat", "put", "")):
        assert not same(spark, a, b), b
    assert not same(spark, ("action: push; object: cup", "a", "b"), ("action: cup; object: push", "a", "b"))
    assert not same(spark, ("Left-handed: push cup", "a", "b"), ("push cup Left-handed:", "a", "b"))


def test_nulls_and_empty(spark):
    assert same(spark, ("Cup", None, "x"), ("cup", "X ", None)) and not same(spark, ("Cup", None, "x"), ("cup", "", "x"))
    assert run(spark, [(None, None, None), (None, None, None), (None, "a", "b"), (None, "a", "b")]) == set()
    assert same(spark, ("Crème", None, None), ("CRÈME", None, None))
    assert run(spark, [("...", None, None), ("...", None, None), ("", None, None), ("", None, None)]) == set()
    assert run(spark, []) == set()


def test_long_text_and_repeated_rows(spark):
    long = "push the cup " * 5000
    assert run(spark, [(long, "a", "b"), (long.upper(), "a", "b"), (long, "a", "b"), (long + "now", "a", "b")]) == {(0, 1), (0, 2)}


def test_hot_text(spark, monkeypatch):
    import epiloom.llm.formatting as f

    monkeypatch.setattr(f, "HOT_LEAST", 5)
    rows = [("Same", "a", "b")] * 40 + [("same.", "a", "b"), ("other", "a", "b")]
    assert run(spark, rows) == {(0, i) for i in range(1, 41)}


def test_counts(spark):
    rows = [("A cup", "a", "b"), ("a  CUP", "b", "a"), ("a cup.", "a", "b"), ("A cup", "a", "b"), ("!", None, None), ("!", None, None), ("?", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA)
    got = {tuple(r) for r in collapsed(df, "id", "text", ("verb", "noun")).collect()}
    assert got == {(0, 4, 3, "A cup", "a", "b"), (4, 2, 1, "!", None, None), (6, 1, 1, "?", None, None), (7, 1, 1, None, None, None)}
