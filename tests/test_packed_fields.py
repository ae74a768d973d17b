import pytest

from pricemill.operators import packed_fields as pf
from pricemill.operators.packed_fields import DIALECTS, candidates, choose_dialects, codes, read_json, split_field, unpack_fields

MIXED = DIALECTS["mixed"]


@pytest.mark.parametrize(
    "text, values",
    [
        ("a; b;;c", ["a", "b", "c"]),
        ('"set ""3 in 1""",usb-c', ['set "3 in 1"', "usb-c"]),
        ('x\t"bluetooth 5.3" ,y', ["x", "bluetooth 5.3", "y"]),
        ("A 6,1 inch, B 6/128GB / C (2022, EU)", ["A 6,1 inch", "B 6/128GB", "C (2022, EU)"]),
        ("http://a/w_2,h_3.jpg, https://a/v;rev=1/x.jpg https://b", ["http://a/w_2,h_3.jpg", "https://a/v;rev=1/x.jpg", "https://b"]),
        ('"http://a/1.jpg" "http://a/2.jpg"\nhttp://a/3.jpg', ["http://a/1.jpg", "http://a/2.jpg", "http://a/3.jpg"]),
        ('27" panel | x', ['27" panel', "x"]),
        ("", []),
        (" \n ,; ", []),
        ("a, a", ["a", "a"]),
    ],
)
def test_split(text, values):
    assert split_field(text, MIXED) == values


def test_json_lists():
    assert read_json('["a, b", " ", "27\\" panel", null, 3]') == ["a, b", '27" panel', "3"]
    assert read_json("[a]") is None
    assert candidates('["x"]') == [("json", ["x"])]


def test_very_long_field():
    text = ";".join(f"v{i}" for i in range(20000))
    assert len(split_field(text, MIXED)) == 20000


def test_codes_keep_frequent_words():
    assert codes("Acme X-12, all kinds", frozenset({"all", "kinds"}))[1:] == ("A A-N, all kinds", "W, all kinds", 7)


def test_dialect_by_description_length(spark):
    """A comma that is part of a value everywhere else doesn't split."""
    rows = [(i, v, 0) for i, v in enumerate(['["glass, hard"]'] * 30 + ['["red"]', '["blue"]', '["green"]'] * 10 + ["red;glass, hard", "red; blue,green", None, "", "red"])]
    df = spark.createDataFrame(rows, "id int, tags string, vals int")
    got = {r.id: r.vals for r in choose_dialects(df, "id", ["tags"]).collect()}
    assert got[60] == ["red", "glass, hard"]
    assert got[61] == ["red", "blue", "green"]
    assert 62 not in got and got[63] == [] and got[64] == ["red"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, tags string, field string")
    assert unpack_fields(df, "id", ["tags"]).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([("a", "x;y;x", None)], "id string, tags string, extra string")
    rows = {(r.pos, r.val) for r in unpack_fields(df, "id", ["tags", "extra"]).collect()}
    assert rows == {(1, "x"), (2, "y"), (3, "x")}


def test_codes_outside_the_book_count(spark, monkeypatch):
    """A book that holds next to nothing changes no choice, nor does a value too long for it."""
    from pricemill.operators import packed_fields

    long = "glass " * 50 + ", hard"
    rows = [(i, v) for i, v in enumerate(['["glass, hard"]'] * 30 + ['["red"]', '["blue"]', '["green"]'] * 10 + ["red;glass, hard", "red; blue,green", f'["{long}"]', f'["{long}"]', f"red;{long}"])]
    df = spark.createDataFrame(rows, "id int, tags string")
    whole = {r.id: r.vals for r in choose_dialects(df, "id", ["tags"]).collect()}
    assert whole[60] == ["red", "glass, hard"] and whole[64] == ["red", long]
    monkeypatch.setattr(packed_fields, "MOST_CODES", 1)
    assert {r.id: r.vals for r in choose_dialects(df, "id", ["tags"]).collect()} == whole


def _by_character(text, delimiters):
    """A plainer statement of the same reading: character by character, with a value's state beside it."""
    values, current, depth, url, i = [], "", 0, False, 0
    while i < len(text):
        c, rest = text[i], text[i:]
        fresh = not current.strip()
        if fresh and c in "\"'" and (hit := pf._closing(text, i)):
            after = text[hit[0] :]
            gap = after[: len(after) - len(after.lstrip())]
            after = after.lstrip()
            ends = not after or after[0] in delimiters or any(d in gap and d in delimiters for d in "\n\t") or (" " in delimiters and (after[0] == '"' or pf._URL.match(after)))
            if ends:
                values.append(hit[1])
                current, url, depth = "", False, 0
                i = len(text) - len(after) + (after[:1] in delimiters if after else 0)
                continue
        url = url or bool(fresh and pf._URL.match(rest))
        cut = False
        if url:
            cut = (c in delimiters or (c.isspace() and " " in delimiters)) and bool(pf._NEXT_URL.match(rest))
        elif c in "([{" and text.find(")]}"["([{".index(c)], i) > 0:
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif not depth and c in delimiters and c != " ":
            before, behind = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
            cut = not (c == "," and before.isdigit() and behind.isdigit()) and (c != "/" or (before.isspace() and behind.isspace()))
        elif not depth and c.isspace() and " " in delimiters and not fresh:
            cut = bool(pf._URL.match(text[i + 1 :]))
        if cut:
            values.append(current)
            current, url = "", False
            depth = 0
        else:
            current += c
        i += 1
    return [v.strip() for v in [*values, current] if v.strip()]


def test_marks_against_characters():
    import random

    rnd = random.Random(3)
    parts = ["a", "b1", "1", "2", ",", ",", ";", "|", "\t", "\n", "/", " ", " / ", '"', "'", '""', '\\"', "(", ")", "[", "]", "https://x.y/a,b;c", "HTTP://z", "й", "."]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        for d in pf.DIALECTS.values():
            assert pf.split_field(text, d) == _by_character(text, d), (text, d)
