import unicodedata

from pricemill.llm.lookalike import SPELLINGS, Consistent, consistent_texts, same_looking_classes, same_looking_pairs, scripts_of

FORM = Consistent()
SAME = [
    ("The court held", "Τhе cοurt hеld"),
    ("The court held", "Ｔｈｅ ｃourt held"),
    ("The court", "T\u200bhe\ufeff co\u00adurt"),
    ("a b", "a\u00a0b"),
    ("a b", "a\u2009b"),
    ("café naïve", "cafe\u0301 nai\u0308ve"),
    ("final", "ﬁnal"),
    ("Рішення суду їх", "Pішeння cyдy їx"),
    ("її", "i\u0308i\u0308 і".replace(" і", "")),
    ("м. Київ, Україна", "м. Kиїв, Укpаїнa"),
    ("line\nnext", "line \r\nnext"),
    ("a court", "\u03b1 court"),
    ("o court", "\u0585 court"),
    ("o court", "\u2c9f court"),
    ("court", "\U0001d41c\U0001d428\U0001d42e\U0001d42b\U0001d42d"),
    ("class c", "class \u217d"),
    ("legal", "le\u0261al"),
    ("legal", "le\u210aal"),
    ("court", "co\U000e0061urt\U000e007f"),
]
OTHER = [("\u03b2", "B"), ("\u2126 5", "W 5"), ("\u2122", "TM"), ("cat", "car"), ("O", "0"), ("l", "1"), ("a", "A"), ("№ 5", "No 5"), ("a b", "ab"), ("a  b", "a b"), ("x²", "x2"), ("м", "m"), ("й", "и"), ("a\nb", "a b"), ("—", "-"), ("３", "٣")]


def test_pairs_of_forms():
    for a, b in SAME:
        assert FORM(a) == FORM(b), (a, b)
    for a, b in OTHER:
        assert FORM(a) != FORM(b), (a, b)


def test_ruling_script_decides_ambiguous_tokens():
    assert FORM("Суд а не хор") == FORM("Суд a не xop") == "Суд а не хор"
    assert FORM("court а") == "court a"


def test_form_is_stable_and_plain_text_stays():
    for t in ("Plain text.", "Рішення № 5 від 3 травня", "Müller & Söhne", "判決 \U0001f469\u200d⚖\ufe0f"):
        assert FORM(FORM(t)) == FORM(t)
    assert FORM("Рішення № 5") == "Рішення № 5"


def test_tables():
    assert scripts_of("cop") >= {"latin", "cyrillic"} and scripts_of("court") == {"latin"} and scripts_of("жr") == set()
    assert all(len(c) == 1 and unicodedata.category(c)[0] == "L" for c in SPELLINGS)


def test_documents(spark):
    long = "слово " * 60000
    rows = [(1, "The court", 0), (2, "Thе court", 0), (3, "The court", 0), (4, None, 0), (5, "", 0), (6, " \u00a0 ", 0), (7, "\u200b", 0), (8, long, 0), (9, long + "\u200b", 0), (10, "The Court", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, look long")
    got = {tuple(r) for r in same_looking_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (8, 9)}
    texts = {r.doc_id: r.text for r in consistent_texts(df).collect()}
    assert texts[2] == "The court" and texts[4] is None and texts[6] == "" and len(texts) == 10
    assert same_looking_pairs(df.limit(0)).count() == 0


def test_copies_of_two_spellings(spark):
    """Plain copies meet the other spelling only; classes have a row for each document."""
    rows = [(i, "The court") for i in range(40)] + [(100 + i, "Th\u0435 court") for i in range(3)] + [(200, "The\u200b court"), (300, "alone"), (301, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in same_looking_pairs(df).collect()}
    want = {(i, 100 + k) for i in range(40) for k in range(3)} | {(i, 200) for i in range(40)} | {(100 + k, 200) for k in range(3)}
    assert got == want
    classes = {r.doc_id: (r.class_id, r.n_docs, r.n_spellings) for r in same_looking_classes(df).collect()}
    assert set(classes) == {*range(40), 100, 101, 102, 200} and set(classes.values()) == {(0, 44, 3)}
