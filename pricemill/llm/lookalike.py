"""One consistent form for texts that look the same but consist of different characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Letters drawn alike, a row for each script; "." where it has no such letter.
_LATIN = "ABCEHIJKMNOPSTXYZ" "acehijopsxyvu" "hqwd"
_CYRIL = "АВСЕНІЈКМ.ОРЅТХУ." "асеһіјорѕхуѵ." "һԛԝԁ"
_GREEK = "ΑΒϹΕΗΙͿΚΜΝΟΡ.ΤΧΥΖ" "α....ϳορ...ν." "...."
_ARMEN = "..........Օ.Տ...." "...հ..օ.....ս" "հ..."
_COPTI = ".ⲂⲤ.ⲎⲒ.ⲔⲘⲚⲞⲢ.ⲦⲬⲨⲌ" ".ⲥ....ⲟⲣ....." "...."
#: Scripts in the order in which a token that all of them could spell takes one.
SCRIPTS = ("latin", "cyrillic", "greek", "armenian", "coptic")

#: letter -> its spelling in each script that has one
SPELLINGS: dict[str, dict[str, str]] = {}
for _row in zip(_LATIN, _CYRIL, _GREEK, _ARMEN, _COPTI, strict=True):
    _spelt = {s: c for s, c in zip(SCRIPTS, _row) if c != "."}
    for _c in _spelt.values():
        SPELLINGS.setdefault(_c, _spelt)

#: Characters that show nothing: zero-width ones, soft hyphen, direction marks, variation selectors, tags.
_HIDDEN = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff"
_DROP = re.compile(f"[{_HIDDEN}]+")
_CYRILLIC, _ROMAN = re.compile(r"[\u0400-\u052f]"), re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
#: Compatibility forms that look the same: wide and narrow forms, joined letters, Roman numerals, letters in the
#: mathematical and letter-like alphabets, no-break hyphen. Signs of words (such as the numero sign) stay.
_FORMS = {i: unicodedata.normalize("NFKC", chr(i)) for i in [*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x2160, 0x2180), *range(0x1D400, 0x1D800)] if unicodedata.decomposition(chr(i))}
_FORMS |= {i: k for i in range(0x2100, 0x2150) if unicodedata.decomposition(chr(i)).startswith("<font>") and len(k := unicodedata.normalize("NFKC", chr(i))) == 1}
_FORMS |= {0x2010: "-", 0x2011: "-", 0x0261: "g"}
_LETTERLIKE = "".join(chr(i) for i in _FORMS if 0x2100 <= i < 0x2150) + r"\u2126\u212a\u212b"  # ohm, kelvin and angstrom compose to letters
#: Texts with any of these need more than a look at their letters.
_RARE = re.compile(rf"[{_HIDDEN}\t\r\x0b\x0c\x1c-\x1f\u0085\u00a0\u0261\u0300-\u03ff\u0530-\u058f\u1680\u1ab0-\u1aff\u1f00-\u1fff\u2000-\u200a\u2010\u2011\u2028\u2029\u202f\u205f\u20d0-\u20ff{_LETTERLIKE}\u2160-\u217f\u2c80-\u2cff\u3000\ua640-\ua69f\ufb00-\ufb06\uff01-\uffee\U00010000-\U0010ffff]")
# one range for the mathematical letters: single characters beyond the basic plane are tried one by one
_FORM = re.compile("[" + "".join(chr(i) for i in _FORMS if i < 0x10000).replace("-", r"\-").replace("]", r"\]") + r"\U0001d400-\U0001d7ff]")
#: A letter that only Cyrillic has: it tells the script of a text without Roman letters.
_DECISIVE = re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x530)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFD", c)[0] not in SPELLINGS) + "]")
#: Letters of these scripts; those of others look like none of them.
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u037d\u037f-\u03ff\u0400-\u0481\u048a-\u052f\u0531-\u0556\u0561-\u0587\u1e00-\u1fff\u2c80-\u2ce4"
_PLAIN_TOKEN = re.compile(f"[{_LETTER}]+")
_TOKEN = re.compile(rf"[{_LETTER}][{_LETTER}\u0300-\u036f]*")
#: White space but line feeds; it shows as blanks, at a line's end as nothing. A run's length can be seen and stays.
_BLANK = re.compile(r"[^\S\n ]")
_LINE_END = re.compile(r" +(?=\n)")


def _script(letter: str) -> str:
    return unicodedata.name(letter, "").partition(" ")[0].lower()


def scripts_of(token: str) -> frozenset[str]:
    """Scripts in which every letter of the token has a spelling: the intersection of the letters' sets."""
    held: set[str] | None = None
    for c in token:
        if not unicodedata.combining(c):
            mine = set(SPELLINGS.get(c, (_script(c),)))
            held = mine if held is None else held & mine
    return frozenset(held or ())


def spell(token: str, script: str | None) -> str:
    """The token in the script; letters without a spelling there take their first one."""
    return "".join(s.get(script) or next(iter(s.values())) if (s := SPELLINGS.get(c)) else c for c in token)


class Consistent:
    """Brings texts to the consistent form; keeps what it found of each token."""

    def __init__(self, keep: int = 1 << 18):
        self.keep, self.votes, self.spelt = keep, {}, {}

    def _vote(self, token: str) -> int:
        """The place in SCRIPTS of the only script that spells the token, or -1."""
        if len(self.votes) > self.keep:
            self.votes.clear()
        s = scripts_of(unicodedata.normalize("NFD", token))
        x = next(iter(s)) if len(s) == 1 else None
        v = self.votes[token] = SCRIPTS.index(x) if x in SCRIPTS else -1
        return v

    def _change(self, token: str, order: tuple[int, ...], known: dict[str, str | None]) -> str | None:
        """The token in the first of the scripts that can spell it; None if that is the token as it is."""
        if len(known) > self.keep:
            known.clear()
        marked = unicodedata.normalize("NFD", token)
        held = scripts_of(marked)
        out = unicodedata.normalize("NFC", spell(marked, next((SCRIPTS[k] for k in order if SCRIPTS[k] in held), None)))
        known[token] = out if out != token else None
        return known[token]

    def _letters(self, text: str, marks: bool) -> str:
        """The text with each token in one script; tokens of any script take the one that rules the text."""
        pattern = _TOKEN if marks else _PLAIN_TOKEN
        tokens, votes, said = Counter(pattern.findall(text)), [0] * len(SCRIPTS), self.votes.get
        for t, n in tokens.items():
            k = said(t)
            if k is None:
                k = self._vote(t)
            if k >= 0:
                votes[k] += n * len(t)
        order = tuple(sorted(range(len(SCRIPTS)), key=lambda k: (-votes[k], k)))
        known = self.spelt.setdefault(order, {})
        other = {}
        for t in tokens:
            to = known[t] if t in known else self._change(t, order, known)
            if to is not None:
                other[t] = to
        return pattern.sub(lambda m: other.get(m[0], m[0]), text) if other else text

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if rare := _RARE.search(text):
            text = _BLANK.sub(" ", _FORM.sub(lambda m: _FORMS.get(ord(m[0]), m[0]), _DROP.sub("", text)).replace("\r\n", "\n"))
        if rare or (_CYRILLIC.search(text) and (_ROMAN.search(text) or not _DECISIVE.search(text))):
            text = self._letters(text, bool(rare))
        if rare:
            text = unicodedata.normalize("NFC", text)
        return (_LINE_END.sub("", text) if " \n" in text else text).strip()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def consistent_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): each whole text in the consistent form; null stays null, blank becomes empty.

    Hidden characters go, wide forms and joined letters become plain ones, all blanks become spaces, accents
    are composed. Each token (letters with their accents) is spelt in the one script that can spell all of
    its letters; where several can, in that of them which rules the text (its other tokens decide, and they
    are the same in texts that look the same). Letters, digits and case that look different stay. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Consistent()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(form, b.column(1).to_pylist()), pa.string())], names=["doc_id", "text"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, text string")


def same_looking(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, look BINARY, spelling BINARY): 128-bit digests of the consistent form and of the text itself.

    Null, empty and blank texts have no row. Two texts look the same when `look` is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Consistent()
        for b in batches:
            rows = [(i, _digest(shown), _digest(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None and (shown := form(t))]
            cols = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (b.column(0).type, pa.binary(), pa.binary()))], names=["doc_id", "look", "spelling"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, look binary, spelling binary")


def _variants(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """same_looking() of the looks that have several spellings, and (look, spelling) of those, each once."""
    rows = stored(same_looking(docs, doc_id, text), "looks")
    many = rows.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("look")
    kept = stored(rows.join(many, "look", "left_semi"), "variants")
    return kept, kept.select("look", "spelling").distinct()


def same_looking_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts look the same but aren't the same string.

    Looks with one spelling only (all unlike texts and all plain copies, however many) leave before the join:
    one combinable aggregate finds the looks that have several. Spellings meet first, each once, then their
    documents are put in, so plain copies are never compared; the output is the pairs asked for, and adaptive
    execution splits a large one.
    """
    kept, spellings = _variants(docs, doc_id, text)
    two = spellings.withColumnRenamed("spelling", "sa").join(spellings.withColumnRenamed("spelling", "sb"), "look").where("sa < sb")
    a, b = (kept.select("look", F.col("spelling").alias(f"s{n}"), F.col("doc_id").alias(n)) for n in "ab")
    pairs = two.join(a, ["look", "sa"]).join(b, ["look", "sb"])
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def same_looking_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_docs, n_spellings): documents that look the same share the least doc_id of their class.

    A row for each document of a look with several spellings; the size of the output is that of the input at most.
    """
    kept, spellings = _variants(docs, doc_id, text)
    size = kept.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"))
    return kept.join(size, "look").join(spellings.groupBy("look").agg(F.count("*").alias("n_spellings")), "look").select("doc_id", "class_id", "n_docs", "n_spellings")
