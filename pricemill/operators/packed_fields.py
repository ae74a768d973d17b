"""Several values packed in one field: dialects chosen by minimum description length."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: name -> delimiters; a blank delimits only before a URL.
DIALECTS = {
    "mixed": (",", ";", "|", "\t", "\n", "/", " "),
    "comma": (",",),
    "semicolon": (";",),
    "bar": ("|",),
    "tab": ("\t",),
    "line": ("\n",),
    "slash": ("/",),
    "blank": (" ",),
    "whole": (),
}
#: Bits for naming a dialect, for a separator, for each character of a code never seen (more if some dialect's
#: delimiter), for each letter or digit that a shape leaves open, and for using a coarser code.
DIALECT_BITS, SEPARATOR_BITS, CHARACTER_BITS, DELIMITER_BITS, OPEN_BITS, LEVEL_BITS = 3.2, 2.0, 4.0, 10.0, 4.5, 3.0

_URL = re.compile(r"https?://", re.I)
_NEXT_URL = re.compile(r"[\s,;|/\"]*(?:https?://|$)", re.I)
_OPEN, _CLOSE = "([{", ")]}"
_INK = re.compile(r"\s*")


def read_json(text: str) -> list[str] | None:
    """The items if text is a JSON list of plain values."""
    t = text.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    try:
        items = json.loads(t)
    except ValueError:
        return None
    if not isinstance(items, list) or any(isinstance(x, (dict, list)) for x in items):
        return None
    return [s for x in items if x is not None and (s := (x if isinstance(x, str) else json.dumps(x)).strip())]


def _closing(text: str, at: int) -> tuple[int, str] | None:
    """Where the quoted value that opens at `at` ends, and its content; None where nothing closes it."""
    quote, i, out = text[at], at + 1, []
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in (quote, "\\"):
            out.append(text[i + 1])
            i += 2
        elif c == quote and text[i + 1 : i + 2] == quote:
            out.append(quote)
            i += 2
        elif c == quote:
            return i + 1, "".join(out)
        else:
            out.append(c)
            i += 1
    return None


@cache
def _stops(delimiters: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of the characters at which a value, and a URL, may end or change its state."""
    marks = "".join(re.escape(d) for d in delimiters if d != " ")
    blank = r"\s" if " " in delimiters else ""
    return re.compile(rf"[{marks}{blank}()\[\]{{}}]"), re.compile(rf"[{marks}{blank}]" if marks or blank else r"(?!)")


def split_field(text: str, delimiters: tuple[str, ...]) -> list[str]:
    """Values of a field in one dialect.

    What is in quotes is one value (doubled or escaped quotes are one); decimal commas, anything in brackets,
    slashes without blanks on both sides and punctuation inside a URL don't separate. Outer white space and
    empty values go. Goes from mark to mark, not by character.
    """
    values: list[str] = []
    plain, in_url = _stops(delimiters)
    n, at = len(text), 0
    while at < n:
        # at a value's start: blanks, then a quote, a URL or plain text
        start = _INK.match(text, at).end()
        if start == n:
            break
        c = text[start]
        if c in "\"'" and (hit := _closing(text, start)):
            stop, content = hit
            after = _INK.match(text, stop).end()
            gap, last = text[stop:after], text[after : after + 1]
            if not last or last in delimiters or ("\n" in gap and "\n" in delimiters) or ("\t" in gap and "\t" in delimiters) or (" " in delimiters and (last == '"' or _URL.match(text, after))):
                if content := content.strip():
                    values.append(content)
                at = after + (last != "" and last in delimiters)
                continue
        i, depth, end = start, 0, n
        if _URL.match(text, start):
            while m := in_url.search(text, i):
                i = m.start()
                if _NEXT_URL.match(text, i):
                    end = i
                    break
                i += 1
        else:
            while m := plain.search(text, i):
                i, c = m.start(), m[0]
                if c in _OPEN:
                    depth += text.find(_CLOSE[_OPEN.index(c)], i) > 0
                elif c in _CLOSE:
                    depth -= depth > 0
                elif not depth and c in delimiters and c != " ":
                    left, right = text[i - 1 : i], text[i + 1 : i + 2]
                    if not (c == "," and left.isdigit() and right.isdigit()) and (c != "/" or (left.isspace() and right.isspace())):
                        end = i
                        break
                elif not depth and c.isspace() and i > start and _URL.match(text, i + 1):
                    end = i
                    break
                i += 1
        if value := text[start:end].strip():
            values.append(value)
        at = end + 1
    return values


_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_OPEN_WORDS = re.compile(r"[AN](?:[ .-]*[AN])*")
#: A word is kept in shapes if it is one of this many of its field's words, so at most as many are kept.
KEPT_WORDS = 500
#: Bounds of a code book: codes of each level of a field, and characters of a code; others are looked up by joins.
MOST_CODES, LONGEST_CODE = 20_000, 200


def codes(value: str, kept: frozenset[str] = frozenset()) -> tuple[str, str, str, int]:
    """Code names of a value from fine to coarse, and how many letters and digits the shapes leave open.

    The value itself; its shape, with frequent words kept, other words A and numbers N; its shape with runs of
    those as one.
    """
    open_ = 0

    def word(m: re.Match) -> str:
        nonlocal open_
        if m[0] in kept:
            return m[0]
        open_ += len(m[0])
        return "A"

    shape = _LETTERS.sub(word, value.lower())
    open_ += sum(map(str.isdigit, shape))
    shape = _DIGITS.sub("N", shape)
    return value, shape, _OPEN_WORDS.sub("W", shape), open_


def candidates(text: str) -> list[tuple[str, list[str]]]:
    """The different parses of a field, each with the first dialect that gives it; JSON leaves no other."""
    if (items := read_json(text)) is not None:
        return [("json", items)]
    out: dict[tuple[str, ...], str] = {}
    here, done = set(text), set()
    for name, delimiters in DIALECTS.items():
        # dialects that share the delimiters which occur read the field alike
        occur = tuple(d for d in delimiters if d in here)
        if occur not in done:
            done.add(occur)
            out.setdefault(tuple(split_field(text, occur)), name)
    return [(name, list(values)) for values, name in out.items()]


def _parses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, field, dialects, parses): all different parses of each field."""
    for b in batches:
        out = [(i, f, *map(list, zip(*candidates(t)))) for i, f, t in zip(*(c.to_pylist() for c in b.columns)) if t is not None]
        cols = zip(*out) if out else ([],) * 4
        kinds = (b.column(0).type, pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "field", "dialects", "parses"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, word, n), counted per batch before they leave the task."""
    for b in batches:
        values = Counter((f, v) for f, vs in zip(b.column("field").to_pylist(), b.column("vals").to_pylist()) for v in vs)
        count: Counter = Counter()
        for (f, v), n in values.items():
            for w in _LETTERS.findall(v.lower()):
                count[f, w] += n
        f, w = zip(*count) if count else ([],) * 2
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(w, pa.string()), pa.array(list(count.values()), pa.int64())], names=["field", "word", "n"])


def _code_rows(kept: dict[str, frozenset[str]]):
    """(field, level, code, n) of all values, counted per batch before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = Counter((f, v) for f, vs in zip(b.column("field").to_pylist(), b.column("vals").to_pylist()) for v in vs)
            count: Counter = Counter()
            for (f, v), n in values.items():
                for level, code in enumerate(codes(v, kept.get(f, frozenset()))[:3]):
                    count[f, level, code] += n
            f, level, code = zip(*count) if count else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(level, pa.int32()), pa.array(code, pa.string()), pa.array(list(count.values()), pa.int64())], names=["field", "level", "code", "n"])

    return run


def _digest(code: str) -> bytes:
    """As Spark's unhex(md5(code))."""
    return hashlib.md5(code.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _open_codes(books: dict[str, tuple], kept: dict[str, frozenset[str]]):
    """(id, field, level, digest): the codes in the parses of each field that its book lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, field, level, digest = [], [], [], []
            for i, (f, ps) in enumerate(zip(b.column("field").to_pylist(), b.column("parses").to_pylist())):
                bits, k = books[f][0], kept.get(f, frozenset())
                for key in {(n, c) for v in {v for p in ps for v in p} for n, c in enumerate(codes(v, k)[:3])}:
                    if key not in bits:
                        at.append(i)
                        field.append(f)
                        level.append(key[0])
                        digest.append(_digest(key[1]))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(level, pa.int32()), pa.array(digest, pa.binary())], names=["id", "field", "level", "digest"])

    return run


class CodeBook:
    """Bits of a field's values: of three codes the cheapest, with what the code leaves open.

    rare holds counts of codes that the book lacks, by level and digest, for the field at hand.
    """

    def __init__(self, bits: dict[tuple[int, str], float], totals: dict[int, float], kept: frozenset[str], memory: int = 1 << 16):
        self.bits, self.totals, self.kept, self.memory, self.known, self.rare = bits, totals, kept, memory, {}, {}
        self.unseen = [log2(totals.get(level, 1) + 2) for level in range(3)]

    def of(self, value: str) -> float:
        if (best := self.known.get(value)) is None:
            *names, open_ = codes(value, self.kept)
            best = float("inf")
            for level, code in enumerate(names):
                b = self.bits.get((level, code))
                if b is None and self.rare and (n := self.rare.get((level, _digest(code)))):
                    b = -log2(n / self.totals[level])
                if b is None:
                    if not level:  # a value never seen has no code of its own
                        continue
                    # a shape never seen is spelt out
                    b = self.unseen[level] + CHARACTER_BITS * len(code) + DELIMITER_BITS * sum(map(code.count, ",;|\t\n"))
                best = min(best, b + level * LEVEL_BITS + (OPEN_BITS * open_ if level else 0))
            if len(self.known) > self.memory:
                self.known.clear()
            self.known[value] = best
        return best

    def parse(self, values: list[str]) -> float:
        return DIALECT_BITS + SEPARATOR_BITS * max(0, len(values) - 1) + sum(map(self.of, values))


def _choose(books: dict[str, tuple], kept: dict[str, frozenset[str]]):
    """The cheapest parse of each field that has several; ties go to the dialect named first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {f: CodeBook(*books.get(f, ({}, {})), k) for f, k in kept.items()}
        for b in batches:
            dialect, values = [], []
            for f, ds, ps, rare in zip(*(b.column(c).to_pylist() for c in ("field", "dialects", "parses", "rare"))):
                ready[f].rare = {(r["level"], r["digest"]): r["n"] for r in rare or ()}
                at = min(range(len(ps)), key=lambda k: (round(ready[f].parse(ps[k]), 6), k))
                dialect.append(ds[at])
                values.append(ps[at])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("field"), pa.array(dialect, pa.string()), pa.array(values, pa.list_(pa.string()))], names=["id", "field", "dialect", "vals"])

    return run


def choose_dialects(df: DataFrame, row_id: str, fields: list[str], rounds: int = 2) -> DataFrame:
    """(id, field, dialect, vals ARRAY<STRING>): each non-null field in its cheapest dialect.

    The code table counts each value and its two shapes, in the first round over all fields that read alike in
    every dialect, in the next over all fields as then chosen. A parse costs its dialect, its separators and for
    each value the cheapest of its three codes: -log2 of the code's share (a shape never seen: its characters)
    and what the code leaves open. Counting is combined in the tasks; the books that go to the tasks hold codes
    with at least one in MOST_CODES of their level's values, of LONGEST_CODE characters at most, so their size
    has a bound. They only save work: codes that they lack are joined from the counts to the fields whose
    parses have them, so every code counts at every size.
    """
    stack = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    rows = df.select(F.col(row_id).alias("id"), F.expr(f"stack({len(fields)}, {stack}) as (field, text)")).where("text IS NOT NULL")
    id_type = rows.schema["id"].dataType.simpleString()
    parses = stored(rows.mapInArrow(_parses, f"id {id_type}, field string, dialects array<string>, parses array<array<string>>"), "parses")
    several = parses.where(F.size("parses") > 1)
    # a field with one parse needs no price and no Python
    alone = parses.where(F.size("parses") <= 1).select("id", "field", F.col("dialects")[0].alias("dialect"), F.col("parses")[0].alias("vals"))
    read = alone.select("field", "vals")

    words = stored(read.mapInArrow(_words, "field string, word string, n long").groupBy("field", "word").agg(F.sum("n").alias("n")), "words")
    least = words.groupBy("field").agg((F.sum("n") / KEPT_WORDS).alias("least"))  # a row a field
    kept: dict[str, set[str]] = {f: set() for f in fields}
    for r in words.join(F.broadcast(least), "field").where("n >= least").collect():  # KEPT_WORDS a field at most
        kept[r.field].add(r.word)
    frozen = {f: frozenset(w) for f, w in kept.items()}

    for turn in range(rounds):
        counted = read.mapInArrow(_code_rows(frozen), "field string, level int, code string, n long").groupBy("field", "level", "code").agg(F.sum("n").alias("n"))
        counted = stored(counted, "codes")
        totals = counted.groupBy("field", "level").agg(F.sum("n").alias("total"))  # three rows a field
        # a code that one value of an earlier choice has alone would only confirm that choice
        seen = counted.join(F.broadcast(totals), ["field", "level"]).where(f"n > {int(turn > 0)}")
        in_book = f"length(code) <= {LONGEST_CODE} AND n >= total / {MOST_CODES}"
        books: dict[str, tuple] = {f: ({}, {}) for f in fields}
        for r in seen.where(in_book).collect():  # MOST_CODES for each level of a field at most
            books[r.field][0][r.level, r.code] = -log2(r.n / r.total)
        for r in totals.collect():
            books[r.field][1][r.level] = r.total
        rare = seen.where(f"NOT ({in_book})").select("field", "level", F.unhex(F.md5("code")).alias("digest"), "n")
        hits = "array<struct<level:int,digest:binary,n:bigint>>"
        if rare.isEmpty():
            priced = several.withColumn("rare", F.lit(None).cast(hits))
        else:
            lacking = several.mapInArrow(_open_codes(books, frozen), f"id {id_type}, field string, level int, digest binary")
            found = lacking.join(rare, ["field", "level", "digest"]).groupBy("id", "field").agg(F.collect_list(F.struct("level", "digest", "n")).cast(hits).alias("rare")).withColumnsRenamed({"id": "i", "field": "f"})  # of one field's own codes
            priced = several.join(found, several["id"].eqNullSafe(found["i"]) & (several["field"] == found["f"]), "left").drop("i", "f")
        chosen = priced.mapInArrow(_choose(books, frozen), f"id {id_type}, field string, dialect string, vals array<string>")
        chosen = alone.unionAll(chosen)
        read = chosen if turn == rounds - 1 else stored(chosen, "read")
    return read


def unpack_fields(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(id, field, pos BIGINT, val STRING): one row for each value, pos from 1 within the field.

    Null and blank fields give no row, repeated values all count, row_id must be unique. An empty table gives
    an empty result; other columns are not read, whatever their names.
    """
    chosen = choose_dialects(df, row_id, fields)
    return chosen.select("id", "field", F.posexplode("vals").alias("pos", "val")).select("id", "field", (F.col("pos") + 1).cast("long").alias("pos"), "val")
