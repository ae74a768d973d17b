"""JSON price lists as a stream: a Spark data source that cuts the list `products` into its elements."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .xlsx import _open

#: Bytes read at once, and characters of elements handed over at once.
BLOCK, BATCH = 1 << 20, 1 << 20
#: A cut-off text fails this near its end: the longest word of JSON, escapes included, is shorter.
_EDGE = 16


def _not_json(word: str):
    raise json.JSONDecodeError("Expecting value", word, 0)


_DECODER = json.JSONDecoder(parse_constant=_not_json)


class _Text:
    """A file's text, of which only what isn't read yet is held."""

    def __init__(self, f):
        self.f, self.decoder, self.text, self.at, self.done, self.ahead = f, codecs.getincrementaldecoder("utf-8-sig")(), "", 0, False, BLOCK

    def more(self) -> None:
        block = self.f.read(self.ahead)
        self.done = not block
        self.text, self.at = self.text[self.at :] + self.decoder.decode(block, self.done), 0

    def peek(self) -> str:
        """The next character that isn't white space; nothing at the file's end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\n\r":
                self.at += 1
            if self.at < len(self.text) or self.done:
                return self.text[self.at : self.at + 1]
            self.more()

    def take(self, *expected: str) -> str:
        c = self.peek()
        if c not in expected:
            raise ValueError(f"not JSON: {' or '.join(expected)} missing before {self.text[self.at : self.at + 40]!r}")
        self.at += 1
        return c

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        self.ahead = BLOCK
        while True:
            try:
                found, end = _DECODER.raw_decode(self.text, self.at)
                if end < len(self.text) or self.done:
                    text, self.at, self.ahead = self.text[self.at : end], end, BLOCK
                    return found, text
            except json.JSONDecodeError as e:
                cut = e.doc is self.text and (e.pos >= len(self.text) - _EDGE or e.msg.startswith("Unterminated string"))
                if self.done or not cut:
                    raise ValueError(f"not JSON: {e.msg} near {self.text[self.at : self.at + 40]!r}") from e
            self.ahead *= 2  # a long value is read anew a few times only
            self.more()

    def elements(self) -> Iterator[tuple[object, str]]:
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.take(",", "]") == "]":
                return


def products(f) -> Iterator[str | None]:
    """Null once the list `products` is found, then the text of each object in it, in order; the whole file is checked.

    Raises ValueError where the text isn't JSON.
    """
    text = _Text(f)
    if text.peek() != "{":
        text.value()
    else:
        text.take("{")
        end = text.peek() == "}" and text.take("}")
        while not end:
            if text.peek() != '"':
                text.take('"')
            key = text.value()[0]
            text.take(":")
            if text.peek() == "[":
                wanted = key == "products"
                if wanted:
                    yield None
                for found, item in text.elements():
                    if wanted and isinstance(found, dict):
                        yield item
            else:
                text.value()
            end = text.take(",", "}") == "}"
    if text.peek():
        raise ValueError(f"not JSON: text after its end: {text.text[text.at : text.at + 40]!r}")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        def batch(items: list, error: str | None = None):
            return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([error] * len(items), pa.string())], names=["item", "error"])

        items: list[str | None] = []
        size = 0
        try:
            with _open(partition.value) as f:
                for item in products(f):
                    items.append(item)
                    size += len(item or "")
                    if size >= BATCH:
                        yield batch(items)
                        items, size = [], 0
        except (ValueError, RecursionError) as e:  # the file's own trouble, for the driver to tell
            yield batch([None], str(e) or "not JSON")
        if items:
            yield batch(items)


class JsonProducts(DataSource):
    """format("json_products").option("paths", a JSON list of files): (item, error), a task a file."""

    @classmethod
    def name(cls):
        return "json_products"

    def schema(self):
        return "item string, error string"

    def reader(self, schema):
        return _Reader(json.loads(self.options["paths"]))
