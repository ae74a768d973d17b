"""Which configured models a product name mentions: one walk over the name, whatever the number of models."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: Key of a trie node under which the models that end there are listed.
_END = None


def model_pattern(brand: str, model: str) -> str:
    """A pattern for a model's name with any separators or none between its words."""
    tokens = f"{brand or ''} {model or ''}".split()
    return r"(?<![A-Za-z0-9])" + r"[\W_]*".join(map(re.escape, tokens)) + r"(?![A-Za-z0-9])" if tokens else ""


def _add(trie: dict, path: Iterable, model: int) -> None:
    for step in path:
        trie = trie.setdefault(step, {})
    ends = trie.setdefault(_END, [])
    if model not in ends:
        ends.append(model)


class Lexicon:
    """The models of a configuration, ready for names.

    Own patterns are compiled, as each has its own syntax. All other models lie in one trie of letters, where a
    step "" stands for any separators between two words of the model. The word sequences that stand for a model
    (brand and name, the name, its telling ends) lie in one trie of words.
    """

    def __init__(self, models: list[dict]):
        self.tags = [[t for t in m.get("tags") or [] if t] for m in models]
        self.patterns: list[tuple[int, re.Pattern]] = []
        self.letters: dict = {}
        self.words: dict = {}
        self.whole: list[list[str]] = []
        self.by_word: dict[str, list[int]] = {}
        for i, m in enumerate(models):
            brand, name = m.get("brand") or "", m.get("name") or ""
            pattern = m.get("pattern")
            if pattern and pattern != model_pattern(brand, name):
                try:
                    self.patterns.append((i, re.compile(pattern, re.I)))
                except re.error:
                    pass  # a model with a broken pattern still has its words
            elif parts := f"{brand} {name}".lower().split():
                _add(self.letters, [c for k, p in enumerate(parts) for c in ([""] if k else []) + list(p)], i)
            own = list(dict.fromkeys(_WORD.findall(name.lower())))
            whole = list(dict.fromkeys(_WORD.findall(brand.lower()) + own))
            self.whole.append(whole)
            for sequence in [whole, *(own[k:] for k in range(len(own)) if k == 0 or self._tells(own[k:]))]:
                if sequence:
                    _add(self.words, sequence, i)
            if whole:
                self.by_word.setdefault(max(whole, key=len), []).append(i)

    @staticmethod
    def _tells(end: list[str]) -> bool:
        """An end of two words or more must begin with a letter somewhere in its first; one word alone needs letters and digits."""
        first = end[0]
        lettered = any(c.isalpha() for c in first)
        return lettered if len(end) > 1 else lettered and len(first) >= 3 and any(c.isdigit() for c in first)

    def _spelt(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, model) of names spelt with any separators, for each model from left to right without overlap."""
        alnum = [c.isascii() and c.isalnum() for c in text]
        loose = [not (c.isalnum()) for c in text]
        free: dict[int, int] = {}
        for start, c in enumerate(text):
            if c not in self.letters or (start and alnum[start - 1]):
                continue
            best: dict[int, int] = {}
            todo = [(self.letters, start)]
            while todo:
                node, at = todo.pop()
                if _END in node and not (at < len(text) and alnum[at]):
                    for m in node[_END]:
                        best[m] = max(at, best.get(m, 0))
                if "" in node:
                    todo.append((node[""], at))
                    stop = at
                    while stop < len(text) and loose[stop]:
                        stop += 1
                        todo.append((node[""], stop))
                if at < len(text) and text[at] in node:
                    todo.append((node[text[at]], at + 1))
            for m, end in best.items():
                if start >= free.get(m, 0):
                    free[m] = end
                    yield start, end, m

    def mentions(self, text: str) -> tuple[set[tuple[int, int, int]], set[tuple[int, int, int]]]:
        """(start, end, model) of the mentions by pattern or spelling, and by words of the models that have none such."""
        low = text.lower()
        exact = {(x.start(), x.end(), i) for i, p in self.patterns for x in p.finditer(text) if x.end() > x.start()}
        exact.update(self._spelt(low) if len(low) == len(text) else ())
        told = {m for *_, m in exact}
        found = list(_WORD.finditer(low))
        by_words = set()
        for k in range(len(found)):
            node = self.words
            for w in found[k:]:
                node = node.get(w[0])
                if node is None:
                    break
                by_words.update((found[k].start(), w.end(), m) for m in node.get(_END, ()) if m not in told)
        return exact, by_words

    def of(self, text: str | None) -> list[str]:
        """Sorted tags of every model mentioned in no longer mention; if none is, of the model whose words occur in order, gaps allowed.

        A mention by words doesn't hide one by pattern. Of models in loose order the one of most words, then
        letters, then the first listed counts. Null and empty texts have none.
        """
        exact, by_words = self.mentions(text or "")
        kept = _outermost(exact, exact) | _outermost(by_words, exact | by_words)
        models = {m for *_, m in kept}
        if not models:
            words = _WORD.findall((text or "").lower())
            loose = [m for w in set(words) for m in self.by_word.get(w, ()) if _in_order(self.whole[m], words)]
            models = set(sorted(loose, key=lambda m: (-len(self.whole[m]), -sum(map(len, self.whole[m])), m))[:1])
        return sorted({t for m in models for t in self.tags[m]})

    def longest(self, text: str | None) -> str | None:
        """The longest stretch of the text that a pattern or spelling matches, the first of equals."""
        exact, _ = self.mentions(text or "")
        best = min(((a - z, a) for a, z, _ in exact), default=None)
        return text[best[1] : best[1] - best[0]] if best else None


def _in_order(sequence: list[str], words: list[str]) -> bool:
    at = iter(words)
    return bool(sequence) and all(s in at for s in sequence)


def _outermost(mine: set[tuple[int, int, int]], hiding: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Those of mine whose stretch lies in no other, longer stretch of hiding: one sweep from left to right."""
    far, inner = -1, set()
    for start, end in sorted({(a, -z) for a, z, _ in hiding}):
        if -end <= far:
            inner.add((start, -end))
        far = max(far, -end)
    return {m for m in mine if m[:2] not in inner}


def match_models(df: DataFrame, name: str, models: list[dict], out: str = "model_tags") -> DataFrame:
    """df with the model tags of each name; no shuffle, equal names of a batch are looked up once.

    models: brand, name, tags and perhaps pattern; a configured list, sent to the workers with the plan.
    """

    @F.pandas_udf("array<string>")
    def tags(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(models)
        for s in names:
            known = {x: lexicon.of(x) for x in s.dropna().unique()}
            yield s.map(lambda x: known.get(x, []))

    return df.withColumn(out, tags(name))
