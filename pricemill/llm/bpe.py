"""Byte-level BPE of a whole corpus by prefix-sharing trie traversal."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into words before merges, as the vocabulary's publisher gives it.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of chunks, words and ids that a worker keeps between batches, about; beyond it the store starts anew (speed only).
KEEP_BYTES = 192 << 20
#: What an entry of the store's tables takes beside its text and ids, about.
ENTRY_BYTES = 160


class PrefixEncoder:
    """Encodes sets of words; encodings of shared prefixes are computed once.

    The BPE encoding of a prefix p is the encoding of p without its last token t, followed by t; so one
    last token per trie node holds the encodings of all prefixes. t is the one suffix of p that is a token
    and whose join with the last token before it stays two tokens under the merge rules.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: join the adjacent pair of lowest rank until none is left."""
        parts, rank = [word[i : i + 1] for i in range(len(word))], self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, last: bytes | None, token: bytes) -> bool:
        if last is None:
            if (ok := self.whole.get(token)) is None:
                ok = self.whole[token] = self.merged(token) == [token]
            return ok
        key = (last, token)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(last + token) == [last, token]
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each word. Sorted words visit their trie depth first: the path shared with the word before stays."""
        out, before = {}, b""
        last: list[bytes | None] = [None]  # last[d]: the last token of the encoding of the path's first d bytes
        for word in sorted(set(words)):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                for begin in range(max(0, end - self.longest), end):
                    token = word[begin:end]
                    if token in self.ranks and self._fits(last[begin], token):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            ids, end = [], len(word)
            while end:
                token = last[end]
                ids.append(self.ranks[token])
                end -= len(token)
            out[word] = ids[::-1]
            before = word
        return out


@cache
def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a rank file (a line: base64 of a token, its id)."""
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class Growing:
    """A numeric array that is appended to; its capacity doubles, so that appending copies each value twice at most."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.room):
            room = np.empty(max(need, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : need] = more
        self.n = need


class ChunkStore:
    """Ids of text chunks, kept by a worker: all ids in one pool, a slot (start, length) for each chunk."""

    def __init__(self, path: str):
        self.encoder, self.word = encoder(path), regex.compile(WORD_PATTERN)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}
        self.pool, self.start, self.size = Growing(np.int32), Growing(np.int64), Growing(np.int64)
        self.held = 0

    def slots(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in dict.fromkeys(chunks) if c not in self.slot]
        if new:
            parts = [self.word.findall(c) for c in new]
            fresh = {w.encode("utf-8", "surrogatepass") for ws in parts for w in ws if w not in self.words}
            self.words.update((w.decode("utf-8", "surrogatepass"), ids) for w, ids in self.encoder.encode_words(list(fresh)).items())
            rows = [[i for w in ws for i in self.words[w]] for ws in parts]
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            self.start.extend(self.pool.n + np.cumsum(size) - size)
            self.size.extend(size)
            self.pool.extend(np.fromiter((i for r in rows for i in r), np.int32, int(size.sum())))
            # letters may take 4 bytes each; a word's ids are a list of 8 bytes each beside their 4 in the pool
            self.held += 4 * (sum(map(len, new)) + sum(map(len, fresh))) + 12 * int(size.sum()) + ENTRY_BYTES * (len(new) + len(fresh))
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
        return np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))


@cache
def _store(path: str) -> ChunkStore:
    return ChunkStore(path)


def _chunk_slots(store: ChunkStore, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the chunks of all texts, and how many chunks each text has.

    A blank directly before a visible character always starts a word, so texts are cut there and each
    distinct chunk is encoded once. Pieces that are empty or begin with white space stay with the piece
    before, as there the words cross the blank.
    """
    lists = pc.split_pattern(text, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    enc = flat.dictionary_encode()
    kinds, which = enc.dictionary.to_pylist(), enc.indices.to_numpy()
    slots = store.slots([" " + k for k in kinds])[which]
    heads = offsets[:-1]
    slots[heads] = store.slots([kinds[i] for i in which[heads]])
    glued = np.array([not k or k[0].isspace() for k in kinds], bool)[which]
    glued[heads] = False
    if not glued.any():
        return slots, np.diff(offsets)
    first = np.zeros(len(which), bool)
    first[heads] = True
    own = np.flatnonzero(~glued)
    ends = np.append(own[1:], len(which))
    many = np.flatnonzero(ends - own > 1)
    slots[own[many]] = store.slots([" " * (not first[a]) + " ".join([kinds[i] for i in which[a:b]]) for a, b in zip(own[many], ends[many])])
    upto = np.concatenate([[0], np.cumsum(~glued)])
    return slots[own], np.diff(upto[offsets])


def encode_batch(path: str, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the number of ids of each text); null counts as empty."""
    store = _store(path)
    if store.held > KEEP_BYTES:
        store.clear()
    if not len(text):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    slots, count = _chunk_slots(store, text)
    size = store.size.room[slots]
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(store.start.room[slots] - upto[:-1], size)
    at += np.arange(upto[-1])
    ends = np.concatenate([[0], np.cumsum(count)])
    return store.pool.room[at], np.diff(upto[ends])


def _texts(column: pa.Array) -> Iterator[pa.Array]:
    """Pieces of a column of about 16 MB of text, so that a batch's index arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) >> 24
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        yield pc.fill_null(column.slice(a, b - a), "")


def encode_corpus(docs: DataFrame, path: str = DEFAULT_RANKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids ARRAY<INT>): ids of each document's whole text under the byte BPE of the rank file.

    No shuffle: each task cuts its texts into chunks in Arrow, puts the distinct words that its worker
    hasn't met into the trie, and gathers ids by slot. Null, empty: an empty list. Special tokens' strings
    are ordinary text. Every row gives a row; repeated rows, other columns and an empty table do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for part in _texts(b.column(1)):
                ids, n = encode_batch(path, part)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(part)), pa.ListArray.from_arrays(ends, pa.array(ids))], names=["doc_id", "ids"])
                row += len(part)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], path: str = DEFAULT_RANKS, text: str = "text") -> DataFrame:
    """The columns `keep` and n_tokens BIGINT of each row's text; null and empty texts have 0."""
    from pyspark.sql import types as T

    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [encode_batch(path, part)[1] for part in _texts(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate([np.empty(0, np.int64), *n]))], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema.fields if f.name != "__text"), T.StructField("n_tokens", T.LongType())]))
