"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts each text into chunks (content decides, so equal passages of different
texts fall into equal chunks). Inside a chunk, what lies between its first and last white space is its core. Cores
that occur more than once in the corpus are encoded once, by the text that owns the first occurrence, and their ids
travel to all others; other cores are encoded where they are. A chunk join (from the last white space before a cut to
the first one behind it) is repaired by encoding it anew. Where the tokenizer is one whose pre-tokeniser never crosses
white space (added tokens hold none, normalisation doesn't compose across it), the tokens of core and join agree with
the whole text's by that. With any other tokenizer the agreement is tested at both ends of each reused core: what
stands some 64 bytes before and behind must have the same ids together as apart; a text that fails is encoded whole.
A cut without white space near it lengthens the join up to the next one; very long words thus stay whole.

Only hashes of chunks are counted; texts are shuffled once, each different text once, whatever its number of copies.
Null texts are empty and have no ids. Rows with equal ids are encoded on their own; other columns are never read.
The tokenizer is a parameter (a tokenizers file); its path must be readable on the executors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import distinct_texts, free_names, lean, text_key, written
from .words import slices

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
#: Characters for which str.lower() and Python's classes agree with the tokenizer's, and that NFC leaves alone.
_PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-įı-ɏ]*")
_GEAR = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
#: Words whose ids a task remembers at most (some 120 bytes each).
REMEMBERED = 200_000
#: Bytes of text that are encoded at once.
AT_ONCE = 500_000


def _parts(sequence: object, name: str) -> list[str]:
    """Kinds of the members of a normalizer or pre-tokenizer that is a sequence."""
    return [x["type"] for x in json.loads(sequence.__getstate__()).get(name, [])] if sequence is not None else []


class Encoder:
    """Ids of a piece of text. Plain pieces go word by word through a memory of words; all others through the tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.by_word = _parts(self.whole.normalizer, "normalizers") == ["NFC", "Replace", "Lowercase"] and _parts(self.whole.pre_tokenizer, "pretokenizers") == ["Split", "ByteLevel"]
        #: Which ids end a pre-token, where the model marks that.
        mark = getattr(self.whole.model, "end_of_word_suffix", None)
        self.word_end = np.array([self.whole.id_to_token(i).endswith(mark) for i in range(self.whole.get_vocab_size())]) if self.by_word and mark else None
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, int] = {}  # number of each known word
        self.ids, self.ends = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64)  # ids of all known words; where those of each end, after a 0

    def learn(self, words: list[str]) -> None:
        """Remembers new words. A word of letters is one pre-token, and so is the punctuation behind it: each is encoded once."""
        ends = [(w, w.rstrip(".,;:!?)")) for w in words if not w.isalpha()]
        parts = {w: (stem, w[len(stem) :]) for w, stem in ends if stem.isalpha() and stem != w} if self.word_end is not None else {}
        new = dict.fromkeys(w for w in words if w not in parts) | {x: None for both in parts.values() for x in both if x not in self.memory}
        letters = [w for w in new if w.isalpha()] if self.word_end is not None else []
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            ids = np.array(self.whole.encode(" ".join(part), add_special_tokens=False).ids, np.int32)
            last = np.flatnonzero(self.word_end[ids])
            self._remember(part, ids, np.diff(last, prepend=-1)) if len(last) == len(part) else self._one_by_one(part)
        self._one_by_one([w for w in new if not w.isalpha() or self.word_end is None])
        both = [[self._known(x) for x in each] for each in parts.values()]
        self._remember(list(parts), np.concatenate([x for each in both for x in each]) if both else np.empty(0, np.int32), [len(x) + len(y) for x, y in both])

    def _one_by_one(self, words: list[str]) -> None:
        for at in range(0, len(words), 1000):  # the library's encodings are large
            part = words[at : at + 1000]
            found = [x.ids for x in self.whole.encode_batch_fast(part, add_special_tokens=False)]
            self._remember(part, np.fromiter(chain.from_iterable(found), np.int32), [len(x) for x in found])

    def _known(self, word: str) -> np.ndarray:
        n = self.memory[word]
        return self.ids[self.ends[n] : self.ends[n + 1]]

    def _remember(self, words: list[str], ids: np.ndarray, sizes: list[int] | np.ndarray) -> None:
        known = len(self.memory)
        used = int(self.ends[known])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids) + len(ids), np.int32)])
        if known + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(words), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.ends[known + 1 : known + 1 + len(words)] = used + np.cumsum(sizes, dtype=np.int64)
        self.memory.update(zip(words, range(known, known + len(words)), strict=True))

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        hard, easy, counts, words = [], [], [], []
        for i, piece in enumerate(pieces):
            if self.by_word and _PLAIN.fullmatch(piece) and not any(s in piece for s in self.special):
                split = piece.lower().split()
                easy.append(i)
                counts.append(len(split))
                words += split
            else:
                hard.append(i)
        missing = list({w for w in words if w not in self.memory})
        if len(self.memory) + len(missing) > REMEMBERED:
            self.forget()
            missing = list(set(words))
        self.learn(missing)
        known = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))
        start, size = self.ends[known], self.ends[known + 1] - self.ends[known]
        end = np.cumsum(size)
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(start - (end - size), size)]
        cuts = np.append(0, end)[np.cumsum(counts, dtype=np.int64)] if counts else []
        for i, found in zip(easy, np.split(ids, cuts[:-1]) if counts else (), strict=True):
            out[i] = found
        for i, found in zip(hard, self.whole.encode_batch_fast([pieces[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, np.int32)
        return out

    def agree(self, before: list[str], after: list[str]) -> list[bool]:
        """Of texts that follow each other, whether their ids are those of both as one. Words decide for themselves where the pre-tokeniser never crosses white space."""
        if self.by_word:
            return [True] * len(before)
        ids = [x.ids for x in self.whole.encode_batch_fast([*before, *after, *map(str.__add__, before, after)], add_special_tokens=False)]
        n = len(before)
        return [ids[i] + ids[n + i] == ids[2 * n + i] for i in range(n)]


class Decoder:
    """Texts of ids. A tokenizer without a decoder joins tokens by spaces, for which their strings are enough."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.tokens = [whole.id_to_token(i) for i in range(whole.get_vocab_size(with_added_tokens=True))]
        self.whole = whole if whole.decoder is not None else None

    def decode(self, ids: np.ndarray) -> str:
        if self.whole is None:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.whole.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The worker's encoder, which knows no word any more once the task ends: an executor keeps idle workers, whose memories would add up."""
    code = encoder(path)
    try:
        yield code
    finally:
        code.forget()


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash of each byte and the 15 before it, in four doublings."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    return h


def cores(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> list[list[tuple[int, int]]]:
    """Of each row of a slice, the cores (start, end) of its chunks; what lies between them are joins."""
    candidates = np.flatnonzero((gear(data) & np.uint64((1 << bits) - 1)) == 0) + 1
    spaces = np.flatnonzero(_SPACE[data])
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        cuts, at = [], start
        own = candidates[np.searchsorted(candidates, start + least) : np.searchsorted(candidates, end)].tolist()
        k = 0
        while end - at > least:
            while k < len(own) and own[k] < at + least:
                k += 1
            at = min(own[k] if k < len(own) else end, at + most)
            if at >= end:
                break
            cuts.append(at)
        where = np.searchsorted(spaces, cuts)
        found, begin = [], start
        for w in where.tolist():
            last = int(spaces[w - 1]) if w and spaces[w - 1] >= start else start
            after = int(spaces[w]) if w < len(spaces) and spaces[w] < end else end
            found.append((begin, max(begin, last)))
            begin = max(begin, after)
        found.append((begin, end))
        out.append(found)
    return out


def _around(raw: bytes, start: int, at: int, end: int, wide: int = 64) -> tuple[str, str]:
    """What stands before and after a place at white space: some `wide` bytes each way, up to white space."""
    low, high = max(start, at - wide), min(end, at + wide)
    while low > start and raw[low] not in b" \t\n\r":
        low -= 1
    while high < end and raw[high] not in b" \t\n\r":
        high += 1
    return raw[low:at].decode(), raw[at:high].decode()


def _core_hash(data: bytes, span: tuple[int, int]) -> bytes:
    return hashlib.blake2b(data[span[0] : span[1]], digest_size=16).digest()


def encode_texts(docs: DataFrame, path: str, text_column: str = "text", bits: int = 10, least: int = 256, most: int = 8192, shareable: int = 64) -> DataFrame:
    """(key, copies, ids): each different text once; key is storage.text_key of the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for i, _, data, offsets in slices(batch.column("text")):
                raw, rows = data.tobytes(), []
                for r, spans in enumerate(cores(data, offsets, bits, least, most)):
                    rows += [(_core_hash(raw, s), keys[i + r], n) for n, s in enumerate(spans) if s[1] - s[0] >= shareable]
                if rows:
                    h, key, n = zip(*rows, strict=True)
                    yield pa.record_batch({"h": pa.array(h, pa.binary()), "key": pa.array(key, pa.binary()), "n": pa.array(n, pa.int32())})

    seen = written(docs.select(text_key(text_column).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(lean(cut), "h binary, key binary, n int").distinct())
    shared = seen.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "n")).alias("owner")).filter("times > 1")
    owners = shared.groupBy(F.col("owner.key").alias("key")).agg(F.collect_list("owner.n").alias("own"))  # at most the chunks of one text
    texts = distinct_texts(docs, text_column)  # read twice below, with the same columns: Spark shuffles it once

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(path) as code:
            for batch in batches:
                own = batch.column("own").to_pylist()
                for i, _, data, offsets in slices(batch.column("text"), AT_ONCE):
                    raw, spans = data.tobytes(), []
                    for r, found in enumerate(cores(data, offsets, bits, least, most)):
                        spans += [found[n] for n in own[i + r]]
                    ids = code.encode([raw[a:b].decode() for a, b in spans])
                    yield pa.record_batch({"h": pa.array([_core_hash(raw, s) for s in spans], pa.binary()), "core_ids": pa.array(ids, pa.list_(pa.int32()))})

    encoded = texts.join(owners, "key").select("key", "copies", "text", "own").mapInArrow(lean(once), "h binary, core_ids array<int>")
    given = seen.join(encoded, "h").groupBy("key").agg(F.collect_list(F.struct("n", "core_ids")).alias("given"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(path) as code:
            for batch in batches:
                given = batch.column("given")
                for i, j, data, offsets in slices(batch.column("text"), AT_ONCE):
                    raw, pieces, plan = data.tobytes(), [], []  # plan: of each row, its parts in order: ids, or numbers of pieces
                    cuts: list = []  # row, and a text's end and start at each of its joins
                    for r, found in enumerate(cores(data, offsets, bits, least, most)):
                        have = given[i + r].values
                        have = {} if have is None else {x["n"].as_py(): x["core_ids"].values.to_numpy() for x in have}
                        parts, pending = [], int(offsets[r])
                        for n, (a, b) in enumerate(found):
                            if n in have:  # what lies before it, join or unshared core, is one piece
                                if a > pending:
                                    parts.append(len(pieces))
                                    pieces.append(raw[pending:a].decode())
                                parts.append(have[n])
                                pending = b
                                if not code.by_word:
                                    cuts += [(r, *_around(raw, int(offsets[r]), at, int(offsets[r + 1]))) for at in (a, b)]
                        at = int(offsets[r + 1])
                        if at > pending:
                            parts.append(len(pieces))
                            pieces.append(raw[pending:at].decode())
                        plan.append(parts)
                    # a text whose parts disagree at a join is encoded anew as a whole
                    for r in {c[0] for c, good in zip(cuts, code.agree([c[1] for c in cuts], [c[2] for c in cuts]), strict=True) if not good} if cuts else ():
                        plan[r] = [len(pieces)]
                        pieces.append(raw[offsets[r] : offsets[r + 1]].decode())
                    ids = code.encode(pieces)
                    rows = [[ids[p] if isinstance(p, int) else p for p in parts] for parts in plan]
                    flat = [x for row in rows for x in row]
                    ends = np.concatenate([[0], np.cumsum([sum(map(len, row)) for row in rows])]).astype(np.int32)
                    values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), batch.column("copies").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), values)], ["key", "copies", "ids"])

    return texts.join(given, "key", "left").select("key", "copies", "text", "given").mapInArrow(lean(whole), "key binary, copies long, ids array<int>")


def decode(frame: DataFrame, path: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """frame with the text of its ids (special tokens included) in `out`; null ids give null. Other columns stay, whatever their names."""
    kept = frame.drop(out)
    schema = type(kept.schema)([*kept.schema.fields]).add(out, "string")
    at_ids = kept.columns.index(ids_column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(at_ids)
                texts = [None if not x.is_valid else code.decode(x.values.to_numpy()) for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=pa.schema([*part.schema, pa.field(out, pa.string())]))

    return kept.mapInArrow(lean(read), schema)


def encode(docs: DataFrame, path: str, text_column: str = "text", **chunking: int) -> DataFrame:
    """docs with ids, as the tokenizer gives them without special tokens added. A row's ids come by the key of its text."""
    plain = docs.drop("ids")
    (key,) = free_names(plain, "key_of_text")
    ids = encode_texts(docs, path, text_column, **chunking).select(F.col("key").alias(key), "ids")
    return plain.withColumn(key, text_key(text_column)).join(ids, key, "left").drop(key)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
