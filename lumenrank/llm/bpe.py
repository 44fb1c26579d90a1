"""BPE encoding and decoding with reuse of content-defined chunks.

Chunks. A rolling (gear) hash over the last ``WINDOW`` UTF-8 bytes cuts a text
wherever its low bits are zero, so equal passages of different documents fall
into equal chunks, wherever they stand. A chunk's encoding is kept in a bounded
cache of the Python worker, and the next document with that chunk takes it from
there. Entries are keyed by the bytes themselves, so no digest can mislead.

Joins. A chunk's own encoding covers what lies between its first and last white
space. The ragged ends that meet at a join are encoded again, together with the
chunks' words on either side: if that encoding begins and ends as the chunks' own
do, what lies between is the join's. A chunk without white space is all join. Where
an end doesn't agree, the whole document is encoded again, so the result is exact
for any neighbours.

Tokenizers. Reuse of chunks and words rests on how a tokenizer normalises and
splits; ``reusable`` compares its parts with those that were checked. Any other
file is encoded and decoded by the library alone.

Misses go to the tokenizers library in one batch; below a chunk, units between
white space that repeat are encoded once as well. A lost task starts with an
empty cache and gives the same result. Memory: two generations of at most
``CACHE_BYTES`` each and ``UNITS`` units, whatever the input. The caches live as long as the worker,
so a chunk is encoded once per worker and generation, without moving any text.

Defined cases: a null text is empty and has no tokens; special token strings in a
text become those tokens, as in the library; repeated rows give repeated results;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .merges import Words, merges_agree

#: Bytes that the rolling hash covers, a power of two.
WINDOW = 16
#: One cut in this many bytes on average, a power of two; and the least bytes between cuts.
CHUNK, LEAST_CHUNK = 256, 48
CACHE_BYTES = 12 << 20
#: Documents whose results leave the worker together.
SLICE = 256

#: Distinct units that a worker remembers.
UNITS = 100_000
#: Letters that the tokenizer keeps together, whose lower case is one letter each.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

#: From the first to the last white space.
EDGES = re.compile(rb"[\x20\x09-\x0d](?:.*[\x20\x09-\x0d])?", re.DOTALL)
#: Marks after a letter or digit and before white space: one word of the tokenizer. No apostrophe, which may begin a shortened word.
MARKS = re.compile(rb"([!-&(-/:-;=-@\[-`{-~](?:(?<=[a-z0-9][!-&(-/:-;=-@\[-`{-~])|(?<=\xc3[\xa0-\xb6\xb8-\xbf][!-&(-/:-;=-@\[-`{-~]))[!-&(-/:-;=-@\[-`{-~]*)(?![^\x20\x09-\x0d])")

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where chunks end, the end of the data included. Never inside a UTF-8 character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= LEAST_CHUNK:
        return [len(b)]
    rolled, back = _GEAR[b], 1
    while back < WINDOW:  # sums over twice as many bytes each time
        rolled[back:] = rolled[back:] + (rolled[:-back] << np.uint32(back))
        back *= 2
    found = np.nonzero((rolled >> np.uint32(WINDOW - 1)) % np.uint32(CHUNK) == 0)[0] + 1
    inside = (b & 0xC0) == 0x80
    out, last = [], 0
    for at in found.tolist():
        if at - last >= LEAST_CHUNK:
            while at < len(b) and inside[at]:
                at += 1
            out.append(at)
            last = at
    if last < len(b):
        out.append(len(b))
    return out


def pieces(data: bytes) -> list[bytes]:
    """The units between white space; marks after a word are units of their own.

    After a letter or digit and before white space such marks are a word of their
    own for the tokenizer, and it lower-cases by itself, so neither changes the
    ids. Data with a ``<`` may hold special tokens and is only split.
    """
    return (data if b"<" in data else MARKS.sub(rb" \1", data.lower())).split()


def word_pieces(data: bytes, marked: bool) -> list[bytes]:
    """``pieces`` of one word as they are in its text, which ``marked`` says to hold a ``<``."""
    word = data.strip()
    return [word] if marked and word else [word.lower()] if word.isalpha() else pieces(word)


class Cache:
    """Two generations of entries; the older one goes when the younger is full."""

    def __init__(self, most_bytes: int):
        self.most, self.used, self.young, self.old = most_bytes, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def put(self, key, value, size: int) -> None:
        if self.used > self.most:
            self.young, self.old, self.used = {}, self.young, 0
        self.young[key] = value
        self.used += size


class Chunk:
    """The encoding between a chunk's first and last white space, its words at either end of that, and the ragged ends beside it."""

    __slots__ = ("head", "tail", "open", "body", "first", "last", "ids")

    def __init__(self, data: bytes):
        found = EDGES.search(data)
        #: A chunk without white space has neither end; its neighbours join over it.
        self.open = found is None
        self.ids = self.body = self.tail = b""
        self.head = data
        #: The outermost words of the body with the white space around them, and then their ids.
        self.first = self.last = (b"", b"")
        if found:
            start, end = found.span()
            self.head, self.body, self.tail = data[:start], data[start:end], data[end:]
            inner = self.body.strip()
            if inner:
                word = inner.split(None, 1)[0]
                self.first = self.body[: self.body.index(word) + len(word)], b""
                word = inner.rsplit(None, 1)[-1]
                self.last = self.body[self.body.rindex(word) :], b""
            else:
                self.first = self.last = (self.body, b"")


def joins_of(parts: list[Chunk]) -> list[tuple[Chunk | None, bytes, Chunk | None]]:
    """(chunk before, ragged text, chunk after) of each join; chunks without white space belong to the text."""
    out, ragged, before = [], b"", None
    for c in parts:
        ragged += c.head
        if not c.open:
            out.append((before, ragged, c))
            before, ragged = c, c.tail
    return [*out, (before, ragged, None)]


#: The parts of a tokenizer with which words between white space, and marks after them, are encoded by themselves.
REUSABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "suffix": "</w>",
}


def reusable(parts: dict) -> bool:
    """Whether a tokenizer file's parts are such that its words may be encoded by themselves, and tokens decode to their names with spaces between."""
    model, pre = parts.get("model") or {}, (parts.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = [x for x in pre if x.get("type") == "Split" and x.get("invert") and x.get("behavior") == "Removed"]
    rest = [x for x in pre if x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")]
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) and not re.search(r"\s", t["content"]) for t in parts.get("added_tokens") or [])
    return (
        parts.get("normalizer") == REUSABLE["normalizer"]
        and len(pre) == 2
        and len(split) == len(rest) == 1
        and split[0]["pattern"] == {"Regex": REUSABLE["split"]}
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == REUSABLE["suffix"]
        and not model.get("dropout")
        and not model.get("continuing_subword_prefix")
        and not model.get("byte_fallback")
        and not model.get("ignore_merges")
        and parts.get("decoder") is None
        and plain
    )


class Encoder:
    """The tokenizer of one file, with its caches."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, fast: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunks = Cache(cache_bytes)
        #: The ids of each unit. Emptied between batches when there are more than UNITS.
        self.ids: dict[bytes, bytes] = {}
        #: Chunks taken from the cache and not, and documents that a join made the library encode whole.
        self.hits = self.misses = self.whole = 0
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.reuse = reusable(parts)
        #: ``fast``: ``merges_agree`` holds for the file.
        self.words = Words(parts["model"]) if fast and self.reuse else None
        special = [t for t in parts.get("added_tokens") or [] if t.get("special") and t["content"].startswith("<")]
        self.part = (special[0]["content"], special[0]["id"]) if special else None
        #: By id: the token, and whether it ends a word.
        self.names = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.ends = np.array([n.endswith("</w>") for n in self.names])

    def _learn(self, units: set[bytes]) -> None:
        """Fill ``ids`` for all units."""
        if len(self.ids) > UNITS:
            self.ids = {}
        self.ids.update(self.units(units - self.ids.keys()))

    def units(self, lacking: set[bytes]) -> dict[bytes, bytes]:
        """The ids of units by themselves."""
        plain = [u for u in lacking if u.isalpha() or PLAIN.fullmatch(u.decode())]
        other = list(lacking.difference(plain))
        if self.words is not None:
            found = dict(zip(plain, self.words.encode(plain)))
        else:
            found = self._plain(plain)
            other += [u for u in plain if u not in found]
        found.update(zip(other, self._library([u.decode() for u in other])))
        return found

    def _plain(self, plain: list[bytes]) -> dict[bytes, bytes]:
        """Plain letters are one word of the tokenizer, and just its last token has the word-end mark; none if that fails for some word."""
        joined = self.library.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids
        ids = np.array(joined, dtype="<u4")
        ends = ((np.nonzero(self.ends[ids])[0] + 1) * 4).tolist()
        data = ids.tobytes()
        return dict(zip(plain, [data[a:b] for a, b in zip([0, *ends], ends)])) if len(ends) == len(plain) else {}

    def _encoded(self, units: list[bytes]) -> bytes:
        return b"".join(map(self.ids.__getitem__, units))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids]) if self.reuse else self.library.decode(ids, skip_special_tokens=False)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of many short texts, each by itself. A special token between them parts them before anything else looks at them."""
        if self.words is not None:
            split = [pieces(x) for x in texts]
            self._learn(set().union(*split))
            return dict(zip(texts, map(self._encoded, split)))
        alone = [x for x in texts if self.part is None or b"<" in x]
        found = dict(zip(alone, self._library([x.decode() for x in alone])))
        rest = [x for x in texts if x not in found]
        if rest:
            name, ident = self.part
            ids = np.frombuffer(self._library([name.join([x.decode() for x in rest])])[0], dtype="<u4")
            ends = (np.nonzero(ids == ident)[0] * 4).tolist()
            data = ids.tobytes()
            found.update(zip(rest, [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(data)])]))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.reuse:
            return self._library(texts)
        split, new, words = [], {}, {}
        for t in texts:
            data, last, parts = t.encode(), 0, []
            for end in cuts(data):
                chunk = data[last:end]
                found = self.chunks.get(chunk) or new.get(chunk)
                if found is None:
                    found = new[chunk] = Chunk(chunk)
                    marked = b"<" in found.body
                    words[chunk] = pieces(found.body), word_pieces(found.first[0], marked), word_pieces(found.last[0], marked)
                    self.misses += 1
                else:
                    self.hits += 1
                parts.append(found)
                last = end
            split.append(joins_of(parts))
        self._learn(set().union(*(units for three in words.values() for units in three)))
        for key, c in new.items():
            body, first, last = words[key]
            c.ids, c.body = self._encoded(body), b""
            c.first, c.last = (c.first[0], self._encoded(first)), (c.last[0], self._encoded(last))
            self.chunks.put(key, c, 600 + len(key) + len(c.ids))
        asked = list(dict.fromkeys(text for joins in split for _, _, _, text in map(self._asked, joins) if text is not None))
        met = self._each(asked)
        return [self._assembled(t, joins, met) for t, joins in zip(texts, split)]

    @staticmethod
    def _asked(join: tuple[Chunk | None, bytes, Chunk | None]) -> tuple[bytes, bytes, bytes, bytes | None]:
        """The ids that a join must begin and end with, and the text to encode; none where only white space meets."""
        before, ragged, after = join
        begin, end = before.last if before else (b"", b""), after.first if after else (b"", b"")
        return begin[1], ragged, end[1], begin[0] + ragged + end[0] if ragged else None

    def _assembled(self, text: str, joins: list, met: dict[bytes, bytes]) -> bytes:
        out = []
        for join in joins:
            begin, _, end, asked = self._asked(join)
            if asked is not None:
                ids = met[asked]
                if len(ids) < len(begin) + len(end) or not ids.startswith(begin) or not ids.endswith(end):
                    self.whole += 1
                    return self._library([text])[0]
                out.append(ids[len(begin) : len(ids) - len(end)])
            if join[2] is not None:
                out.append(join[2].ids)
        return b"".join(out)


_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(path: str | None) -> str:
    """A tokenizer file; None is the word-level vocabulary that the machine offers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return str(path)


def encoder(path: str | None, fast: bool = False) -> Encoder:
    """The worker's encoder for a file. ``fast``: ``merges_agree`` holds for it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    key = tokenizer_path(path), fast
    if key not in _encoders:
        _encoders[key] = Encoder(key[0], fast=fast)
    return _encoders[key]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded."""
    ship(docs.sparkSession)
    fast = merges_agree(tokenizer_path(path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, fast)
        for x in frames:
            for at in range(0, len(x), SLICE):
                part = x.iloc[at : at + SLICE]
                done = tool.encode(list(part["text"]))
                back = [tool.decode(array("I", ids)) for ids in done]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(ids) // 4 for ids in done], "ids": done, "decoded": back})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids, special tokens included."""
    return encoder(path).decode(ids)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
