"""Merges of plain words by tiktoken, whose merge loop costs a third of the tokenizers library's.

The end-of-word suffix becomes a zero byte, which no word of letters has, and each merge a rank.
tiktoken merges any two neighbours whose bytes are a token, the library only the
pairs of its list. Both agree on every word if each token, spelled out by
itself, is put together by the listed pairs: what stands beside it can't change
that as long as nothing merges over its ends. ``merges_agree`` proves this for a file,
once, on the driver; if it fails, the library encodes plain words too.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np

#: Stands for the end-of-word suffix.
END = b"\0"


def byte_letters() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_list(model: dict) -> list[tuple[str, str]]:
    return [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]


@cache
def merges_agree(path: str) -> bool:
    """Whether every token of a file, spelled out by itself, is put together by the listed pairs in order of rank."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    if parts["model"].get("type") != "BPE" or not parts["model"].get("end_of_word_suffix"):
        return False
    suffix, pairs = parts["model"]["end_of_word_suffix"], merge_list(parts["model"])
    ranks = {p: i for i, p in enumerate(pairs)}
    if len({a + b for a, b in pairs}) < len(pairs):
        return False
    for a, b in pairs:
        token = a + b
        letters = list(token.removesuffix(suffix))
        if token.endswith(suffix):
            letters[-1] += suffix
        while len(letters) > 1:
            rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(letters, letters[1:])))
            if rank == len(ranks):
                return False
            letters[at : at + 2] = [letters[at] + letters[at + 1]]
    return True


class Words:
    """The ids of words of plain letters of one tokenizer file, for which ``merges_agree`` holds."""

    def __init__(self, model: dict):
        import tiktoken

        letters, vocab, suffix = byte_letters(), model["vocab"], model["end_of_word_suffix"]
        spelled = lambda name: bytes(letters[c] for c in name.removesuffix(suffix)) + END * name.endswith(suffix)
        singles = [*letters, *[c + suffix for c, b in letters.items() if b]]
        names = [*singles, *[a + b for a, b in merge_list(model)]]
        ranks = {spelled(n): i for i, n in enumerate(names)}
        #: By rank: the id, and whether it ends a word.
        self.id_of = np.array([vocab.get(n, 0) for n in names], dtype="<u4")
        self.ends = np.array([n.endswith(suffix) for n in names])
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        end = END.decode() + " "
        ranks = np.array(self.merge(b" ".join(words).decode().lower().replace(" ", end) + end), dtype=np.int64)
        ends = ((np.nonzero(self.ends[ranks])[0] + 1) * 4).tolist()
        data = self.id_of[ranks].tobytes()
        assert len(ends) == len(words)
        return [data[a:b] for a, b in zip([0, *ends], ends)]
