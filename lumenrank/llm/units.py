"""Token ids of whole texts, with every unit between white space encoded once and remembered.

Where ``bpe.reusable`` holds, a text's ids are those of its units in a row, so a
worker keeps the ids of the units that it has met. At most ``UNITS`` are kept; what is
forgotten is encoded again, with the same ids.
"""

from __future__ import annotations

from . import bpe

#: Distinct units that a worker remembers.
UNITS = 600_000


class Units:
    """The ids of units of one tokenizer file. ``fast``: ``merges_agree`` holds for it."""

    def __init__(self, path: str | None, fast: bool):
        self.base = bpe.encoder(path, fast)
        self.ids: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.base.reuse:
            return self.base._library(texts)
        if len(self.ids) > UNITS:
            self.ids = {}
        split = [bpe.pieces(t.encode()) for t in texts]
        found = [list(map(self.ids.get, units)) for units in split]
        lacking = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        self.ids.update(self.base.units({units[i] for units, at in zip(split, lacking) for i in at}))
        for units, f, at in zip(split, found, lacking):
            for i in at:
                f[i] = self.ids[units[i]]
        return [b"".join(f) for f in found]


_units: dict[tuple, Units] = {}


def units(path: str | None, fast: bool) -> Units:
    """The worker's own, kept from task to task."""
    if (path, fast) not in _units:
        _units[path, fast] = Units(path, fast)
    return _units[path, fast]
