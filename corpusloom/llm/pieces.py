"""Encode texts unit by unit with a bounded memory of units, for tokenizers that split by `PATTERN`.

A unit is white space and the following run of other characters. `PATTERN` never matches across the end of a
run of non-space characters and looks no further ahead than the next character, so a text's ids are those of its
units one after the other. Most texts are cut at single spaces, which is exact unless a space stands between
two white-space characters or ends the text after one; those are cut by a pattern of Unicode's White_Space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Units held at most, the longest that is held, and the characters of texts looked at together.
HELD, LONGEST, TOGETHER = 1_000_000, 48, 1 << 20

_AWKWARD = re.compile(r"\s \s|\s \Z")
_UNIT = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")


class UnitEncoder:
    """`encode_units` gives the ids of some distinct units, 4 bytes each; every unit is asked for once while held."""

    def __init__(self, encode_units: Callable[[list[str]], Iterable[bytes]]):
        self.encode_units = encode_units
        self.held: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            size, j = 0, i
            while j < len(texts) and (j == i or size < TOGETHER):
                size += len(texts[j] or "")
                j += 1
            out += self._some([t or "" for t in texts[i:j]])
            i = j
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.held) > HELD:
            self.held.clear()
        awkward = [at for at, text in enumerate(texts) if _AWKWARD.search(text)]
        out: list[bytes] = [b""] * len(texts)
        for at in awkward:
            units = _UNIT.findall(texts[at])
            out[at] = b"".join(self._ids(units))
        skip = set(awkward)
        plain = [at for at in range(len(texts)) if at not in skip]
        for at, ids in zip(plain, self._plain([texts[at] for at in plain]), strict=True):
            out[at] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts cut at single spaces: equal units of all texts are looked up once and their ids dealt out by number."""
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        flat, ends = parts.flatten(), parts.offsets.to_numpy()
        later = np.ones(len(flat), dtype=bool)
        later[ends[:-1]] = False
        # A text's first part has no space before it; an empty one is no unit.
        first = flat.filter(pa.array(~later)).to_pylist()
        words = flat.filter(pa.array(later)).dictionary_encode()
        found = self._ids([" " + word for word in words.dictionary.to_pylist()] + first)
        number = np.empty(len(flat), dtype=np.int64)
        number[later], number[~later] = words.indices.to_numpy(), len(words.dictionary) + np.arange(len(first))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = pa.LargeListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pa.array(np.frombuffer(b"".join(found), "<u4"))
        )
        dealt = table.take(pa.array(number))
        ids, bounds = dealt.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes[number])])[ends]
        return [ids[low:high].tobytes() for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _ids(self, units: list[str]) -> list[bytes]:
        held = self.held
        missing = [unit for unit in dict.fromkeys(units) if unit not in held]
        # After a letter or digit the pattern always cuts before a mark, so words are asked for without their marks.
        split = {}
        for unit in missing:
            word = unit.rstrip(".,;:!?")
            if word != unit and word and word[-1].isalnum():
                split[unit] = word, unit[len(word) :]
        alone = {p for pair in split.values() for p in pair}.union(u for u in missing if u not in split)
        asked = [unit for unit in alone if unit and unit not in held]
        held.update(zip(asked, self.encode_units(asked), strict=True))
        for unit, (word, marks) in split.items():
            held[unit] = held[word] + held[marks]
        out = [held[unit] if unit else b"" for unit in units]
        for unit in (*asked, *split):
            if len(unit) > LONGEST:
                del held[unit]
        return out
