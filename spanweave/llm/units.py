"""Encoding of whole texts unit by unit, with a bounded cache.

Byte-level BPE never merges across a pre-token, and a pre-token never crosses
from a visible character into a space, nor holds a space that a visible
character follows except as its first character.  So a text may be cut before
every space that has a visible character on at least one side, and the ids of
the units, joined, are the ids of the text.  Within a unit, letters, marks and
a line end before a letter are pre-tokens of their own, so units of that shape
are put together from the ids of words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: A space with white space on both sides: cutting there isn't safe.
_INNER = re.compile(r"\s\x20\s")
_SAFE = re.compile(r"\x20(?=\S)")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
_WORD = re.compile(_LETTERS)
#: A word with marks behind it, and perhaps a line end and the word that begins the next line.
_SHAPE = re.compile(rf"({_LETTERS})([.,;:!?#*$%&|]*)(?:\n({_LETTERS}))?")
#: Characters of texts that are looked up together.
GROUP = 200_000
#: Values that each of the three caches keeps; at 200 bytes or so each they come to hundreds of MB.
MOST = 1_500_000


class UnitEncoder:
    """Ids of texts, little-endian unsigned 32-bit.

    ``one`` encodes any text; ``many`` encodes units that each are a space, a
    visible character and whatever follows up to the next space, a value for
    each; ``words`` encodes words of letters with nothing before them.  Texts go
    in groups, so units that several of them lack are encoded once and together.  A cache is emptied when it holds ``most`` values, and
    units longer than ``longest`` characters aren't kept, so memory is bounded
    on any input but for the group at hand.
    """

    def __init__(
        self,
        one: Callable[[str], bytes],
        many: Callable[[list[str]], list[bytes]],
        words: Callable[[list[str]], list[bytes]],
        most: int = MOST,
        longest: int = 40,
    ) -> None:
        self.one, self.many, self.words, self.most, self.longest = one, many, words, most, longest
        self.after_space: dict[str, bytes] = {}
        #: Values of words with a space before them, which most units are made of.
        self.spaced: dict[str, bytes] = {}
        #: Values of pieces with nothing before them: first words of lines, marks, what texts begin with.
        self.bare: dict[str, bytes] = {}

    def _learn(self, missing: set[str], odd: set[str]) -> list[str]:
        """Makes ``missing`` known; what is returned must be forgotten after use: long units and those of ``odd``."""
        known, spaced, bare = self.after_space, self.spaced, self.bare
        words, plain, shaped, whole = [], [], [], list(odd)
        for p in missing.difference(odd):
            if p.isalpha():
                words.append(p)
            elif (m := _SHAPE.fullmatch(p)) and len(p) <= self.longest:
                shaped.append((p, *m.groups()))
            else:
                (whole if " " in p else plain).append(p)
        new = list({*words, *(x[1] for x in shaped)}.difference(spaced))
        lines = list({x[3] for x in shaped if x[3]}.difference(bare))
        if lines:
            bare.update(zip(lines, self.words(lines), strict=True))
        if new or plain:
            found = self.many([f" {p}" for p in (*new, *plain)])
            spaced.update(zip(new, found))
            known.update(zip(plain, found[len(new) :]))
        known.update(zip(words, map(spaced.__getitem__, words)))
        for p, word, marks, line in shaped:
            known[p] = spaced[word] + self._bare(marks) + (self._bare("\n") + bare[line] if line else b"")
        for p in whole:
            known[p] = self.one(f" {p}")
        for p in new:
            if len(p) > self.longest:
                del spaced[p]
        return [*odd, *(p for p in missing if len(p) > self.longest and p not in odd)]

    def _bare(self, piece: str) -> bytes:
        if len(piece) > self.longest:
            return self.one(piece)
        found = self.bare.get(piece)
        if found is None:
            found = self.bare[piece] = self.one(piece) if piece else b""
        return found

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        for cache in (self.after_space, self.spaced, self.bare):
            if len(cache) > self.most:
                cache.clear()
        known = self.after_space
        cut = [t.split(" ") for t in texts]
        heads = [c.pop(0) for c in cut]

        def looked_up(pieces: list[str]) -> tuple[list, list[int]]:
            values = list(map(known.get, pieces))
            return values, [i for i, v in enumerate(values) if v is None] if None in values else []

        found = [looked_up(pieces) for pieces in cut]
        missing = {pieces[i] for pieces, (_, gaps) in zip(cut, found, strict=True) for i in gaps}
        # These aren't kept, so they show up here whenever a text may have a space that isn't safe to cut at.
        odd = {p for p in missing if not p or p[0].isspace()}
        if odd:
            for k, (_, gaps) in enumerate(found):
                if any(cut[k][i] in odd for i in gaps) and _INNER.search(texts[k]):
                    heads[k], *cut[k] = _SAFE.split(texts[k])
                    found[k] = looked_up(cut[k])
            missing = {pieces[i] for pieces, (_, gaps) in zip(cut, found, strict=True) for i in gaps}
            odd &= missing
        brief = self._learn(missing, odd) if missing else ()
        first = [h for h in set(heads).difference(self.bare) if len(h) <= self.longest and _WORD.fullmatch(h)]
        if first:
            self.bare.update(zip(first, self.words(first), strict=True))
        out = []
        for head, pieces, (values, gaps) in zip(heads, cut, found, strict=True):
            for i in gaps:
                values[i] = known[pieces[i]]
            out.append(self._bare(head) + b"".join(values))
        for p in brief:
            del known[p]
        yield from out

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def __call__(self, text: str) -> bytes:
        return next(self._group([text]))
