"""Sum-of-squares packing (operator 2).

Documents become ids, cut into whole windows and a rest.  Whole windows are
sequences at once.  A rest goes to the fill level that makes the sum of squared
counts of partly filled windows smallest; a level array holds the counts.  Each
task packs the stream of its own partition with its own level array, whose size
is the window, so tasks need nothing from each other and a lost one is simply
run again.  At the end of a stream the open windows are poured together, cut
freely, and the last tokens are cut at powers of two, which need no padding.

Defined results: a null text is empty and yields its end token alone; a null id
stays null; the string of a special token in a text is that token, as the
library has it; repeated rows are packed once each; ties go to the fullest
level; a very long text is whole windows and one rest; an empty table gives an
empty result; only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, text_of
from .units import MOST, UnitEncoder

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are the partition's number times this, plus a count.
STRIDE = 1 << 40


class LevelArray:
    """Counts of open windows by fill level, and the windows themselves."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, size: int) -> int:
        """The level (0: a new window) for a piece of ``size`` tokens, under the whole window."""
        last = self.window - size
        here, there = self.counts[: last + 1], self.counts[size:]
        # (N + 1)^2 - N^2 at the level reached, (N - 1)^2 - N^2 at the level left;
        # neither an empty nor a full window counts.
        cost = 2 * (there - here) + 2
        cost[last] -= 2 * there[last] + 1
        cost[0] += 2 * here[0] - 1
        usable = here > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return last - int(cost[::-1].argmin())

    def add(self, piece: tuple, size: int) -> list | None:
        """Puts the piece down; the window's pieces, if that fills it."""
        level = self.place(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.window:
            return window
        self.counts[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def rest(self) -> Iterator[tuple]:
        """Pieces of all open windows, the fullest first."""
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                yield from window


def pack(documents: Iterator[tuple[int, bytes]], window: int) -> Iterator[list[tuple]]:
    """Sequences, each a list of (doc_id, start, ids, doc_tokens) in order; ids are 4 bytes each."""
    levels, full = LevelArray(window), window * 4
    for doc, ids in documents:
        tokens = len(ids) // 4
        whole = len(ids) // full * full
        for at in range(0, whole, full):
            yield [(doc, at // 4, ids[at : at + full], tokens)]
        if whole < len(ids):
            done = levels.add((doc, whole // 4, ids[whole:], tokens), (len(ids) - whole) // 4)
            if done:
                yield done
    pieces = list(levels.rest())
    left = sum(len(p[2]) for p in pieces) // 4
    sequence: list[tuple] = []
    room = size = min(window, 1 << left.bit_length() - 1) if left else 0
    for doc, start, ids, tokens in pieces:
        while ids:
            part, ids = ids[: room * 4], ids[room * 4 :]
            sequence.append((doc, start, part, tokens))
            start, room = start + len(part) // 4, room - len(part) // 4
            if not room:
                yield sequence
                sequence, left = [], left - size
                room = size = (window if left >= window else 1 << left.bit_length() - 1) if left else 0


@lru_cache(maxsize=1)
def _json_encoder(path: str, most: int = MOST) -> Callable[[Iterable[str]], Iterator[bytes]]:
    """Ids of each text as the library gives them without adding any: strings of the file's added tokens become those tokens.

    The library cuts a text at these strings before anything else, so what
    stands between is encoded unit by unit, each part as a text of its own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("added tokens that look at their surroundings aren't supported")
    # Units are kept here already; the library's own cache of words only costs time.
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)
    words = tokenizer.get_vocab()
    begins = np.zeros(max(words.values()) + 1, dtype=bool)
    # The vocabulary writes a space as this letter.
    begins[[i for w, i in words.items() if w.startswith("\u0120")]] = True

    def ids(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def many(units: list[str]) -> list[bytes]:
        """The units as one text; ids that begin with a space tell where each starts."""
        found = ids("".join(units))
        at = (np.flatnonzero(begins[found]) * 4).tolist()
        blob = found.tobytes()
        return [blob[a:b] for a, b in zip(at, [*at[1:], len(blob)], strict=True)]

    line_end = ids("\n")[0]

    def lines(texts: list[str]) -> list[bytes]:
        """Words as the lines of one text; a line end before a letter is a token of its own."""
        found = ids("\n".join(texts))
        ends = [*np.flatnonzero(found == line_end).tolist(), len(found)]
        return [found[a:b].tobytes() for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    plain = UnitEncoder(lambda text: ids(text).tobytes(), many, lines, most)
    marks = {x: i.to_bytes(4, "little") for x, i in added.items()}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None

    def each(texts: Iterable[str]) -> Iterator[bytes]:
        """Parts of one text go through ``plain`` like texts of their own and are joined again."""
        plan: deque[list[str]] = deque()

        def parts() -> Iterator[str]:
            for text in texts:
                whole = cut is None or not any(map(text.__contains__, marks))
                plan.append([text] if whole else cut.split(text))
                yield from plan[-1][::2]

        found = plain.each(parts())
        for first in found:
            # The first part is at hand, so its text is in the plan.
            split = plan.popleft()
            yield first if len(split) == 1 else b"".join([first, *(marks[x] if k % 2 else next(found) for k, x in enumerate(split[1:], 1))])

    return each


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, most: int = MOST) -> DataFrame:
    """A row for each piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers
    library, present on every executor.  Each cache of a worker keeps ``most``
    values; fewer take less memory and more time, the rows are the same.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _json_encoder(vocabulary, most)
        base = TaskContext.get().partitionId() * STRIDE

        def documents() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                texts = (text.as_py() for text in batch.column(1))
                for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    yield doc, ids + end

        rows: list[tuple] = []
        held = 0
        for n, sequence in enumerate(pack(documents(), window)):
            offset = 0
            for doc, start, ids, tokens in sequence:
                rows.append((doc, start, ids, tokens, base + n, offset))
                offset += len(ids) // 4
            held += offset
            if held >= 2_000_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names)
    )


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
