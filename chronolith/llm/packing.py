"""Hierarchical multi-length packing of tokenised documents.

Every task tokenises its documents and packs them as it goes, so no text or token is shuffled. Of a document,
whole windows of the longest tier become sequences of their own; the rest is routed to the tier with the
smallest window that holds it. A tier's window takes its own piece first, then the longest pieces of shorter
tiers that still fit, and last the head of a piece cut to fill the gap. A closed window is therefore full.
What is left when a task's documents end is cut at powers of two, so nothing is padded.
Sequences of one tier are dealt to step groups of equal token counts.

The ids are those of the tokenizer file's vocabulary. Its byte-level BPE is run by ``tiktoken`` with the file's
own ids as merge ranks, which gives the same ids several times as fast; texts that it refuses go through
``tokenizers``. Special tokens written in a text are encoded as special tokens, as ``tokenizers`` does.

Defined cases: a null or empty text has the closing id alone; repeated rows are packed one by one; an empty
table gives no pieces; other columns are ignored. Memory: one Arrow batch of texts and at most ``POOL`` pieces
a tier. Sequence ids hold the task's partition number, so a task that is run again gives the same ids.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

TIERS = (256, 512, 1024, 2048)
CLOSING_ID = 1
STEP_TOKENS = 1 << 16
POOL = 512

Piece = tuple[int, int, int]  # length, document's number, start


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text -> ids by the tokenizer file at ``path`` (a byte-level BPE whose ids follow its merge order)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    chars = _byte_chars()
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the regex engine's own panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


class Packer:
    """Packs pieces into full windows; ``close(length, pieces)`` is called for each sequence."""

    def __init__(self, tiers: tuple[int, ...], close: Callable[[int, list[Piece]], None]):
        self.tiers, self.close, self.pools = tiers, close, {t: [] for t in tiers}

    def add(self, number: int, n: int) -> None:
        top = self.tiers[-1]
        at = 0
        while n - at >= top:
            self.close(top, [(top, number, at)])
            at += top
        if at < n:
            self._route((n - at, number, at))

    def _route(self, piece: Piece) -> None:
        tier = next(t for t in self.tiers if t >= piece[0])
        insort(self.pools[tier], piece)
        if len(self.pools[tier]) > POOL:
            self._pack(tier, POOL // 2)

    def _take(self, most: int, room: int) -> Piece | None:
        """From the tiers up to window ``most``: the longest piece that fits in ``room``, else the head of the longest."""
        for tier in reversed([t for t in self.tiers if t <= most]):
            pool = self.pools[tier]
            if i := bisect_right(pool, (room, float("inf"), 0)):
                return pool.pop(i - 1)
        for tier in [t for t in self.tiers if t <= most]:
            if pool := self.pools[tier]:
                n, number, start = pool.pop()
                self._route((n - room, number, start + room))
                return room, number, start
        return None

    def _pack(self, tier: int, down_to: int) -> None:
        """Full windows of one tier, until few of its pieces are left."""
        while len(self.pools[tier]) > down_to:
            window, room = [self.pools[tier].pop()], tier
            room -= window[0][0]
            while room:
                piece = self._take(tier, room)
                if piece is None:
                    return self._cut(window)
                window.append(piece)
                room -= piece[0]
            self.close(tier, window)

    def _cut(self, pieces: list[Piece]) -> None:
        """Sequences of falling powers of two from pieces that fill no window."""
        left = sum(p[0] for p in pieces)
        pieces = pieces[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                n, number, start = pieces.pop()
                window.append((min(n, room), number, start))
                if n > room:
                    pieces.append((n - room, number, start + room))
                room -= window[-1][0]
            self.close(size, window)
            left -= size

    def finish(self) -> None:
        for tier in reversed(self.tiers):
            self._pack(tier, 0)


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        first = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}  # document's number -> id, token ids, tokens not yet placed
        rows: list[tuple] = []
        n_docs = n_seqs = 0
        dealt = dict.fromkeys(range(32), 0)

        def close(length: int, pieces: list[Piece]) -> None:
            nonlocal n_seqs
            tier = length.bit_length() - 1
            step = first + (dealt[tier] // step_tokens << 5) + tier
            dealt[tier] += length
            offset = 0
            for n, number, start in pieces:
                doc = held[number]
                rows.append((doc[0], start, n, zlib.crc32(doc[1][start : start + n].tobytes()), len(doc[1]), first + n_seqs, offset, length, step))
                offset += n
                doc[2] -= n
                if not doc[2]:
                    del held[number]
            n_seqs += 1

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], NAMES)

        packer = Packer(tiers, close)
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "").astype("<u4"), np.array([CLOSING_ID], "<u4"))
                held[n_docs] = [doc_id, ids, len(ids)]
                packer.add(n_docs, len(ids))
                n_docs += 1
            if rows:
                yield out(id_type)
        packer.finish()
        if rows:
            yield out(id_type)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:]))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
