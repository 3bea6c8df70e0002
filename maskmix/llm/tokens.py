"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once in a while.

A byte-level BPE with the usual splitting pattern never merges across a space that a visible
character follows: the space opens the next word.  Texts are therefore cut there, the library encodes
the distinct pieces, and a text's ids are put together from them.  A word of Latin letters is one piece
of the splitting pattern, so it goes to the library's model without the steps before it.  Texts that
spell a special token are encoded in one call.  The result equals encoding every text in one call.

What was encoded is kept in two generations of bounded size: when the younger is full it becomes the older
one, which is dropped, and words found in the older one move to the younger.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes a worker's kept pieces take at most, both generations together; only speed depends on it.
CACHE_BYTES = 96_000_000
#: Bytes of a kept piece beside its letters: two objects with some ids and their places in a table.
_PIECE_BYTES = 200

_SPACE_THEN_SPACE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Letters, closing marks, perhaps a line feed and the same again: the splitting pattern cuts between all four.
_WORDS = re.compile(rf"([{_L}]+)([.,;:!?|#%&$*]*)(?:\n([{_L}]+)([.,;:!?|#%&$*]*))?\Z")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as one plain call of the library would."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letter_table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.half = cache_bytes // 2
        self.young: dict[str, bytes] = {}  # pieces with the space that opens them
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.marks: dict[str, bytes] = {}  # closing marks
        self.id_bytes = [n.to_bytes(4, "little") for n in range(self.vocabulary())]

    def vocabulary(self) -> int:
        return self.library.get_vocab_size()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text.  Millions of short-lived strings make the cycle collector search in vain, so
        it rests meanwhile; nothing here refers to itself."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, spaced, pieces, counts = [], [], [], []
        for n, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                ids = self.library.encode(text, add_special_tokens=False).ids
                out[n] = np.array(ids, dtype="<u4").tobytes()
            elif _SPACE_THEN_SPACE.search(text):
                own = _CUT.split(text)
                spaced.append(n)
                pieces += own
                counts.append(len(own))
            else:
                plain.append(n)
        lists = pc.split_pattern(pa.array([texts[n] for n in plain], pa.large_string()), " ")
        starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        for where, flat, bounds in (
            (plain, lists.flatten(), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)),
            (spaced, pa.array(pieces, pa.large_string()), starts),
        ):
            if where:
                for n, ids in zip(where, self._joined(flat, np.asarray(bounds, np.int64))):
                    out[n] = ids
        return out

    def _joined(self, pieces: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """Ids of texts that are cut into ``pieces``; text k has those from ``bounds[k]`` to ``bounds[k + 1]``."""
        coded = pieces.dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.young.get, kinds))
        if None in known:
            new = self._learn([p for p, ids in zip(kinds, known) if ids is None], " ")
            known = [new[p] if ids is None else ids for p, ids in zip(kinds, known)]
            self.young.update(new)
            self.size += _PIECE_BYTES * len(new) + sum(map(len, new))
            if self.size > self.half:
                self.old, self.young, self.size = self.young, {}, 0
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        length = sizes[code]
        length[bounds[:-1]] = 0  # the opening of a text has no space before it
        ends = np.cumsum(length)
        ids = flat[np.repeat(begin[code] - ends + length, length) + np.arange(int(ends[-1]))].tobytes()
        openings = pieces.take(pa.array(bounds[:-1])).to_pylist()
        bare = self._learn(set(openings), "")
        stops = (4 * ends[bounds[1:] - 1]).tolist()
        return [bare[opening] + ids[at:stop] for opening, at, stop in zip(openings, [0, *stops], stops)]

    def _learn(self, pieces: Iterable[str], lead: str) -> dict[str, bytes]:
        """Ids of pieces behind ``lead``, a space or nothing."""
        known: dict[str, bytes] = {}
        others: list[str] = []
        marked: list[tuple[str, tuple]] = []
        marks: set[str] = set()
        old = self.old.get if lead else {}.get
        opening = self.letter_table[ord(" ")] if lead else ""
        tokenize, id_bytes = self.tokenize, self.id_bytes
        for piece in pieces:
            ids = old(piece)
            if ids is not None:
                known[piece] = ids
            elif piece.isalpha() and piece.isascii():  # such letters stand for themselves
                known[piece] = b"".join([id_bytes[t.id] for t in tokenize(opening + piece)])
            elif (found := _WORDS.match(piece)) is None:
                others.append(piece)
            elif found.end(1) == len(piece):
                known[piece] = self._letters(lead + piece)
            else:
                marked.append((piece, found.groups()))
                marks.update((found[2], found[4] or ""))
        if len(self.marks) > 10_000:
            self.marks = {}
        self.marks.update(self._by_library([m for m in ("\n", *marks) if m not in self.marks], ""))
        known.update(self._by_library(others, lead))
        get, young, bare = self.marks.__getitem__, self.young.get, self._letters
        for piece, (head, closing, word, last) in marked:
            ids = (young(head) or old(head) or known.get(head)) if lead else None
            ids = (ids or bare(lead + head)) + get(closing)
            known[piece] = ids if word is None else ids + get("\n") + bare(word) + get(last)
        return known

    def _letters(self, text: str) -> bytes:
        """Ids of one piece of the splitting pattern, with letters standing for its bytes."""
        if not text.isascii():
            text = text.encode().decode("latin-1")
        return b"".join([self.id_bytes[t.id] for t in self.tokenize(text.translate(self.letter_table))])

    def _by_library(self, pieces: list[str], lead: str) -> dict[str, bytes]:
        known: dict[str, bytes] = {}
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            encoding = self.library.encode([lead + p for p in some], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(encoding.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(encoding.word_ids, dtype=np.int64), np.arange(len(some) + 1)).tolist()
            known.update({p: raw[4 * a : 4 * b] for p, a, b in zip(some, ends, ends[1:])})
        return known


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that what it keeps outlives a task."""
    return Encoder(path)
