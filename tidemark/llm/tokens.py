"""Batch encoding of whole texts with a public tokenizer, words met before from a cache.

A text is cut where the tokenizer's own pre-tokenizer always cuts (before single
spaces, at lone line ends, before the comma or stop that closes a word), so the ids of
the pieces joined are the ids of the text.  Distinct pieces of a slice are found by
Arrow and looked up in the pieces the worker met before, which are held as Arrow and
numpy arrays of bounded size; only the others go to the tokenizer, many in one run.
Texts in which other white space stands before a space are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.batches import folded, held, spaced

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker remembers, their bytes and those of their ids, and the longest one
#: kept when the memory is full.
MEMORY_PIECES = 600_000
MEMORY_BYTES = 48 << 20
SHORT_BYTES = 64
#: White space of any kind before a space.
BEFORE_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}] "

# Fixed marks of the tokenizer files: a leading space, the opening of a special token.
SPACE_MARK, SPECIAL = "\u0120", "<|"
#: Joins pieces where spaces leave no trace; a control byte no merge knows.
MARK = "\x01"
RUN = 200


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranges(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] for all i, joined."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(size.sum())]


class PieceEncoder:
    """ids of texts; ``spaced`` if a piece's leading space is part of its tokens."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        # pieces met before; ids[at[i]:at[i + 1]] are those of the i-th
        self.pieces = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        # ids at which a joined run of pieces can be cut apart again
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith(SPACE_MARK)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _each(self, text: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]

    def _joined(self, atoms: list[str]) -> list[bytes]:
        """ids of atoms, encoded in runs and cut apart."""
        out = []
        parts = [atoms[a : a + RUN] for a in range(0, len(atoms), RUN)]
        text = ["".join(part) if self.spaced else f" {MARK} ".join(part) for part in parts]
        for part, raw in zip(parts, self._each(text)):
            ids = np.frombuffer(raw, np.uint32)
            if self.spaced:
                cuts = np.flatnonzero(self.opens[ids])[1:]
            else:
                marks = ids == self.mark
                cuts = np.flatnonzero(marks)
                cuts -= np.arange(len(cuts))
                ids = ids[~marks]
            if len(cuts) + 1 != len(part):
                raise ValueError("a run of pieces was not cut where it was joined")
            raw = ids.tobytes()
            ends = [4 * int(c) for c in cuts]
            out.extend(raw[x:y] for x, y in zip([0, *ends], [*ends, len(raw)]))
        return out

    def _joins(self, atom: str) -> bool:
        if len(atom) > SHORT_BYTES or SPECIAL in atom:
            return False
        if self.spaced:
            return atom[0] == " " and len(atom) > 1 and len(atom.split()) == 1 and not atom[1].isspace() and not atom[-1].isspace()
        return self.mark is not None and MARK not in atom

    def _atoms(self, piece: str, lead: str) -> list[str]:
        """Parts of a piece between which the pre-tokenizer cuts: at a line end between
        characters that are no space, and before commas and stops that close a word."""
        if "\n" in piece and self.spaced:
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                out = self._atoms(lines[0], lead)
                for x in lines[1:]:
                    out.append("\n")
                    out += self._atoms(x, "")
                return out
        stem = piece.rstrip(".,")
        if stem and len(stem) < len(piece) and stem[-1].isalnum() and SPECIAL not in piece:
            return [lead + stem, piece[len(stem) :]]
        return [lead + piece]

    def _encoded(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each piece's ids, and all ids; each distinct atom is encoded once."""
        atoms: list[str] = []
        count = np.empty(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            if p.isalnum():
                atoms.append(lead + p)
                count[i] = 1
            else:
                own = self._atoms(p, lead) if p or lead else []
                atoms += own
                count[i] = len(own)
        ids_of = dict.fromkeys(atoms)
        joined, other = [], []
        for x in ids_of:
            (joined if self._joins(x) else other).append(x)
        ids_of.update(zip(joined, self._joined(joined)))
        for a in range(0, len(other), 20_000):
            ids_of.update(zip(other[a : a + 20_000], self._each(other[a : a + 20_000])))
        parts = [ids_of[x] for x in atoms]
        atom_at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)])
        return atom_at[np.concatenate([[0], np.cumsum(count)])], np.frombuffer(b"".join(parts), np.uint32)

    def _places(self, pieces: pa.Array, lead: str) -> np.ndarray:
        """Places of distinct pieces in the memory; those not met before are encoded and added."""
        place = pc.index_in(pieces, value_set=self.pieces)
        lack = place.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if lack.any():
            new = pieces.filter(pa.array(lack))
            place[lack] = len(self.pieces) + np.arange(len(new))
            at, ids = self._encoded(new.to_pylist(), lead)
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.at = np.concatenate([self.at, len(self.ids) + at[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return place

    def _forget(self, place: np.ndarray) -> None:
        """Once the memory is full, keep only the short pieces at these places, half of it at most."""
        if len(self.pieces) <= MEMORY_PIECES and self.pieces.nbytes + self.ids.nbytes <= MEMORY_BYTES:
            return
        short = pc.less_equal(pc.binary_length(self.pieces.take(pa.array(place))), SHORT_BYTES)
        place = place[short.to_numpy(zero_copy_only=False)][: MEMORY_PIECES // 2]
        size = self.at[place + 1] - self.at[place]
        self.pieces = self.pieces.take(pa.array(place))
        self.ids = _ranges(self.ids, self.at[place], size)
        self.at = np.concatenate([[0], np.cumsum(size)])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all ids."""
        n = len(text)
        if not n:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        if self.spaced:
            whole = pc.match_substring_regex(text, BEFORE_SPACE).to_numpy(zero_copy_only=False)
            split = pc.split_pattern(pc.if_else(pa.array(whole), "", text), " ")
        else:
            # the tokenizer lowers letters and drops white space itself
            whole = np.zeros(n, bool)
            split = pc.split_pattern(pc.if_else(pc.match_substring(text, SPECIAL), spaced(text), folded(text)), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = self._places(coded.dictionary, " " if self.spaced else "")
        start, size, known = self.at[place], self.at[place + 1] - self.at[place], self.ids
        if self.spaced:  # a text's first piece has no space before it
            first = at[:-1][np.diff(at) > 0]
            own = self._each(coded.dictionary.take(pa.array(codes[first])).to_pylist())
            codes[first] = len(start) + np.arange(len(first))
            own_size = np.array([len(x) // 4 for x in own], np.int64)
            start = np.concatenate([start, len(known) + np.cumsum(own_size) - own_size])
            size = np.concatenate([size, own_size])
            known = np.concatenate([known, np.frombuffer(b"".join(own), np.uint32)])
        n_ids = size[codes]
        ids = _ranges(known, start[codes], n_ids)
        self._forget(place)
        ends = np.cumsum(n_ids)
        out_at = np.concatenate([[0], ends])[at]
        if whole.any():
            rows = np.flatnonzero(whole)
            parts = np.split(ids, out_at[1:-1])
            for i, x in zip(rows, self._each([text[int(i)].as_py() for i in rows])):
                parts[i] = np.frombuffer(x, np.uint32)
            ids = np.concatenate(parts)
            out_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out_at, ids


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder, with its cache, for all tasks of a worker's stage."""
    return PieceEncoder(path, spaced)


held(encoder.cache_clear)


def with_end(at: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text."""
    return at + np.arange(len(at)), np.insert(ids, at[1:], end)
