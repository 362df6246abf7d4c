"""Token ids of whole texts, each distinct piece encoded once.

The tokenizer cuts texts at white space and then into runs of letters, single digits and runs of other signs, and encodes each
such piece by itself. A task splits the distinct words of a slice into lower-cased pieces, encodes the pieces it doesn't remember
with the tokenizers library, and gathers the rest. Words with anything but ASCII and Latin letters go through the library whole.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from framewright.llm.common import coded, parts_of, runs_sum, split_words, starts_of, strings

#: Pieces whose ids a task remembers; beyond that, the half that was met least goes.
REMEMBERED = 300_000
#: Text bytes that are encoded together: the more, the fewer words are looked up again.
SLICE_BYTES = 4_000_000
#: Words whose lower case, normal form and pieces are the same for Python and for the tokenizer: ASCII and Latin letters.
_PLAIN = r"^[\x21-\x7EÀ-ÖØ-öø-įı-ſ]+$"
#: Fixed value: the tokenizer's own pattern, for words of that kind in lower case; \n ends a word.
_PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level tokenizers write for each byte: its own if it prints in Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after another."""
    return flat[np.repeat(starts - starts_of(lengths), lengths) + np.arange(lengths.sum())]


class WordEncoder:
    """Ids of texts under a tokenizer file that cuts at white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        pre = json.load(open(path, encoding="utf-8"))["pre_tokenizer"]
        if r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" not in str(pre) or "'Removed'" not in str(pre):
            raise ValueError(f"{path} doesn't cut texts at white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)  # no normalizer, no cutting: pieces are given as they are
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.signs = _byte_signs()
        self.rows: dict[str, int] = {}
        self.flat, self.lengths, self.starts, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first in range(0, len(words), 20_000):
            part = words[first : first + 20_000]
            found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            flats.append(np.array(found.ids, np.uint32))
            lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(flats), np.concatenate(lengths)

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.met, kind="stable")[: REMEMBERED // 2])
        names = list(self.rows)
        self.rows = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.flat, self.lengths, self.met = _gathered(self.flat, self.starts[kept], self.lengths[kept]), self.lengths[kept], self.met[kept] // 2
        self.starts = starts_of(self.lengths)

    def _of_pieces(self, pieces: list[str]) -> np.ndarray:
        """The row of each distinct piece; those not remembered are learnt."""
        if len(self.rows) > REMEMBERED:
            self._forget()
        if new := [p for p in pieces if p not in self.rows]:
            shown = "\n".join(new).encode("utf-8").decode("latin-1").translate(self.signs | {10: 10}).split("\n")
            flat, lengths = self._encoded(self.pieces, shown)
            before = len(self.rows)
            self.rows.update(zip(new, range(before, before + len(new)), strict=True))
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.starts = starts_of(self.lengths)
        rows = np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces))
        self.met[rows] += 1
        return rows

    def _of_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct words in order, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(distinct, _PLAIN), pc.invert(pc.match_substring(distinct, "<|"))).to_numpy(zero_copy_only=False)
        found = _PIECE.findall("\n".join([*strings(distinct.filter(pa.array(plain))), ""]).lower())
        codes, pieces = coded(pa.array(found, pa.large_string()))
        pieces = strings(pieces)
        ends = codes == (pieces.index("\n") if plain.any() else -1)
        rows = np.zeros(len(pieces), np.int64)
        real = np.array([p != "\n" for p in pieces], bool)
        rows[real] = self._of_pieces([p for p in pieces if p != "\n"])
        row = rows[codes[~ends]]
        per_word = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        lengths = np.zeros(len(distinct), np.int64)
        lengths[plain] = runs_sum(self.lengths[row], per_word)
        other_flat, lengths[~plain] = self._encoded(self.tokenizer, strings(distinct.filter(pa.array(~plain))))
        flat = np.zeros(lengths.sum(), np.uint32)
        of_plain = np.repeat(plain, lengths)
        flat[of_plain], flat[~of_plain] = _gathered(self.flat, self.starts[row], self.lengths[row]), other_flat
        return flat, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has; a long text is encoded part by part."""
        flats, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for owner, part in parts_of(texts, SLICE_BYTES):
            words, n = split_words(part)
            codes, distinct = coded(words)
            flat, lengths = self._of_words(distinct)
            flats.append(_gathered(flat, starts_of(lengths)[codes], lengths[codes]))
            np.add.at(counts, owner, runs_sum(lengths[codes], n))
        return np.concatenate(flats), counts

    def encode_ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with the id end after each text."""
        ids, counts = self.encode(texts)
        out = np.full(len(ids) + len(counts), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


def crc32s(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.fromiter((zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)), np.int64, len(starts))
