"""Token ids of whole texts inside tasks, by a public tokenizer file.

White space never takes part in a token of the word-level tokenizers used here and never joins what stands on
its two sides, so the ids of a text are the ids of its pieces between white space, one after the other. Pieces
and the words in them repeat a lot: two bounded memos, which live as long as the Python worker, turn most of the
work into dictionary look-ups. Whether a file cuts texts in this way is read from the file; texts of any other
tokenizer are encoded whole.
"""

from __future__ import annotations

import functools
import os
import json
from collections.abc import Callable

import regex

#: Fixed values of the word-level tokenizer file: how it normalises texts and cuts them into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTTERS = [
    {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
WORD = regex.compile(WORD_PATTERN)
#: Pieces for which Unicode normal form and lower-casing hold no surprises.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]+")
#: Python's split() also splits at these, the tokenizer doesn't.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: itself if it can be printed, else the next from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


@functools.cache
def encoder(path: str, width: int = 4) -> Encoder:
    """The worker's own encoder for this file, with what it has learnt."""
    return Encoder(path, width)


@functools.cache
def id_width(path: str) -> int:
    """2 if all ids of a tokenizer file fit into 16 bits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


class Memo(dict):
    """Texts to ids, filled when asked. Holds two generations of at most `most` entries: what is asked for again moves to the
    young one, and what isn't goes with the old one."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text) or self.encode(text)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[text] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned ids of `width` bytes. memo: entries of a generation of pieces; half as many of words."""

    def __init__(self, path: str, width: int = 4, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        held = [(told.get("normalizer") or {}).get("normalizers"), (told.get("pre_tokenizer") or {}).get("pretokenizers")]
        self.split = held == [NORMALIZERS, CUTTERS] and told["model"]["type"] == "BPE" and not told["model"]["unk_token"]
        self.added = tuple(t["content"][:2] for t in told["added_tokens"])
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        if size > 1 << 8 * width:
            raise ValueError(f"ids up to {size - 1} don't fit into {width} bytes")
        self.packed = [i.to_bytes(width, "little") for i in range(size)]
        self.tokenize = self.tokenizer.model.tokenize
        self.words = Memo(self._word, memo // 2)
        self.pieces = Memo(self._piece, memo)

    def _word(self, word: str) -> bytes:
        packed = self.packed
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([packed[t.id] for t in self.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable() or PLAIN.fullmatch(piece):
            low = piece.lower()
            if low.isalpha():
                return self.words[low]
            if low[:-1].isalpha() and low[-1] in ".,":
                return self.words[low[:-1]] + self.words[low[-1]]
            if not any(a in piece for a in self.added):
                return b"".join(map(self.words.__getitem__, WORD.findall(low)))
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if not self.split:
            return [self._whole(t or "") for t in texts]
        of = self.pieces.__getitem__
        return [b"".join(map(of, self._split(t or ""))) for t in texts]

    def rest(self) -> None:
        """Forgets the old generations: the worker may stay idle for long after a task."""
        self.pieces.old, self.words.old = {}, {}

    @staticmethod
    def _split(text: str) -> list[str]:
        return regex.split(r"[ \t\n\r]+", text.strip(" \t\n\r")) if SEPARATORS.search(text) else text.split()
