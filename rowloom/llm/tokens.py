"""Tokenizers that remember the pieces of text they have seen.

``tokenizers`` spends most of its time on merging the letters of words. Texts are cut at
places where the tokenizer cuts in any case, and each distinct piece is encoded once in a
task. Words of Latin letters, by far the most, go through ``tiktoken``'s merging with the
same merge order; tests hold both against ``tokenizers``. All other pieces go to ``tokenizers``
itself. The memory is emptied when it holds MEMORY pieces; long pieces are never remembered.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

import numpy as np
import tiktoken
from tokenizers import Tokenizer

MEMORY = 600_000
LONGEST = 64
MARKS = ".,;:!?$%&*#|()"  # marks that are one piece when they follow a word; no apostrophe
WORD_END = "</w>"
END_BYTE = b"\xff"  # stands for a word's end; never part of UTF-8


def version(path: str) -> str:
    """Digest of a tokenizer file, which names its version."""
    with open(path, "rb") as file:
        return sha256(file.read()).hexdigest()


def latin_word(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) <= "\xff")


def word_and_marks(text: str) -> tuple[str, str]:
    """A Latin word and the marks after it, or twice the empty string."""
    word = text.rstrip(MARKS)
    return (word, text[len(word):]) if word and latin_word(word) else ("", "")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable bytes stand for themselves, others count on from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merger(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """``tiktoken`` with the merges of a byte-level BPE file, and the file's id for each of its ranks.

    A word's end mark becomes a byte that joins the last letter before any other merge.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    alphabet = byte_alphabet()

    def raw(token: str) -> bytes:
        ended = bool(model["end_of_word_suffix"]) and token.endswith(WORD_END)
        return bytes(alphabet[c] for c in (token[: -len(WORD_END)] if ended else token)) + END_BYTE * ended

    ranks = {bytes([b]): b for b in range(256)}
    if model["end_of_word_suffix"]:
        ranks |= {bytes([b]) + END_BYTE: 256 + b for b in range(255)}
    for k, pair in enumerate(model["merges"]):
        ranks[raw("".join(pair) if isinstance(pair, list) else pair.replace(" ", ""))] = 512 + k
    ids = np.zeros(512 + len(model["merges"]), dtype="<u4")
    for token, number in model["vocab"].items():
        if all(c in alphabet for c in token.removesuffix(WORD_END)) and (rank := ranks.get(raw(token))) is not None:
            ids[rank] = number
    return tiktoken.Encoding("merges", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}), ids


class ByteLevelCounts(dict):
    """Token counts for byte-level BPE that takes one space to the word after it.

    A space between two characters that are no white space always begins a new piece there,
    with or without special tokens. Keys are such pieces without their space.
    """

    unsafe = re.compile(r"\s \S|\S \s|\s \s|^ | $")

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = merger(path)[0]._core_bpe.encode_single_piece

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        word, marks = word_and_marks(piece)
        if word:
            n = len(self.merge(b" " + word.encode())) + (self.encoded(marks) if marks else 0)
        else:
            n = self.encoded(" " + piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        words = text.split(" ")
        if len(words) == 1:
            return self.encoded(text)
        if not self.unsafe.search(text):
            return self.encoded(words[0]) + sum(map(self.__getitem__, words[1:]))
        total, start = 0, 0  # white space runs stay with what is around them
        for cut in re.finditer(r"(?<=\S) (?=\S)", text):
            total += self.piece(text[start:cut.start()])
            start = cut.start()
        return total + self.piece(text[start:])

    def piece(self, text: str) -> int:
        return self[text[1:]] if text[:1] == " " and text[1:2].strip() else self.encoded(text)


class WordIds(dict):
    """Token ids for BPE that drops white space: every run of other characters is encoded alone."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        encoding, self.numbers = merger(path)
        self.merge = encoding._core_bpe.encode_single_piece

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "surrogatepass")
        word, marks = word_and_marks(text)
        if word:
            found = self.numbers[self.merge(word.lower().encode() + END_BYTE)].tobytes()
            if marks:
                found += self[marks.encode()]
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))
