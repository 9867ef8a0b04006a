"""Token ids of public tokenizer files, one encoder per Python worker."""

from __future__ import annotations

import base64
import json
import os
import re
from dataclasses import dataclass
from functools import cache

import numpy as np


@dataclass(frozen=True)
class Vocabulary:
    """Where a byte-level BPE tokenizer lies on every executor: its file and, for speed, the same
    vocabulary as a rank file with its pre-token pattern."""

    path: str
    ranks_path: str | None = None
    pattern: str | None = None


# Texts of these characters alone (Latin, the usual marks) are encoded by tiktoken from
# the same vocabulary's rank file, if one is given: same ids (tested), about four
# times as fast. Any other text goes through the tokenizer file itself, so that two
# libraries' Unicode tables never decide an id. So do texts with long runs of white space,
# on which tiktoken's pattern matcher runs out of stack (at some 950,000 characters).
PLAIN = re.compile("[\u0000-\u017f\u2010-\u2027\u20ac]*")
LONG = 10_000
LONG_SPACE = re.compile(r"\s{%d}" % LONG)


class Encoder:
    """Ids of a byte-level BPE tokenizer file. The strings of its added tokens are those tokens
    (the library's plain call), or ordinary text with ``special_as_text``."""

    def __init__(self, vocabulary: Vocabulary, special_as_text: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.plain, self.added = None, None
        if not special_as_text:
            added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.added = re.compile("|".join(map(re.escape, added))) if added else None
        if vocabulary.ranks_path:
            with open(vocabulary.ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    def is_plain(self, text: str) -> bool:
        return (self.plain is not None and PLAIN.fullmatch(text) is not None
                and not (self.added and self.added.search(text))
                and not (len(text) >= LONG and LONG_SPACE.search(text)))

    def ids(self, text: str) -> list[int]:
        if self.is_plain(text):
            return self.plain.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return np.array(self.ids(text), dtype="<u4").tobytes()


@cache
def encoder(vocabulary: Vocabulary, special_as_text: bool = False) -> Encoder:
    return Encoder(vocabulary, special_as_text)


def byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in
    order, for the code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    letters, entries = byte_of_letter(), content["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in content["added_tokens"]}
    size = max([*entries.values(), *added]) + 1
    out = [b""] * size
    for entry, i in entries.items():
        out[i] = added.get(i) or bytes(letters[c] for c in entry)
    return out


@cache
def pieces(path: str):
    """A sentencepiece processor and the bytes of its pieces (U+2581 is a space, a byte
    piece its byte)."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i)
           else processor.id_to_piece(i).replace("\u2581", " ").encode() for i in range(processor.get_piece_size())]
    return processor, out
