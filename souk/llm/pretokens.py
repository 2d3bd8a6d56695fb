"""Pre-tokens: the stretches of a text that a tokenizer file encodes by themselves, so that a text's ids are theirs in turn.

Byte-level BPE (``.json``): the pieces of the file's own splitting pattern, between
special tokens; of those each one's string is a piece of its own. BPE of
sentencepiece (``.model``): a stretch begins where a blank follows another
character, since no piece of such a file has a blank after another character.
A file for which this does not hold is refused.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

#: Ids of at most about so many bytes of pre-tokens are kept by a worker; what is kept changes the speed, never the ids.
CACHE_BYTES = 48 << 20
LONG = 64
ENTRY = 160  # bytes an entry takes besides its characters and ids
BLANK = "▁"
_known: dict[tuple, object] = {}


def byte_of() -> dict[str, int]:
    """Byte-level BPE's characters: printable Latin-1 ones stand for themselves, the other bytes for U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {**{chr(b): b for b in own}, **{chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}}


class ByteLevel:
    """A ``.json`` file. specials: their strings in a text are tokens of their own (the library's default), else ordinary text."""

    def __init__(self, path: str, specials: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split = kind["pre_tokenizer"] or {}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in kind["added_tokens"])
        if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or kind["normalizer"] or kind["truncation"] or kind["padding"] or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        names = sorted((t["content"] for t in kind["added_tokens"]), key=len, reverse=True) if specials else []
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        import public_tokenizers

        self.find = regex.compile(public_tokenizers.PATTERN).findall
        # letters and digits of a younger Unicode version than the library's: texts that hold one are split by the library
        none = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
        self.odd = frozenset(regex.findall(r"[\p{L}\p{N}\s]", none))
        self.size = self.tokenizer.get_vocab_size()

    def split(self, text: str) -> list[str]:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens in order, and how many special tokens stand between them."""
        if self.special is None:
            return self.split(text), 0
        parts = self.special.split(text)
        if len(parts) == 1:
            return self.split(text), 0
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def encode(self, pretokens: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]

    def raw(self, pretokens: list[str]) -> list[bytes]:
        """Ids of 32 bits, as bytes."""
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        known = byte_of()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        return [bytes([known[c] for c in n]) if all(c in known for c in n) else n.encode() for n in names]


class Pieces:
    """A ``.model`` file, which adds a blank before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.names = [self.model.id_to_piece(i) for i in range(self.size)]
        odd = " a  b ½▁ﬁ́ c "
        if any(re.search(f"[^{BLANK}]{BLANK}", n) for n in self.names) or self.model.normalize(odd) != BLANK + odd.replace(" ", BLANK):
            raise ValueError(f"{path}: pieces cross blanks, or texts are changed")
        self.blank = self.model.piece_to_id(BLANK)
        self.begins = np.array([n.startswith(BLANK) for n in self.names])
        self.find = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+").findall

    def pretokens(self, text: str) -> tuple[list[str], int]:
        return (self.find(" " + text) if text else []), 0

    def encode(self, pretokens: list[str]) -> list[np.ndarray]:
        # each begins with a blank, which the model adds itself
        ids = self.model.encode([p[1:] for p in pretokens], num_threads=1)
        return [np.array(x if len(p) > 1 else [self.blank], dtype=np.int32) for p, x in zip(pretokens, ids, strict=True)]

    def raw(self, pretokens: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.encode(pretokens)]

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(self.names)]


def reader(path: str, specials: bool = True):
    """The file's reader; a worker opens each file once."""
    key = path, specials
    if key not in _known:
        _known[key] = Pieces(path) if path.endswith(".model") else ByteLevel(path, specials)
    return _known[key]


class Ids:
    """Ids of whole texts through the ids of their pre-tokens, of which the frequent ones are kept."""

    def __init__(self, of) -> None:
        self.of, self.known, self.kept = of, {}, 0

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(self.of.pretokens(text)[0])), dtype=np.int32)

    def pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as bytes; what is new in them is asked at once."""
        got = list(map(self.known.get, parts))
        if None not in got:
            return got
        new = list({p for p, x in zip(parts, got, strict=True) if x is None})
        fresh = dict(zip(new, self.of.raw(new), strict=True))
        if self.kept < CACHE_BYTES:
            keep = {p: x for p, x in fresh.items() if len(p) <= LONG}
            self.known.update(keep)
            self.kept += sum(len(p) + len(x) + ENTRY for p, x in keep.items())
        return [fresh[p] if x is None else x for p, x in zip(parts, got, strict=True)]
