"""Token ids of whole texts, by the tokenizers library with a memo of words.

A text whose only white space is blank, tab and line end is cut where the tokenizer's own
pre-tokenizer always cuts, each distinct piece is encoded once per worker, and the memo joins
the pieces' ids. Any other text, and one that holds an added token such as ``<|endoftext|>``, goes to the tokenizer whole. Both give the same ids (tested).
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

import numpy as np

#: Characters for which the shortcuts are proven: ASCII without odd controls, Latin letters with one form.
_PLAIN = re.compile(r"[\t\n\r !-~¡-¬®-ÖØ-öø-ħĴ-ňŊ-ſ]*")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", r" \t\n\r"  # letters, numbers and white space among them
_MARKS = "'(?:s|t|re|ve|m|ll|d)"
#: The pre-tokenizers' patterns over these characters; a contraction can't start where a letter or number does.
_BLANK = re.compile(rf" ?[{_L}]+| ?[{_N}]+|{_MARKS}| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORDS = re.compile(rf"[{_L}]+|{_MARKS}|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


class Memo(dict):
    """What ``make`` gives for a key, for a bounded number of keys: the older half goes when the newer is full."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, rules = spec["pre_tokenizer"] or {}, (spec["normalizer"] or {}).get("normalizers", [])
        self.cut = None
        if spec["model"]["type"] == "BPE" and spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]:
            self.cut, self.lower = _BLANK.findall, False  # a blank belongs to the word after it
        elif spec["model"]["type"] == "BPE" and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in str(before.get("pretokenizers", [{}])[0].get("pattern")).replace("\\\\", "\\") and [x["type"] for x in rules] == ["NFC", "Replace", "Lowercase"]:
            self.cut, self.lower = _WORDS.findall, True  # white space is dropped
        self.added = [t["content"] for t in spec.get("added_tokens", [])]  # ids of their own wherever a text holds them
        if self.cut and self.lower:
            self.added = [t.lower() for t in self.added]
        self.model, self.table = self.tokenizer.model, _byte_chars()
        self.words = Memo(self._word, memo)

    def _word(self, word: str) -> bytes:
        """The ids of one piece that the pre-tokenizer gives."""
        if word.isascii() and word.isalnum():
            raw = word
        elif word[0] == " " and word.isascii() and word[1:].isalnum():
            raw = self.table[32] + word[1:]
        else:
            raw = "".join(map(self.table.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cut or not _PLAIN.fullmatch(text):
            return self._whole(text)
        seen = text.lower() if self.lower else text
        if any(t in seen for t in self.added):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, self.cut(seen)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
