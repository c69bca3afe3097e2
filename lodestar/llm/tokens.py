"""Token ids by a public tokenizer of the tokenizers library, with each distinct word encoded once.

The vocabularies that this module speeds up split a text into words before any merge, and a word's ids depend on the
word alone. So the ids of a text are those of its words in order. Words are kept in tables bounded by their bytes, long texts
are read piece by piece; the merges of a new word are the library's. A text with a character that the word pattern classes otherwise than the library, and
any text under another kind of tokenizer file, is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import regex

# The published word pattern of byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LONGEST, ENTRY, PIECE = 64, 150, 1 << 20  # characters of a kept key; bytes of a table entry besides its text; characters of a piece


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers; special strings count as plain text."""

    def __init__(self, path: str, most: int = 160 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.vocabulary = self.whole.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, first = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = before.get("pretokenizers", [])
        self.spaced = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and first is None
        split = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        self.dropped = bool(split and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"])
        kinds = {x["type"] for x in (first or {}).get("normalizers", [])}
        self.dropped = self.dropped and kinds <= {"NFC", "Replace", "Lowercase"}
        self.by_word = (self.spaced or self.dropped) and spec["model"]["type"] == "BPE" and spec["post_processor"] in (None, {**before})
        if self.spaced and spec["post_processor"] and spec["post_processor"]["type"] == "ByteLevel":
            self.by_word = True
        self.pattern = regex.compile(BYTE_LEVEL if self.spaced else steps[0]["pattern"]["Regex"]) if self.by_word else None
        self.model, self.normalizer, self.letters = self.whole.model, self.whole.normalizer, _byte_letters()
        self.most = most
        self.forget()
        self.fine, self.odd = set(map(chr, range(128))), set()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.old_words.get(word)
            if ids is None:
                letters = word.encode().decode("latin-1").translate(self.letters)
                found = [t.id for t in self.model.tokenize(letters)]
                ids = struct.pack(f"<{len(found)}I", *found)
            self._keep(self.words, word, ids)
        return ids

    def _keep(self, known: dict[str, bytes], key: str, ids: bytes) -> None:
        """Long keys hardly come again."""
        if len(key) <= LONGEST:
            self.held += ENTRY + len(key) + len(ids)
            known[key] = ids

    def _age(self) -> None:
        """When the tables have half of `most` bytes they become the old ones; what is asked for again comes back from there."""
        if self.held > self.most // 2:
            old = self.words, self.chunks
            self.forget()
            self.old_words, self.old_chunks = old

    def forget(self) -> None:
        self.held, self.words, self.old_words = 0, {}, {}
        # Without a normalizer a word is also a chunk with the same ids, so one table has both.
        self.chunks, self.old_chunks = (self.words, self.old_words) if self.spaced else ({}, {})

    def _chunk(self, chunk: str) -> bytes:
        if chunk and max(chunk) <= "\u00ff":  # Latin letters: lower-casing is plain and nothing composes
            body = chunk[1:] if self.spaced and chunk[0] == " " else chunk
            if body.isalpha():
                return self._word(chunk if self.spaced else chunk.lower())
            if body[-1:] in (",", ".") and body[:-1].isalpha():
                return self._word(chunk[:-1] if self.spaced else chunk[:-1].lower()) + self._word(body[-1])
        plain = self.normalizer.normalize_str(chunk) if self.dropped else chunk
        return b"".join([self._word(w) for w in self.pattern.findall(plain)])

    def _judge(self, chars: set[str]) -> None:
        """Whether both libraries put new characters in the same classes; their versions of Unicode may differ."""
        for c in chars:
            probes = [f"a{c}", f"1{c}", f":{c}", f"{c} {c}a"]
            whole = [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch(probes, add_special_tokens=False)]
            plain = [self.normalizer.normalize_str(p) if self.dropped else p for p in probes]
            same = [b"".join(map(self._word, self.pattern.findall(p))) for p in plain] == whole
            (self.fine if same else self.odd).add(c)

    def encode(self, text: str) -> bytes:
        if self.by_word and not text.isascii():
            seen = set(text)
            if not seen <= self.fine:
                self._judge(seen - self.fine - self.odd)
        if not self.by_word or (self.odd and not self.odd.isdisjoint(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.spaced and "  " in text:  # a word border then depends on the run of spaces
            return b"".join(self._each(text))
        if not self.spaced:
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + PIECE)
            end = len(text) if end < 0 else end
            out.append(self._piece(text[at:end]))
            at = end
        return b"".join(out)

    def _each(self, text: str) -> Iterator[bytes]:
        for m in self.pattern.finditer(text):
            self._age()
            yield self._word(m.group())

    def _piece(self, text: str) -> bytes:
        """The ids of a text that is cut before a space, or whole."""
        self._age()
        parts = text.split(" ")
        if self.spaced:
            parts[1:] = [" " + p for p in parts[1:]]
        known = self.chunks
        new = {p: self.old_chunks.get(p) or self._chunk(p) for p in set(parts).difference(known)}
        if not new:
            return b"".join(map(known.__getitem__, parts))
        ids = [new[p] if p in new else known[p] for p in parts]
        for p, i in new.items():
            if p not in known:
                self._keep(known, p, i)
        return b"".join(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process: its tables of words serve all the tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Empty the word tables of this process, for work that needs the memory."""
    for e in _ENCODERS.values():
        e.forget()
