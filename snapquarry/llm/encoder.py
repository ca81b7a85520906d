"""Exact batch tokenisation with a cache of words.

A byte-pair tokenizer encodes each pre-token by itself, so the ids of a text are the ids of
its pieces if no cut changes the pre-tokens.  The cuts here stand before single spaces and
single newlines; texts with white space beside white space are encoded whole.  A piece of
Latin letters, with or without punctuation behind, goes straight to the library's byte-pair
model; any other piece goes through the whole tokenizer.  A text that may hold a special
token's string is encoded whole, so that string gives what the library gives.  All ids come
from the ``tokenizers`` library; only repeated pieces are looked up.  The cache is bounded by
pieces and by their length, emptied when full and given back at the end of a task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

#: Characters of the longest piece that is kept.
_LONGEST = 64
#: Letters whose lower case and normal form are themselves or one such letter.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,80})([.,;:!?]{0,8})")


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encode texts to little-endian unsigned 32-bit ids, as ``encode(text, add_special_tokens=False)`` gives them.

    Null texts count as empty.
    """

    def __init__(self, path: str, max_pieces: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, bpe = spec.get("pre_tokenizer") or {}, spec["model"].get("type") == "BPE"
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if bpe and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
            self._kind, self._newline = "bytes", self._whole("\n")
        elif bpe and spec["model"].get("end_of_word_suffix") and steps == ["NFC", "Replace", "Lowercase"] and '"Removed"' in json.dumps(pre):
            self._kind, self._newline = "words", b""
        else:
            self._kind = "whole"
        # the start of each added token's string; normalising makes no such marks of other characters
        added = {x["content"][:2] for x in spec.get("added_tokens") or []}
        if not all(re.fullmatch(r"[!-/:-@\[-`{-~]{2}", x) for x in added):
            self._kind = "whole"
        self._added = re.compile("|".join([r"\s\s", *map(re.escape, sorted(added))]))
        self._symbols = _byte_symbols()
        self._cache: dict[str, bytes] = {}
        self._packed = [i.to_bytes(4, "little") for i in range(self._tok.get_vocab_size())]
        self._marks: dict[str, bytes] = {"": b""}
        self._max = max_pieces

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; a newline at its start stands for itself, else a space comes before it."""
        head = piece[:1] == "\n"
        body = piece[1:] if head else piece
        plain = _PLAIN.fullmatch(body)
        if not plain:
            ids = self._whole(body if head else " " + body) if body or not head else b""
        else:
            word, marks = plain.groups()
            stem = word if not marks else ("\n" + word if head else word)
            ids = self._cache.get(stem) if marks else None
            if ids is not None and head:
                ids = ids[len(self._newline) :]
            if ids is None:
                symbols = word.lower() if self._kind == "words" else word
                if not word.isascii():
                    symbols = symbols.encode().decode("latin-1").translate(self._symbols)
                if self._kind == "bytes" and not head:
                    symbols = self._symbols[32] + symbols
                packed = self._packed
                ids = b"".join([packed[t.id] for t in self._model.tokenize(symbols)])
                if marks and len(stem) <= _LONGEST:
                    self._cache[stem] = self._newline + ids if head else ids
            end = self._marks.get(marks)
            if end is None:
                if len(self._marks) > 10_000:
                    self._marks.clear()
                end = self._marks[marks] = self._whole(marks)
            ids += end
        return self._newline + ids if head else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed; nulls give no ids."""
        whole = self._added.search
        cache, out, skip = self._cache, [], 0 if self._kind == "whole" else len(self._newline)
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if self._kind == "whole" or whole(text):
                out.append(self._whole(text))
                continue
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\n" + pieces[0]
            ids = list(map(cache.get, pieces))
            for i in [i for i, known in enumerate(ids) if known is None]:
                piece = pieces[i]
                known = cache.get(piece)
                if known is None:
                    if len(cache) >= self._max:
                        cache.clear()
                    known = self._piece(piece)
                    if len(piece) <= _LONGEST:
                        cache[piece] = known
                ids[i] = known
            out.append(b"".join(ids)[skip:])
        return out


    def forget(self) -> None:
        self._cache = {}
        self._marks = {"": b""}


_ENCODERS: dict[str, WordEncoder] = {}


@contextmanager
def encoder(path: str, keep: bool = False) -> Iterator[WordEncoder]:
    """One encoder for each worker process and file.

    What it learned in a task goes when the task ends, unless ``keep`` leaves it, within
    ``max_pieces`` short pieces, to the worker's next task.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        if not keep:
            _ENCODERS[path].forget()
