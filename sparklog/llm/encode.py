"""Token ids of many texts, by the tokenizers library, with a cache of chunks.

In both kinds of tokenizer handled here merges never cross the border of a pre-token, and nothing looks back. A text is
cut at places that are such borders under either pattern: before white space that follows something else, and after a
run of Latin letters that an ASCII sign or digit follows. The ids of a text are those of its chunks in a row, so each
distinct chunk needs to be encoded once; new chunks of letters alone are encoded many at a time, and told apart by their
first or last tokens. Where the tokenizer drops white space, chunks do without it; where it folds
case too, texts up to U+00FF, which its other normalisation leaves alone, are folded before. A tokenizer of another kind,
a text that holds a special token's string (which the library takes for that token), and a text with control characters
that Python takes for white space and the patterns don't, are encoded whole. So the ids are always those of the plain
call ``encode(text, add_special_tokens=False)``.

Chunks are kept in two generations of bounded size: when the young one is full it takes the old one's place, and what is
met again in the old one moves to the young one. So frequent chunks stay, however many rare ones a corpus has.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np

from .common import dropped_by

_LATIN = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\s!-@\[-`{-~])|\S++"
_CHUNK = {"bytes": re.compile(rf"\s*(?:{_LATIN})|\s+"), "words": re.compile(_LATIN)}
#: Chunks that are one pre-token each, what joins them, and how a token tells that one starts ("bytes") or ends ("words").
_PURE = {"bytes": re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+"), "words": re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")}
_JOIN = {"bytes": "", "words": " "}
_MARK = {"bytes": lambda token: token.startswith("Ġ"), "words": lambda token: token.endswith("</w>")}
_TOGETHER = 1000
_ODD = re.compile("[\x1c-\x1f\x85]")
#: Bytes of memory that a generation of kept chunks may take, and what an entry takes besides its letters and ids.
CACHE, ENTRY = 80 << 20, 190


def _kind(path: str) -> str | None:
    """ "bytes" or "words" for the kinds that can be cut."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model = j["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or j.get("post_processor"):
        return None
    if any(not t["special"] or t["normalized"] for t in j["added_tokens"]):
        return None
    pre, norm = j["pre_tokenizer"], j["normalizer"]
    if norm is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return "bytes"
    if norm is None or pre is None or norm["type"] != "Sequence" or pre["type"] != "Sequence":
        return None
    patterns = [p["pattern"].get("Regex") for p in pre["pretokenizers"] if p["type"] == "Split"]
    folds = [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]
    return "words" if folds and patterns == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"] else None


class Encoder:
    """Texts to arrays of ids, those of the library's plain call."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        #: 16-bit ids where they hold all, to keep what is stored small.
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = _kind(path)
        self.marks = np.zeros(self.size, bool)
        if self.kind:
            for token, i in self.tokenizer.get_vocab().items():
                self.marks[i] = _MARK[self.kind](token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = CACHE

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if self.kind:
            pure = list(filter(_PURE[self.kind].fullmatch, chunks))
            size = self.dtype.itemsize
            for i in range(0, len(pure), _TOGETHER):
                part = pure[i : i + _TOGETHER]
                ids = np.array(self.tokenizer.encode_batch_fast([_JOIN[self.kind].join(part)], add_special_tokens=False)[0].ids, self.dtype)
                at = np.flatnonzero(self.marks[ids])
                if len(at) == len(part):
                    edges = (np.append(at, len(ids)) if self.kind == "bytes" else np.append(0, at + 1)) * size
                    raw, edge = ids.tobytes(), edges.tolist()
                    out.update(zip(part, (raw[a:b] for a, b in zip(edge, edge[1:]))))
        rest = [c for c in chunks if c not in out]
        out.update(zip(rest, self._each(rest)))
        return out

    def _chunks(self, text: str) -> list[str]:
        low = text.lower()
        if self.kind is None or _ODD.search(text) or any(t in low for t in self.special):
            return [text]
        if self.kind == "words":
            try:
                text.encode("latin-1")
                text = low
            except UnicodeEncodeError:
                pass
        return _CHUNK[self.kind].findall(text)

    def encode(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text (null: none), with the end id if one is given."""
        on = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and looking for cycles among so many lists and tuples takes a fifth of the time
        try:
            return self._encode(texts, end)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str | None], end: int | None) -> list[np.ndarray]:
        get, tail = self.young.get, b"" if end is None else array(self.code, [end]).tobytes()
        done: list[list[bytes | None]] = []
        missing: dict[str, list[tuple[list[bytes | None], int]]] = {}
        for text in texts:
            chunks = self._chunks(text) if text else []
            parts = list(map(get, chunks))
            done.append(parts)
            at = -1
            for _ in range(parts.count(None)):
                at = parts.index(None, at + 1)
                missing.setdefault(chunks[at], []).append((parts, at))
        again = {chunk: ids for chunk in missing if (ids := self.old.get(chunk)) is not None}
        for chunk, ids in (again | self._ids([chunk for chunk in missing if chunk not in again])).items():
            if len(chunk) <= 64:
                self.young[chunk] = ids
                self.room -= ENTRY + len(chunk) + len(ids)
            for parts, at in missing[chunk]:
                parts[at] = ids
        if self.room < 0:
            self.old, self.young, self.room = self.young, {}, CACHE
        return [np.frombuffer(b"".join((*parts, tail)), self.dtype) for parts in done]  # type: ignore[arg-type]


_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    for e in _encoders.values():
        e.old = {}


dropped_by(_forget)


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; workers keep it, with one generation of chunks when they turn to another function."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
