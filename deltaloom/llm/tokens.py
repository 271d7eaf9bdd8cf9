"""Public tokenizers, and how a text is cut into pre-tokens that can be encoded one by one.

A byte-level tokenizer cuts a text before it merges anything, and a run of white space with the run of other characters
after it is cut alike wherever it stands. So the ids of a text are those of its parts, and each distinct part needs to
be encoded only once. Texts with one of four control characters that Python and the tokenizer class differently, and
tokenizers of other kinds, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from collections.abc import Callable
from itertools import compress
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A run of white space and what follows it, up to the next white space.
_PART = re.compile(r"\s*\S+|\s+")
#: Where no two white spaces meet, a text may be cut before any of them.
_RUN = re.compile(r"\s\s")
_UNCLEAR = re.compile("[\x1c-\x1f]")
#: By byte: 1 for ASCII white space, 2 for those of _UNCLEAR, 4 for a-z and A-Z, 8 for other ASCII; 0 beyond ASCII.
_KIND = np.array([1 if b in b" \t\n\v\f\r" else 2 if 0x1C <= b < 0x20 else 4 if chr(b).isalpha() else 8 for b in range(128)] + [0] * 128, dtype=np.uint8)
#: So many bytes of texts are cut at a time, and the whole of the last of them.
_AT_ONCE = 4 << 20
#: So many parts that no cache knows are encoded as one text.
_JOINED = 512
#: The plain case of a part: letters, perhaps after one blank, and then perhaps marks. It cuts as PRE_TOKEN does.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

# Fixed value: the pattern by which byte-level tokenizers of this kind cut a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it shows, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizer file: ``.json`` for tokenizers, ``.model`` for sentencepiece. Adds no special tokens; their strings
    inside a text are handled as the library does by default."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._pattern = regex.compile(PRE_TOKEN)
        self.specials: list[str] = []
        self.byte_level = False
        #: How many bytes of a text each id stands for, if the ids of a text are known to cover all of its bytes.
        self.bytes_of: np.ndarray | None = None
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode: Callable[[list[str]], list[list[int]]] = lambda texts: processor.encode(texts, num_threads=1)
            self.size = processor.get_piece_size()
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task is one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.size = tokenizer.get_vocab_size()
        self._merge = tokenizer.model.tokenize
        self._id = tokenizer.token_to_id
        cut, added = described.get("pre_tokenizer") or {}, described.get("added_tokens") or []
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        self.byte_level = cut.get("type") == "ByteLevel" and bool(cut.get("use_regex")) and not cut.get("add_prefix_space") and described.get("normalizer") is None and plain
        self.specials = [t["content"] for t in added] if self.byte_level else []
        known = tokenizer.get_vocab() if self.byte_level else {}
        if known and all(letter in known for letter in _LETTERS.values()):
            self.bytes_of = np.zeros(max(known.values()) + 1, dtype=np.int64)
            self.bytes_of[list(known.values())] = list(map(len, known))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._encode(texts) if texts else []

    def parts(self, text: str) -> list[str]:
        """Pieces of the text, in order, whose ids one after another are the text's."""
        if not text:
            return []
        if not self.byte_level or (not text.isprintable() and _UNCLEAR.search(text)):
            return [text]
        if self._special is None or not any(s in text for s in self.specials):
            return self._cut(text)
        out: list[str] = []
        for piece in self._special.split(text):
            out += [piece] if piece in self.specials else self._cut(piece)
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        if "\0" in text or _RUN.search(text):
            return _PART.findall(text)
        return [part for part in text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if part]

    def pre_tokens(self, part: str) -> list[str]:
        """What the tokenizer itself cuts a part into."""
        if (m := _PLAIN.fullmatch(part)) and self.byte_level:
            return [m[1], m[2]] if m[2] else [part]
        if not self.byte_level or part in self.specials or any(s in part for s in self.specials) or _UNCLEAR.search(part):
            return [part]
        return self._pattern.findall(part)

    def encode_pre_token(self, pre_token: str) -> list[int]:
        """The ids of one of pre_tokens(): of byte-level tokenizers by their model alone, as nothing is left to cut."""
        if not self.byte_level or _UNCLEAR.search(pre_token):
            return self._encode([pre_token])[0]
        if pre_token in self.specials:
            return [self._id(pre_token)]
        return [t.id for t in self._merge(pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS))]

    def encode_parts(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The parts in another order, in that order their ids one after another, and how many each has.

        Between a part that ends in no white space and one that begins with ASCII white space every text is cut. So many such
        parts are encoded as one text, whose ids are told apart by the bytes that they stand for.
        """
        joined: list[bytes] = []
        alone: list[bytes] = []
        for part in parts:
            fits = self.bytes_of is not None and part[0] in b" \t\n\v\f\r" and not part.decode()[-1].isspace()
            (joined if fits else alone).append(part)
        names: list[bytes] = []
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(joined), _JOINED):
            here = joined[k : k + _JOINED]
            text = b"".join(here).decode()
            if any(s in text for s in self.specials) or _UNCLEAR.search(text):
                alone += here
                continue
            found = np.array(self._encode([text])[0], dtype=np.uint32)
            ends, upto = np.cumsum(list(map(len, here))), np.cumsum(self.bytes_of[found])
            last = np.searchsorted(upto, ends)
            if upto[-1:] != ends[-1:] or (upto[last] != ends).any():
                alone += here
                continue
            names += here
            ids.append(found)
            sizes.append(np.diff(last, prepend=-1))
        each = [[x for p in self.pre_tokens(part.decode()) for x in self.encode_pre_token(p)] for part in alone]
        ids.append(np.array([x for found in each for x in found], dtype=np.uint32))
        sizes.append(np.array(list(map(len, each)), dtype=np.int64))
        return names + alone, np.concatenate(ids), np.concatenate(sizes)


class IdCache:
    """The ids of parts as bytes, each distinct pre-token encoded once. Emptied when it has grown beyond a bound, so
    memory does not follow the vocabulary; each() keeps what it has met again."""

    def __init__(self, encoder: Encoder, most: int = 600_000) -> None:
        self.encoder, self.most = encoder, most
        self.known: dict[str, bytes] = {}
        # For each(): the number of a part; by number where its ids begin among those held, and how often it was looked up.
        self.place: dict[bytes, int] = {}
        self.first, self.held, self.uses = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)

    def _add(self, part: str) -> bytes:
        """A pre-token is a part too, so parts and pre-tokens share one table."""
        out = []
        for pre_token in self.encoder.pre_tokens(part):
            ids = self.known.get(pre_token)
            if ids is None:
                found = self.encoder.encode_pre_token(pre_token)
                ids = self.known[pre_token] = struct.pack(f"<{len(found)}I", *found)
            out.append(ids)
        whole = self.known[part] = b"".join(out)
        return whole

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers, closed by ``end``."""
        parts = self.encoder.parts(text) if text else []
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self.known.get(part) or self._add(part) if ids is None else ids for part, ids in zip(parts, found, strict=True)]
        if end is not None:
            found.append(struct.pack("<I", end))
        if len(self.known) > self.most:
            self.known = {}
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _shrink(self) -> None:
        """Keeps the parts that were looked up more than once, half of ``most`` at most. What was long ago counts less."""
        often = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        kept = np.zeros(len(self.uses), dtype=bool)
        kept[often] = self.uses[often] > 1
        sizes = np.diff(self.first)
        self.place = {part: k for k, part in enumerate(compress(self.place, kept.tolist()))}
        self.held, self.uses = self.held[np.repeat(kept, sizes)], (self.uses[kept] + 1) >> 1
        self.first = np.append(0, np.cumsum(sizes[kept]))

    def _places(self, parts: list[bytes]) -> np.ndarray:
        """The numbers of distinct parts; those not known are encoded."""
        found = list(map(self.place.get, parts))
        if None in found:
            names, ids, sizes = self.encoder.encode_parts([part for part, at in zip(parts, found, strict=True) if at is None])
            self.place.update(zip(names, range(len(self.uses), len(self.uses) + len(names)), strict=True))
            self.first = np.append(self.first, len(self.held) + np.cumsum(sizes))
            self.held, self.uses = np.append(self.held, ids), np.append(self.uses, np.zeros(len(names), dtype=np.int32))
            found = [self.place[part] if at is None else at for part, at in zip(parts, found, strict=True)]
        places = np.array(found, dtype=np.int64)
        self.uses[places] += 1
        return places

    def each(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """ids() of every text, closed by ``end``. The parts of many texts are found and told apart as arrays."""
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            here = texts[at:]
            ends = np.frombuffer(here.buffers()[1], dtype=width)[here.offset : here.offset + len(here) + 1]
            n = min(len(here), int(np.searchsorted(ends, int(ends[0]) + _AT_ONCE)) or 1)
            here, ends = here[:n], ends[: n + 1]
            data = np.frombuffer(here.buffers()[2] or b"", dtype=np.uint8)[int(ends[0]) : int(ends[-1])]
            out += self._each(here, data, ends.astype(np.int64) - int(ends[0]), end)
            at += n
        return out

    def _each(self, texts: pa.Array, data: np.ndarray, ends: np.ndarray, end: int) -> list[np.ndarray]:
        """The same of texts that are the bytes of ``data`` between ``ends``."""
        kind, odd = _KIND[data], np.full(len(texts), not self.encoder.byte_level)
        if (unclear := np.flatnonzero(kind == 2)).size:
            odd[np.searchsorted(ends, unclear, side="right") - 1] = True
        for special in self.encoder.specials:
            odd |= pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)
        if odd.all():
            return [self.ids(t.as_py(), end) for t in texts]
        # A text is cut where it begins, before ASCII white space that follows none, and between a letter and an ASCII mark or
        # digit, where the letter is ASCII or of U+00C0 to U+023F.
        cut = kind == 1
        cut[1:] &= kind[:-1] != 1
        cut[1:] |= (kind[1:] == 8) & (kind[:-1] == 4)
        after = np.flatnonzero((kind[2:] == 8) & (data[1:-1] >= 0x80)) + 2
        lead, last = data[after - 2], data[after - 1]
        cut[after[(lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead >= 0xC4) & (lead <= 0xC8)]] = True
        wide = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
        one, two, three = (data[np.maximum(wide - k, 0)] for k in (1, 2, 3))
        joined = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
        joined |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
        cut[wide[joined]] = False
        cut[ends[:-1][ends[1:] > ends[:-1]]] = True
        starts = np.flatnonzero(cut)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        if len(self.place) > self.most:
            self._shrink()
        places = self._places(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, places = np.append(self.held, np.uint32(end)), np.append(places, len(self.uses))
        begin, sizes = self.first[places], np.append(self.first, len(flat))[places + 1] - self.first[places]
        # The parts of each text, and after them its end.
        texts_of = np.searchsorted(starts, ends).tolist()
        codes = np.full(len(starts) + len(texts), len(places) - 1)
        codes[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), np.diff(texts_of))] = parts.indices.to_numpy()
        lengths = sizes[codes]
        upto = np.cumsum(lengths)
        ids = flat[np.repeat(begin[codes] - upto + lengths, lengths) + np.arange(upto[-1])]
        last = upto[np.array(texts_of[1:]) + np.arange(len(texts))].tolist()
        return [self.ids(texts[k].as_py(), end) if odd[k] else ids[a:b] for k, (a, b) in enumerate(zip([0, *last], last, strict=False))]


def process_cache(path: str) -> IdCache:
    """One cache per worker process and file, kept from task to task."""
    kept = sys.modules.setdefault("_deltaloom_worker", ModuleType("_deltaloom_worker")).__dict__
    if path not in kept:
        kept[path] = IdCache(Encoder(path))
    return kept[path]


def drop_caches() -> None:
    """Frees what process_cache() keeps, for tasks that need memory for other things."""
    sys.modules.pop("_deltaloom_worker", None)
