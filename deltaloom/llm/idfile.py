"""Files of token ids, compressed by context mixing and range coding.

A file holds documents one after another. Its ids are cut into blocks of ``block_ids``, each coded by a model that
starts afresh, with a checksum of its own, so blocks can be read alone and damage stays in one.

The model has three orders. Order 0 counts all ids of the block, order 1 those that followed the id before, and order 2
has, for the two ids before, the one that last proved right, with how often it came and how often another. Orders 1 and
0 are mixed by a weight that is learnt by how much order 1 has seen in its context: the share of ids that it knew. Order
2 is mixed with both by another, learnt from the share it had in the probability of what came. The id that order 2 names
gets the mixed probability of all three; the rest is an escape, after which the id is coded by the mixture of orders 1
and 0: whether order 1 knows it, and then the id by that order's counts.

A block is coded as many streams, consecutive parts of it that share the block's model: one id of every stream of every
block of a file goes through the coder at a time, as vector operations. What has come is learnt at fixed steps, after
which all predictions stand until the next, so the encoder makes those of many steps at once.

    file:   magic, header (JSON), blocks, documents (doc_id, its ids), directory, footer
    block:  number of ids, number of streams, crc32 of the ids, code words of each stream, code words of 32 bits
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"IDCM0003"
BLOCK_IDS = 1 << 18
#: A block has so many streams, or one for each so many ids.
STREAMS, STREAM_IDS = 128, 512
_BITS = 16
_TOTAL = 1 << _BITS
#: Slots of order 2 per block, in powers of two; what a slot counts to; how much a known id adds to the counts of order 0.
_SLOTS_LOG, _MOST, _GAIN = 17, 200, 64
#: Steps between learning, at most; kinds of slots of order 2 and of contexts of order 1, that have weights of their own.
_EVERY, _KINDS_2, _KINDS_1 = 128, 65, 256
_U64 = np.uint64
_WORD = _U64(32)
_LOW32 = _U64(0xFFFFFFFF)


class IdFileError(ValueError):
    """The file breaks the format or a checksum."""


class _Lanes:
    """The interval of each lane; its size is kept above 2^32 between symbols."""

    def __init__(self, lanes: int) -> None:
        self.size = np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=_U64)
        self.used = np.zeros(lanes, dtype=np.int64)

    def widen(self, m: int) -> None:
        short = np.flatnonzero(self.size[:m] <= _LOW32)
        if len(short):
            self.size[short] <<= _WORD
            self.shift(short)

    def shift(self, lanes: np.ndarray) -> None:
        raise NotImplementedError


class _Encoder(_Lanes):
    def __init__(self, lanes: int, most: int) -> None:
        super().__init__(lanes)
        self.low = np.zeros(lanes, dtype=_U64)
        self.words = np.zeros((lanes, most), dtype=np.uint32)
        self.carries = np.zeros((lanes, most), dtype=np.uint32)

    def put(self, lanes: slice | np.ndarray, step: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Narrows lanes to ``width`` steps from ``low`` on."""
        more = step * low.view(_U64)
        now = self.low[lanes] + more
        self.low[lanes] = now
        over = np.flatnonzero(now < more)
        if len(over):
            over = over if isinstance(lanes, slice) else lanes[over]
            self.carries[over, self.used[over] - 1] += 1
        self.size[lanes] = step * width.view(_U64)

    def shift(self, lanes: np.ndarray) -> None:
        used, low = self.used[lanes], self.low[lanes]
        if used.max() >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.carries = np.concatenate([self.carries, np.zeros_like(self.carries)], axis=1)
        self.words[lanes, used] = low >> _WORD
        self.low[lanes] = low << _WORD
        self.used[lanes] = used + 1

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.shift(np.arange(len(self.low)))
        out = []
        for k, n in enumerate(self.used.tolist()):
            code, carries = self.words[k, :n].astype(">u4").tobytes(), self.carries[k, :n]
            if carries.any():
                code = (int.from_bytes(code) + int.from_bytes(carries.astype(">u4").tobytes())).to_bytes(4 * n)
            out.append(code)
        return out


class _Decoder(_Lanes):
    def __init__(self, codes: list[np.ndarray]) -> None:
        super().__init__(len(codes))
        self.width = max(map(len, codes)) + 4
        self.words = np.zeros((len(codes), self.width), dtype=_U64)
        for k, code in enumerate(codes):
            self.words[k, : len(code)] = code
        self.used += 2
        self.code = (self.words[:, 0] << _WORD) | self.words[:, 1]  # counted from the interval's low end

    def target(self, lanes: slice | np.ndarray, step: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        """The step in which each lane's code stands; damaged code may stand beyond them all."""
        return np.minimum((self.code[lanes] // step).view(np.int64), total - 1)

    def take(self, lanes: slice | np.ndarray, step: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        self.code[lanes] -= step * low.view(_U64)
        self.size[lanes] = step * width.view(_U64)

    def shift(self, lanes: np.ndarray) -> None:
        used = self.used[lanes]
        self.code[lanes] = (self.code[lanes] << _WORD) | self.words[lanes, np.minimum(used, self.width - 1)]
        self.used[lanes] = used + 1


def _in_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys, equal ones as they stand. Keys and places sort as one number where both fit in it."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (62 - bits):
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) + np.arange(len(keys))) & ((1 << bits) - 1)


class _Counts:
    """Counts of sorted keys, as sums before each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.set(keys, counts)

    def set(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.below = np.concatenate([[0], np.cumsum(counts)])

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted keys, each once."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.counts[at[known]] += counts[known]
        self.set(np.insert(self.keys, at[~known], keys[~known]), np.insert(self.counts, at[~known], counts[~known]))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand, and their counts, 0 if they are not there. Looked up in order, which is much faster."""
        order = _in_order(keys)
        found = keys[order]
        places = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        at, counts = np.empty_like(keys), np.empty_like(keys)
        at[order], counts[order] = places, self.counts.take(places) * (self.keys.take(places) == found)
        return at, counts


class _Model:
    """Predictions from the tables of blocks. Encoder and decoder drive it alike.

    Sums, products, quotients and roundings alone make the probabilities, so they are the same on every machine. Lanes
    are given by their blocks, in arrays of any shape.
    """

    def __init__(self, blocks: int, vocabulary: int) -> None:
        self.vocabulary, self.blocks = vocabulary, blocks
        # Order 2, by slot: the id named, how often it came and how often another, its kind (0: none named), and what
        # orders 1 and 0 gave it when it was last looked at. By kind: how often it came or not, and the weight's share.
        slots = blocks << _SLOTS_LOG
        self.named = np.zeros(slots, dtype=np.uint16 if vocabulary <= 1 << 16 else np.uint32)
        self.hits, self.misses, self.kind_2 = (np.zeros(slots, dtype=np.uint8) for _ in range(3))
        self.by_10 = np.zeros(slots, dtype=np.float32)
        self.came = np.ones((2, blocks * _KINDS_2))
        self.share = np.tile([[0.5], [1.0]], blocks * _KINDS_2)
        # Order 1: keys of (block, id before, id); sums before each context; and by kind how often it knew the id or not.
        self.first = _Counts(np.full(1, np.iinfo(np.int64).max), np.zeros(1, dtype=np.int64))
        self.below_1 = np.zeros(blocks * vocabulary + 1, dtype=np.int64)
        self.kind_1 = np.zeros(blocks * vocabulary, dtype=np.uint8)
        self.known = np.ones((2, blocks * _KINDS_1))
        # Order 0: of block and id, each of one or more.
        self.zero = np.ones(blocks * vocabulary, dtype=np.int64)
        self.next, self.step = 4, 0
        self._add_up()

    def _add_up(self) -> None:
        """All that is looked up until the next learning."""
        self.below_0 = np.concatenate([[0], np.cumsum(self.zero)])
        self.start_0 = self.below_0[:: self.vocabulary]
        self.right_2 = self.came[0] / (self.came[0] + self.came[1])
        self.weight_2 = self.share[0] / self.share[1]
        self.mine_2, self.rest_2 = self.weight_2 * self.right_2, 1.0 - self.weight_2
        self.weight_1 = self.known[0] / (self.known[0] + self.known[1])
        self.knows_1 = (self.weight_1 * (_TOTAL - 64)).astype(np.int64) + 32

    def order_2(self, block: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id named, what it has of _TOTAL: 0 if none is named)."""
        key = ((one + (two << 20)).view(_U64) * _U64(0xD6E8FEB86659FD93)) >> _U64(64 - _SLOTS_LOG)
        slot = (block << _SLOTS_LOG) + key.view(np.int64)
        kind = self.kind_2.take(slot)
        at = block * _KINDS_2 + kind
        mixed = self.mine_2.take(at) + self.rest_2.take(at) * self.by_10.take(slot)
        return slot, self.named.take(slot).astype(np.int64), ((mixed * (_TOTAL - 600)).astype(np.int64) + 1) * (kind > 0)

    def order_1(self, block: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, counts before it, counts in it, what of _TOTAL it has that the id is known: 0 if nothing is)."""
        context = block * self.vocabulary + one
        below = self.below_1.take(context)
        n = self.below_1.take(context + 1) - below
        return context, below, n, self.knows_1.take(block * _KINDS_1 + self.kind_1.take(context)) * (n > 0)

    def learn(self, block: np.ndarray, one: np.ndarray, ids: np.ndarray, slot: np.ndarray, named: np.ndarray, share: np.ndarray) -> None:
        """What has come since the last time, step by step, with what order 2 said."""
        v = self.vocabulary
        came = (named == ids) & (share > 0)
        context, _, n, _ = self.order_1(block, one)
        pairs = context * v + ids
        # The weights, by what has come.
        some = np.flatnonzero(share)
        at, yes = block[some] * _KINDS_2 + self.kind_2[slot[some]], came[some]
        by_10 = self.by_10[slot[some]].astype(float)
        mine = self.weight_2[at] * np.where(yes, self.right_2[at], 1.0 - self.right_2[at])
        other = self.rest_2[at] * np.where(yes, by_10, 1.0 - by_10)
        size = len(self.weight_2)
        seen = np.bincount(at, minlength=size)
        self.share += [np.bincount(at, weights=mine / (mine + other), minlength=size), seen]
        hits = np.bincount(at, weights=yes, minlength=size)
        self.came += [hits, seen - hits]
        some = np.flatnonzero(~came & (n > 0))
        at, inside = block[some] * _KINDS_1 + self.kind_1[context[some]], self.first.of(pairs[some])[1] > 0
        size = len(self.weight_1)
        hits = np.bincount(at, weights=inside, minlength=size)
        self.known += [hits, np.bincount(at, minlength=size) - hits]
        # The counts of orders 0 and 1.
        self.zero += _GAIN * np.bincount(block * v + ids, minlength=len(self.zero))
        keys, times = np.unique(pairs, return_counts=True)
        self.first.add(keys, times)
        of = self.first.keys[:-1] // v
        kinds = np.bincount(of, minlength=self.blocks * v)
        self.below_1 = self.first.below[np.concatenate([[0], np.cumsum(kinds)])]
        touched = keys[np.concatenate([[True], keys[1:] // v != keys[:-1] // v])] // v
        sizes = np.frexp((self.below_1[touched + 1] - self.below_1[touched]).astype(float))[1]
        self.kind_1[touched] = 16 * np.minimum(sizes, 15) + np.minimum(np.frexp(kinds[touched].astype(float))[1], 15)
        self._add_up()
        # Order 2: sorted by slot and time, so the last of each slot is what came last there.
        order = _in_order(slot)
        here = slot[order]
        heads = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        last = order[np.append(heads[1:], len(order)) - 1]
        here, times = here[heads], np.diff(np.append(heads, len(order)))
        right = np.add.reduceat(came[order].astype(np.int64), heads)
        hits, misses = self.hits[here] + right, self.misses[here] + times - right
        new = misses > hits
        self.named[here] = np.where(new, ids[last], self.named[here])
        hits, misses = np.where(new, 1, hits), np.where(new, 0, misses)
        full = hits + misses > _MOST
        while full.any():
            hits, misses = np.where(full, (hits + 1) >> 1, hits), np.where(full, misses >> 1, misses)
            full = hits + misses > _MOST
        self.hits[here], self.misses[here] = hits, misses
        self.kind_2[here] = 1 + 8 * np.minimum(hits, 7) + np.minimum(misses, 7)
        block, named = block[last], self.named[here].astype(np.int64)
        context, _, n, _ = self.order_1(block, one[last])
        weight = self.weight_1[block * _KINDS_1 + self.kind_1[context]]
        by_0 = self.zero[block * v + named] / (self.start_0[block + 1] - self.start_0[block])
        self.by_10[here] = weight * self.first.of(context * v + named)[1] / np.maximum(n, 1) + (1.0 - weight) * by_0


def _streams(n: int) -> list[int]:
    """How many ids each stream of a block of n has."""
    streams = max(1, min(STREAMS, n // STREAM_IDS))
    return [(n * (k + 1)) // streams - (n * k) // streams for k in range(streams)]


def _lanes(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, length, first id in all blocks on end) of each lane, longest first."""
    parts = [_streams(n) for n in sizes]
    block = np.repeat(np.arange(len(sizes)), list(map(len, parts)))
    length = np.array([n for part in parts for n in part], dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    return block[order], length[order], (np.cumsum(length) - length)[order]


def _segments(steps: int) -> list[tuple[int, int]]:
    """(first step, step after the last) between learnings."""
    out, at = [], 0
    while at < steps:
        out.append((at, min(steps, at + max(4, min(at, _EVERY)))))
        at = out[-1][1]
    return out


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[list[bytes]]:
    """The codes of the streams of each block of one id or more."""
    if not blocks:
        return []
    block, length, first = _lanes([len(b) for b in blocks])
    steps, every = int(length[0]), np.concatenate([np.zeros(2, dtype=np.uint32), *blocks])
    live = np.searchsorted(-length, -np.arange(steps), side="left").tolist()
    model, coder = _Model(len(blocks), vocabulary), _Encoder(len(block), steps // 2 + 16)
    for begin, end in _segments(steps):
        # All lanes in each step; those that have ended are left out of what is coded and learnt.
        step, lanes = np.arange(begin, end)[:, None], slice(0, live[begin])
        at = np.minimum(first[lanes] + step, len(every) - 3) + 2
        ids, one, two = (every[at - k].astype(np.int64) * (step >= k) for k in range(3))
        of = np.broadcast_to(block[lanes], ids.shape)
        slot, named, share = model.order_2(of, one, two)
        escaped = (named != ids) | (share == 0)
        low_2, width_2 = np.where(escaped, share, 0), np.where(escaped, _TOTAL - share, share)
        context, below, n, knows = model.order_1(of, one)
        place, count = (x.reshape(ids.shape) for x in model.first.of((context * vocabulary + ids).ravel()))
        inside = count > 0
        low_1, width_1 = np.where(inside, 0, knows), np.where(inside, knows, _TOTAL - knows)
        at = of * vocabulary + ids
        low = np.where(inside, model.first.below[place] - below, model.below_0[at] - model.start_0[of])
        width = np.where(inside, count, model.zero[at])
        total = np.where(inside, n, model.start_0[of + 1] - model.start_0[of]).view(_U64)
        for k, m in enumerate(live[begin:end]):
            coder.put(slice(0, m), coder.size[:m] >> _U64(_BITS), low_2[k, :m], width_2[k, :m])
            coder.widen(m)
            odd = np.flatnonzero(escaped[k, :m])
            coder.put(odd, coder.size[odd] >> _U64(_BITS), low_1[k].take(odd), width_1[k].take(odd))
            coder.widen(m)
            coder.put(odd, coder.size[odd] // total[k].take(odd), low[k].take(odd), width[k].take(odd))
            coder.widen(m)
        if end < steps:
            came = step < length[lanes]
            model.learn(*[x[came] for x in (of, one, ids, slot, named, share)])
    codes = coder.finish()
    out: list[list[bytes]] = [[] for _ in blocks]
    for lane in np.argsort(first, kind="stable").tolist():
        out[block[lane]].append(codes[lane])
    return out


def decode_blocks(codes: list[list[np.ndarray]], sizes: list[int], vocabulary: int) -> list[np.ndarray]:
    if not codes:
        return []
    block, length, first = _lanes(sizes)
    by_lane = [code for part in codes for code in part]
    if len(by_lane) != len(block):
        raise IdFileError("a block has another number of streams than it should")
    steps = int(length[0])
    live = np.searchsorted(-length, -np.arange(steps), side="left").tolist()
    every = np.zeros(int(length.sum()), dtype=np.uint32)
    model, coder = _Model(len(sizes), vocabulary), _Decoder([by_lane[k] for k in np.argsort(np.argsort(first, kind="stable"), kind="stable")])
    one, two = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
    for begin, end in _segments(steps):
        came = []
        # Which key of order 1 each of the counts belongs to, so that none is searched for.
        owner = np.repeat(np.arange(len(model.first.counts), dtype=np.int32), model.first.counts)
        for step, m in zip(range(begin, end), live[begin:end], strict=True):
            slot, named, share = model.order_2(block[:m], one[:m], two[:m])
            ids = named.copy()
            part = coder.size[:m] >> _U64(_BITS)
            escaped = coder.target(slice(0, m), part, _TOTAL) >= share
            coder.take(slice(0, m), part, np.where(escaped, share, 0), np.where(escaped, _TOTAL - share, share))
            coder.widen(m)
            odd = np.flatnonzero(escaped)
            of = block.take(odd)
            _, below, total, knows = model.order_1(of, one.take(odd))
            part = coder.size[odd] >> _U64(_BITS)
            inside = coder.target(odd, part, _TOTAL) < knows
            coder.take(odd, part, np.where(inside, 0, knows), np.where(inside, knows, _TOTAL - knows))
            coder.widen(m)
            out = np.flatnonzero(~inside)
            below[out] = model.start_0.take(of[out])
            total[out] = model.start_0.take(of[out] + 1) - below[out]
            part = coder.size[odd] // total.view(_U64)
            target = below + coder.target(odd, part, total)
            mine, low, count = np.empty_like(odd), np.empty_like(odd), np.empty_like(odd)
            known = np.flatnonzero(inside)
            at = owner.take(target[known])
            mine[known], low[known], count[known] = model.first.keys.take(at) % vocabulary, model.first.below.take(at), model.first.counts.take(at)
            at = np.searchsorted(model.below_0, target[out], side="right") - 1
            mine[out], low[out], count[out] = at % vocabulary, model.below_0.take(at), model.zero.take(at)
            coder.take(odd, part, low - below, count)
            coder.widen(m)
            ids[odd] = mine
            every[first[:m] + step] = ids
            came.append((block[:m], one[:m], ids, slot, named, share))
            one, two = ids, one
        del owner
        if end < steps:
            model.learn(*[np.concatenate(x) for x in zip(*came, strict=True)])
    ends = np.cumsum(sizes)
    return [every[b - n : b] for b, n in zip(ends.tolist(), sizes, strict=True)]


_BLOCK, _DOCUMENT, _FOOTER = "<III", "<?qQ", "<QQQI"


@dataclass(frozen=True)
class Documents:
    """What a file holds: ids of all documents on end, each document's doc_id and length, and the ids before them."""

    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


def write_ids(held: Documents, vocabulary: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A whole file. Ids must be below ``vocabulary``, which may be 2^20 at most."""
    if vocabulary > 1 << 20 or (len(held.ids) and int(held.ids.max()) >= vocabulary):
        raise IdFileError("ids must be below the vocabulary's size, and that 2^20 at most")
    blocks = [held.ids[k : k + block_ids] for k in range(0, len(held.ids), block_ids)]
    coded = []
    for block, codes in zip(blocks, encode_blocks(blocks, vocabulary), strict=True):
        head = struct.pack(_BLOCK, len(block), len(codes), zlib.crc32(block.astype("<u4").tobytes()))
        coded.append(b"".join([head, struct.pack(f"<{len(codes)}I", *[len(c) // 4 for c in codes]), *codes]))
    return file_of(coded, list_documents(held.doc_ids, held.lengths), vocabulary, block_ids)


def list_documents(doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    return b"".join(struct.pack(_DOCUMENT, d is not None, d or 0, n) for d, n in zip(doc_ids, lengths.tolist(), strict=True))


def listed_documents(listed: bytes) -> tuple[list[int | None], np.ndarray]:
    """What list_documents() was given."""
    documents = list(struct.iter_unpack(_DOCUMENT, listed))
    return [d if there else None for there, d, _ in documents], np.array([k for _, _, k in documents], dtype=np.int64)


def file_of(blocks: list[bytes], listed: bytes, vocabulary: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The file of these blocks and documents."""
    head = json.dumps({"vocabulary": vocabulary, "block_ids": block_ids}).encode()
    out = [MAGIC, struct.pack("<I", len(head)), head, *blocks]
    directory = np.cumsum([sum(map(len, out[:3])), *map(len, blocks)]).tolist()
    where = struct.pack(f"<{len(blocks)}Q", *directory[:-1])
    n_docs = len(listed) // struct.calcsize(_DOCUMENT)
    out += [listed, where, struct.pack(_FOOTER, n_docs, len(blocks), directory[-1], zlib.crc32(listed + where)), MAGIC]
    return b"".join(out)


def parts_of(data: bytes) -> tuple[list[bytes], bytes, int]:
    """(blocks, documents, vocabulary) of a file; raises if its directory is damaged."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise IdFileError("not a file of ids, or a cut one")
    n_docs, n_blocks, at, checksum = struct.unpack(_FOOTER, data[-len(MAGIC) - struct.calcsize(_FOOTER) : -len(MAGIC)])
    tail = data[at : -len(MAGIC) - struct.calcsize(_FOOTER)]
    if zlib.crc32(tail) != checksum or len(tail) != n_docs * struct.calcsize(_DOCUMENT) + n_blocks * 8:
        raise IdFileError("the directory is damaged")
    (n,) = struct.unpack_from("<I", data, len(MAGIC))
    vocabulary = json.loads(data[len(MAGIC) + 4 : len(MAGIC) + 4 + n])["vocabulary"]
    listed = tail[: n_docs * struct.calcsize(_DOCUMENT)]
    places = [*struct.unpack(f"<{n_blocks}Q", tail[len(listed) :]), at]
    return [data[a:b] for a, b in zip(places, places[1:], strict=False)], listed, vocabulary


def read_ids(data: bytes) -> Documents:
    """The documents of a file; raises if a checksum does not hold."""
    found, listed, vocabulary = parts_of(data)
    codes, sizes, sums = [], [], []
    for block in found:
        size, streams, crc = struct.unpack_from(_BLOCK, block)
        place = struct.calcsize(_BLOCK)
        lengths = struct.unpack_from(f"<{streams}I", block, place)
        starts = np.cumsum([place + 4 * streams, *[4 * n for n in lengths]]).tolist()
        codes.append([np.frombuffer(block, dtype=">u4", count=n, offset=start) for n, start in zip(lengths, starts, strict=False)])
        sizes.append(size)
        sums.append(crc)
    blocks = decode_blocks(codes, sizes, vocabulary)
    for k, (block, crc) in enumerate(zip(blocks, sums, strict=True)):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise IdFileError(f"block {k} is damaged")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.uint32)
    return Documents(*listed_documents(listed), ids)
