"""N-gram language model in Elias-Fano tries, trained on and scoring a whole corpus.

The model is a trigram model with additive (Dirichlet) smoothing towards the shorter context:
p(z|x,y) = (c(x,y,z) + U3 p(z|y)) / (c(x,y) + U3), p(z|y) = (c(y,z) + U2 p(z)) / (c(y) + U2), p(z) = (c(z) + 1) / (N + V + 1).

After a count of tokens and distinct tokens, three steps. (1) Each task cuts its documents into blocks, numbers their words, and reduces a block to its distinct words,
pairs and triples with their training counts, dealt to shards: a word by its hash, a pair and the triples that begin with it
by the hash of the pair, so that no word, however frequent, makes a large shard. (2) Each shard adds the counts up, builds
tries (one for each portion of its pairs, to bound its memory), writes each to a file, maps that into memory, looks up what
each block asked and answers in the order asked. (3) Each block puts its answers together and sums its texts' log-probabilities.

A trie has the levels x, x y and x y z. A level is one monotone sequence in Elias-Fano form, each node's successors raised by
the last value before them, with a monotone sequence of pointers to where a node's successors begin. Words of the third
level are numbered relative to their context: z is its rank among the words that follow y in this shard, which keeps the
numbers small; a query first finds that rank, then searches it among the successors of x y. Both search where the numbers lie: pointers are selected in
the mapped bits, and a successor is sought among those that share its high bits; no level is decoded. Triples keep their discounted
probabilities in 8 bits, in logarithmic steps; pairs keep their counts in the same steps, as the counts of their first words, by which these would be
divided, lie in other shards and join them where texts are scored.

Within n-grams words are told apart by 40 bits of a 64-bit hash, which within a shard (of bounded input) mistakes fewer than
one word in a million; single words by all 64 bits.

Defined cases: null and empty texts are the end alone; repeated rows are learned and scored one by one; a null document id
counts as empty text in the split; nothing to learn from leaves p(z) = 1; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import blocks, documents, raw, remainder

BLOCK_TEXT, SHARD_TEXT = 28 << 20, 32 << 20
#: Triples, repeats included, that are looked up through one trie.
PORTION = 1_000_000
#: Parts in which distinct words are counted.
PARTS = 256
U2, U3 = 2000.0, 10.0
START, END = 0, 1
#: Steps of an octave in the 8-bit codes; code 0 is absent.
STEPS = 6.35


def code(x: np.ndarray) -> np.ndarray:
    """8 bits for numbers of 1 and more."""
    return np.clip(1 + np.rint(np.log2(x) * STEPS), 1, 255).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    """The numbers, 0 for absent."""
    return np.where(codes == 0, 0.0, np.exp2((codes.astype(np.float64) - 1) / STEPS))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte planes compressed."""
    import zstandard

    out = []
    for a in arrays:
        width = 8 if a.dtype.itemsize == 8 else a.dtype.itemsize
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), width).T) if len(a) else np.zeros((width, 0), np.uint8)
        used = [p for p in range(width) if planes[p].any()]
        out.append((a.dtype.str, len(a), used, planes[used].tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, n, used, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        a = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
        a[used] = np.frombuffer(planes, np.uint8).reshape(len(used), n)
        out.append(np.ascontiguousarray(a.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
    return out


#: Positions of the set bits of each byte, highest first, and how many it has.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_COUNT = _BITS.sum(1).astype(np.uint8)
_PLACE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _PLACE[_byte, : _COUNT[_byte]] = np.flatnonzero(_BITS[_byte])
#: Bytes of high bits between two entries of the directories.
STRIDE = 8
#: 1 in each of eight bytes.
EACH = np.uint64(0x0101010101010101)


class Sequence:
    """Elias-Fano form of a monotone sequence: low bits packed one after the other, high bits in unary, and directories of the ones and zeros before every STRIDE bytes.

    Numbers are read, and sought, where they lie: no more of the sequence is decoded than is asked for."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.decoded = 0

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = np.empty((n, low_bits), np.uint8)
        for j in range(low_bits):
            bits[:, j] = (values >> np.uint64(low_bits - 1 - j)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = STRIDE * (int(places[-1]) // (8 * STRIDE) + 1) if n else STRIDE
        high = np.zeros(8 * size, np.uint8)
        high[places] = 1
        high = np.packbits(high)
        before = np.cumsum(_COUNT[high].reshape(-1, STRIDE).sum(1, dtype=np.uint32), dtype=np.uint32)
        return cls(n, low_bits, np.append(np.packbits(bits.reshape(-1)), np.zeros(8, np.uint8)), high, np.concatenate([np.zeros(1, np.uint32), before]))

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the one (or zero) before which there are `rank` of its kind."""
        directory = self.ones if ones else (np.arange(len(self.ones), dtype=np.int64) * (8 * STRIDE) - self.ones).astype(np.uint32)
        word = np.searchsorted(directory, rank.astype(np.uint32), "right") - 1
        # Past the last word there are only zeros.
        beyond = word >= len(self.high) // STRIDE
        inside = np.where(beyond, 0, word)
        own = self.high.view("<u8")[inside]  # the first byte is the lowest
        if not ones:
            own = ~own
        left = np.where(beyond, 0, rank - directory[inside]).astype(np.uint64)
        # Ones in each byte, then in it and those before, all eight at once; the byte sought follows those that hold too few.
        counts = own - (own >> np.uint64(1) & np.uint64(0x5555555555555555))
        counts = (counts & np.uint64(0x3333333333333333)) + (counts >> np.uint64(2) & np.uint64(0x3333333333333333))
        counts = (counts + (counts >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * EACH
        shift = np.bitwise_count((left * EACH | EACH << np.uint64(7)) - counts & EACH << np.uint64(7)).astype(np.uint64) << np.uint64(3)
        shift[beyond] = 0
        left -= counts << np.uint64(8) >> shift & np.uint64(255)
        place = word.astype(np.int64) * (8 * STRIDE) + shift.astype(np.int64) + _PLACE[own >> shift & np.uint64(255), np.where(beyond, np.uint64(0), left)]
        return np.where(beyond, word.astype(np.int64) * (8 * STRIDE) + (rank - directory[np.minimum(word, len(directory) - 1)]), place)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        self.decoded += len(i)
        at = i.astype(np.int64) * self.low_bits
        # Eight bytes from any byte on, as one number.
        window = np.ndarray(len(self.low) - 7, ">u8", self.low, strides=(1,))[at >> 3].astype(np.uint64)
        return (window << (at & 7).astype(np.uint64) >> np.uint64(64 - self.low_bits)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        return (self._select(i, True) - i) << self.low_bits | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value between two places, -1 where it is not there: the numbers that share its high bits lie together."""
        out = np.full(len(values), -1, np.int64)
        head = values >> self.low_bits
        most = int(self.get(np.array([self.n - 1]))[0]) >> self.low_bits if self.n else -1
        live = np.flatnonzero((begin < end) & (values >= 0) & (head <= most))
        if not len(live):
            return out
        h = head[live]
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - h + 1, 0)  # after the zero that ends the bucket before
        stop = np.minimum(self._select(h, False) - h, end[live])
        at = np.maximum(at, begin[live])
        low = values[live] & ((1 << self.low_bits) - 1)
        while len(live):
            there = at < stop
            live, at, stop, low = live[there], at[there], stop[there], low[there]
            if not len(live):
                break
            # The middle of what is left of a bucket, which mostly holds one or two.
            middle = (at + stop) >> 1
            own = self._low(middle)
            same = own == low
            out[live[same]] = middle[same]
            at, stop = np.where(own < low, middle + 1, at), np.where(own > low, middle, stop)
            rest = ~same
            live, at, stop, low = live[rest], at[rest], stop[rest], low[rest]
        return out

    def parts(self) -> tuple[list, list[np.ndarray]]:
        return [self.n, self.low_bits], [self.low, self.high, self.ones.view(np.uint8)]


def nested(parents: np.ndarray, children: np.ndarray, n_parents: int) -> tuple[Sequence, Sequence]:
    """Successors of parents (both sorted, parents first) as one monotone sequence, and pointers to each parent's first. A parent's successors are raised by the last number before them."""
    pointers = np.searchsorted(parents, np.arange(n_parents + 1))
    own = np.flatnonzero(np.diff(pointers))
    lasts = children[pointers[own + 1] - 1] + 1
    base = np.zeros(n_parents, np.int64)
    base[own] = np.cumsum(lasts) - lasts
    return Sequence.of(base[parents] + children), Sequence.of(pointers)


class Trie:
    """Pairs and triples of word numbers with 8-bit codes, searched successor by successor."""

    NAMES = ("pairs", "pair_pointers", "ranks", "rank_pointers", "triples", "triple_pointers")

    def __init__(self, n_words: int, sequences: dict[str, Sequence], pair_codes: np.ndarray, triple_codes: np.ndarray):
        self.n_words, self.sequences, self.pair_codes, self.triple_codes = n_words, sequences, pair_codes, triple_codes

    @classmethod
    def build(cls, n_words: int, x: np.ndarray, y: np.ndarray, pair_counts: np.ndarray, pair: np.ndarray, z: np.ndarray, counts: np.ndarray) -> Trie:
        """x, y: the pairs in order. pair, z: the triples in order, by the number of their pair."""
        middle = y[pair]
        follow, place = ranked(middle * np.int64(n_words) + z)
        rank_of = place - np.searchsorted(follow, np.arange(n_words) * np.int64(n_words))[middle]
        # Ranks rise with z, so that triples stay in order.
        sequences = {}
        for (a, b), (parents, children, n) in zip(zip(cls.NAMES[::2], cls.NAMES[1::2], strict=True), ((x, y, n_words), (follow // n_words, follow % n_words, n_words), (pair, rank_of, len(x))), strict=True):
            sequences[a], sequences[b] = nested(parents, children, n)
        discounted = counts / (pair_counts[pair] + U3)
        return cls(n_words, sequences, code(pair_counts), code(1 / discounted))

    def save(self, path: str) -> None:
        heads, arrays = [], [self.pair_codes, self.triple_codes]
        for name in self.NAMES:
            head, parts = self.sequences[name].parts()
            heads.append(head)
            arrays += parts
        head = pickle.dumps((self.n_words, heads, [len(a) for a in arrays]))
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                f.write(a.tobytes())

    @classmethod
    def load(cls, path: str) -> Trie:
        """A trie whose levels stay in the file, mapped into memory."""
        with open(path, "rb") as f:
            n_words, heads, sizes = pickle.loads(f.read(at := int.from_bytes(f.read(8), "little")))
        at += 8
        arrays = []
        whole = np.memmap(path, np.uint8, "r").view(np.ndarray)  # still mapped, without a memmap's cost for each slice
        for size in sizes:
            arrays.append(whole[at : at + size])
            at += size
        sequences = {name: Sequence(*head, low, high, np.frombuffer(ones.tobytes(), np.uint32)) for name, head, low, high, ones in zip(cls.NAMES, heads, arrays[2::3], arrays[3::3], arrays[4::3], strict=True)}
        return cls(n_words, sequences, arrays[0], arrays[1])

    def _find(self, level: int, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of a successor in its level, -1 if it is none of the parent's (or either is -1), and where the parent's successors begin."""
        values, pointers = (self.sequences[name] for name in self.NAMES[2 * level : 2 * level + 2])
        out, first = np.full(len(parent), -1, np.int32), np.zeros(len(parent), np.int64)
        known = np.flatnonzero((parent >= 0) & (child >= 0))
        # Neighbours in order ask for the same parents: each is read once.
        distinct_, number = np.unique(parent[known], return_inverse=True)
        distinct_ = distinct_.astype(np.int64)
        begin, end = pointers.get(distinct_), pointers.get(distinct_ + 1)
        base = np.zeros(len(distinct_), np.int64)
        later = np.flatnonzero((begin > 0) & (begin < end))
        base[later] = values.get(begin[later] - 1) + 1
        first[known] = begin[number]
        out[known] = values.find(base[number] + child[known], begin[number], end[number])
        return out, first

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._find(0, x, y)[0]

    def triples(self, pair: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """pair: positions as pairs() gives them."""
        place, first = self._find(1, y, z)
        return self._find(2, pair, np.where(place >= 0, place - first, -1))[0]

    @staticmethod
    def codes(positions: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(positions), np.uint8)
        return np.where(positions >= 0, np.asarray(codes)[np.maximum(positions, 0)], 0).astype(np.uint8)


def summed(inverse: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.rint(np.bincount(inverse, weights=weights, minlength=n)).astype(np.int64)


class Block:
    """Distinct pairs and triples of some texts, in the order in which they are dealt to shards."""

    def __init__(self, sequence: np.ndarray, lengths: np.ndarray, small: np.ndarray, shards: int):
        """sequence: word numbers, END after each text. small: 16 bits of each word's hash, by which pairs are dealt."""
        n = len(sequence)
        self.sequence, self.begins = sequence, np.cumsum(lengths) - lengths
        keys = np.empty(n + 1, np.int64)
        keys[0] = START << 32 | START
        keys[2:] = sequence[:-1]
        keys[1:][self.begins] = START
        keys[1:] <<= 32
        keys[1:] |= sequence
        self.pairs, self.pair_of = ranked(keys)
        self.start_pair = int(self.pair_of[0])
        self.pair_of = self.pair_of[1:]
        keys = keys[:-1]
        keys[1:] = self.pair_of[:-1]
        keys[self.begins] = self.start_pair
        keys <<= 32
        keys |= sequence
        self.triples, self.triple_of = ranked(keys)
        del keys
        mixed = small[self.pairs >> 32].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ small[self.pairs & 0xFFFFFFFF].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        dealt = ((mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(shards)).astype(np.uint16 if shards < 65536 else np.uint32)
        del mixed
        self.pair_order, self.pair_starts = self._dealt(dealt, shards)
        self.triple_order, self.triple_starts = self._dealt(dealt[self.triples >> 32], shards)

    @staticmethod
    def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        return np.argsort(shard, kind="stable").astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the shard's pairs and triples."""
        part = lambda order, starts: order[starts[shard] : starts[shard + 1]]
        return part(self.pair_order, self.pair_starts), part(self.triple_order, self.triple_starts)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's number among them."""
    order = np.argsort(keys).astype(np.uint32)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], number


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, 3) for w in words), np.uint64, len(words))


#: No word holds a space.
MARKS = [b"\x20start", b"\x20end"]


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the texts with END after each, their lengths, and the words' hashes; frequent words have small numbers."""
    numbers: defaultdict[bytes, int] = defaultdict(count(2).__next__)  # a word not met before gets the next number
    lengths = np.empty(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        ids = np.empty(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        ids[-1] = END
        lengths[i] = len(ids)
        parts.append(ids)
    sequence = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    hashes = hashed([*MARKS, *numbers])
    del numbers, parts
    order = np.argsort(-np.bincount(sequence, minlength=len(hashes))[2:], kind="stable") + 2
    place = np.arange(len(hashes), dtype=np.int32)
    place[order] = np.arange(2, len(hashes), dtype=np.int32)
    return place[sequence], lengths, np.concatenate([hashes[:2], hashes[order]])


def ask(texts: list[bytes], keys: list, train: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, request) for each shard, and (-1, what the block needs to read the answers)."""
    sequence, lengths, hashes = numbered(texts)
    small = (hashes & np.uint64(0xFFFF)).astype(np.uint16)
    block = Block(sequence, lengths, small, shards)
    trained = np.repeat(train, lengths)
    c1 = np.bincount(sequence[trained], minlength=len(hashes)).astype(np.uint32)
    c1[START] = int(train.sum())
    c2 = np.bincount(block.pair_of[trained], minlength=len(block.pairs)).astype(np.uint32)
    c2[block.start_pair] += np.uint32(train.sum())
    c3 = np.bincount(block.triple_of[trained], minlength=len(block.triples)).astype(np.uint32)
    del block.pair_of, block.triple_of
    owner = ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.uint16 if shards < 65536 else np.uint32)
    yield -1, squeeze(sequence.astype(np.uint32), lengths, small, owner, train.astype(np.uint8), np.frombuffer(pickle.dumps(keys), np.uint8))
    short = (hashes >> np.uint64(24)).astype(np.int64)
    used, rank, place = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.uint32), np.zeros(len(block.pairs), np.uint32)
    steps = lambda a: np.diff(a.astype(np.int64), prepend=0).astype(np.uint32)  # noqa: E731  of numbers in order
    for shard in range(shards):
        pairs, triples = block.of(shard)
        x, y = block.pairs[pairs] >> 32, block.pairs[pairs] & 0xFFFFFFFF
        place[pairs] = np.arange(len(pairs))
        of, z = place[block.triples[triples] >> 32], block.triples[triples] & 0xFFFFFFFF
        used[x], used[y], used[z] = True, True, True
        words = np.flatnonzero(used)
        used[words] = False
        rank[words] = np.arange(len(words))
        own = np.flatnonzero(owner == shard)
        yield shard, squeeze(short[words], steps(rank[x]), rank[y], steps(of), rank[z], c2[pairs], c3[triples], hashes[own], c1[own])


def looked_up(pairs: np.ndarray, counts: np.ndarray, owners: np.ndarray, z: np.ndarray, triple_counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of pairs and triples (repeats among them) by a trie of those that were counted. owners: each triple's place in pairs."""
    pairs, pair_of = ranked(pairs)
    triples, triple_of = ranked(np.left_shift(pair_of[owners], 32, dtype=np.int64) | z)
    c2, c3 = summed(pair_of, counts, len(pairs)), summed(triple_of, triple_counts, len(triples))
    kept, held = c2 > 0, c3 > 0
    own = pairs[kept]
    number_of = np.cumsum(kept, dtype=np.int32) - 1
    trie = Trie.build(n_words, own >> 32, own & 0xFFFFFFFF, c2[kept], number_of[triples[held] >> 32], triples[held] & 0xFFFFFFFF, c3[held])
    del own, c2, c3, kept, held, number_of
    handle, path = tempfile.mkstemp(suffix=".trie")
    os.close(handle)
    try:
        trie.save(path)
        trie = Trie.load(path)
        y = (pairs & 0xFFFFFFFF).astype(np.int32)
        found = trie.pairs(pairs >> 32, y)
        pair_codes = trie.codes(found, trie.pair_codes)[pair_of]
        owner = (triples >> 32).astype(np.int32)
        triple_codes = trie.codes(trie.triples(found[owner], y[owner], triples & 0xFFFFFFFF), trie.triple_codes)[triple_of]
        del trie
    finally:
        os.remove(path)
    return pair_codes, triple_codes


def answer(requests: list[bytes]) -> list[bytes]:
    """Answers to the requests of one shard, in their order. Pairs are taken in portions, with the triples that begin with them, each with a trie of its own."""
    read = [unsqueeze(r) for r in requests]
    sizes = [(len(r[1]), len(r[3]), len(r[7])) for r in read]
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    take = lambda i: [r.pop(i) for r in read]  # noqa: E731  the arrays are large: each is dropped once used
    words = take(0)
    every = distinct(np.concatenate(words))
    number = [np.searchsorted(every, w).astype(np.uint32) for w in words]
    del words
    x = cat([m[np.cumsum(a, dtype=np.int64)] for m, a in zip(number, take(0), strict=True)])
    y = cat([m[a] for m, a in zip(number, take(0), strict=True)])
    offsets = np.cumsum([0, *(a for a, _, _ in sizes)])
    owner = cat([(np.cumsum(a, dtype=np.int64) + o).astype(np.uint32) for a, o in zip(take(0), offsets[:-1], strict=True)])
    z = cat([m[a] for m, a in zip(number, take(0), strict=True)])
    c2, c3 = cat(take(0)), cat(take(0))
    pair_codes, triple_codes = np.zeros(len(x), np.uint8), np.zeros(len(z), np.uint8)
    portions = np.uint32(max(1, -(-len(z) // PORTION)))
    portion = ((x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % portions
    of_triple = portion[owner]
    place = np.zeros(len(x), np.uint32)
    for k in range(int(portions)):
        pairs, triples = np.flatnonzero(portion == k), np.flatnonzero(of_triple == k)
        place[pairs] = np.arange(len(pairs))
        pair_codes[pairs], triple_codes[triples] = looked_up(np.left_shift(x[pairs], 32, dtype=np.int64) | y[pairs], c2[pairs], place[owner[triples]], z[triples], c3[triples], len(every))
    single, single_of = ranked(cat(take(0)))
    c1 = summed(single_of, cat(take(0)), len(single))
    out, p, t, s = [], 0, 0, 0
    for a, b, c in sizes:
        out.append(squeeze(pair_codes[p : p + a], triple_codes[t : t + b], c1[single_of[s : s + c]]))
        p, t, s = p + a, t + b, s + c
    return out


def score(needs: bytes, answers: dict[int, bytes], shards: int, n: int, v: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, split, tokens, known tokens, base and model scores of a block's texts."""
    sequence, lengths, small, owner, train, keys = unsqueeze(needs)
    keys = pickle.loads(keys.tobytes())
    if not len(sequence):
        return keys, train, lengths, lengths, lengths * 0.0, lengths * 0.0
    sequence = sequence.astype(np.int32)
    block = Block(sequence, lengths, small, shards)
    c1, pair_codes, triple_codes = np.zeros(len(small), np.int64), np.zeros(len(block.pairs), np.uint8), np.zeros(len(block.triples), np.uint8)
    for shard in range(shards):
        pairs, triples = block.of(shard)
        pair_codes[pairs], triple_codes[triples], c1[owner == shard] = unsqueeze(answers.pop(shard))
    p1 = (c1 + 1) / (n + v + 1)
    x, y = block.pairs >> 32, block.pairs & 0xFFFFFFFF
    c2 = decoded(pair_codes)
    p2 = (np.minimum(c2, np.maximum(c1[x], 0)) + U2 * p1[y]) / (c1[x] + U2)
    context = block.triples >> 32
    head = np.zeros(len(triple_codes))
    there = triple_codes > 0
    head[there] = 1 / decoded(triple_codes[there])
    tail = np.empty(len(head), np.int32)  # the pair y z of each triple
    tail[block.triple_of] = block.pair_of
    logs = np.log10(head + U3 / (c2[context] + U3) * p2[tail])
    each = logs[block.triple_of]
    base = np.log10(p1)[sequence]
    add = lambda a: np.add.reduceat(a, block.begins)
    return keys, train, lengths, add((c1[sequence] > 0).astype(np.int64)), add(base), add(each)


def size(texts: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens (words and the end) of texts(t)."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found, least = 0, set(), []
        for table in blocks(batches, "t", 4 << 20):
            for text in raw(table.column("t")):
                words = text.lower().split()
                n += len(words) + 1
                found.update(words)
            if len(found) > 300_000:
                least, found = [*least, hashed(list(found))], set()
        whole = distinct(np.concatenate([*least, hashed([MARKS[1], *found] if n else [])]))
        part = (whole >> np.uint64(20)) % np.uint64(PARTS)
        order = np.argsort(part, kind="stable")
        starts = np.searchsorted(part[order], np.arange(PARTS + 1))
        rows = [(i, whole[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), pa.array([n if j == 0 else 0 for j in range(len(rows))], pa.int64())], ["part", "hashes", "n"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(0, np.uint64)
        for data in rows["hashes"]:
            seen = np.union1d(seen, np.frombuffer(data, np.uint64))
        return pd.DataFrame({"n": [int(rows["n"].sum())], "v": [len(seen)]})

    found = texts.mapInArrow(counting, "part int, hashes binary, n long").groupBy("part").applyInPandas(count, "n long, v long")
    return tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


def scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, trained, n_tokens, n_known, train_tokens, base_score and score of each of docs' rows; learned from those for which train holds."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // SHARD_TEXT))
    kind = docs.schema[key].dataType.simpleString()

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, table in enumerate(blocks(batches, "t", BLOCK_TEXT)):
            name = f"{part}-{number}"
            for shard, data in ask(raw(table.column("t")), table.column("k").to_pylist(), table.column("train").to_numpy().astype(bool), shards):
                home = shard if shard >= 0 else -1 - number * 65536 - part % 65536
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([name]), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["home", "block", "shard", "data"])

    def answering(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="home")
        return rows if rows["shard"].iloc[0] < 0 else rows.assign(data=answer(list(rows["data"])))

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), train.alias("train"))
    n, v = size(source.where("train").select("t"))
    asked = source.mapInArrow(asking, "home long, block string, shard int, data binary")
    answered = asked.groupBy("home").applyInPandas(answering, "block string, shard int, data binary")

    def scoring(rows: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(rows["shard"], rows["data"], strict=True))
        keys, trained, tokens, known, base, model = score(by.pop(-1), by, shards, n, v)
        return pd.DataFrame({"k": pd.Series(keys, dtype="object"), "trained": trained.astype(bool), "n_tokens": tokens, "n_known": known, "train_tokens": n, "base_score": base, "score": model})

    out = answered.groupBy("block").applyInPandas(scoring, f"k {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
