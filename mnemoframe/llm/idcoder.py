"""Range coder for blocks of token ids, driven by mixed predictions of order 0, 1 and 2.

A block holds up to ``BLOCK`` ids and is reset at its start: its sorted alphabet is stored, and ids become places in it.
For the next id three models speak: order 2 names the id that last followed the two ids before (hashed), order 1 the one
that last followed the id before, and order 0 has adaptive counts of all ids of the alphabet, renewed at the steps
``_RENEWED`` and rounded to powers of two, so that an id is found by its class and a shift. The range of a step is shared
out as ``w2 [s2] + (1 - w2) (w1 [s1] + (1 - w1) counts)``, and an id takes the widest part that names it (parts of order 2
and 1 that name the same are one); the weights are learned while coding, one for every degree of confidence of a prediction. Each
id takes one step of a 62-bit range coder with 32-bit words and carries.

The work of a step is done for many blocks at once (one lane of a numpy array each), because blocks are independent.
Every block carries a CRC-32 of its ids, checked when it is read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
#: Blocks coded side by side.
LANES = 2048
#: Steps before which order 0 is made anew from the counts so far.
_RENEWED = (64, 192, 448, 960, 1728, 2752)
_GAIN = 2
#: Class of a count: the power of two next to ``1 + _GAIN * count``; the whole of order 0 stays below ``1 << 15``.
_CLASS = np.rint(np.log2(1 + _GAIN * np.arange(BLOCK + 1))).astype(np.uint8)
_CLASSES = int(_CLASS[-1]) + 1
_SLOTS = 1 << 12
_LOW_BITS, _WORD = 62, 0xFFFFFFFF
_LEAST = 1 << 30
_SURE = 15
#: What a weight (of 65536) gains by a right prediction, when it loses a 32nd by any; order 0 always keeps a part.
_GAINED = 2010
#: Exponent and power of two of each class in descending order; the last stands for places beyond an alphabet.
_POWER = np.array([*range(_CLASSES - 1, -1, -1), 0])
_WIDE = np.append(1 << _POWER[:-1], 0)


class _Lanes:
    """Models of all blocks that are coded side by side; the blocks that still run are the first ``k``."""

    def __init__(self, alphabet: np.ndarray):
        n = len(alphabet)
        self.n, self.width = n, int(alphabet.max())
        self.lane = np.arange(n)
        self.row = self.lane * self.width
        self.counts = np.zeros((n, self.width), np.uint16)
        self.absent = np.arange(self.width)[None, :] >= alphabet[:, None]
        #: Predictions of order 1, then of order 2: the id and four bits of confidence.
        self.said = np.zeros(n * (self.width + _SLOTS), np.uint16)
        self.slots = n * self.width + self.lane * _SLOTS
        start = (65536 * (np.arange(_SURE + 1) + 0.1) / (np.arange(_SURE + 1) + 1.6)).astype(np.int64)
        self.weights = np.concatenate([np.tile(start // 2, n), np.tile(start, n)])
        self.sure = np.stack([self.lane << 4, (n + self.lane) << 4])
        self.at = np.stack([self.row, self.slots])
        self.hashed = np.zeros(n, np.int64)

    def renew(self, k: int, seen: np.ndarray, coming: np.ndarray | None = None) -> None:
        """Order 0 as of now, with the ids of ``seen`` (a row for each step) counted; for ids that are ``coming``, or to find ids."""
        counts = self.counts[:k]
        if len(seen):
            counts += np.bincount((seen + self.row[:k]).ravel(), minlength=k * self.width).reshape(k, -1).astype(np.uint16)
        # classes in descending order; places beyond an alphabet come last
        order = (_CLASSES - 1 - _CLASS)[counts]
        order[self.absent[:k]] = _CLASSES
        held = np.bincount((order + (self.lane[:k] * (_CLASSES + 1))[:, None]).ravel(), minlength=k * (_CLASSES + 1)).reshape(k, -1)[:, :-1].T
        sizes = held << np.arange(_CLASSES - 1, -1, -1)[:, None]
        ends = sizes.cumsum(axis=0)
        # a little less than 1 / total, so that rounding never gives more than there is
        self.share = (1 - 2.0**-50) / ends[-1]
        by_class = order.argsort(axis=1, kind="stable")
        if coming is not None:
            at = (by_class + self.row[:k, None]).ravel()
            classes = order.ravel().take(at)
            wide = _WIDE.take(classes).reshape(k, -1)
            packed = ((wide.cumsum(axis=1, dtype=np.int64) - wide) << 4).ravel()
            packed += _POWER.take(classes)
            places = np.empty(k * self.width, np.int32)
            places[at] = packed
            self.places = places.take(coming + self.row[:k])
        else:
            self.sorted = by_class.astype(np.uint16).ravel()
            self.top = int(held.any(axis=1).argmax())  # classes above it have no ids
            self.starts = np.ascontiguousarray((ends - sizes)[self.top :].astype(np.int32))
            self.across, self.last = np.int64(k), (ends[-1] - 1).astype(np.uint64)
            self.first = (held.cumsum(axis=0) - held + self.row[:k])[self.top :]

    def predict(self, k: int, span: np.ndarray) -> None:
        """What orders 1 and 2 say, and where in ``span`` the parts of order 2 and 1 end."""
        self.i = self.at[:, :k]
        self.e = self.said.take(self.i).astype(np.int64)
        self.conf = self.e & 15
        self.p = self.e >> 4
        self.j = self.sure[:, :k] + self.conf
        self.w = self.weights.take(self.j)
        w1, w2 = self.w
        self.end2 = (span >> 16) * w2
        rest = span - self.end2
        self.end1 = self.end2 + (rest >> 16) * w1
        # order 0 shares out what remains
        self.unit = ((span - self.end1) * self.share[:k]).astype(np.int64)

    def _named(self, some: np.ndarray, is2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the part of order 2 or else 1 in the lanes ``some``."""
        end2, end1 = self.end2[some], self.end1[some]
        end2 = np.where(self.p[0, some] == self.p[1, some], end1, end2)
        return np.where(is2, 0, end2), np.where(is2, end2, end1 - end2)

    def place(self, x: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the part of the span that the ids ``x`` take, the ``nth`` of those that were coming."""
        self.hit = self.p == x
        packed = self.places[nth, : len(x)].astype(np.int64)
        low, wide = self.end1 + (packed >> 4) * self.unit, self.unit << (packed & 15)
        some = np.flatnonzero(self.hit[0] | self.hit[1])
        named_low, named_wide = self._named(some, self.hit[1, some])
        better = np.flatnonzero(named_wide > wide[some])
        low[some[better]], wide[some[better]] = named_low[better], named_wide[better]
        return low, wide

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose parts hold ``code``, and these parts."""
        k = len(code)
        u = (code - self.end1).view(np.uint64) // self.unit.view(np.uint64)
        u = np.minimum(u, self.last[:k]).astype(np.int32)
        cls = np.add.reduce((self.starts[1:, :k] <= u).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        at = cls * self.across + self.lane[:k]
        power = (_CLASSES - 1 - self.top) - cls
        start = self.starts.take(at)
        nth = (u - start) >> power
        x = self.sorted.take(self.first.take(at) + nth).astype(np.int64)
        low, wide = self.end1 + (start + (nth << power)) * self.unit, self.unit << power
        some = np.flatnonzero(code < self.end1)
        p1, p2 = self.p[0, some], self.p[1, some]
        is2 = (code[some] < self.end2[some]) | (p1 == p2)
        x[some] = np.where(is2, p2, p1)
        low[some], wide[some] = self._named(some, is2)
        self.hit = self.p == x
        return x, low, wide

    def update(self, x: np.ndarray) -> None:
        k = len(x)
        # what was right is surer; what was wrong is replaced, half as sure
        w, e = self.w - (self.w >> 5), (x << 4) + (self.conf >> 1)
        some = np.flatnonzero(self.hit)
        w.ravel()[some] += _GAINED
        had = self.e.ravel()[some]
        e.ravel()[some] = np.minimum(had + 1, had | 15)
        self.weights[self.j] = w
        self.said[self.i] = e
        np.add(self.row[:k], x, out=self.at[0, :k])
        np.add(self.slots[:k], (self.hashed[:k] + x * 1299721) & (_SLOTS - 1), out=self.at[1, :k])
        self.hashed = x * 40503


def _running(lengths: np.ndarray) -> np.ndarray:
    """How many blocks (longest first) still run at each step."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, int(lengths[0]) + 1), "left")


def _segments(lengths: np.ndarray):
    """Steps between which order 0 stays as it is, and the blocks that run at each of them."""
    running = _running(lengths).tolist()
    cuts = [c for c in _RENEWED if c < len(running)] + [len(running)]
    return [(a, b, running[a:b]) for a, b in zip([0, *cuts], cuts)]


def _encode(symbols: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray) -> list[np.ndarray]:
    """Words of every block; ``symbols`` has a row for each step."""
    n = len(lengths)
    model = _Lanes(alphabet)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << _LOW_BITS)
    shift, keep = _LOW_BITS - 32, (1 << (_LOW_BITS - 32)) - 1
    counted, lanes, out = 0, [], []
    for begin, end, running in _segments(lengths):
        model.renew(running[0], symbols[counted:begin, : running[0]], symbols[begin:end, : running[0]])
        counted = begin
        for t, k in enumerate(running):
            model.predict(k, span[:k])
            x = symbols[begin + t, :k].astype(np.int64)
            lo, wide = model.place(x, t)
            low[:k] += lo
            span[:k] = wide
            full = np.flatnonzero(wide < _LEAST)
            had = low[full]
            lanes.append(full.astype(np.uint16))
            out.append(had >> shift)  # may carry one bit into the word before
            low[full] = (had & keep) << 32
            span[full] <<= 32
            model.update(x)
    for _ in range(2):
        lanes.append(np.arange(n, dtype=np.uint16))
        out.append(low >> shift)
        low = (low & keep) << 32
    lane = np.concatenate(lanes)
    words = np.concatenate(out)[lane.argsort(kind="stable")]
    first = np.bincount(lane, minlength=n).cumsum()
    while len(over := np.flatnonzero(words > _WORD)):  # a block's first word has no carry
        words[over] &= _WORD
        words[over - 1] += 1
    return np.split(words.astype("<u4"), first[:-1])


def _decode(streams: list[np.ndarray], lengths: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Symbols of every block, a row for each step."""
    n = len(lengths)
    model = _Lanes(alphabet)
    span = np.full(n, 1 << _LOW_BITS)
    # two zeros end each stream; 62 bits are held at first, so words come two bits later than they stand
    words = np.concatenate([x for s in streams for x in (s, np.zeros(2, np.uint32))]).astype(np.int64)
    at = np.array([0, *(len(s) + 2 for s in streams[:-1])]).cumsum()
    code = (words[at] << (_LOW_BITS - 32)) | (words[at + 1] >> 2)
    words = (((words[:-1] & 3) << 30) | (words[1:] >> 2)).astype(np.uint32)
    at += 1
    out = np.zeros((int(lengths[0]), n), np.uint16)
    counted = 0
    for begin, end, running in _segments(lengths):
        model.renew(running[0], out[counted:begin, : running[0]])
        counted = begin
        for t, k in enumerate(running, begin):
            model.predict(k, span[:k])
            x, lo, wide = model.find(code[:k])
            code[:k] -= lo
            span[:k] = wide
            full = np.flatnonzero(wide < _LEAST)
            place = at[full]
            code[full] = (code[full] << 32) | words.take(place, mode="clip")
            at[full] = place + 1
            span[full] <<= 32
            model.update(x)
            out[t, :k] = x
    return out


_HEAD = struct.Struct("<IIIII")  # ids, alphabet, bytes of the alphabet, words, CRC-32 of the ids


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted alphabet of ``ids``, and the place of each in it."""
    most = int(ids.max())
    if most >= 1 << 17:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(most + 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen)
    where = np.empty(most + 1, np.uint16)
    where[alphabet] = np.arange(len(alphabet))
    return alphabet, where[ids]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each array of ids (not empty, at most ``BLOCK`` of them) as a block that stands for itself."""
    done: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    for lo in range(0, len(order), LANES):
        mine = order[lo : lo + LANES]
        lengths = np.array([len(blocks[k]) for k in mine])
        symbols, alphabets = np.zeros((len(mine), lengths[0]), np.uint16), []
        for r, k in enumerate(mine):
            ids, place = _places(blocks[k])
            alphabets.append(ids)
            symbols[r, : len(place)] = place
        coded = _encode(np.ascontiguousarray(symbols.T), lengths, np.array([len(a) for a in alphabets]))
        for k, ids, words in zip(mine, alphabets, coded, strict=True):
            packed = zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes(), 1)
            crc = zlib.crc32(np.asarray(blocks[k]).astype("<u4").tobytes())
            done[k] = _HEAD.pack(len(blocks[k]), len(ids), len(packed), len(words), crc) + packed + words.tobytes()
    return done


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block as unsigned 32-bit integers; ``ValueError`` if a block is damaged."""
    heads, alphabets, streams = [], [], []
    for data in blocks:
        n, v, packed, words, crc = _HEAD.unpack_from(data)
        if len(data) != _HEAD.size + packed + 4 * words or not 0 < v <= n <= BLOCK:
            raise ValueError("block has a wrong length")
        try:
            ids = np.cumsum(np.frombuffer(zlib.decompress(data[_HEAD.size : _HEAD.size + packed]), "<u4").astype(np.int64))
        except zlib.error as e:
            raise ValueError("alphabet of a block is damaged") from e
        if len(ids) != v or words < 2:
            raise ValueError("alphabet of a block is damaged")
        heads.append((n, v, crc))
        alphabets.append(ids)
        streams.append(np.frombuffer(data, "<u4", words, _HEAD.size + packed))
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -heads[k][0])
    for lo in range(0, len(order), LANES):
        mine = order[lo : lo + LANES]
        lengths = np.array([heads[k][0] for k in mine])
        found = _decode([streams[k] for k in mine], lengths, np.array([heads[k][1] for k in mine])).T
        for r, k in enumerate(mine):
            ids = alphabets[k][np.minimum(found[r, : heads[k][0]], heads[k][1] - 1)].astype("<u4")
            if zlib.crc32(ids.tobytes()) != heads[k][2]:
                raise ValueError("checksum of a block does not match")
            out[k] = ids
    return out
