"""FLAC: a lossless codec for 8-bit mono samples, in numpy, many frames at a time.

The encoder writes a stream marker, STREAMINFO with the MD5 of the samples, a SEEKTABLE, and frames of one subframe: a
linear predictor with quantised coefficients (from the frame's autocorrelation) or a fixed one of order 0 to 2, whichever
is shorter, its residuals in one Rice partition, or verbatim samples where these are shorter still. The decoder reads fixed predictors of order 0 to 4, quantised linear predictors of any order, constant and
verbatim subframes, any partition order and escaped partitions, and checks each header's CRC-8, each frame's CRC-16 and
the MD5. Frames are decoded side by side, a lane for each, so that Python steps once per sample of a block and not
once per sample of a corpus; what the lanes don't do (predictors of an order above LANE_ORDER, several partitions) goes
through a plain decoder for a single frame.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 1024
#: The encoder's linear predictors: order, bits of a coefficient, the largest shift.
ORDER, PRECISION, SHIFT = 4, 10, 12
#: The largest order that is decoded side by side.
LANE_ORDER = 8
#: Bytes of STREAMINFO and of a seek point: fixed values of the format.
INFO_BYTES, POINT_BYTES = 34, 18


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc_lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of data[start : start + size] of each lane; sizes may differ."""
    order = np.argsort(-size, kind="stable")
    s, n, c = start[order], size[order], np.zeros(len(size), np.uint32)
    live = len(n)
    ends = np.searchsorted(-n, -np.arange(1, (int(n[0]) if len(n) else 0) + 1), side="right")
    for i, live in enumerate(ends):
        b = data[s[:live] + i]
        c[:live] = table[b] if bits == 8 and i == 0 else (table[(c[:live] >> (bits - 8)) ^ b] ^ (c[:live] << 8)) & ((1 << bits) - 1)
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame's number in the UTF-8 like code of the format."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(~room << 1) & 0xFF | n, *reversed(tail)])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = 8 - (first ^ 0xFF).bit_length()
    if n < 2 or n > 7:
        raise ValueError("bad frame number")
    value = first & (0x7F >> n)
    for b in data[at + 1 : at + n]:
        value = value << 6 | b & 0x3F
    return value, at + n


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def predictors(x: np.ndarray, start: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame (start, n samples of x), quantised coefficients (a row for each of the last samples) and their shift, by Levinson and Durbin's recursion."""
    pos = np.arange(len(x)) - np.repeat(start, n)
    f = x.astype(np.float64)
    r = []
    for lag in range(order + 1):
        p = np.zeros(len(f))
        p[lag:] = f[lag:] * f[: max(0, len(f) - lag)]
        p[pos < lag] = 0
        r.append(np.add.reduceat(p, start))
    error = r[0] + 1e-3
    a = np.zeros((order, len(n)))
    for i in range(order):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / error
        k = np.clip(k, -0.999, 0.999)
        a[:i] -= k * a[:i][::-1]
        a[i] = k
        error = error * (1 - k * k)
    most = np.maximum(np.abs(a).max(axis=0), 1e-6)
    limit = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(limit / most)), 0, SHIFT).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)), -limit, limit).astype(np.int64), shift


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload; a byte b is the sample b - 128. Every payload needs a byte at least."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads], np.int64)
    if sizes.min() < 1:
        raise ValueError("a payload is empty")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    x = data.astype(np.int32) - 128
    per = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + nth * block
    n = np.minimum(block, np.repeat(sizes, per) - nth * block)

    # the residuals of orders 0 to 2; a frame's first samples are warm-up
    d1 = np.diff(x, prepend=np.int32(0))
    d2 = np.diff(d1, prepend=np.int32(0))
    lane = np.arange(len(n))
    frame_of = np.repeat(lane, n)
    coefficients, lpc_shift = predictors(x, start, n, ORDER)
    ahead = np.zeros(len(x), np.int64)
    for i in range(ORDER):
        ahead[i + 1 :] += coefficients[i][frame_of[i + 1 :]] * x[: -i - 1]
    lpc = (x - (ahead >> lpc_shift[frame_of])).astype(np.int32)
    us = [_zigzag(r) for r in (x, d1, d2, lpc)]
    orders = np.array([0, 1, 2, ORDER])
    for o, u in zip(orders.tolist(), us, strict=True):
        for w in range(o):
            u[(start + w)[n > w]] = 0
    sums = np.stack([np.add.reduceat(u, start, dtype=np.int64) for u in us])
    coded = np.stack([np.maximum(n - o, 0) for o in orders])
    mean = sums / np.maximum(coded, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    lpc_bits = 9 + ORDER * PRECISION  # beside the warm-up samples: 4 of precision, 5 of shift, the coefficients
    bits = sums / (1 << k) + coded * (k + 1) + orders[:, None] * 8 + np.array([0, 0, 0, lpc_bits])[:, None]
    for i, o in enumerate(orders):
        bits[i][n <= o] = np.inf
    bits[0][n < 1] = 0
    choice = np.argmin(bits, axis=0)
    order, k = orders[choice], k[choice, lane]

    pos = np.arange(len(x)) - np.repeat(start, n)
    o_of, k_of = order[frame_of], k[frame_of]
    u = np.choose(choice[frame_of], us)
    warm = pos < o_of
    q = u >> k_of
    length = np.where(warm, 8, q + 1 + k_of).astype(np.int64)
    rice_bits = np.add.reduceat(length, start)
    head_bits = 10 + np.where(choice == 3, lpc_bits, 0)  # the 10: method 2, partition order 4, parameter 4
    verbatim = head_bits + rice_bits >= 8 * n
    if verbatim.any():
        v = verbatim[frame_of]
        warm |= v
        length[v] = 8
        rice_bits = np.where(verbatim, 8 * n, rice_bits)
    value = np.where(warm, x & 0xFF, (1 << k_of) | (u & ((1 << k_of) - 1))).astype(np.uint64)
    width = np.where(warm, 8, k_of + 1).astype(np.int64)

    # headers: sync, variable block size off; 16-bit block size at the end; 8 bits a sample, mono, rate from STREAMINFO
    heads = [b"\xff\xf8\x70\x02" + _number(int(i)) + struct.pack(">H", int(m) - 1) for i, m in zip(nth, n, strict=True)]
    head_n = np.array([len(h) for h in heads], np.int64)
    sub_bits = 8 + np.where(verbatim, 0, head_bits) + rice_bits
    frame_n = head_n + 1 + -(-sub_bits // 8) + 2
    at = np.cumsum(frame_n) - frame_n
    out = np.zeros(int(frame_n.sum()) + 8, np.uint8)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.repeat(at, head_n) + np.arange(len(flat)) - np.repeat(np.cumsum(head_n) - head_n, head_n)
    out[head_at] = flat
    out[at + head_n] = crc_lanes(out, at, head_n, CRC8, 8)
    body = at + head_n + 1
    out[body] = np.where(verbatim, 1, np.where(choice == 3, 31 + order, 8 + order)) << 1
    # warm-up samples come before the head of the predictor and the residual, and so are moved on by none of it
    shift = np.where(verbatim, 0, head_bits)
    ends = (np.cumsum(length) - np.repeat(np.cumsum(rice_bits) - rice_bits, n)) + np.repeat((body + 1) * 8, n) + np.where(warm, 0, shift[frame_of])
    _put(out, ends, value, width)
    rice = ~verbatim
    _put(out, ((body + 1) * 8 + order * 8 + head_bits)[rice], k[rice].astype(np.uint64), np.full(int(rice.sum()), 4))
    own = rice & (choice == 3)
    to = (body + 1)[own] * 8 + ORDER * 8
    _put(out, to + 9, ((PRECISION - 1) << 5 | lpc_shift[own]).astype(np.uint64), np.full(len(to), 9))
    for i in range(ORDER):
        _put(out, to + 9 + (i + 1) * PRECISION, (coefficients[i][own] & ((1 << PRECISION) - 1)).astype(np.uint64), np.full(len(to), PRECISION))
    foot = at + frame_n - 2
    c = crc_lanes(out, at, frame_n - 2, CRC16, 16)
    out[foot], out[foot + 1] = c >> 8, c & 0xFF

    raw, result = out.tobytes(), []
    first = np.cumsum(per) - per
    ends_of = at + frame_n
    signed = (data ^ 0x80).tobytes()
    begin = np.cumsum(sizes) - sizes
    for i, m in enumerate(sizes):
        a, b = int(first[i]), int(first[i] + per[i])
        info = struct.pack(">HH", block, block) + int(frame_n[a:b].min()).to_bytes(3, "big") + int(frame_n[a:b].max()).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | int(m)).to_bytes(8, "big") + hashlib.md5(signed[begin[i] : begin[i] + m]).digest()
        points = b"".join(struct.pack(">QQH", int(j) * block, int(at[a + j] - at[a]), int(n[a + j])) for j in range(b - a))
        result.append(b"fLaC\x00" + INFO_BYTES.to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[int(at[a]) : int(ends_of[b - 1])])
    return result


def _put(out: np.ndarray, end: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Or values, each of at most 17 bits and ending before bit `end`, into zero bits of out."""
    first = (end - width) >> 3
    v = value << (24 - (end - (first << 3))).astype(np.uint64)
    for i in range(3):
        add = (v >> np.uint64(16 - 8 * i)) & np.uint64(0xFF)
        on = add != 0
        where = first[on] + i
        if len(where):
            lo = int(where.min())
            got = np.bincount(where - lo, weights=add[on])
            out[lo : lo + len(got)] |= got.astype(np.uint8)


class Stream:
    """A parsed stream: where its frames are, by its seek table."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.data, at, last, self.points = data, 4, False, []
        info = None
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            part = data[at + 4 : at + 4 + size]
            if kind == 0:
                info = part
            elif kind == 3:
                self.points = [struct.unpack_from(">QQH", part, i) for i in range(0, size, POINT_BYTES)]
            at += 4 + size
        if info is None:
            raise ValueError("no STREAMINFO")
        self.frames_at = at
        packed = int.from_bytes(info[10:18], "big")
        self.bits, self.channels, self.total, self.md5 = (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1, info[18:34]
        if self.bits != 8 or self.channels != 1:
            raise ValueError("only 8-bit mono streams")

    def bounds(self) -> list[tuple[int, int, int, int]]:
        """Of each frame: first sample, samples, first byte, byte after the last."""
        stops = [p[1] for p in self.points[1:]] + [len(self.data) - self.frames_at]
        return [(s, n, self.frames_at + o, self.frames_at + e) for (s, o, n), e in zip(self.points, stops, strict=True)]


def decode_frames(buffers: list[bytes], frames: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """The samples of frames given as (buffer, samples, first byte, byte after the last). Wrong checksums raise ValueError."""
    if not frames:
        return []
    base = np.cumsum([0, *map(len, buffers)])
    joined = b"".join(buffers)
    data = np.frombuffer(joined + bytes(16), np.uint8)
    which = np.array([f[0] for f in frames])
    a = base[which] + np.array([f[2] for f in frames])
    b = base[which] + np.array([f[3] for f in frames])
    n = np.array([f[1] for f in frames], np.int64)
    c = crc_lanes(data, a, b - a - 2, CRC16, 16)
    if (c != (data[b - 2].astype(np.uint32) << 8 | data[b - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    body = np.empty(len(frames), np.int64)
    for i, start in enumerate(a.tolist()):
        if joined[start] != 0xFF or joined[start + 1] & 0xFC != 0xF8:
            raise ValueError("no frame begins here")
        code = joined[start + 2] >> 4
        _, at = _read_number(joined, start + 4)
        size = int.from_bytes(joined[at : at + 2], "big") + 1 if code == 7 else joined[at] + 1 if code == 6 else 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8
        at += 2 if code == 7 else code == 6
        at += (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 2, 0)[joined[start + 2] & 15]
        if size != n[i]:
            raise ValueError("a frame's size differs from the seek table's")
        body[i] = at + 1
    if (crc_lanes(data, a, body - 1 - a, CRC8, 8) != data[body - 1]).any():
        raise ValueError("a header's CRC-8 is wrong")

    kind = data[body] >> 1
    wide = kind.astype(np.int64)
    quantised = (wide >= 32) & (wide <= 31 + LANE_ORDER)
    order = np.where((wide >= 8) & (wide <= 12), wide - 8, np.where(quantised, wide - 31, -1))
    head = (body + 1) * 8 + np.maximum(order, 0) * 8

    def field(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Bit fields of at most 17 bits."""
        v = (data[at >> 3].astype(np.int64) << 8 | data[(at >> 3) + 1]) << 8 | data[(at >> 3) + 2]
        return v >> (24 - (at & 7) - width) & ((1 << width) - 1)

    precision, lpc_shift = field(head, 4) + 1, field(head + 4, 5)
    coefficients_at = head + 9
    head = np.where(quantised, head + 9 + order * precision, head)
    method = field(np.minimum(head, (len(data) - 3) * 8), 10)  # 2 bits of method, 4 of partition order, 4 of the parameter
    quantised &= (precision < 16) & (lpc_shift < 16)  # a negative shift is for the plain decoder
    order = np.where((wide >= 32) & ~quantised, -1, order)
    easy = (order >= 0) & (method >> 4 == 0) & (method & 15 != 15) & ((data[body] & 1) == 0)
    out: list[np.ndarray | None] = [None] * len(frames)
    for i in np.flatnonzero((kind == 1) & ((data[body] & 1) == 0)):
        out[i] = data[body[i] + 1 : body[i] + 1 + n[i]].view(np.int8).astype(np.int32)
    for i in np.flatnonzero(~easy & ~((kind == 1) & ((data[body] & 1) == 0))):
        out[i] = _plain(joined, int(body[i]), int(n[i]))
    lanes = np.flatnonzero(easy)
    if len(lanes):
        lanes = lanes[np.argsort(-n[lanes], kind="stable")]
        o, k, m = order[lanes], method[lanes] & 15, n[lanes]
        res = _rice_lanes(data, head[lanes] + 10, k, m - o)
        grid = np.zeros((len(lanes), int(m.max())), np.int32)
        res = np.pad(res, ((0, 0), (0, grid.shape[1] - res.shape[1])))
        for w in range(LANE_ORDER):
            has = np.flatnonzero(o > w)
            if len(has):
                grid[has, w] = data[body[lanes[has]] + 1 + w].view(np.int8)
        q = quantised[lanes]
        for each in range(1, LANE_ORDER + 1):
            rows = np.flatnonzero(q & (o == each))
            if not len(rows):
                continue
            at = coefficients_at[lanes[rows]]
            bits = precision[lanes[rows]]
            c = [field(at + i * bits, bits) for i in range(each)]
            c = [v - ((v >> (bits - 1)) << bits) for v in c]
            down = lpc_shift[lanes[rows]]
            g = np.ascontiguousarray(grid[rows].T).astype(np.int64)
            e = np.ascontiguousarray(res[rows].T)
            for i in range(each, len(g)):  # a sample of every lane at once
                ahead = c[0] * g[i - 1]
                for w in range(1, each):
                    ahead += c[w] * g[i - 1 - w]
                g[i] = e[i - each] + (ahead >> down) if i - each < len(e) else 0
            grid[rows] = g.T
        for each in range(5):
            rows = np.flatnonzero(~q & (o == each))
            if not len(rows):
                continue
            g = grid[rows]
            g[:, each:] = res[rows, : g.shape[1] - each]
            # warm-up samples become the starts of the differences, which are then summed up again
            for d in range(each, 0, -1):
                at = np.diff(grid[rows, :each], n=d - 1, axis=1)[:, 0] if d > 1 else grid[rows, 0]
                g[:, d - 1] = at
                g[:, d - 1 :] = np.cumsum(g[:, d - 1 :], axis=1)
            grid[rows] = g
        for j, i in enumerate(lanes.tolist()):
            out[i] = grid[j, : n[i]]
    return out  # type: ignore[return-value]


def _rice_lanes(data: np.ndarray, pos: np.ndarray, k: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rice codes of parameter k from bit `pos` on, a row for each lane. Lanes come with falling counts, but for a few."""
    steps = int(count.max())
    out = np.zeros((len(pos), steps), np.int32)
    view = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    pos, k64, down = pos.astype(np.int64).copy(), k.astype(np.uint64), (64 - k).astype(np.uint64)
    top = int(len(view) - 1)
    live_at = len(pos) - np.searchsorted(np.sort(count), np.arange(steps), side="right")
    by = np.argsort(-count, kind="stable")
    if (by != np.arange(len(by))).any():
        rows = _rice_lanes(data, pos[by], k[by], count[by])
        out[by] = rows
        return out
    zero_k = bool((k == 0).any())
    for i in range(steps):
        m = int(live_at[i])
        p = pos[:m]
        w = view[np.minimum(p >> 3, top)].astype(np.uint64) << (p & 7).astype(np.uint64)
        high = (w >> np.uint64(32)).astype(np.float64)
        q = 1054 - (high.view(np.int64) >> 52)  # 31 less the exponent: the zeros before the first one
        long = (high == 0) | (q + k[:m] > 55)
        uq = q.astype(np.uint64)
        rem = (w << np.minimum(uq, np.uint64(62)) << np.uint64(1)) >> np.minimum(down[:m], np.uint64(63))
        if zero_k:
            rem = np.where(k[:m] == 0, np.uint64(0), rem)
        u = (uq << k64[:m] | rem).astype(np.int64)
        step = q + 1 + k[:m]
        for j in np.flatnonzero(long):
            bit, zeros = int(p[j]), 0
            while not data[bit >> 3] >> (7 - (bit & 7)) & 1:
                bit, zeros = bit + 1, zeros + 1
            low = 0
            for t in range(int(k[j])):
                e = bit + 1 + t
                low = low << 1 | int(data[e >> 3] >> (7 - (e & 7)) & 1)
            u[j], step[j] = zeros << int(k[j]) | low, zeros + 1 + int(k[j])
        out[:m, i] = (u >> 1) ^ -(u & 1)
        pos[:m] += step
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _plain(data: bytes, at: int, n: int, bits: int = 8) -> np.ndarray:
    """One subframe of any kind, sample by sample."""
    r = _Bits(data, at)
    kind = r.take(8)
    wasted = r.unary() + 1 if kind & 1 else 0
    kind, bits = kind >> 1 & 63, bits - wasted
    if kind == 0:
        x = [r.signed(bits)] * n
    elif kind == 1:
        x = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [r.signed(bits) for _ in range(order)]
        shift = 0
        if kind >= 32:
            precision, shift = r.take(4) + 1, r.signed(5)
            coefficients = [r.signed(precision) for _ in range(order)]
        else:
            coefficients = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order]
        wide = 5 if r.take(2) else 4
        parts = 1 << r.take(4)
        for part in range(parts):
            count = n // parts - (order if part == 0 else 0)
            k = r.take(wide)
            raw = r.take(5) if k == (1 << wide) - 1 else -1
            for _ in range(count):
                if raw >= 0:
                    e = r.signed(raw)
                else:
                    u = r.unary() << k | r.take(k)
                    e = (u >> 1) ^ -(u & 1)
                x.append(e + (sum(c * v for c, v in zip(coefficients, reversed(x[-order:] if order else []), strict=True)) >> shift))
    else:
        raise ValueError("a reserved kind of subframe")
    return np.array(x, np.int64).astype(np.int32) << wasted


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, checked against its MD5."""
    parsed = [Stream(s) for s in streams]
    bounds = [p.bounds() for p in parsed]
    flat = [(i, n, a, b) for i, own in enumerate(bounds) for _, n, a, b in own]
    samples, out, at = decode_frames(streams, flat), [], 0
    for p, own in zip(parsed, bounds, strict=True):
        x = np.concatenate(samples[at : at + len(own)]).astype(np.int8) if own else np.empty(0, np.int8)
        at += len(own)
        if len(x) != p.total or p.md5 != bytes(16) and hashlib.md5(x.tobytes()).digest() != p.md5:
            raise ValueError("the MD5 of the samples is wrong")
        out.append((x.view(np.uint8) ^ 0x80).tobytes())
    return out


def read_at(stream: bytes, first: int, count: int) -> bytes:
    """`count` bytes of the payload from `first` on; the seek table names the only frames that are decoded."""
    p = Stream(stream)
    own = [(s, n, a, b) for s, n, a, b in p.bounds() if s < first + count and s + n > first]
    x = np.concatenate(decode_frames([stream], [(0, n, a, b) for _, n, a, b in own]) or [np.empty(0, np.int32)]).astype(np.int8)
    skip = first - own[0][0] if own else 0
    return (x[skip : skip + count].view(np.uint8) ^ 0x80).tobytes()
