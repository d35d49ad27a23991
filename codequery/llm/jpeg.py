"""Progressive JPEG in numpy: a decoder for any Huffman-coded progressive file of 8-bit samples, and an encoder
that stores coefficients losslessly.

Entropy-coded segments (between restart markers) are independent, so a batch of files is decoded with all of
its segments in lockstep: every step reads one symbol of each segment. Scans add into one array of coefficients
(rows: blocks, 64 columns in zigzag order): DC and AC first passes with spectral selection, then their
refinements by successive approximation.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

RESTART = 8
_marker = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_restart = re.compile(rb"\xff[\xd0-\xd7]")


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order, from the rule of alternating diagonals."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])


def _basis(bits: int = 13) -> np.ndarray:
    """Zigzag coefficients to pixels, in whole numbers of 2**-bits, so that float64 products are exact in any order."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    two = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)  # u: row frequency, x: row
    return np.round(two[zigzag()] * (1 << bits))


BASIS = _basis()


class Huffman:
    """Canonical code: counts of codes by length 1..16 and symbols in order."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.lengths = np.zeros(1 << 16, np.int64)
        self.symbols = np.zeros(1 << 16, np.int64)
        self.code, self.size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                first = code << (16 - length)
                self.lengths[first : first + (1 << (16 - length))] = length
                self.symbols[first : first + (1 << (16 - length))] = symbol
                self.code[symbol], self.size[symbol] = code, length
                code += 1
            at += n
            code <<= 1


def _table(by_length: dict[int, list[int]]) -> tuple[bytes, bytes]:
    return bytes(len(by_length.get(n, ())) for n in range(1, 17)), bytes(s for n in sorted(by_length) for s in by_length[n])


def _ac_table() -> tuple[bytes, bytes]:
    """Short codes for what bytes of text give (sizes 7, 6, 8, 5 without a run, end of block), 15 bits for the rest."""
    short = {1: [0x07], 2: [0x06], 3: [0x08], 4: [0x05], 5: [0x00], 6: [0x04], 7: [0xF0]}
    taken = {s for x in short.values() for s in x}
    rest = [r << 4 | s for r in range(16) for s in range(9) if (r << 4 | s) not in taken]
    return _table(short | {15: rest})


DC_SPEC, AC_SPEC = _table({4: list(range(12))}), _ac_table()
DC_CODE, AC_CODE = Huffman(*DC_SPEC), Huffman(*AC_SPEC)
#: (Ss, Se, Ah, Al) in the order of coding, for each component on its own.
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 0), (0, 0, 1, 0), (1, 5, 1, 0))


# ---------------------------------------------------------------- encoding


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v).astype(np.float64) + 1)).astype(np.int64)


def _ac_words() -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of every pair of run (0 to 15) and value (-128 to 127), and their number."""
    run, v = np.divmod(np.arange(16 * 256), 256)
    v = v - 128
    size = _sizes(v)
    symbol = run << 4 | size
    return (AC_CODE.code[symbol] << size.astype(np.uint64)) | _bits_of(v, size), AC_CODE.size[symbol] + size


def _bits_of(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (np.int64(1) << size) - 1, v).astype(np.uint64)


AC_WORDS, AC_WORD_SIZES = _ac_words()


def _dc_first(c: np.ndarray, fresh: np.ndarray, al: int):
    v = c[:, 0].astype(np.int64) >> al
    diff = v - np.where(fresh, 0, np.concatenate([[0], v[:-1]]))
    size = _sizes(diff)
    return np.arange(len(c)), (DC_CODE.code[size] << size.astype(np.uint64)) | _bits_of(diff, size), DC_CODE.size[size] + size


def _dc_refine(c: np.ndarray, al: int):
    n = len(c)
    return np.arange(n), ((c[:, 0].astype(np.int64) >> al) & 1).astype(np.uint64), np.ones(n, np.int64)


def _ac_first(c: np.ndarray, ss: int, se: int, al: int):
    band = c[:, ss : se + 1]
    band = np.sign(band) * (np.abs(band) >> al) if al else np.ascontiguousarray(band)
    row, col = np.divmod(np.flatnonzero(band), band.shape[1])
    v = band.ravel()[row * band.shape[1] + col].astype(np.int64)
    fresh = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    run = col - np.where(fresh, -1, np.concatenate([[0], col[:-1]])[: len(col)]) - 1
    word = ((run & 15) << 8) + v + 128
    value, nbits = AC_WORDS[word], AC_WORD_SIZES[word]
    zrl, zlen = int(AC_CODE.code[0xF0]), int(AC_CODE.size[0xF0])
    for times in range(1, 1 + int(run.max(initial=0)) // 16):
        at = np.flatnonzero(run >> 4 == times)
        lead = sum(zrl << (zlen * i) for i in range(times))
        value[at] |= np.uint64(lead) << nbits[at].astype(np.uint64)
        nbits[at] += times * zlen
    short = np.flatnonzero(band[:, -1] == 0)  # these blocks close with an end of block
    at = np.searchsorted(row, short, "right")
    return np.insert(row, at, short), np.insert(value, at, AC_CODE.code[0]), np.insert(nbits, at, AC_CODE.size[0])


def _ac_refine(c: np.ndarray, ss: int, se: int, al: int):
    """For bands of up to 16 coefficients, at most one item for each and one to close a block."""
    n, width = len(c), se - ss + 1
    size = np.abs(c[:, ss : se + 1].astype(np.int64)) >> al
    sign = c[:, ss : se + 1] >= 0
    values, lengths = np.zeros((n, width + 1), np.uint64), np.zeros((n, width + 1), np.int64)
    held, held_n, run = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(width):
        old, new = size[:, k] > 1, size[:, k] == 1
        symbol = run << 4 | 1
        head = (AC_CODE.code[symbol] << np.uint64(1)) | sign[:, k].astype(np.uint64)
        values[:, k] = np.where(new, (head << held_n.astype(np.uint64)) | held, 0)
        lengths[:, k] = np.where(new, AC_CODE.size[symbol] + 1 + held_n, 0)
        run = np.where(new, 0, run + (size[:, k] == 0))
        held = np.where(new, 0, np.where(old, (held << np.uint64(1)) | (size[:, k] & 1).astype(np.uint64), held))
        held_n = np.where(new, 0, held_n + old)
    last = size[:, -1] != 1
    values[:, width] = np.where(last, (AC_CODE.code[0] << held_n.astype(np.uint64)) | held, 0)
    lengths[:, width] = np.where(last, AC_CODE.size[0] + held_n, 0)
    row, col = np.nonzero(lengths)
    return row, values[row, col], lengths[row, col]


def _packed(value: np.ndarray, nbits: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments one after another, each closed with ones; and where each begins (n + 1 places)."""
    bits = np.bincount(segment, nbits, n).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(-(-bits // 8))])
    before = np.cumsum(nbits) - nbits
    at = before - np.concatenate([[0], np.cumsum(bits)])[segment] + 8 * start[segment]
    out = np.zeros(start[-1] // 8 + 2, np.uint64)
    word, end = at >> 6, (at & 63) + nbits
    over = end > 64
    left = np.where(over, value >> np.where(over, end - 64, 0).astype(np.uint64), value << np.where(over, 0, 64 - end).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
    if len(first):
        out[word[first]] = np.bitwise_or.reduceat(left, first)
    out[word[over] + 1] |= value[over] << (128 - end[over]).astype(np.uint64)
    data = out.byteswap().view(np.uint8)[: start[-1]]
    some = bits > 0
    data[start[1:][some] - 1] |= ((1 << (-bits[some] % 8)) - 1).astype(np.uint8)
    return data, start


def _marked(data: np.ndarray, start: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With zeros stuffed after 0xFF and restart markers between the segments of a scan; and the new places."""
    stuffed = np.flatnonzero(data == 255) + 1
    ends = start[1:][~last]
    place = np.concatenate([stuffed, np.repeat(ends, 2)])
    marks = np.stack([np.full(len(ends), 255), 0xD0 + number[~last] % 8], 1).ravel()
    out = np.insert(data, place, np.concatenate([np.zeros(len(stuffed), np.int64), marks]).astype(np.uint8))
    moved = start + np.searchsorted(stuffed, start, "right") + 2 * np.concatenate([[0], np.cumsum(~last)])
    return out, moved


def grid(blocks: int) -> tuple[int, int]:
    """MCU columns and rows of the 4:2:0 image that holds so many blocks, six to an MCU."""
    mcus = max(1, -(-blocks // 6))
    columns = int(np.ceil(np.sqrt(mcus)))
    return columns, -(-mcus // columns)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_SETUP = _segment(0xDB, b"\0" + b"\1" * 64) + b"".join(_segment(0xC4, bytes([kind]) + counts + symbols) for kind, (counts, symbols) in ((0x00, DC_SPEC), (0x10, AC_SPEC))) + _segment(0xDD, struct.pack(">H", RESTART))


def _scan_header(component: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, ss, se, ah << 4 | al]))


_HEADERS = [[_scan_header(c, *s) for s in SCRIPT] for c in (1, 2, 3)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 JPEG for each payload (a multiple of 64 bytes): its bytes, as signed, are the coefficients.

    The blocks fill the luma raster, then Cb, then Cr; the rest stays zero. A comment holds the number of blocks.
    """
    grids = [grid(len(p) // 64) for p in payloads]
    parts: list[list[np.ndarray]] = [[], [], []]
    for p, (columns, rows) in zip(payloads, grids, strict=True):
        m = columns * rows
        c = np.zeros((6 * m, 64), np.int8)
        c.reshape(-1)[: len(p)] = np.frombuffer(p, np.int8)
        for k, (a, b) in enumerate(((0, 4 * m), (4 * m, 5 * m), (5 * m, 6 * m))):
            parts[k].append(c[a:b])
    scans: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for each in parts:
        c, counts = np.concatenate(each).astype(np.int16), np.array([len(x) for x in each])
        pieces = -(-counts // RESTART)
        doc_first = np.cumsum(pieces) - pieces
        number = np.arange(pieces.sum()) - np.repeat(doc_first, pieces)
        last = number == np.repeat(pieces, pieces) - 1
        within = np.arange(len(c)) - np.repeat(np.cumsum(counts) - counts, counts)
        segment = np.repeat(doc_first, counts) + within // RESTART
        done = []
        for ss, se, ah, al in SCRIPT:
            if se == 0:
                row, value, nbits = _dc_refine(c, al) if ah else _dc_first(c, within % RESTART == 0, al)
            else:
                row, value, nbits = (_ac_refine if ah else _ac_first)(c, ss, se, al)
            data, start = _marked(*_packed(value, nbits, segment[row], len(number)), number, last)
            first = start[doc_first]
            # a scan ends before the marker that would follow it; start of the next segment has no marker for the last
            done.append((data.tobytes(), first, np.append(first[1:], len(data))))
        scans.append(done)
    out = []
    for d, (p, (columns, rows)) in enumerate(zip(payloads, grids, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        file = [b"\xff\xd8", _segment(0xFE, str(len(p) // 64).encode()), _SETUP, _segment(0xC2, frame)]
        for headers, done in zip(_HEADERS, scans, strict=True):
            for header, (data, first, end) in zip(headers, done, strict=True):
                file += [header, data[first[d] : end[d]]]
        out.append(b"".join([*file, b"\xff\xd9"]))
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Component:
    h: int
    v: int
    quant: int
    row: int = 0  # of its first block in the coefficient array
    wide: int = 0  # blocks of a row, with those that only fill MCUs
    high: int = 0
    own_wide: int = 0  # blocks of a row that the image needs
    own_high: int = 0


@dataclass
class Picture:
    comment: bytes = b""
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list = field(default_factory=list)
    blocks: int = 0
    orders: dict = field(default_factory=dict)


_codes: dict[tuple[bytes, bytes], Huffman] = {}


def _code(counts: bytes, symbols: bytes) -> Huffman:
    if (counts, symbols) not in _codes:
        if len(_codes) > 64:
            _codes.clear()
        _codes[counts, symbols] = Huffman(counts, symbols)
    return _codes[counts, symbols]


def parse(file: bytes) -> Picture:
    """Markers, tables and the whereabouts of entropy-coded data; ValueError for what isn't a progressive JPEG."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    picture, at, tables, restart = Picture(), 2, {}, 0
    while at + 2 <= len(file):
        if file[at] != 0xFF:
            raise ValueError("marker expected")
        marker = file[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        if at + 4 > len(file):
            raise ValueError("no end of image")
        size = struct.unpack_from(">H", file, at + 2)[0]
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            picture.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                picture.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
            picture.components = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            most_h, most_v = (max(getattr(c, a) for c in picture.components.values()) for a in "hv")
            mcus_wide, mcus_high = -(-picture.width // (8 * most_h)), -(-picture.height // (8 * most_v))
            for c in picture.components.values():
                c.row, c.wide, c.high = picture.blocks, mcus_wide * c.h, mcus_high * c.v
                c.own_wide, c.own_high = -(-(-(-picture.width * c.h // most_h)) // 8), -(-(-(-picture.height * c.v // most_v)) // 8)
                picture.blocks += c.wide * c.high
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            found = _marker.search(file, at)
            end = found.start() if found else len(file)
            spec = tuple(tables.get(d if ss == 0 else 0x10 | a) for _, d, a in chosen)
            cuts = [at, *(x for m in _restart.finditer(file, at, end) for x in m.span()), end]
            segments = [file[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            picture.scans.append((tuple(c for c, _, _ in chosen), ss, se, approx >> 4, approx & 15, spec, restart, segments))
            at = end
        elif marker in (0xC0, 0xC1, *range(0xC5, 0xD0)) and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded file")
    else:
        raise ValueError("no end of image")
    return picture


def _units(picture: Picture, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of the coefficient array in the order of the scan, the component of each, and units of an MCU."""
    if chosen not in picture.orders:
        picture.orders[chosen] = _order(picture, chosen)
    return picture.orders[chosen]


def _order(picture: Picture, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(chosen) == 1:
        c = picture.components[chosen[0]]
        rows = (c.row + np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).ravel()
        return rows, np.zeros(len(rows), np.int64), 1
    rows, kinds = [], []
    for k, name in enumerate(chosen):
        c = picture.components[name]
        at = (c.row + np.arange(c.high)[:, None] * c.wide + np.arange(c.wide)).reshape(c.high // c.v, c.v, c.wide // c.h, c.h)
        rows.append(at.transpose(0, 2, 1, 3).reshape(-1, c.v * c.h))
        kinds += [k] * (c.v * c.h)
    rows = np.concatenate(rows, 1)
    return rows.ravel(), np.tile(kinds, len(rows)), rows.shape[1]


class _Bits:
    """The segments' bits; peek and take work on many segments at once."""

    def __init__(self, segments: list[bytes]) -> None:
        lengths = np.array([len(s) + 8 for s in segments])
        data = np.frombuffer(b"".join(s + b"\xff" * 8 for s in segments) + b"\xff" * 8, np.uint8).astype(np.uint64)
        two = (data[:-1] << np.uint64(8)) | data[1:]
        four = (two[:-2] << np.uint64(16)) | two[2:]
        self.window = (four[:-4] << np.uint64(32)) | four[4:]
        self.at = 8 * (np.cumsum(lengths) - lengths)
        self.end = self.at + 8 * lengths

    def look(self, who: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, at the top."""
        p = self.at[who]
        return self.window[p >> 3] << (p & 7).astype(np.uint64)

    def check(self) -> None:
        if (self.at > self.end - 64).any():
            raise ValueError("entropy-coded data end too early")


def _field(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (0 to 16) after the first skip ones."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _known(length: np.ndarray) -> None:
    if not length.all():
        raise ValueError("a code that the table doesn't have")


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (np.int64(1) << np.maximum(size - 1, 0)), bits - (np.int64(1) << size) + 1, bits)


def _read_dc(coef, bits, codes, units, kinds, first, count, ah, al) -> None:
    predicted = np.zeros((len(first), max(1, len(codes))), np.int64)
    for step in range(int(count.max(initial=0))):
        who = np.flatnonzero(count > step)
        unit = first[who] + step
        window = bits.look(who)
        if ah:
            coef[units[unit], 0] |= ((window >> np.uint64(63)).astype(np.int64) << al).astype(coef.dtype)
            bits.at[who] += 1
            continue
        kind = kinds[unit]
        for k, code in enumerate(codes):
            on = kind == k
            some, w = who[on], window[on]
            head = (w >> np.uint64(48)).astype(np.int64)
            size, length = code.symbols[head], code.lengths[head]
            _known(length)
            predicted[some, k] += np.where(size > 0, _signed(_field(w, length, size), size), 0)
            coef[units[unit[on]], 0] = predicted[some, k] << al
            bits.at[some] += length + size


def _read_ac_first(coef, bits, code, units, first, count, ss, se, al) -> None:
    unit, end = first.copy(), first + count
    k = np.full(len(first), ss)
    who = np.flatnonzero(unit < end)
    while len(who):
        window = bits.look(who)
        head = (window >> np.uint64(48)).astype(np.int64)
        symbol, length = code.symbols[head], code.lengths[head]
        _known(length)
        run, size = symbol >> 4, symbol & 15
        plain, closing = size > 0, (size == 0) & (run < 15)
        extra = np.where(plain, size, np.where(closing, run, 0))
        value = _field(window, length, extra)
        bits.at[who] += length + extra
        at = k[who] + np.where(closing, 0, run)
        if (at[plain] > se).any():
            raise ValueError("coefficient out of its band")
        coef[units[unit[who[plain]]], at[plain]] = _signed(value[plain], size[plain]) << al
        at += 1
        ended = closing | (at > se)
        unit[who] += np.where(closing, (np.int64(1) << extra) + value, ended)
        k[who] = np.where(ended, ss, at)
        if ended.any():
            who = who[unit[who] < end[who]]


def _read_ac_refine(coef, bits, code, units, first, count, ss, se, al) -> None:
    n = len(first)
    unit, end = first.copy(), first + count
    k, run, new, ends = np.full(n, ss), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    wants = np.ones(n, bool)
    who = np.flatnonzero(unit < end)
    while len(who):
        some = who[wants[who]]
        if len(some):
            window = bits.look(some)
            head = (window >> np.uint64(48)).astype(np.int64)
            symbol, length = code.symbols[head], code.lengths[head]
            _known(length)
            r, size = symbol >> 4, symbol & 15
            closing = (size == 0) & (r < 15)
            extra = np.where(size > 0, 1, np.where(closing, r, 0))
            value = _field(window, length, extra)
            bits.at[some] += length + extra
            run[some] = r
            new[some] = np.where(size > 0, np.where(value == 1, 1, -1) << al, 0)
            ends[some] = np.where(closing, (np.int64(1) << extra) + value, 0)
            wants[some] = False
        row, at = units[unit[who]], k[who]
        now = coef[row, at].astype(np.int64)
        old = now != 0
        if old.any():
            bit = bits.look(who[old]) >> np.uint64(63) == 1
            bits.at[who[old]] += 1
            v = now[old]
            coef[row[old], at[old]] = np.where(bit & (np.abs(v) >> al & 1 == 0), v + (np.sign(v) << al), v)
        open_, over = ~old & (ends[who] == 0), run[who] == 0
        placed = open_ & over
        coef[row[placed], at[placed]] = new[who[placed]]
        wants[who[placed]] = True
        run[who[open_ & ~over]] -= 1
        k[who] += 1
        full = who[k[who] > se]
        if len(full):
            closed = ends[full] > 0
            ends[full[closed]] -= 1
            wants[full] = ends[full] == 0
            unit[full] += 1
            k[full] = ss
            who = who[unit[who] < end[who]]


def coefficients(pictures: list[Picture]) -> list[np.ndarray]:
    """Blocks by 64 zigzag coefficients of each picture; the k-th scans of all pictures are read together."""
    base = np.cumsum([0, *(p.blocks for p in pictures)])
    coef = np.zeros((base[-1], 64), np.int16)
    for turn in range(max((len(p.scans) for p in pictures), default=0)):
        alike: dict[tuple, list] = {}
        for b, p in zip(base, pictures, strict=False):
            if turn < len(p.scans):
                chosen, ss, se, ah, al, spec, restart, segments = p.scans[turn]
                rows, kinds, mcu = _units(p, chosen)
                per = restart * mcu or len(rows)
                alike.setdefault((ss, se, ah, al, spec), []).append((rows + b, kinds, segments[: -(-len(rows) // per)], per))
        for (ss, se, ah, al, spec), group in alike.items():
            counts = [np.minimum(per, len(rows) - per * np.arange(len(segments))) for rows, _, segments, per in group]
            units, kinds, count = (np.concatenate(x) for x in ([g[0] for g in group], [g[1] for g in group], counts))
            starts = np.cumsum([0, *(len(g[0]) for g in group)])
            first = np.concatenate([s + per * np.arange(len(segments)) for s, (_, _, segments, per) in zip(starts, group, strict=False)])
            bits = _Bits([s for g in group for s in g[2]])
            codes = [_code(*x) for x in spec if x]
            try:
                if se == 0:
                    _read_dc(coef, bits, codes, units, kinds, first, count, ah, al)
                else:
                    (_read_ac_refine if ah else _read_ac_first)(coef, bits, codes[0], units, first, count, ss, se, al)
            except IndexError as e:
                raise ValueError("entropy-coded data end too early") from e
            bits.check()
    return [coef[a:b] for a, b in zip(base, base[1:], strict=False)]


def _pixels(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 64) samples; sums of whole numbers under 2**53, so equal blocks give equal pixels in any batch."""
    own = (coef.astype(np.float64) * quant) @ BASIS
    own += 1 << 12
    own *= 1 / (1 << 13)
    return np.clip(np.floor(own, out=own) + 128, 0, 255).astype(np.uint8)


def _coloured(y: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    y, b, r = y.astype(np.int32), b.astype(np.int32) - 128, r.astype(np.int32) - 128
    # fixed values: 1.402, 0.344136, 0.714136 and 1.772, in 65536ths
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + ((91881 * r + 32768) >> 16), 0, 255)
    out[..., 1] = np.clip(y - ((22554 * b + 46802 * r + 32768) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((116130 * b + 32768) >> 16), 0, 255)
    return out


def rgb_all(pictures: list[Picture], coefs: list[np.ndarray]) -> list[np.ndarray]:
    """rgb() of each picture; those in 4:2:0 with one quantisation are transformed and coloured together."""
    out: list = [None] * len(pictures)
    usual = []
    for i, p in enumerate(pictures):
        c = list(p.components.values())
        if [(x.h, x.v) for x in c] == [(2, 2), (1, 1), (1, 1)] and all((p.quants[x.quant] == 1).all() for x in c):
            usual.append(i)
        else:
            out[i] = rgb(p, coefs[i])
    if not usual:
        return out
    base = np.cumsum([0, *(pictures[i].blocks for i in usual)])
    pixels = _pixels(np.concatenate([coefs[i] for i in usual]), np.ones(64)).reshape(-1, 8, 8)
    units = np.concatenate([_units(pictures[i], tuple(pictures[i].components))[0] + b for i, b in zip(usual, base, strict=False)]).reshape(-1, 6)
    luma = pixels[units[:, :4]].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    blue, red = (pixels[units[:, k]].repeat(2, 1).repeat(2, 2) for k in (4, 5))
    mcus = _coloured(luma, blue, red)
    at = 0
    for i in usual:
        p = pictures[i]
        wide, high = -(-p.width // 16), -(-p.height // 16)
        own = mcus[at : at + wide * high].reshape(high, wide, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * high, 16 * wide, 3)
        out[i] = own[: p.height, : p.width]
        at += wide * high
    return out


def rgb(picture: Picture, coef: np.ndarray) -> np.ndarray:
    """(height, width, 3) uint8: inverse transform, chroma repeated up to full resolution, JFIF colours."""
    most_h, most_v = (max(getattr(c, a) for c in picture.components.values()) for a in "hv")
    planes = []
    for c in picture.components.values():
        pixels = _pixels(coef[c.row : c.row + c.wide * c.high], picture.quants[c.quant])
        plane = pixels.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)
        plane = plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.stack([planes[0]] * 3, 2)
    return _coloured(*planes)
