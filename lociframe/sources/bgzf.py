"""Block-compressed text and the index of its records.

A block-compressed file is a row of small gzip members, each with its own size in the header, so that reading may begin
at any of them. A virtual offset names a place in it: the member's place in the file, shifted by 16 bits, plus the place in
the member's text. An index says for each bin of a contig at which virtual offsets its records stand; bins of several
widths are nested, and a record belongs to the narrowest that holds it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

BLOCK = 0xFF00          # bytes of text in a block that is written
FETCH = 1 << 20         # bytes that are read at once
# Fixed values of the formats: narrowest bin, number of levels below the widest, columns of a variant file.
SHIFT, DEPTH = 14, 5
VCF_LAYOUT = (2, 1, 2, 0, ord("#"), 0)


def block(text: bytes) -> bytes:
    """A member that holds text; empty text gives the mark of the end of a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, ord("B"), ord("C"), 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def blocks(source, begin: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(place, place of the next one, text) of the members from a place on. source has read_at and size."""
    at, data, end = begin, b"", source.size()
    while at < end or data:
        if len(data) < 1 << 16 and at + len(data) < end:
            data += source.read_at(min(FETCH, end - at - len(data)), at + len(data))
        if len(data) < 18 or data[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block-compressed member at byte {at}")
        extra, = struct.unpack_from("<H", data, 10)
        size, k = 0, 12
        while k < 12 + extra:
            name, length = data[k:k + 2], struct.unpack_from("<H", data, k + 2)[0]
            if name == b"BC":
                size = struct.unpack_from("<H", data, k + 4)[0] + 1
            k += 4 + length
        if not size or len(data) < size:
            raise ValueError(f"the member at byte {at} is cut off or has no size")
        text = zlib.decompress(data[12 + extra:size - 8], -15)
        if zlib.crc32(text) != struct.unpack_from("<I", data, size - 8)[0]:
            raise ValueError(f"the member at byte {at} is damaged")
        yield at, at + size, text
        at, data = at + size, data[size:]


def lines_between(source, begin: int = 0, end: int | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """The lines that begin at virtual offsets from begin up to end, with those offsets, a list per member."""
    rest, rest_at = b"", None
    for at, after, text in blocks(source, begin >> 16):
        first = begin & 0xFFFF if at == begin >> 16 else 0
        if rest_at is None and end is not None and (at << 16 | first) >= end:
            return
        offsets, lines, k = [], [], first
        while (stop := text.find(b"\n", k)) >= 0:
            where = rest_at if rest_at is not None else at << 16 | k
            if end is not None and where >= end:
                break
            offsets.append(where)
            lines.append(rest + text[k:stop])
            rest, rest_at, k = b"", None, stop + 1
        else:
            if k < len(text):
                if rest_at is None:
                    rest_at = at << 16 | k
                rest += text[k:]
            if lines:
                yield offsets, lines
            if end is not None and rest_at is not None and rest_at >= end:
                return
            continue
        if lines:
            yield offsets, lines
        return
    if rest and (end is None or rest_at < end):
        yield [rest_at], [rest]


def level_start(level: int) -> int:
    """The number of the first bin of a level; level 0 is the widest."""
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> int:
    """The narrowest bin that holds start .. end."""
    for level in range(depth, 0, -1):
        width = shift + 3 * (depth - level)
        if start >> width == (end - 1) >> width:
            return level_start(level) + (start >> width)
    return 0


def bin_range(number: int, shift: int, depth: int) -> tuple[int, int]:
    """(width in bits, place among the bins of that width) of a bin."""
    level = next(k for k in range(depth + 1) if number < level_start(k + 1))
    return shift + 3 * (depth - level), number - level_start(level)


def record_span(line: bytes) -> tuple[bytes, int, int]:
    """Contig, start and end (0-based, exclusive) of a variant's line; END of the last column's values counts."""
    parts = line.split(b"\t", 8)
    start = int(parts[1]) - 1
    end = start + max(1, len(parts[3]))
    said = re.search(rb"(?:^|;)END=([0-9]+)", parts[7]) if len(parts) > 7 else None
    return parts[0], start, max(end, int(said[1])) if said else end


@dataclass
class Contig:
    """The bins of a contig, each a list of [begin, end) of virtual offsets, and the first offset per narrowest bin."""
    bins: dict[int, list[list[int]]] = field(default_factory=dict)
    floors: list[int] = field(default_factory=list)


@dataclass
class Index:
    contigs: dict[str, Contig] = field(default_factory=dict)
    shift: int = SHIFT
    depth: int = DEPTH

    def add(self, chrom: str, start: int, end: int, begin: int, stop: int) -> None:
        """A record that stands at begin .. stop; records come in the order of the file."""
        own = self.contigs.setdefault(chrom, Contig())
        chunks = own.bins.setdefault(bin_of(start, end, self.shift, self.depth), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        last = (end - 1) >> self.shift
        while len(own.floors) <= last:
            own.floors.append(begin)

    def packed(self) -> bytes:
        """As the bytes of a .tbi file before compression."""
        names = b"".join(n.encode() + b"\0" for n in self.contigs)
        out = [b"TBI\1", struct.pack("<8i", len(self.contigs), *VCF_LAYOUT, len(names)), names]
        for own in self.contigs.values():
            out.append(struct.pack("<i", len(own.bins)))
            for number, chunks in sorted(own.bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack(f"<i{len(own.floors)}Q", len(own.floors), *own.floors))
        return b"".join(out)


def compressed(data: bytes) -> bytes:
    return b"".join(block(data[k:k + BLOCK]) for k in range(0, len(data), BLOCK)) + block(b"")


def unpack_index(source) -> Index:
    """The index of a .tbi or .csi file."""
    data = b"".join(text for _, _, text in blocks(source))
    at = 4

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return out

    if data[:4] == b"TBI\1":
        shift, depth = SHIFT, DEPTH
        *_, length = take("8i")
        names, at = data[at:at + length], at + length
    elif data[:4] == b"CSI\1":
        shift, depth, aux = take("3i")
        names, at = data[at + 28:at + aux], at + aux
        take("i")
    else:
        raise ValueError("neither a .tbi nor a .csi index")
    index = Index({}, shift, depth)
    for name in names.rstrip(b"\0").split(b"\0") if names else []:
        own = index.contigs[name.decode()] = Contig()
        for _ in range(take("i")[0]):
            if data[:3] == b"TBI":
                number, n = take("Ii")
            else:
                number, _, n = take("IQi")
            chunks = [list(take("QQ")) for _ in range(n)]
            if number < level_start(depth + 1):       # a number beyond holds counts
                own.bins[number] = chunks
        if data[:3] == b"TBI":
            own.floors = list(take(f"{take('i')[0]}Q"))
    return index


def index_records(source) -> Index:
    """The index of a block-compressed variant file, whose records are in order."""
    index, before = Index(), None
    for offsets, lines in lines_between(source):
        for where, line in zip(offsets, lines):
            if before is not None:
                index.add(*before, where)
            before = None
            if line.strip() and not line.startswith(b"#"):
                chrom, start, end = record_span(line)
                before = chrom.decode(), start, end, where
    if before is not None:
        index.add(*before, source.size() << 16)
    return index


class Writer:
    """Writes lines as block-compressed text and keeps the index of its records."""

    def __init__(self, out):
        self.out, self.index, self.at, self.text = out, Index(), 0, bytearray()

    def _flush(self) -> None:
        data = block(bytes(self.text))
        self.out.write(data)
        self.at += len(data)
        self.text.clear()

    def line(self, line: bytes, span: tuple[str, int, int] | None = None) -> None:
        line += b"\n"
        if self.text and len(self.text) + len(line) > BLOCK:
            self._flush()
        begin = self.at << 16 | len(self.text)
        while len(self.text) + len(line) > BLOCK:       # a line longer than a block
            room = BLOCK - len(self.text)
            self.text += line[:room]
            line = line[room:]
            self._flush()
        self.text += line
        if len(self.text) == BLOCK:
            self._flush()
        if span:
            self.index.add(*span, begin, self.at << 16 | len(self.text))

    def close(self) -> None:
        if self.text:
            self._flush()
        self.out.write(block(b""))
