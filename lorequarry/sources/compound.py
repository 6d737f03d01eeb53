"""Compound files: Word documents of the binary format and saved messages, read from chains of sectors."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Callable

Parsed = list[tuple[str, str, int, list[str]]]

# Fixed values of the container.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST_SECTOR = 0xFFFFFFFA  # larger numbers end a chain


class Compound:
    """The streams of a compound file by path, read when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        shift, small = struct.unpack_from("<HH", data, 30)
        n_fat, directory = struct.unpack_from("<II", data, 44)
        self.cutoff, first_small, _, more, n_more = struct.unpack_from("<5I", data, 56)
        if shift not in (9, 12) or small != 6:
            raise ValueError("odd sectors")
        self.size, self.small_size = 1 << shift, 1 << small
        tables = list(struct.unpack_from("<109I", data, 76))
        while more < _LAST_SECTOR and n_more:
            block = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables += block[:-1]
            more, n_more = block[-1], n_more - 1
        self.next = [x for t in tables[:n_fat] if t < _LAST_SECTOR for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        entries = self._chain(directory)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        root = self.entries[0]
        smalls = self._chain(first_small) if first_small < _LAST_SECTOR else b""
        self.next_small = struct.unpack(f"<{len(smalls) // 4}I", smalls)
        self.small = self._chain(struct.unpack_from("<I", root, 116)[0])
        self.at: dict[str, bytes] = {}
        self._walk(struct.unpack_from("<I", root, 76)[0])

    def _sector(self, n: int) -> bytes:
        block = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if not block:
            raise ValueError("a sector lies outside the file")
        return block.ljust(self.size, b"\0")

    def _chain(self, n: int) -> bytes:
        out: list[bytes] = []
        while n < _LAST_SECTOR:
            out.append(self._sector(n))
            if len(out) > len(self.next):
                raise ValueError("a chain of sectors is a circle")
            n = self.next[n]
        return b"".join(out)

    def _walk(self, first: int) -> None:
        """Entries are trees of siblings; storages have a tree of their own."""
        stack, seen = [(first, "")], set()
        while stack:
            n, path = stack.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            length, kind, left, right, child = struct.unpack_from("<HBx3I", e, 64)
            name = path + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            stack += [(left, path), (right, path)]
            if kind == 1:
                stack.append((child, name + "/"))
            elif kind == 2:
                self.at[name] = e

    def read(self, name: str) -> bytes:
        start, size = struct.unpack_from("<II", self.at[name], 116)
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, n = [], start
        while n < _LAST_SECTOR and len(out) * self.small_size < size:
            out.append(self.small[n * self.small_size : (n + 1) * self.small_size])
            n = self.next_small[n]
        return b"".join(out)[:size]


# Places in the header of a Word document, and the characters that its text has for other things than text.
_FLAGS, _MAIN_CHARACTERS, _PARAGRAPH_PAGES, _PIECES = 0x0A, 0x4C, 0x0102, 0x01A2
_ENCRYPTED, _OTHER_TABLE, _ONE_BYTE = 0x0100, 0x0200, 1 << 30
_FIELD = re.compile("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15")


def word_pieces(main: bytes, table: bytes) -> list[tuple[int, str, int, int]]:
    """(first character, text, place of its first byte, bytes a character) of each piece of the text, in order."""
    at, size = struct.unpack_from("<II", main, _PIECES)
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:  # changes of formatting
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ValueError("the document has no piece table")
    n = (struct.unpack_from("<I", clx, i + 1)[0] - 4) // 12
    cps = struct.unpack_from(f"<{n + 1}I", clx, i + 5)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", clx, i + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        chars = cps[k + 1] - cps[k]
        if fc & _ONE_BYTE:
            place = (fc & ~_ONE_BYTE) // 2
            out.append((cps[k], main[place : place + chars].decode("cp1252", "replace"), place, 1))
        else:
            # a surrogate pair is two characters of the format
            out.append((cps[k], main[fc : fc + 2 * chars].decode("utf-16-le", "replace"), fc, 2))
    return out


def word_styles(main: bytes, table: bytes) -> list[tuple[int, int, int]]:
    """(first byte, end, style) of the paragraphs' runs of bytes, from the pages that hold paragraphs' formatting."""
    at, size = struct.unpack_from("<II", main, _PARAGRAPH_PAGES)
    n, out = max(0, (size - 4) // 8), []
    for page in struct.unpack_from(f"<{n}I", table, at + 4 * (n + 1)) if n else ():
        block = main[page * 512 : (page + 1) * 512]
        if len(block) < 512:
            continue
        count = block[511]
        bounds = struct.unpack_from(f"<{count + 1}I", block, 0)
        for k in range(count):
            where = 2 * block[4 * (count + 1) + 13 * k]
            style = 0
            if where:
                where += 1 if block[where] else 2
                style = struct.unpack_from("<H", block, where)[0] if where < 510 else 0
            out.append((bounds[k], bounds[k + 1], style))
    return out


def parse_doc(content: bytes) -> Parsed:
    """Paragraphs of the main text; those in the built-in heading styles are headings. Cells of tables are paragraphs."""
    c = Compound(content)
    if "WordDocument" not in c.at:
        raise ValueError("no Word document")
    main = c.read("WordDocument")
    flags = struct.unpack_from("<H", main, _FLAGS)[0]
    if flags & _ENCRYPTED:
        raise ValueError("the file is encrypted")
    table = c.read("1Table" if flags & _OTHER_TABLE else "0Table")
    total = struct.unpack_from("<I", main, _MAIN_CHARACTERS)[0]
    styles = sorted(word_styles(main, table))
    starts = [a for a, _, _ in styles]
    out: Parsed = []
    held: list[str] = []
    seen = 0
    for _, text, place, width in word_pieces(main, table):
        byte = place
        for part in re.split("(?<=[\r\x07\x0c])", text):
            units = len(part.encode("utf-16-le")) // 2 if width == 2 else len(part)
            if not part or seen >= total:
                break
            if seen + units > total:
                part = part.encode("utf-16-le")[: 2 * (total - seen)].decode("utf-16-le", "ignore")
            held.append(part)
            seen += units
            byte += units * width
            if part[-1] in "\r\x07\x0c":
                _paragraph(out, "".join(held), _style(styles, starts, byte - width))
                held = []
    _paragraph(out, "".join(held), 0)
    return out


def _style(styles: list[tuple[int, int, int]], starts: list[int], byte: int) -> int:
    i = bisect_right(starts, byte) - 1
    return styles[i][2] if i >= 0 and byte < styles[i][1] else 0


def _paragraph(out: Parsed, text: str, style: int) -> None:
    while (shown := _FIELD.sub(lambda m: m[1] or "", text)) != text:  # what a field shows, not what it says; fields nest
        text = shown
    text = " ".join(re.sub("[\x00-\x08\x0b-\x1f]", " ", text).split())
    if text:
        out.append((text, "heading" if 1 <= style <= 9 else "paragraph", style if 1 <= style <= 9 else 0, []))


# What compressed rich text refers back to at its beginning.
_RTF_START = (
    rb"{\rtf1\ansi\mac\deff0\deftab720{\fonttbl;}{\f0\fnil \froman \fswiss \fmodern \fscript \fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\colortbl\red0\green0\blue0"
    b"\r\n" rb"\par \pard\plain\f0\fs20\b\i\u\tab\tx"
)


def rich_text(data: bytes) -> bytes:
    """Compressed rich text of a message, opened."""
    packed, raw, kind = struct.unpack_from("<II4s", data, 0)
    if kind == b"MELA":
        return data[16 : 16 + raw]
    if kind != b"LZFu":
        raise ValueError("odd rich text")
    window, out, at, end = bytearray(_RTF_START.ljust(4096, b" ")), bytearray(), 16, min(len(data), packed + 4)
    write = len(_RTF_START)
    while at < end and len(out) < raw:
        flags = data[at]
        at += 1
        for bit in range(8):
            if at >= end:
                break
            if not flags >> bit & 1:
                run = data[at : at + 1]
                at += 1
            else:
                ref = int.from_bytes(data[at : at + 2], "big")
                at += 2
                offset, length = ref >> 4, (ref & 15) + 2
                if offset == write % 4096:
                    return bytes(out[:raw])
                run = bytearray()
                for k in range(length):
                    byte = window[(offset + k) % 4096]
                    window[(write + k) % 4096] = byte
                    run.append(byte)
            for k, byte in enumerate(run):
                window[(write + k) % 4096] = byte
            write += len(run)
            out += run
    return bytes(out[:raw])


# Properties of a message, and types of their values.
_SUBJECT, _BODY, _HTML, _RTF = "0037", "1000", "1013", "1009"
_UNICODE, _ANSI, _BINARY = "001F", "001E", "0102"


def parse_msg(content: bytes, parse_html: Callable[[bytes], Parsed], parse_rtf: Callable[[bytes], Parsed]) -> Parsed:
    """The subject as a heading, and the paragraphs of the body: plain, or else as HTML or rich text."""
    c = Compound(content)

    def text(prop: str) -> str:
        for kind, codec in ((_UNICODE, "utf-16-le"), (_ANSI, "cp1252")):
            if (name := f"__substg1.0_{prop}{kind}") in c.at:
                return c.read(name).decode(codec, "replace").rstrip("\0")
        return ""

    if "__properties_version1.0" not in c.at:
        raise ValueError("no message")
    subject, body = " ".join(text(_SUBJECT).split()), text(_BODY)
    out: Parsed = [(subject, "heading", 1, [])] if subject else []
    if body.strip():
        return out + [(t, "paragraph", 0, []) for p in re.split(r"\r?\n[ \t]*\r?\n", body) if (t := " ".join(p.split()))]
    if (name := f"__substg1.0_{_HTML}{_BINARY}") in c.at:
        return out + parse_html(c.read(name))
    if (name := f"__substg1.0_{_RTF}{_BINARY}") in c.at:
        return out + parse_rtf(rich_text(c.read(name)))
    return out
