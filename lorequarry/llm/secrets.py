"""Secret scans with structural confirmation.

Three base patterns are always reported. Further candidates, runs of base64 or hex digits, PEM blocks and dotted tokens,
are reported only if what they decode to has the structure of a key or token: nested DER lengths that add up, a private
key container's magic and fields, or the JSON header of a signed token.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32

#: Kinds in the order that breaks ties of ``start``: the base ones, then those that need confirmation.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
_PLACE = {k: i for i, k in enumerate(KINDS)}

_PEM_BEGIN, _PEM_END = "-----BEGIN ", "-----END "
_PEM_LABEL = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----", re.ASCII)
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\+[nrt/])*+", re.ASCII)
_PEM_HEADER = re.compile(r"^[ \t]*([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.ASCII | re.MULTILINE)
#: Block lengths of the ciphers of encrypted blocks, by how their names begin.
CIPHER_BLOCKS = {"AES": 16, "CAMELLIA": 16, "SEED": 16, "ARIA": 16, "DES": 8, "RC2": 8, "IDEA": 8, "BF": 8, "CAST": 8}
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])", re.ASCII)
#: Fewest characters of an encoded key: an EC key of 256 bits without its public part takes more.
B64_MIN, HEX_KEY_MIN = 40, 48
#: Where a key can start in base64 (tag 0x30 and a length, or the container's magic) and in hex (and the next tag), at any place in a run.
_B64_START = re.compile(r"M(?=[A-I])|b3BlbnNzaC(?=1rZXktdjE)", re.ASCII)
_HEX_START = re.compile(r"30(?=(?:[0-7][0-9a-f]|81..|82.{4}|83.{6})(?:0201|30))|6f70656e737368(?=2d6b65792d7631)", re.ASCII | re.IGNORECASE)
_B64_PIECE, _HEX_PIECE = re.compile(r"[A-Za-z0-9+/_-]+", re.ASCII), re.compile(r"[0-9a-fA-F]+")
#: Between the lines of a wrapped key: a line break, as it is or escaped, with quotes and indentation.
_BREAK = re.compile(r"""[ \t"',]*+(?:\\++[nr]|[\r\n])(?:\\++[nrt]|[\s"']++)*+""", re.ASCII)
_ESCAPED_SLASH = re.compile(r"\\+/")
_OPENSSH_MAGIC = b"openssh-key-v1\0"
#: Algorithms of signed and encrypted tokens.
_ALGS = ("HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES256K", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of whole matches that pass; failing matches use up their text all the same."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    # every maximal run is a match, so the length can be part of the pattern
    found += [("hex", *m.span()) for m in _HEX_LONG.finditer(text)]
    return found


_HEX_LONG = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)


def _decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: ``read(at, n)``: up to ``n`` bytes from ``at``.
Reader = Callable[[int, int], bytes]


def _header(read: Reader, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value whose header is at ``at``."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    n, k = head[1], 0
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or 2 + k > len(head):
            return None
        n = int.from_bytes(head[2 : 2 + k], "big")
    return head[0], at + 2 + k, at + 2 + k + n


def _items(read: Reader, at: int, end: int, most: int) -> list[tuple[int, int, int]]:
    """The values that fill the bytes up to ``end`` exactly; none if they don't, or if there are more than ``most``."""
    items = []
    while at < end:
        item = _header(read, at)
        if item is None or item[2] > end or len(items) == most:
            return []
        items.append(item)
        at = item[2]
    return items


def _der_end(read: Reader, size: int) -> int:
    """The end of a private key at the start of ``size`` bytes: a DER sequence whose nested lengths fit, laid out as PKCS#1,
    SEC1, PKCS#8 or encrypted PKCS#8. 0 if there is none. Only headers are read, and no layout has more than ten values."""
    top = _header(read, 0)
    if top is None or top[0] != 0x30 or top[2] > size:
        return 0
    inner = _items(read, top[1], top[2], 10)
    if len(inner) < 2:
        return 0
    tags, sizes = [t for t, _, _ in inner], [b - a for _, a, b in inner]

    def algorithm(i: int) -> bool:
        parts = _items(read, inner[i][1], inner[i][2], 4)
        return bool(parts) and parts[0][0] == 0x06

    good = False
    if tags[0] == 0x02 and sizes[0] == 1:
        if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):  # version, n, e, d, p, q, dp, dq, qinv
            good = sizes[1] >= 32
        elif tags[1] == 0x04 and sizes[1] >= 16 and read(inner[0][1], 1) == b"\x01":  # SEC1
            good = all(t in (0xA0, 0xA1) for t in tags[2:])
        elif tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8
            good = algorithm(1)
    elif tags == [0x30, 0x04]:  # encrypted PKCS#8
        good = algorithm(0) and sizes[1] >= 16
    return top[2] if good else 0


def _of(data: bytes) -> Reader:
    return lambda at, n: data[at : at + n]


def der_key(data: bytes) -> bool:
    return len(data) > 0 and _der_end(_of(data), len(data)) == len(data)


def _openssh_end(read: Reader, size: int, follow: dict[int, int] | None = None, base: int = 0) -> int:
    """The end of the container at the start of the bytes: its magic, three strings, a key count and that many public keys
    and one private part, with lengths that fit. 0 if there is none.

    ``follow`` keeps, by place from ``base`` on, how many strings follow one another there, so that many starts in one run
    don't walk the same way twice.
    """
    if read(0, len(_OPENSSH_MAGIC)) != _OPENSSH_MAGIC:
        return 0

    def after(at: int) -> int:
        head = read(at, 4)
        end = at + 4 + int.from_bytes(head, "big") if len(head) == 4 else size + 1
        return end if end <= size else 0

    at = len(_OPENSSH_MAGIC)
    for _ in range(3):
        at = after(at)
        if not at:
            return 0
    head = read(at, 4)
    keys = int.from_bytes(head, "big")
    if len(head) < 4 or not keys:
        return 0
    follow, walked, here = {} if follow is None else follow, [], at + 4
    while here and base + here not in follow:
        walked.append(here)
        here = after(here)
    n = follow[base + here] if here else 0
    for k, place in enumerate(reversed(walked), 0 if not here else 1):
        follow[base + place] = n + k
    at += 4
    if follow[base + at] < keys + 1:
        return 0
    for _ in range(keys + 1):
        at = after(at)
    return at


def openssh_key(data: bytes) -> bool:
    """A private key container from the start of ``data``."""
    return _openssh_end(_of(data), len(data)) > 0


def token_header(part: str) -> bool:
    """base64url of a JSON object that names an algorithm."""
    raw = _decode64(part)
    if raw is None:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and (head["alg"] in _ALGS or "enc" in head)


def _blob_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if der_key(data) else "openssh" if openssh_key(data) else None


class _Run:
    """The digits from a place on, over line breaks, joined, with where each piece of them stands in the text."""

    def __init__(self, text: str, at: int, piece: re.Pattern[str]):
        self.b64, self.places, self.froms, self.breaks = piece is _B64_PIECE, [], [], []
        parts, n = [], 0
        while True:
            if m := piece.match(text, at):
                part = m[0]
            elif self.b64 and n and (m := _ESCAPED_SLASH.match(text, at)):
                part = "/"
            elif n and (m := _BREAK.match(text, at)) and piece.match(text, m.end()):
                at = m.end()
                self.breaks.append(n)
                continue
            else:
                break
            self.places.append(n)
            self.froms.append(at)
            parts.append(part)
            n, at = n + len(part), m.end()
        self.digits, self.end = "".join(parts).replace("-", "+").replace("_", "/"), at
        #: by alignment, how many strings follow one another at a byte
        self.follow: list[dict[int, int]] = [{} for _ in range(4)]

    def index(self, place: int) -> int:
        """Of a place in the text, which digit it is."""
        i = bisect_right(self.froms, place) - 1
        return self.places[i] + place - self.froms[i]

    def place(self, digit: int) -> int:
        """Of a digit, where it stands in the text."""
        i = bisect_right(self.places, digit) - 1
        return self.froms[i] + digit - self.places[i]

    def bytes_at(self, first: int) -> tuple[Reader, int]:
        """The bytes of the digits from ``first`` on, read where they are asked for, and their number."""
        def read_hex(at: int, n: int) -> bytes:
            s = self.digits[first + 2 * at : first + 2 * (at + n)]
            return bytes.fromhex(s[: len(s) // 2 * 2])

        def read(at: int, n: int) -> bytes:
            skip = at % 3
            a = first + at // 3 * 4
            s = self.digits[a : a + -(-(skip + n) // 3) * 4]
            odd = len(s) % 4
            return binascii.a2b_base64(s if not odd else s[:-1] if odd == 1 else s + "=" * (4 - odd))[skip : skip + n]

        left = len(self.digits) - first
        return (read, left * 3 // 4) if self.b64 else (read_hex, left // 2)


def _keys(text: str, start: re.Pattern[str], piece: re.Pattern[str], least: int) -> list[tuple[str, int, int, bool]]:
    """Keys in base64 or hex from any place in a run, by the length in their own header; and whether each is in one line.

    Runs are joined once, and of a candidate only the headers of nested values are decoded."""
    b64, found, done, run = piece is _B64_PIECE, [], 0, None
    for m in start.finditer(text):
        at = m.start()
        if at < done:
            continue
        if run is None or at >= run.end:
            run = _Run(text, at, piece)
        first = run.index(at)
        read, size = run.bytes_at(first)
        if len(m[0]) > 2:
            step = 4 if b64 else 2
            kind, n = "openssh", _openssh_end(read, size, run.follow[first % step], first // step * (3 if b64 else 1))
        else:
            head = read(0, 9)
            k = head[1] & 0x7F if len(head) == 9 and head[1] >= 0x80 else 0
            # the first value is a version of one byte or a sequence
            kind, n = "der", _der_end(read, size) if head[2 + k : 4 + k] == b"\x02\x01" or head[2 + k : 3 + k] == b"\x30" else 0
        digits = -(-n * 4 // 3) if b64 else 2 * n
        if not n or digits < least:
            continue
        last = run.place(first + digits - 1)
        end = last + 1
        if run.digits[first + digits - 1] == "/" and text[last] == "\\":  # an escaped slash is longer than itself
            end = _ESCAPED_SLASH.match(text, last).end()
        whole = bisect_right(run.breaks, first) == bisect_right(run.breaks, first + digits - 1)
        while b64 and end < len(text) and text[end] == "=" and text[max(at, end - 2) : end] != "==":
            end += 1
        found.append((kind, at, end, whole))
        done = end
    return found


def pem_key(body: str) -> bool:
    """What stands between the marks of a block: a key, or, below the headers of an encrypted one, an IV of the cipher's
    block length and whole blocks. Line breaks and slashes may be escaped."""
    body = re.sub(r"\\+/", "/", re.sub(r"\\+t", " ", re.sub(r"\\+[nr]", "\n", body)))
    headers = {m[1].lower(): m[2] for m in _PEM_HEADER.finditer(body)}
    data = _decode64("".join(_PEM_HEADER.sub("", body).split()))
    if headers.get("proc-type", "").replace(" ", "").upper() == "4,ENCRYPTED":
        cipher, _, iv = headers.get("dek-info", "").partition(",")
        block = next((n for name, n in CIPHER_BLOCKS.items() if cipher.upper().startswith(name)), 0)
        return bool(block and data) and re.fullmatch(r"\s*[0-9A-Fa-f]{%d}\s*" % (2 * block), iv) is not None and len(data) % block == 0
    return _blob_kind(data) is not None


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """Blocks from a BEGIN line to the END line of its label with no other BEGIN between; each part of the text is looked
    at once."""
    at = text.find(_PEM_BEGIN)
    while at >= 0:
        after = text.find(_PEM_BEGIN, at + len(_PEM_BEGIN))
        if (m := _PEM_LABEL.match(text, at)) and m[1].endswith("PRIVATE KEY"):
            stop = len(text) if after < 0 else after
            end = text.find(f"{_PEM_END}{m[1]}-----", m.end(), stop)
            if end >= 0 and _PEM_BODY.match(text, m.end(), end).end() == end and pem_key(text[m.end() : end]):
                yield at, end + len(_PEM_END) + len(m[1]) + 5
        at = after


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("pem", a, b) for a, b in pem_spans(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if token_header(m[1])]
    pems = [(a, b) for k, a, b in found if k == "pem"]
    for kind, a, b, whole in _keys(text, _B64_START, _B64_PIECE, B64_MIN) + _keys(text, _HEX_START, _HEX_PIECE, HEX_KEY_MIN):
        # the lines of a block are the block's
        if whole or not any(x <= a and b <= y for x, y in pems):
            found.append((kind, a, b))
    return found


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], _PLACE[x[0]], x[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            rows = []
            for text in part.column(1).to_pylist():
                base, more = base_spans(text or ""), confirmed_spans(text or "")
                kinds = [k for k, _, _ in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), _line(base), _line(base + more)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_spans", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_assign, n_access, n_hex, n_confirmed, base_spans, spans``, a row per input row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by ``KINDS``, joined by commas. A
    confirmed span may cover a base one; both are listed. A null text is an empty one and has no spans; repeated rows
    are scanned each; other columns are not looked at; an empty table gives an empty result. One text at a time is in
    memory besides its batch.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans", "n_confirmed")
