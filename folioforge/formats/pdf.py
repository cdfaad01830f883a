"""PDF: objects, filters, encryption, fonts and the text of pages, in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

from folioforge.formats.layout import render_pages

WHITE, DELIMITERS = b" \t\r\n\f\0", b"()<>[]{}/%"
MOST_BYTES, DEEPEST = 512 << 20, 64


class Name(str):
    """A name object."""


class Ref(tuple):
    """A reference: (number, generation)."""


class Stream:
    def __init__(self, meta: dict, raw: bytes):
        self.meta, self.raw = meta, raw


class Keyword(bytes):
    """An operator or other bare word."""


class PdfError(ValueError):
    pass


class Lexer:
    """Reads objects from bytes."""

    TOKEN = re.compile(rb"[^ \t\r\n\f\0()<>\[\]{}/%]+")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in WHITE:
                self.at += 1
            elif c == 0x25:
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self, depth: int = 0):
        """The next object, or None at the end."""
        if depth > DEEPEST:
            raise PdfError("objects are nested too deeply")
        self.skip()
        data = self.data
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if c == b"/":
            found = self.TOKEN.match(data, self.at + 1)
            self.at = found.end() if found else self.at + 1
            raw = found.group(0) if found else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self.string()
        if data[self.at : self.at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                key = self.next(depth + 1)
                if key is None or key == b">>":
                    return out
                value = self.next(depth + 1)
                if value == b">>":
                    return out
                value = self.reference(value)
                if isinstance(key, Name):
                    out[str(key)] = value
        if c == b"<":
            end = data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end if end >= 0 else len(data)])
            self.at = end + 1 if end >= 0 else len(data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                value = self.next(depth + 1)
                if value is None or value == b"]":
                    return out
                if value == b"R" and isinstance(value, Keyword) and len(out) >= 2 and isinstance(out[-1], int) and isinstance(out[-2], int):
                    out[-2:] = [Ref((out[-2], out[-1]))]
                else:
                    out.append(value)
        if data[self.at : self.at + 2] == b">>":
            self.at += 2
            return Keyword(b">>")
        if c in (b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return Keyword(c)
        found = self.TOKEN.match(data, self.at)
        self.at = found.end()
        word = found.group(0)
        try:
            return int(word)
        except ValueError:
            pass
        if re.fullmatch(rb"[+-]*\d*\.?\d*", word) and re.search(rb"\d", word):
            return float(re.sub(rb"^[+-]*-", b"-", word))
        return {b"true": True, b"false": False}.get(word, Keyword(word))

    def reference(self, value):
        """``value``, or the reference that it begins."""
        if isinstance(value, int) and not isinstance(value, bool):
            found = re.compile(rb"[ \t\r\n\f\0]+(\d+)[ \t\r\n\f\0]+R(?![^ \t\r\n\f\0()<>\[\]{}/%])").match(self.data, self.at)
            if found:
                self.at = found.end()
                return Ref((value, int(found.group(1))))
        return None if value == b"null" and isinstance(value, Keyword) else value

    def string(self) -> bytes:
        data, out, depth = self.data, bytearray(), 1
        self.at += 1
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            elif c == 0x5C and self.at < len(data):
                e = data[self.at : self.at + 1]
                self.at += 1
                if e in b"01234567":
                    digits = e
                    while len(digits) < 3 and data[self.at : self.at + 1] in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7"):
                        digits += data[self.at : self.at + 1]
                        self.at += 1
                    out.append(int(digits, 8) & 255)
                elif e in b"\r\n":
                    if e == b"\r" and data[self.at : self.at + 1] == b"\n":
                        self.at += 1
                else:
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
                continue
            out.append(c)
        return bytes(out)


# ---------------------------------------------------------------- filters


def _predicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        out = bytearray(data)
        if bits == 8:
            for row in range(0, len(out), width):
                for i in range(row + step, min(row + width, len(out))):
                    out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    out, last = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            a, b = (row[i - step] if i >= step else 0), last[i]
            c = last[i - step] if i >= step else 0
            if how == 1:
                row[i] = (row[i] + a) & 255
            elif how == 2:
                row[i] = (row[i] + b) & 255
            elif how == 3:
                row[i] = (row[i] + (a + b) // 2) & 255
            elif how == 4:
                p = a + b - c
                row[i] = (row[i] + min((a, b, c), key=lambda v: (abs(p - v)))) & 255
        out += row
        last = bytes(row) + bytes(width - len(row))
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    out, engine = b"", zlib.decompressobj()
    try:
        out = engine.decompress(data, MOST_BYTES)
    except zlib.error:
        # Damaged data: what comes out piece by piece counts.
        engine, parts = zlib.decompressobj(), []
        try:
            for i in range(0, len(data), 64):
                parts.append(engine.decompress(data[i : i + 64]))
        except zlib.error:
            pass
        out = b"".join(parts)
    if engine.unconsumed_tail:
        raise PdfError("a stream is too large")
    return out


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~>")[0]:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        value = sum(v * 85 ** (4 - i) for i, v in enumerate(group + [84] * (5 - n)))
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _lzw(data: bytes, early: int = 1) -> bytes:
    table, out, width, buffer, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], [], 9, 0, 0, b""
    for byte in data:
        buffer, bits = (buffer << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = (buffer >> bits) & ((1 << width) - 1)
            buffer &= (1 << bits) - 1
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code == 257:
                return b"".join(out)
            word = table[code] if code < len(table) else last + last[:1]
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
            size = len(table) + early
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return b"".join(out)


def _run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


# ---------------------------------------------------------------- encryption


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _sboxes() -> tuple[bytes, bytes]:
    """The AES substitution and its inverse, from their definition."""
    p = q = 1
    box = [0] * 256
    while True:
        p ^= (p << 1) & 255 ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 0x80:
            q ^= 0x09
        box[p] = q ^ _turn(q, 1) ^ _turn(q, 2) ^ _turn(q, 3) ^ _turn(q, 4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (8 - n)) & 255


BOX, BACK = _sboxes()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


MULTIPLES = {k: bytes(_times(i, k) for i in range(256)) for k in (9, 11, 13, 14)}


def aes_keys(key: bytes) -> list[bytes]:
    n, words = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)]
    factor = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes([BOX[w[1]] ^ factor, BOX[w[2]], BOX[w[3]], BOX[w[0]]])
            factor = _times(factor, 2)
        elif n > 6 and i % n == 4:
            w = bytes(BOX[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def aes_cbc(key: bytes, start: bytes, data: bytes) -> bytes:
    """AES in CBC mode, decrypted; the padding stays."""
    rounds, out, last = aes_keys(key), bytearray(), start
    m9, m11, m13, m14 = (MULTIPLES[k] for k in (9, 11, 13, 14))
    shift = [(i - 4 * (i % 4)) % 16 for i in range(16)]
    for at in range(0, len(data) - 15, 16):
        block = data[at : at + 16]
        s = [a ^ b for a, b in zip(block, rounds[-1])]
        for r in range(len(rounds) - 2, -1, -1):
            s = [BACK[s[i]] ^ k for i, k in zip(shift, rounds[r])]
            if r:
                t = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    t += [m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]]
                s = t
        out += bytes(a ^ b for a, b in zip(s, last))
        last = block
    return bytes(out)


PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Crypt:
    """The standard security handler with RC4 or AES, for the user password (empty by default)."""

    def __init__(self, meta: dict, ident: bytes, password: bytes):
        self.v, r = meta.get("V", 0), meta.get("R", 2)
        filters = meta.get("CF") or {}
        method = (filters.get(str(meta.get("StmF", "Identity"))) or {}).get("CFM")
        self.aes = method in ("AESV2", "AESV3")
        self.plain = self.v >= 4 and str(meta.get("StmF", "Identity")) == "Identity"
        o, u = meta.get("O", b""), meta.get("U", b"")
        if r >= 5:
            check = self.hashed(password, u[32:40], b"", r)
            if check != u[:32]:
                raise PdfError("the document needs a password")
            self.key = aes_cbc(self.hashed(password, u[40:48], b"", r), bytes(16), meta.get("UE", b"")[:32])
            return
        size = meta.get("Length", 40) // 8 if r >= 3 else 5
        if self.v >= 4:
            size = 16
        seed = (password + PAD)[:32] + o[:32] + (meta.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + ident
        if r >= 4 and meta.get("EncryptMetadata") is False:
            seed += b"\xff\xff\xff\xff"
        key = hashlib.md5(seed).digest()
        if r >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if r == 2:
            good = rc4(self.key, PAD) == u[:32]
        else:
            value = rc4(self.key, hashlib.md5(PAD + ident).digest())
            for i in range(1, 20):
                value = rc4(bytes(k ^ i for k in self.key), value)
            good = value == u[:16]
        if not good:
            raise PdfError("the document needs a password")

    @staticmethod
    def hashed(password: bytes, salt: bytes, more: bytes, revision: int) -> bytes:
        key = hashlib.sha256(password + salt + more).digest()
        if revision < 6:
            return key
        i, last = 0, 0
        while i < 64 or last > i - 32:
            block = aes_encrypt(key[:16], key[16:32], (password + key + more) * 64)
            key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
            last, i = block[-1], i + 1
        return key[:32]

    def open(self, data: bytes, number: int, generation: int) -> bytes:
        if self.plain:
            return data
        key = self.key
        if self.v < 5:
            key = hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if self.aes else b"")).digest()[: min(16, len(key) + 5)]
        if not self.aes:
            return rc4(key, data)
        out = aes_cbc(key, data[:16], data[16:])
        return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


def aes_encrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """AES in CBC mode over whole blocks."""
    rounds, out, last = aes_keys(key), bytearray(), start
    shift = [(i + 4 * (i % 4)) % 16 for i in range(16)]
    two = bytes(_times(i, 2) for i in range(256))
    for at in range(0, len(data) - 15, 16):
        s = [a ^ b ^ k for a, b, k in zip(data[at : at + 16], last, rounds[0])]
        for r in range(1, len(rounds)):
            s = [BOX[s[i]] for i in shift]
            if r < len(rounds) - 1:
                t = []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    x = a ^ b ^ d ^ e
                    t += [a ^ x ^ two[a ^ b], b ^ x ^ two[b ^ d], d ^ x ^ two[d ^ e], e ^ x ^ two[e ^ a]]
                s = t
            s = [a ^ k for a, k in zip(s, rounds[r])]
        last = bytes(s)
        out += last
    return bytes(out)


# ---------------------------------------------------------------- documents


class Document:
    """Objects of a file by number, through its cross references or, failing these, a scan."""

    def __init__(self, data: bytes, password: bytes = b""):
        start = data.find(b"%PDF-", 0, 1024)
        self.data = data[start:] if start > 0 else data
        self.places: dict[int, tuple] = {}
        self.cache: dict[int, object] = {}
        self.busy: set[int] = set()
        self.trailer: dict = {}
        self.crypt: Crypt | None = None
        try:
            self.read_references()
            if not isinstance(self.get(self.trailer.get("Root")), dict) or not self.pages():
                raise PdfError("no pages")
        except Exception:  # noqa: BLE001 whatever is wrong with the references, a scan finds the objects
            self.places, self.cache, self.crypt = {}, {}, None
            self.scan()
        if self.crypt is None:
            self.unlock(password)

    def unlock(self, password: bytes) -> None:
        meta = self.get(self.trailer.get("Encrypt"))
        if isinstance(meta, dict):
            meta = {k: self.get(v) for k, v in meta.items()}
            if isinstance(meta.get("CF"), dict):
                meta["CF"] = {k: self.get(v) for k, v in meta["CF"].items()}
            ident = self.get(self.trailer.get("ID")) or [b""]
            self.cache = {}
            self.crypt = Crypt(meta, ident[0] if isinstance(ident[0], bytes) else b"", password)
            self.locked = self.trailer.get("Encrypt")

    def read_references(self) -> None:
        found = re.findall(rb"startxref\s+(\d+)", self.data[-2048:])
        at, seen = int(found[-1]) if found else -1, set()
        while isinstance(at, int) and 0 <= at < len(self.data) and at not in seen:
            seen.add(at)
            lexer = Lexer(self.data, at)
            first = lexer.next()
            if first == b"xref":
                meta = self.table(lexer)
                if isinstance(meta.get("XRefStm"), int):
                    self.reference_stream(meta["XRefStm"])
            else:
                meta = self.reference_stream(at)
            for k, v in meta.items():
                self.trailer.setdefault(k, v)
            at = meta.get("Prev")
        if "Root" not in self.trailer:
            raise PdfError("no trailer")
        self.unlock(b"")

    def table(self, lexer: Lexer) -> dict:
        while True:
            first = lexer.next()
            if first == b"trailer" or first is None:
                meta = lexer.next()
                return meta if isinstance(meta, dict) else {}
            count = lexer.next()
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("bad reference table")
            for number in range(first, first + count):
                offset, generation, kind = lexer.next(), lexer.next(), lexer.next()
                if kind == b"n" and isinstance(offset, int):
                    self.places.setdefault(number, ("at", offset, generation))

    def reference_stream(self, at: int) -> dict:
        number, value = self.object_at(at)
        if not isinstance(value, Stream):
            raise PdfError("bad reference stream")
        data, widths = self.decoded(value), [w if isinstance(w, int) else 0 for w in value.meta.get("W", [])]
        index, size = value.meta.get("Index") or [0, value.meta.get("Size", 0)], sum(widths)
        if len(widths) != 3 or not size:
            raise PdfError("bad reference stream")
        row = 0
        for first, count in zip(index[::2], index[1::2]):
            for n in range(first, first + count):
                entry = data[row : row + size]
                if len(entry) < size:
                    break
                row += size
                a, b, c = (int.from_bytes(entry[sum(widths[:i]) : sum(widths[: i + 1])], "big") for i in range(3))
                kind = a if widths[0] else 1
                if kind == 1:
                    self.places.setdefault(n, ("at", b, c))
                elif kind == 2:
                    self.places.setdefault(n, ("in", b, c))
        return value.meta

    def scan(self) -> None:
        for m in re.finditer(rb"(?<!\d)(\d{1,9})[ \t\r\n\f\0]+(\d{1,5})[ \t\r\n\f\0]+obj\b", self.data):
            self.places[int(m.group(1))] = ("at", m.start(), int(m.group(2)))
        for m in re.finditer(rb"trailer\s*<<", self.data):
            try:
                meta = Lexer(self.data, m.end() - 2).next()
            except PdfError:
                continue
            if isinstance(meta, dict):
                self.trailer |= meta
        for number in list(self.places):
            value = self.object(number)
            if isinstance(value, Stream) and value.meta.get("Type") == "ObjStm":
                for k, inner in enumerate(self.packed(value)):
                    self.places.setdefault(inner, ("in", number, k))
            if isinstance(value, Stream) and value.meta.get("Type") == "XRef":
                for k in ("Root", "Encrypt", "ID"):
                    if k in value.meta:
                        self.trailer.setdefault(k, value.meta[k])
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            roots = [n for n in self.places if isinstance(self.object(n), dict) and self.object(n).get("Type") == "Catalog"]
            if not roots:
                raise PdfError("no pages can be found")
            self.trailer["Root"] = Ref((roots[-1], 0))

    def object_at(self, at: int):
        lexer = Lexer(self.data, at)
        number, generation, word = lexer.next(), lexer.next(), lexer.next()
        if word != b"obj" or not isinstance(number, int):
            raise PdfError(f"no object at {at}")
        value = lexer.reference(lexer.next())
        if isinstance(value, dict):
            lexer.skip()
            if self.data[lexer.at : lexer.at + 6] == b"stream":
                begin = lexer.at + 6
                begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1 if self.data[begin : begin + 1] in (b"\n", b"\r") else 0
                size = self.get(value.get("Length"))
                end = begin + size if isinstance(size, int) and size >= 0 else -1
                if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 20]):
                    end = self.data.find(b"endstream", begin)
                    end = len(self.data) if end < 0 else end
                    end -= self.data[end - 1 : end] == b"\n"
                    end -= self.data[end - 1 : end] == b"\r"
                value = Stream(value, self.data[begin:end])
        return number, value

    def object(self, number: int):
        if number in self.cache:
            return self.cache[number]
        if number in self.busy or number not in self.places:
            return None
        self.busy.add(number)
        try:
            kind, a, b = self.places[number]
            if kind == "at":
                found, value = self.object_at(a)
                if found != number:
                    raise PdfError(f"object {number} is not where it should be")
                if self.crypt is not None and getattr(self, "locked", None) != Ref((number, b)):
                    value = self.opened(value, number, b if isinstance(b, int) else 0)
            else:
                holder = self.object(a)
                value = self.packed(holder).get(number) if isinstance(holder, Stream) else None
        finally:
            self.busy.discard(number)
        self.cache[number] = value
        return value

    def opened(self, value, number: int, generation: int):
        if isinstance(value, bytes) and not isinstance(value, Keyword):
            return self.crypt.open(value, number, generation)
        if isinstance(value, list):
            return [self.opened(v, number, generation) for v in value]
        if isinstance(value, dict):
            return {k: self.opened(v, number, generation) for k, v in value.items()}
        if isinstance(value, Stream) and value.meta.get("Type") != "XRef":
            return Stream(self.opened(value.meta, number, generation), self.crypt.open(value.raw, number, generation))
        return value

    def packed(self, stream: Stream) -> dict[int, object]:
        data, lexer = self.decoded(stream), None
        count, first = self.get(stream.meta.get("N")) or 0, self.get(stream.meta.get("First")) or 0
        lexer = Lexer(data)
        heads = [(lexer.next(), lexer.next()) for _ in range(min(count, 100_000))]
        out = {}
        for number, offset in heads:
            if isinstance(number, int) and isinstance(offset, int):
                inner = Lexer(data, first + offset)
                out[number] = inner.reference(inner.next())
        return out

    def get(self, value):
        """``value`` with references followed."""
        for _ in range(DEEPEST):
            if not isinstance(value, Ref):
                return value
            value = self.object(value[0])
        raise PdfError("references in a circle")

    def decoded(self, stream: Stream) -> bytes:
        data = stream.raw
        names, parms = self.get(stream.meta.get("Filter", stream.meta.get("F"))), self.get(stream.meta.get("DecodeParms", stream.meta.get("DP")))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms]
        if len(names) > 8:
            raise PdfError("too many filters")
        for k, name in enumerate(map(self.get, names)):
            p = self.get(parms[k]) if k < len(parms) else None
            p = {x: self.get(y) for x, y in p.items()} if isinstance(p, dict) else {}
            if name in ("FlateDecode", "Fl"):
                data = _predicted(_inflate(data), p)
            elif name in ("LZWDecode", "LZW"):
                data = _predicted(_lzw(data, p.get("EarlyChange", 1)), p)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            elif name not in ("Crypt", None):
                raise PdfError(f"filter {name} holds an image")
            if len(data) > MOST_BYTES:
                raise PdfError("a stream is too large")
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out, seen = [], set()

        def walk(value, inherited: dict, depth: int) -> None:
            mark = value[0] if isinstance(value, Ref) else id(value)
            if depth > 32 or mark in seen:
                raise PdfError("the page tree runs in a circle")
            seen.add(mark)
            node = self.get(value)
            if not isinstance(node, dict):
                return
            inherited = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                for kid in kids:
                    walk(kid, inherited, depth + 1)
            else:
                out.append(inherited | node)

        root = self.get(self.trailer.get("Root"))
        walk(root.get("Pages") if isinstance(root, dict) else None, {}, 0)
        return out


# ---------------------------------------------------------------- fonts

# Glyph names that differ from their Unicode names.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "quotesinglbase": "‚",
    "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "dagger": "†", "daggerdbl": "‡", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "AE": "Æ", "ae": "æ",
    "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "dotlessi": "ı", "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°",
    "plusminus": "±", "multiply": "×", "divide": "÷", "minus": "−", "mu": "µ", "exclamdown": "¡", "questiondown": "¿", "periodcentered": "·", "nbspace": " ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π",
    "sigma": "σ", "omega": "ω", "lambda": "λ", "theta": "θ", "infinity": "∞", "summation": "∑", "integral": "∫", "partialdiff": "∂", "radical": "√", "lessequal": "≤", "greaterequal": "≥", "notequal": "≠", "approxequal": "≈",
}
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}


def glyph_text(name: str) -> str:
    """The text of a glyph by its name: listed, by code point, or a letter with an accent."""
    import unicodedata

    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)|u([0-9A-Fa-f]{4,6})", name):
        digits = m.group(1) or m.group(2)
        parts = [digits[i : i + 4] for i in range(0, len(digits), 4)] if m.group(1) else [digits]
        return "".join(chr(int(p, 16)) for p in parts if int(p, 16) < 0x110000)
    for accent, mark in ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            return unicodedata.normalize("NFC", name[0] + mark)
    if "_" in name:
        return "".join(map(glyph_text, name.split("_")))
    return ""


def cmap(data: bytes) -> tuple[dict[int, str], int]:
    """Code -> text of a ToUnicode map, and the width of its codes in bytes."""
    out, wide, lexer, stack = {}, 1, Lexer(data), []

    def text(raw: bytes) -> str:
        return raw.decode("utf-16-be", "ignore")

    while (token := lexer.next()) is not None:
        if not isinstance(token, Keyword):
            stack.append(token)
            continue
        if token == b"endcodespacerange":
            wide = max([wide, *(len(x) for x in stack if isinstance(x, bytes))])
        elif token == b"endbfchar":
            for code, to in zip(stack[::2], stack[1::2]):
                if isinstance(code, bytes) and isinstance(to, bytes):
                    out[int.from_bytes(code, "big")] = text(to)
        elif token == b"endbfrange":
            for low, high, to in zip(stack[::3], stack[1::3], stack[2::3]):
                if not isinstance(low, bytes) or not isinstance(high, bytes):
                    continue
                a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k, code in enumerate(range(a, min(b, a + 0xFFFF) + 1)):
                    if isinstance(to, list):
                        if k < len(to) and isinstance(to[k], bytes):
                            out[code] = text(to[k])
                    elif isinstance(to, bytes) and to:
                        out[code] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + k & 0xFFFF).to_bytes(2, "big")) if len(to) >= 2 else chr(to[0] + k)
        if token != b"def":
            stack = []
    return out, wide


def glyph_map(data: bytes) -> dict[int, str]:
    """Glyph number -> text of a TrueType font, from its own character map turned round."""
    import struct

    out: dict[int, str] = {}
    try:
        count = struct.unpack_from(">H", data, 4)[0]
        tables = {data[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">I", data, 20 + 16 * k)[0] for k in range(min(count, 64))}
        base = tables[b"cmap"]
        places = [struct.unpack_from(">HHI", data, base + 4 + 8 * k) for k in range(struct.unpack_from(">H", data, base + 2)[0])]
        for _, _, offset in sorted(places, key=lambda p: (p[0] != 3, p[1] not in (10, 1))):
            at = base + offset
            kind = struct.unpack_from(">H", data, at)[0]
            if kind == 4:
                n = struct.unpack_from(">H", data, at + 6)[0] // 2
                ends, starts, deltas, ranges = (struct.unpack_from(f">{n}H", data, at + 14 + 2 * n * k + (2 if k else 0)) for k in range(4))
                for i in range(n):
                    for code in range(starts[i], min(ends[i], 0xFFFE) + 1):
                        if ranges[i]:
                            place = at + 16 + 6 * n + 2 * i + ranges[i] + 2 * (code - starts[i])
                            glyph = struct.unpack_from(">H", data, place)[0] if place + 2 <= len(data) else 0
                            glyph = (glyph + deltas[i]) & 0xFFFF if glyph else 0
                        else:
                            glyph = (code + deltas[i]) & 0xFFFF
                        if glyph:
                            out.setdefault(glyph, chr(code - 0xF000 if 0xF000 <= code < 0xF100 else code))
            elif kind == 12:
                for k in range(min(struct.unpack_from(">I", data, at + 12)[0], 10_000)):
                    first, last, glyph = struct.unpack_from(">III", data, at + 16 + 12 * k)
                    for code in range(first, min(last, first + 70_000) + 1):
                        out.setdefault(glyph + code - first, chr(code))
            if out:
                break
    except (struct.error, KeyError, ValueError):
        pass
    return out


class Font:
    """Decodes shown bytes to (text, width in thousandths, whether it is a single space byte)."""

    def __init__(self, doc: Document, meta: dict):
        get = doc.get
        self.name = str(get(meta.get("BaseFont")) or "")
        kind = get(meta.get("Subtype"))
        self.two = kind == "Type0"
        self.scale = 0.001
        self.text: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 500.0
        flags = 0
        if self.two:
            below = get((get(meta.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(get(below.get("DW")) or 1000)
            self.cid_widths(doc, get(below.get("W")) or [])
            descriptor = get(below.get("FontDescriptor")) or {}
            program = get(descriptor.get("FontFile2"))
            if isinstance(program, Stream) and not isinstance(get(meta.get("ToUnicode")), Stream):
                # Codes are glyph numbers where nothing maps them.
                self.text |= glyph_map(doc.decoded(program))
        else:
            descriptor = get(meta.get("FontDescriptor")) or {}
            self.simple(doc, meta, descriptor)
            if kind == "Type3":
                matrix = get(meta.get("FontMatrix")) or [0.001]
                self.scale = abs(float(get(matrix[0]) or 0.001))
        flags = get(descriptor.get("Flags")) or 0
        self.bold = "bold" in self.name.lower() or "black" in self.name.lower() or bool(isinstance(flags, int) and flags & 0x40000) or (get(descriptor.get("FontWeight")) or 0) >= 700
        stream = get(meta.get("ToUnicode"))
        self.wide = 2 if self.two else 1
        if isinstance(stream, Stream):
            table, wide = cmap(doc.decoded(stream))
            self.text |= table
            self.wide = 2 if self.two else 1

    def cid_widths(self, doc: Document, w: list) -> None:
        i = 0
        while i < len(w):
            first, more = doc.get(w[i]), doc.get(w[i + 1]) if i + 1 < len(w) else None
            if isinstance(more, list):
                for k, v in enumerate(more):
                    self.widths[first + k] = float(doc.get(v))
                i += 2
            elif i + 2 < len(w):
                for c in range(first, min(int(more), first + 70_000) + 1):
                    self.widths[c] = float(doc.get(w[i + 2]))
                i += 3
            else:
                break

    def simple(self, doc: Document, meta: dict, descriptor: dict) -> None:
        get = doc.get
        encoding = get(meta.get("Encoding"))
        base = get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        for c in range(32, 256):
            try:
                self.text[c] = bytes([c]).decode(codec)
            except UnicodeDecodeError:
                continue
        program = get(descriptor.get("FontFile"))
        if encoding is None and isinstance(program, Stream):
            # The program's own encoding stands in its clear part.
            for m in re.finditer(rb"dup\s+(\d+)\s*/(\S+)\s+put", doc.decoded(program).split(b"eexec")[0]):
                if text := glyph_text(m.group(2).decode("latin-1")):
                    self.text[int(m.group(1))] = text
        if isinstance(encoding, dict):
            code = 0
            for item in get(encoding.get("Differences")) or []:
                item = get(item)
                if isinstance(item, int):
                    code = item
                elif isinstance(item, Name):
                    if text := glyph_text(item):
                        self.text[code] = text
                    code += 1
        first = get(meta.get("FirstChar")) or 0
        for k, v in enumerate(get(meta.get("Widths")) or []):
            v = get(v)
            if isinstance(v, (int, float)):
                self.widths[first + k] = float(v)
        self.default = float(get(descriptor.get("MissingWidth")) or 0) or (500.0 if not self.widths else 0.0) or 500.0

    def show(self, raw: bytes):
        step = self.wide
        for i in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[i : i + step], "big")
            yield self.text.get(code, ""), self.widths.get(code, self.default) * self.scale, step == 1 and code == 32


# ---------------------------------------------------------------- pages


def times(a: tuple, b: tuple) -> tuple:
    """The matrix product a x b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Interpreter:
    """Runs the content of a page and gathers text items, ruling lines and pictures."""

    def __init__(self, doc: Document, hidden: set):
        self.doc, self.hidden = doc, hidden
        self.items: list[dict] = []
        self.rules: list[tuple[float, float, float, float]] = []
        self.images: list[tuple[float, float, float, float]] = []
        self.fonts: dict[int, Font] = {}
        self.blind = self.shown = 0

    def run(self, data: bytes, resources: dict, matrix: tuple, depth: int = 0) -> None:
        if depth > 12:
            return
        doc, get, lexer = self.doc, self.doc.get, Lexer(data)
        state = {"m": matrix, "font": None, "size": 0.0, "lead": 0.0, "char": 0.0, "word": 0.0, "stretch": 1.0, "rise": 0.0}
        stack, args, marks = [], [], []
        text = line = IDENTITY
        path: list[tuple] = []
        here = (0.0, 0.0)

        def number(k: int) -> float:
            return float(args[k]) if -len(args) <= k < len(args) and isinstance(args[k], (int, float)) else 0.0

        def show(raw: bytes) -> None:
            nonlocal text
            font = state["font"]
            if font is None or any(m == "hidden" for m, _ in marks):
                return
            for piece, width, blank in font.show(raw):
                self.shown += 1
                at = times((state["size"] * state["stretch"], 0, 0, state["size"], 0, state["rise"]), times(text, state["m"]))
                advance = (width * state["size"] + state["char"] + (state["word"] if blank else 0)) * state["stretch"]
                if piece:
                    size = (at[2] ** 2 + at[3] ** 2) ** 0.5
                    actual = next((m for m in marks if m[0] == "actual"), None)
                    if actual is not None:
                        piece, actual[1][:] = "".join(actual[1]), []
                    if piece:
                        self.items.append({"text": piece, "x": at[4], "y": at[5], "width": width * (at[0] ** 2 + at[1] ** 2) ** 0.5, "size": size, "bold": font.bold})
                else:
                    self.blind += 1
                text = times((1, 0, 0, 1, advance, 0), text)

        while (token := lexer.next()) is not None:
            if not isinstance(token, Keyword):
                args.append(token)
                if len(args) > 500:
                    del args[:-100]
                continue
            op, n = bytes(token), len(args)
            if op == b"q":
                stack.append(dict(state))
            elif op == b"Q":
                state = stack.pop() if stack else state
            elif op == b"cm" and n >= 6:
                state["m"] = times(tuple(number(k) for k in range(-6, 0)), state["m"])
            elif op == b"BT":
                text = line = IDENTITY
            elif op == b"Tf" and n >= 2:
                meta = get((get(resources.get("Font")) or {}).get(str(args[-2])))
                if isinstance(meta, dict):
                    if id(meta) not in self.fonts:
                        self.fonts[id(meta)] = Font(doc, meta)
                    state["font"] = self.fonts[id(meta)]
                state["size"] = number(-1)
            elif op in (b"Td", b"TD") and n >= 2:
                if op == b"TD":
                    state["lead"] = -number(-1)
                text = line = times((1, 0, 0, 1, number(-2), number(-1)), line)
            elif op == b"Tm" and n >= 6:
                text = line = tuple(number(k) for k in range(-6, 0))
            elif op == b"T*":
                text = line = times((1, 0, 0, 1, 0, -state["lead"]), line)
            elif op in (b"TL", b"Tc", b"Tw", b"Ts"):
                state[{b"TL": "lead", b"Tc": "char", b"Tw": "word", b"Ts": "rise"}[op]] = number(-1)
            elif op == b"Tz":
                state["stretch"] = number(-1) / 100
            elif op == b"Tj" and n and isinstance(args[-1], bytes):
                show(args[-1])
            elif op in (b"'", b'"') and n and isinstance(args[-1], bytes):
                if op == b'"' and n >= 3:
                    state["word"], state["char"] = number(-3), number(-2)
                text = line = times((1, 0, 0, 1, 0, -state["lead"]), line)
                show(args[-1])
            elif op == b"TJ" and n and isinstance(args[-1], list):
                for part in args[-1]:
                    if isinstance(part, (int, float)):
                        text = times((1, 0, 0, 1, -part / 1000 * state["size"] * state["stretch"], 0), text)
                    elif isinstance(part, bytes):
                        show(part)
            elif op == b"m" and n >= 2:
                here = (number(-2), number(-1))
            elif op == b"l" and n >= 2:
                there = (number(-2), number(-1))
                path.append((*here, *there))
                here = there
            elif op in (b"c", b"v", b"y") and n >= 2:
                here = (number(-2), number(-1))
            elif op == b"re" and n >= 4:
                x, y, w, h = (number(k) for k in range(-4, 0))
                path.append((x, y, x + w, y + h))
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                if op != b"n":
                    self.draw(path, state["m"], filled=op not in (b"S", b"s"))
                path = []
            elif op == b"BI":
                self.skip_inline(lexer)
            elif op in (b"BMC", b"BDC"):
                marks.append(self.mark(op, args, resources))
            elif op == b"EMC" and marks:
                marks.pop()
            elif op == b"Do" and n and isinstance(args[-1], Name):
                self.external(get((get(resources.get("XObject")) or {}).get(str(args[-1]))), resources, state["m"], depth, marks)
            args = []

    def mark(self, op: bytes, args: list, resources: dict) -> tuple:
        get = self.doc.get
        if op == b"BDC" and len(args) >= 2:
            value = args[-1]
            raw = (get(resources.get("Properties")) or {}).get(str(value)) if isinstance(value, Name) else value
            meta = get(raw)
            if args[-2] == "OC" and isinstance(raw, Ref) and raw in self.hidden:
                return ("hidden", None)
            if isinstance(meta, dict) and isinstance(actual := get(meta.get("ActualText")), bytes):
                text = actual[2:].decode("utf-16-be", "ignore") if actual[:2] == b"\xfe\xff" else actual.decode("latin-1")
                return ("actual", [text])
        return ("plain", None)

    def external(self, value, resources: dict, matrix: tuple, depth: int, marks: list) -> None:
        get = self.doc.get
        if not isinstance(value, Stream) or any(m == "hidden" for m, _ in marks):
            return
        if isinstance(value.meta.get("OC"), Ref) and value.meta["OC"] in self.hidden:
            return
        kind = get(value.meta.get("Subtype"))
        if kind == "Form":
            own = [float(get(v)) for v in get(value.meta.get("Matrix")) or IDENTITY]
            self.run(self.doc.decoded(value), get(value.meta.get("Resources")) or resources, times(tuple(own), matrix), depth + 1)
        elif kind == "Image":
            xs, ys = zip(*[(matrix[4] + a * matrix[0] + b * matrix[2], matrix[5] + a * matrix[1] + b * matrix[3]) for a in (0, 1) for b in (0, 1)])
            self.images.append((min(xs), min(ys), max(xs), max(ys)))

    def draw(self, path: list[tuple], m: tuple, filled: bool) -> None:
        for x1, y1, x2, y2 in path:
            a = (x1 * m[0] + y1 * m[2] + m[4], x1 * m[1] + y1 * m[3] + m[5])
            b = (x2 * m[0] + y2 * m[2] + m[4], x2 * m[1] + y2 * m[3] + m[5])
            w, h = abs(a[0] - b[0]), abs(a[1] - b[1])
            if min(w, h) <= (3.0 if filled else 0.8) and max(w, h) > 3:
                self.rules.append((min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])))
            elif not filled:
                # The edges of a stroked box.
                for edge in ((a[0], a[1], b[0], a[1]), (a[0], b[1], b[0], b[1]), (a[0], a[1], a[0], b[1]), (b[0], a[1], b[0], b[1])):
                    self.rules.append((min(edge[0], edge[2]), min(edge[1], edge[3]), max(edge[0], edge[2]), max(edge[1], edge[3])))

    @staticmethod
    def skip_inline(lexer: Lexer) -> None:
        while (token := lexer.next()) is not None and token != b"ID":
            pass
        found = re.compile(rb"[ \t\r\n]EI(?=[ \t\r\n]|$)").search(lexer.data, lexer.at)
        lexer.at = found.end() if found else len(lexer.data)


def extract(data: bytes, password: bytes = b"") -> list[dict]:
    """Pages of a file: number, width, height, items, rules, images.

    Raises PdfError where pages have text of which nothing can be decoded, as with
    fonts whose character maps are not at hand.
    """
    doc = Document(data, password)
    get, out, blind, shown = doc.get, [], 0, 0
    root = get(doc.trailer.get("Root")) or {}
    off = get((get((get(root.get("OCProperties")) or {}).get("D")) or {}).get("OFF")) or []
    hidden = {r for r in off if isinstance(r, Ref)}
    for number, page in enumerate(doc.pages(), 1):
        box = [float(get(v)) for v in get(page.get("CropBox")) or get(page.get("MediaBox")) or (0, 0, 612, 792)]
        left, bottom, right, top = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
        turn = int(get(page.get("Rotate")) or 0) % 360
        width, height = right - left, top - bottom
        base = {90: (0, -1, 1, 0, -bottom, right), 180: (-1, 0, 0, -1, right, top), 270: (0, 1, -1, 0, top, -left)}.get(turn, (1, 0, 0, 1, -left, -bottom))
        if turn in (90, 270):
            width, height = height, width
        reader = Interpreter(doc, hidden)
        parts = get(page.get("Contents"))
        streams = [get(p) for p in parts] if isinstance(parts, list) else [parts]
        content = b"\n".join(doc.decoded(s) for s in streams if isinstance(s, Stream))
        reader.run(content, get(page.get("Resources")) or {}, tuple(map(float, base)))
        blind, shown = blind + reader.blind, shown + reader.shown
        inside = [i for i in reader.items if -2 <= i["x"] <= width + 2 and -2 <= i["y"] <= height + 2]
        out.append({"page_number": number, "page_width": width, "page_height": height, "items": inside, "rules": reader.rules, "images": reader.images})
    if shown and blind == shown:
        raise PdfError("no text of the document can be decoded")
    return out


MOST_PIXELS = 64_000_000


def png(width: int, height: int, bits: int, kind: int, rows: bytes) -> bytes:
    """A PNG file of packed rows."""
    stride = len(rows) // height
    raw = b"".join(b"\0" + rows[k * stride : (k + 1) * stride] for k in range(height))
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([bits, kind, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(doc: Document, stream: Stream) -> tuple[str, bytes] | None:
    """(extension, bytes) of a picture: JPEG and JPEG 2000 as they are, bitmaps as PNG; None for what can't be read."""
    get = doc.get
    names = get(stream.meta.get("Filter"))
    last = (names[-1] if isinstance(names, list) and names else names) if names else None
    width, height, bits = get(stream.meta.get("Width")), get(stream.meta.get("Height")), get(stream.meta.get("BitsPerComponent")) or 1
    if not isinstance(width, int) or not isinstance(height, int) or not 0 < width * height <= MOST_PIXELS:
        return None
    if last in ("DCTDecode", "DCT", "JPXDecode"):
        if isinstance(names, list) and len(names) > 1:
            return None
        return ("jp2" if last == "JPXDecode" else "jpg"), stream.raw
    try:
        data = doc.decoded(stream)
    except PdfError:
        return None
    space = get(stream.meta.get("ColorSpace"))
    name = get(space[0]) if isinstance(space, list) and space else space
    colors = {"DeviceRGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "Indexed": 1, "I": 1}.get(str(name), 1)
    if name == "ICCBased":
        profile = get(space[1])
        colors = get(profile.meta.get("N")) if isinstance(profile, Stream) else 3
    stride = (width * colors * bits + 7) // 8
    if bits not in (1, 2, 4, 8) or len(data) < stride * height:
        return None
    data = data[: stride * height]
    if name in ("Indexed", "I") and bits == 8:
        base, table = get(space[1]), get(space[3])
        table = doc.decoded(table) if isinstance(table, Stream) else table
        n = 3 if "RGB" in str(base) or isinstance(base, list) else 1
        if isinstance(table, bytes):
            blank = bytes(n)
            data, colors = b"".join(table[n * c : n * c + n] or blank for c in data), n
    if colors == 4 and bits == 8:
        data = bytes(v for k in range(0, len(data), 4) for v in ((255 - data[k]) * (255 - data[k + 3]) // 255, (255 - data[k + 1]) * (255 - data[k + 3]) // 255, (255 - data[k + 2]) * (255 - data[k + 3]) // 255))
        colors = 3
    return "png", png(width, height, bits, 2 if colors == 3 else 0, data)


def pictures(data: bytes, password: bytes = b"") -> list[tuple[int, str, bytes]]:
    """(page, extension, bytes) of the pictures that the pages hold directly, each object once for a page."""
    doc, out = Document(data, password), []
    for number, page in enumerate(doc.pages(), 1):
        resources = doc.get(page.get("Resources")) or {}
        seen = set()
        for value in (doc.get(resources.get("XObject")) or {}).values():
            stream = doc.get(value)
            if isinstance(stream, Stream) and doc.get(stream.meta.get("Subtype")) == "Image" and id(stream) not in seen:
                seen.add(id(stream))
                if found := picture(doc, stream):
                    out.append((number, *found))
    return out


def convert(data: bytes, info: dict) -> tuple[str, str | None]:
    return render_pages(extract(data, (info.get("password") or "").encode())), None
