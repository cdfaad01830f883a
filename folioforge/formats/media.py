"""What pictures and recordings say about themselves."""

from __future__ import annotations

import struct

# ---------------------------------------------------------------- pictures

# EXIF tags by number.
TAGS = {
    0x0100: "width", 0x0101: "height", 0xA002: "width", 0xA003: "height", 0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0131: "software",
    0x013B: "artist", 0x8298: "copyright", 0x9003: "taken", 0x9004: "created", 0x829A: "exposure", 0x829D: "fnumber", 0x8827: "iso", 0x920A: "focal",
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure inside a JPEG, PNG, WebP or TIFF file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if data[at + 1] == 0xDA:
                break
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
    return None


def exif(data: bytes) -> dict:
    """Named fields; the first value of a tag counts."""
    block, out = tiff_block(data), {}
    if block is None or len(block) < 8:
        return out
    end = "<" if block[:2] == b"II" else ">"

    def directory(at: int, gps: bool, depth: int) -> None:
        if depth > 4 or at + 2 > len(block):
            return
        for k in range(struct.unpack_from(end + "H", block, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(block):
                return
            tag, kind, count = struct.unpack_from(end + "HHI", block, entry)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(end + "I", block, entry + 8)[0]
            if not size or place + size > len(block):
                continue
            raw = block[place : place + size]
            if tag in (0x8769, 0x8825) and not gps:
                directory(struct.unpack(end + "I", raw[:4])[0], tag == 0x8825, depth + 1)
                continue
            name = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}.get(tag) if gps else TAGS.get(tag)
            if name and name not in out:
                value = _value(raw, kind, count, end)
                if value not in (None, "", []):
                    out[name] = value

    directory(struct.unpack_from(end + "I", block, 4)[0], False, 0)
    return out


def _value(raw: bytes, kind: int, count: int, end: str):
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        pairs = [struct.unpack_from(end + ("II" if kind == 5 else "ii"), raw, 8 * i) for i in range(count)]
        values = [a / b if b else 0.0 for a, b in pairs]
    elif kind in (3, 4, 8, 9):
        values = [struct.unpack_from(end + {3: "H", 4: "I", 8: "h", 9: "i"}[kind], raw, SIZES[kind] * i)[0] for i in range(count)]
    else:
        return None
    return values if count > 1 else values[0]


def _short(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


def image(data: bytes, info: dict) -> tuple[str, str | None]:
    try:
        f = exif(data)
    except (struct.error, ValueError):
        f = {}
    lines = []
    if "width" in f and "height" in f:
        lines.append(f"ImageSize: {f['width']}x{f['height']}")
    lines += [f"{label}: {f[k]}" for k, label in (("description", "Description"), ("artist", "Artist"), ("copyright", "Copyright")) if k in f]
    camera = " ".join(f[k] for k in ("make", "model") if k in f)
    lines += [f"Camera: {camera}"] if camera else []
    lines += [f"{label}: {f[k]}" for k, label in (("taken", "DateTimeOriginal"), ("created", "CreateDate")) if k in f]
    if isinstance(f.get("lat"), list) and isinstance(f.get("lon"), list):
        lat, lon = (sum(v / 60**i for i, v in enumerate(f[k][:3])) * (-1 if f.get(k + "_ref") in ("S", "W") else 1) for k in ("lat", "lon"))
        lines.append(f"GPS: {lat:.6f}, {lon:.6f}")
    if isinstance(f.get("exposure"), float) and f["exposure"] > 0:
        lines.append(f"ExposureTime: 1/{round(1 / f['exposure'])}s")
    lines += [f"FNumber: f/{_short(f['fnumber'])}"] if isinstance(f.get("fnumber"), float) else []
    lines += [f"ISO: {f['iso'][0] if isinstance(f['iso'], list) else f['iso']}"] if "iso" in f else []
    lines += [f"FocalLength: {_short(f['focal'])}mm"] if isinstance(f.get("focal"), float) else []
    lines += [f"Software: {f['software']}"] if "software" in f else []
    if not lines:
        return f"*[image: {info.get('filename') or 'unknown'}]*", None
    return "\n".join(["## Metadata\n", *lines]), None


# ---------------------------------------------------------------- recordings


def wav(data: bytes) -> dict:
    out, at, rate = {}, 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, sample, rate, _, _ = struct.unpack("<HHIIHH", body[:16])
            out |= {"format": {1: "PCM", 3: "IEEE_FLOAT", 2: "ADPCM"}.get(kind, f"non-PCM ({kind})"), "channels": channels, "rate": sample, "bitrate": round(rate * 8 / 1000)}
        elif name == b"data" and rate:
            out["seconds"] = size / rate
        elif name == b"LIST" and body[:4] == b"INFO":
            k = 4
            while k + 8 <= len(body):
                length = int.from_bytes(body[k + 4 : k + 8], "little")
                text = body[k + 8 : k + 8 + length].rstrip(b"\0").decode("utf-8", "replace")
                field = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"IGNR": "genre", b"ICRD": "year"}.get(body[k : k + 4])
                if field and text:
                    out[field] = text
                k += 8 + length + length % 2
        at += 8 + size + size % 2
    return out


def vorbis_comments(body: bytes) -> dict:
    out = {}
    at = 4 + int.from_bytes(body[:4], "little")
    count = int.from_bytes(body[at : at + 4], "little")
    at += 4
    for _ in range(min(count, 10_000)):
        size = int.from_bytes(body[at : at + 4], "little")
        key, _, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        field = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "GENRE": "genre", "TRACKNUMBER": "track", "TRACKTOTAL": "total", "DATE": "year", "LYRICS": "lyrics"}.get(key.upper())
        if field and value and field not in out:
            out[field] = value
        at += 4 + size
    return out


def flac(data: bytes) -> dict:
    out, at, last = {"format": "FLAC"}, 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18], "big")
            out |= {"rate": bits >> 44, "channels": ((bits >> 41) & 7) + 1}
            if bits >> 44:
                out["seconds"] = (bits & ((1 << 36) - 1)) / (bits >> 44)
        elif kind == 4:
            out |= vorbis_comments(body)
        at += 4 + size
    return out


# MPEG audio tables.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}


def mp3(data: bytes) -> dict:
    out, at = {}, 0
    if data[:3] == b"ID3" and len(data) > 10:
        size = sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
        out |= id3(data[10 : 10 + size], data[3])
        at = 10 + size
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        if head >> 21 == 0x7FF and (layer := 4 - ((head >> 17) & 3)) < 4 and (head >> 19) & 3 != 1:
            version = {0: "2.5", 2: "2", 3: "1"}[(head >> 19) & 3]
            k, r = (head >> 12) & 15, (head >> 10) & 3
            if 0 < k < 15 and r < 3:
                rate = BITRATES[1 if version == "1" else 2, layer][k]
                out |= {"format": f"MPEG {version} Layer {layer}", "rate": RATES[version][r], "channels": 1 if (head >> 6) & 3 == 3 else 2, "bitrate": rate, "seconds": (len(data) - at) * 8 / (rate * 1000)}
                return out
        at += 1
        if at > (1 << 20):
            break
    return out


def id3(body: bytes, version: int) -> dict:
    out, at = {}, 0
    names = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TCON": "genre", b"TRCK": "track", b"TYER": "year", b"TDRC": "year", b"USLT": "lyrics"}
    while at + 10 <= len(body) and body[at]:
        raw = body[at + 4 : at + 8]
        size = sum(b << s for b, s in zip(raw, (21, 14, 7, 0))) if version >= 4 else int.from_bytes(raw, "big")
        field, value = names.get(body[at : at + 4]), body[at + 10 : at + 10 + size]
        if field and value:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            if field == "lyrics":
                mark = b"\0\0" if value[0] in (1, 2) else b"\0"
                value = value[:1] + value[4:].partition(mark)[2]
            text = value[1:].decode(codec, "replace").strip("\0﻿ ")
            if text and field not in out:
                out[field] = text
        at += 10 + size
    return out


def mp4(data: bytes) -> dict:
    out: dict = {}

    def boxes(start: int, end: int, path: str) -> None:
        at = start
        while at + 8 <= end:
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
            head = 8
            if size == 1:
                size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            size = size or end - at
            if size < head or at + size > end:
                return
            inner, whole = at + head, f"{path}/{name}"
            if name in ("moov", "udta", "ilst", "trak", "mdia", "minf", "stbl"):
                boxes(inner, at + size, whole)
            elif name == "meta":
                boxes(inner + 4, at + size, whole)
            elif name == "mvhd":
                wide = data[inner] == 1
                scale, length = struct.unpack_from(">IQ" if wide else ">II", data, inner + (20 if wide else 12))
                if scale:
                    out["seconds"] = length / scale
            elif name == "stsd" and data[inner + 12 : inner + 16] in (b"mp4a", b"alac"):
                out["format"] = "ALAC" if data[inner + 12 : inner + 16] == b"alac" else "MPEG-4/AAC"
                out["channels"], out["rate"] = struct.unpack_from(">H", data, inner + 8 + 24)[0], struct.unpack_from(">H", data, inner + 8 + 32)[0]
            elif whole.endswith("/ilst/" + name):
                field = {"\xa9nam": "title", "\xa9ART": "artist", "\xa9alb": "album", "\xa9gen": "genre", "\xa9day": "year", "\xa9lyr": "lyrics", "trkn": "track"}.get(name)
                if field and data[inner + 4 : inner + 8] == b"data":
                    body = data[inner + 16 : at + size]
                    if field == "track":
                        out["track"], out["total"] = str(int.from_bytes(body[2:4], "big")), str(int.from_bytes(body[4:6], "big") or "")
                    else:
                        out[field] = body.decode("utf-8", "replace")
            at += size

    boxes(0, len(data), "")
    return out


def ogg(data: bytes) -> dict:
    out: dict = {}
    if (k := data.find(b"\x01vorbis")) >= 0:
        out |= {"format": "Vorbis I", "channels": data[k + 11], "rate": int.from_bytes(data[k + 12 : k + 16], "little"), "bitrate": round(int.from_bytes(data[k + 20 : k + 24], "little") / 1000)}
        if (c := data.find(b"\x03vorbis")) >= 0:
            out |= vorbis_comments(data[c + 7 :])
    elif (k := data.find(b"OpusHead")) >= 0:
        out |= {"format": "Opus", "channels": data[k + 9], "rate": 48000}
        if (c := data.find(b"OpusTags")) >= 0:
            out |= vorbis_comments(data[c + 8 :])
    last = data.rfind(b"OggS")
    if out.get("rate") and last >= 0:
        out["seconds"] = int.from_bytes(data[last + 6 : last + 14], "little") / out["rate"]
    return out


def duration(seconds: float) -> str:
    """h:mm:ss, or m:ss below an hour, rounded to seconds."""
    s = int(seconds + 0.5)
    return f"{s // 3600}:{s % 3600 // 60:02}:{s % 60:02}" if s >= 3600 else f"{s // 60}:{s % 60:02}"


def audio(data: bytes, info: dict) -> tuple[str, str | None]:
    try:
        if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
            f = wav(data)
        elif data[:4] == b"fLaC":
            f = flac(data)
        elif data[4:8] == b"ftyp":
            f = mp4(data)
        elif data[:4] == b"OggS":
            f = ogg(data)
        elif data[:3] == b"ID3" or data[:1] == b"\xff":
            f = mp3(data)
        else:
            f = {}
    except (struct.error, IndexError, ValueError):
        f = {}
    if not f:
        return f"*[audio: {info.get('filename') or 'unknown'}]*", None
    lines = ["## Metadata\n"] + [f"{label}: {f[k]}" for k, label in (("title", "Title"), ("artist", "Artist"), ("album", "Album"), ("genre", "Genre")) if f.get(k)]
    if f.get("track"):
        number, _, total = str(f["track"]).partition("/")
        total = total or f.get("total")
        lines.append(f"Track: {number} of {total}" if total else f"Track: {number}")
    lines += [f"Year: {str(f['year'])[:4]}"] if f.get("year") else []
    lines += [f"Duration: {duration(f['seconds'])}"] if f.get("seconds", 0) > 0 else []
    lines += [f"Format: {f['format']}"] if f.get("format") else []
    lines += [f"SampleRate: {f['rate']} Hz"] if f.get("rate") else []
    lines += [f"Channels: {f['channels']}"] if f.get("channels") else []
    lines += [f"Bitrate: {f['bitrate']} kbps"] if f.get("bitrate") else []
    lines += [f"\n## Lyrics\n\n{f['lyrics']}"] if f.get("lyrics") else []
    return "\n".join(lines).strip(), None
