"""The converters in the order in which they are tried."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass

from folioforge.formats import media, office, pdf, text
from folioforge.formats.package import Package

Convert = Callable[[bytes, dict], tuple[str, str | None]]

# What each converter accepts.
PLAIN = (
    ".txt .md .markdown .rst .log .cfg .ini .yaml .yml .toml .xml .svg .env .sh .bash .zsh .fish .py .js .ts .jsx .tsx .go .rs .rb .java .c .cpp .h .hpp .cs "
    ".swift .kt .scala .sql .r .m .lua .pl .php .ex .exs .zig .nim .v .d .hs .ml .clj .makefile .dockerfile"
)
OOXML = "application/vnd.openxmlformats-officedocument."
GITHUB_HOSTS = ("github.com", "www.github.com", "gist.github.com")
WIKIPEDIA = r"^https?://([a-z]{2,3}\.)?wikipedia\.org/"


@dataclass(frozen=True)
class Rule:
    """What a converter accepts: an extension, or the start of a media type, or a URL."""

    name: str
    extensions: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    #: Media types that must match whole.
    exact: tuple[str, ...] = ()
    url: str | None = None
    #: Also accepts what has neither extension nor media type.
    unknown: bool = False
    convert: Convert | None = None

    def accepts(self, info: dict) -> bool:
        ext, kind, url = info.get("extension"), info.get("mimetype"), info.get("url")
        if ext is not None and ext in self.extensions:
            return True
        if kind is not None and (kind.startswith(self.types or ("\0",)) or kind in self.exact):
            return True
        if self.url and url and re.search(self.url, url):
            return True
        return self.unknown and ext is None and kind is None


def zipped(data: bytes, info: dict) -> tuple[str, str | None]:
    """Every entry by the first converter that takes it and gives text; archives and plain text are not tried inside."""
    package = Package(data)
    label = posixpath.basename(info.get("local_path") or info.get("filename") or "archive.zip")
    sections = [f"Content from `{label}`:"]
    for path in package.names():
        inner = {"extension": extension(path), "filename": posixpath.basename(path)}
        body = ""
        for rule in RULES:
            if rule.name in ("zip", "plain-text") or not rule.accepts(inner):
                continue
            try:
                body = rule.convert(package.read(path), inner)[0].strip()
            except Exception:  # noqa: BLE001 a failing entry is shown as binary
                continue
            if body:
                break
        sections.append(f"## File: {path}\n\n{body or '*[binary file]*'}")
    return "\n\n".join(sections).strip(), None


def extension(path: str) -> str | None:
    """The last suffix of a path's name, lower case with its dot; dot files have none."""
    name = posixpath.basename(path)
    stem, dot, suffix = name.rpartition(".")
    return f".{suffix.lower()}" if dot and stem and suffix else None


def fetched_only(data: bytes, info: dict) -> tuple[str, str | None]:
    raise ValueError("GitHub pages are read through their addresses")


RULES = (
    Rule("pdf", (".pdf",), ("application/pdf", "application/x-pdf"), convert=pdf.convert),
    Rule("docx", (".docx",), (OOXML + "wordprocessingml.document",), convert=office.docx),
    Rule("pptx", (".pptx",), (OOXML + "presentationml.presentation",), convert=office.pptx),
    Rule("xlsx", (".xlsx",), (OOXML + "spreadsheetml.sheet",), convert=office.xlsx),
    Rule("epub", (".epub",), ("application/epub", "application/epub+zip", "application/x-epub+zip"), convert=office.epub),
    Rule("ipynb", (".ipynb",), convert=text.ipynb),
    Rule("iwork", (".pages", ".key", ".numbers"), convert=office.iwork),
    Rule("github", url=rf"^https?://({'|'.join(map(re.escape, GITHUB_HOSTS))})(:\d+)?/[^/?#]", convert=fetched_only),
    Rule("wikipedia", url=WIKIPEDIA, convert=text.wikipedia),
    Rule("rss", (".rss", ".atom", ".xml"), ("application/rss+xml", "application/rss", "application/atom+xml", "application/atom", "text/xml", "application/xml"), convert=text.feed),
    Rule("csv", (".csv", ".tsv"), ("text/csv", "text/tab-separated-values"), convert=text.csv),
    Rule("json", (".json",), ("application/json",), convert=text.as_json),
    Rule("yaml", (".yaml", ".yml"), ("text/yaml", "application/x-yaml"), convert=text.yaml),
    Rule("image", (".jpg", ".jpeg", ".png", ".gif", ".webp", ".tiff", ".tif", ".bmp", ".svg"), ("image/",), convert=media.image),
    Rule("audio", (".mp3", ".wav", ".m4a", ".mp4", ".ogg", ".flac", ".aac", ".wma"), ("audio/",), ("video/mp4",), convert=media.audio),
    Rule("zip", (".zip",), ("application/zip", "application/x-zip-compressed"), convert=zipped),
    Rule("xml", (".xml", ".svg"), ("text/xml", "application/xml"), convert=text.xml),
    Rule("html", (".html", ".htm"), ("text/html", "application/xhtml"), convert=text.html),
    Rule("plain-text", tuple(PLAIN.split()), ("text/",), unknown=True, convert=text.plain),
)
BY_NAME = {r.name: r for r in RULES}
#: Converters of the user's own; they come first.
EXTRA: list[Rule] = []


def rules() -> tuple[Rule, ...]:
    """All converters in the order in which they are tried."""
    return (*EXTRA, *RULES)


def named(name: str) -> Rule:
    return next(r for r in rules() if r.name == name)


# The formats as users are told of them.
FORMATS = (
    ("PDF", ".pdf"), ("Word", ".docx"), ("PowerPoint", ".pptx"), ("Excel", ".xlsx"), ("HTML", ".html .htm"), ("EPUB", ".epub"), ("Jupyter", ".ipynb"),
    ("RSS/Atom", ".rss .atom .xml"), ("CSV", ".csv .tsv"), ("JSON", ".json"), ("YAML", ".yaml .yml"), ("XML", ".xml .svg"), ("Images", ".jpg .png .gif .webp"),
    ("Audio", ".mp3 .wav .m4a .flac"), ("Pages", ".pages"), ("Keynote", ".key"), ("Numbers", ".numbers"), ("GitHub", "github.com/* gist.github.com/*"), ("ZIP", ".zip"),
    ("Plain text", ".txt .md .rst .log"), ("Code", ".py .js .ts .go .rs ..."), ("URLs", "http:// https://"), ("Wikipedia", "*.wikipedia.org"),
)


def convert(data: bytes | None, info: dict, only: str | None = None, extra: list[Rule] | None = None) -> dict:
    """The record of one document: converter, markdown, title and the errors on the way.

    ``extra`` are the user's own converters, where another process has registered them.

    The first accepting converter that succeeds wins. Failures are data: a document
    that nothing converts has null converter and markdown, and says why in ``errors``.
    """
    errors: list[dict] = []
    if data is None:
        return {"converter": None, "markdown": None, "title": None, "errors": [{"converter": "", "message": "no content"}]}
    if info.get("extension") is None and info.get("mimetype") is None and data[:5] == b"%PDF-":
        info = {**info, "mimetype": "application/pdf"}
    for rule in (*(EXTRA if extra is None else extra), *RULES):
        if rule.name != only if only else not rule.accepts(info):
            continue
        try:
            markdown, title = rule.convert(data, info)
        except RecursionError:
            errors.append({"converter": rule.name, "message": "nested too deeply"})
        except Exception as e:  # noqa: BLE001 one bad document must not end a job
            errors.append({"converter": rule.name, "message": f"{e}" or type(e).__name__})
        else:
            return {"converter": rule.name, "markdown": markdown, "title": title, "errors": errors}
    if not errors:
        errors.append({"converter": "", "message": f"Unsupported format: {info.get('extension') or info.get('mimetype') or 'unknown'}"})
    return {"converter": None, "markdown": None, "title": None, "errors": errors}


def failure(errors: list[dict]) -> str:
    """The errors of a record as one message."""
    if len(errors) == 1 and not errors[0]["converter"]:
        return errors[0]["message"]
    return "\n".join(["Conversion failed:", *(f"  {e['converter']}: {e['message']}" for e in errors)])
