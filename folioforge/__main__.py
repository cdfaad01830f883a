"""python -m folioforge: convert one source, or list formats."""

from __future__ import annotations

import argparse
import json
import os
import sys

from folioforge.formats import pdf, registry
from folioforge.sources.fetch import convert_address

OK, ERROR, UNSUPPORTED = 0, 1, 3
COMMANDS = ("convert", "formats")
#: Short names of commands.
ALIASES = {"c": "convert"}


def distance(a: str, b: str) -> int:
    """Edit distance of two commands."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def main(args: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if args:
        args[0] = ALIASES.get(args[0], args[0])
    if args and args[0] not in COMMANDS and not args[0].startswith("-") and "." not in args[0] and "/" not in args[0]:
        near = min(COMMANDS, key=lambda c: distance(args[0], c))
        hint = f"; did you mean {near}?" if distance(args[0], near) <= 2 else ""
        print(f"Unknown command: {args[0]}{hint}", file=sys.stderr)
        return ERROR
    if args and args[0] not in COMMANDS and not args[0].startswith("--"):
        args.insert(0, "convert")
    parser = argparse.ArgumentParser(prog="folioforge")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("convert", help="a file, an address, or - for standard input")
    one.add_argument("source")
    one.add_argument("-o", "--output")
    pictures = one.add_mutually_exclusive_group()
    pictures.add_argument("--image-dir", help="where the pictures of a PDF go; beside the output, if there is one")
    pictures.add_argument("--no-images", action="store_true", help="write no pictures")
    for p in (one, sub.add_parser("formats", help="what can be converted")):
        p.add_argument("--json", action="store_true")
        p.add_argument("-q", "--quiet", action="store_true")
    chosen = parser.parse_args(args)
    if chosen.command == "formats":
        rows = [{"name": n, "extensions": e.split(), "builtin": True} for n, e in registry.FORMATS]
        print(json.dumps(rows) if chosen.json else "\n".join(f"{r['name']}: {' '.join(r['extensions'])}" for r in rows))
        return OK
    return _convert(chosen)


def _pictures(data: bytes, path: str, folder: str) -> None:
    """The pictures of a PDF as files; what cannot be read of them is left out."""
    os.makedirs(folder, exist_ok=True)
    stem = os.path.splitext(os.path.basename(path))[0]
    for k, (page, kind, body) in enumerate(pdf.pictures(data)):
        with open(os.path.join(folder, f"{stem}-p{page}-{k}.{kind}"), "wb") as file:
            file.write(body)


def _convert(chosen: argparse.Namespace) -> int:
    source = chosen.source
    try:
        if source == "-":
            if sys.stdin.isatty():
                print("No input on standard input", file=sys.stderr)
                return ERROR
            found = registry.convert(sys.stdin.buffer.read(), {})
        elif source.startswith(("http:", "https:", "file:")):
            found = convert_address(source)
        else:
            path = source
            with open(path, "rb") as file:
                data = file.read()
            found = registry.convert(data, {"extension": registry.extension(path), "filename": path.rpartition("/")[2], "local_path": path})
            if chosen.image_dir and not chosen.no_images and found["converter"] == "pdf":
                _pictures(data, path, chosen.image_dir)
    except OSError as e:
        found = {"markdown": None, "title": None, "errors": [{"converter": "", "message": str(e)}]}
    markdown = found["markdown"]
    if markdown is None:
        message = registry.failure(found["errors"])
        print(json.dumps({"success": False, "source": source, "error": message}) if chosen.json else message, file=sys.stdout if chosen.json else sys.stderr)
        return UNSUPPORTED if message.startswith("Unsupported format") else ERROR
    if chosen.output:
        with open(chosen.output, "w", encoding="utf-8") as file:
            file.write(markdown)
    if chosen.json:
        answer = {"success": True, "source": source}
        answer |= {"output": chosen.output} if chosen.output else {}
        answer |= {"title": found["title"]} if found["title"] else {}
        answer |= {"length": len(markdown.encode("utf-16-le")) // 2} if chosen.output else {"markdown": markdown}
        print(json.dumps(answer, ensure_ascii=False))
    elif not chosen.output:
        print(markdown)
    elif not chosen.quiet:
        print(f"Wrote {chosen.output}")
    return OK


if __name__ == "__main__":
    sys.exit(main())
