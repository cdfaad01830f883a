"""Zip packages and their relationships, as office formats use them."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile

#: A part that would unpack to more is refused, as are packages of more parts.
MOST_BYTES, MOST_PARTS = 512 << 20, 20_000


def local(tag: str) -> str:
    """A tag or attribute name without its namespace."""
    return tag.rpartition("}")[2]


def attribute(node: ET.Element, name: str) -> str | None:
    """The attribute called ``name`` in whatever namespace."""
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def kids(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [c for c in node if local(c.tag) == name]


def kid(node: ET.Element | None, *path: str) -> ET.Element | None:
    """The first child along ``path``."""
    for name in path:
        node = next(iter(kids(node, name)), None)
    return node


def below(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [n for n in node.iter() if local(n.tag) == name]


class Package:
    """The parts of a zip file by name, and the relationships of each part."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        infos = self.zip.infolist()
        if len(infos) > MOST_PARTS:
            raise ValueError("the package has too many parts")
        self.infos = {i.filename: i for i in infos if not i.is_dir()}

    def names(self) -> list[str]:
        return list(self.infos)

    def read(self, name: str) -> bytes | None:
        info = self.infos.get(name)
        if info is None:
            return None
        if info.file_size > MOST_BYTES:
            raise ValueError(f"{name} is too large")
        return self.zip.read(info)

    def xml(self, name: str) -> ET.Element | None:
        data = self.read(name)
        return None if data is None else ET.fromstring(data)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target part or outside address) of a part."""
        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for r in kids(root, "Relationship"):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join("/", folder, target)).lstrip("/")
            out[r.get("Id", "")] = (r.get("Type", ""), target)
        return out

    def main_part(self, otherwise: str) -> str:
        """The part that the package names as its office document."""
        found = sorted((i, t) for i, (kind, t) in self.relations("").items() if kind.endswith("/officeDocument"))
        return found[0][1] if found else otherwise
