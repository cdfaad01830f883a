"""The engine as a library: what most programs need of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from folioforge.formats import registry
from folioforge.formats.registry import Convert, Rule
from folioforge.operators.convert import convert, convert_with, failure_message, pdf_pictures, pdf_relations, register
from folioforge.operators.routing import accepts, converter_names, formats
from folioforge.sources.fetch import convert_address, convert_urls
from folioforge.sources.files import read_files, write_images, zip_markdown

__all__ = ["accepts", "add_converter", "convert", "convert_address", "convert_file", "convert_files", "convert_urls", "convert_with", "converter_names", "failure_message", "formats", "pdf_pictures", "pdf_relations", "register", "write_images", "zip_markdown"]


def convert_files(spark: SparkSession, folder: str, pattern: str = "*", overrides: dict[str, Column] | None = None) -> DataFrame:
    """Results of the files below ``folder``; ``overrides`` replace what is known of them before routing.

    Path, extension and name always come from the file.
    """
    kept = {k: v for k, v in (overrides or {}).items() if k not in ("local_path", "extension", "filename", "doc_id", "content")}
    return convert(read_files(spark, folder, pattern).withColumns(kept))


def convert_file(path: str) -> dict:
    """One file without Spark."""
    with open(path, "rb") as file:
        data = file.read()
    return registry.convert(data, {"extension": registry.extension(path), "filename": path.rpartition("/")[2], "local_path": path})


def add_converter(name: str, convert_: Convert, extensions: tuple[str, ...] = (), types: tuple[str, ...] = (), url: str | None = None) -> None:
    """Put a converter of one's own before the others.

    ``convert_`` takes bytes and a description and returns Markdown and title. Plans
    made after the call use it.
    """
    registry.EXTRA.insert(0, Rule(name, tuple(extensions), tuple(types), url=url, convert=convert_))
