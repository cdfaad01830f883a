"""Which converters take a document, as Column expressions over its description.

The rules are those of the registry, compiled to predicates that Catalyst can
push and prune; no content is read but five bytes of what nothing describes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.formats.registry import FORMATS, Rule, named, rules


def accepts(rule: Rule | str, extension: Column, mimetype: Column, url: Column) -> Column:
    """Whether a converter takes a document; never null."""
    rule = named(rule) if isinstance(rule, str) else rule
    tests = [extension.isin(*rule.extensions)] if rule.extensions else []
    tests += [mimetype.startswith(t) for t in rule.types]
    tests += [mimetype.isin(*rule.exact)] if rule.exact else []
    tests += [url.rlike(rule.url)] if rule.url else []
    tests += [extension.isNull() & mimetype.isNull()] if rule.unknown else []
    return reduce(or_, (F.coalesce(t, F.lit(False)) for t in tests))


def sniffed(content: Column, extension: Column, mimetype: Column) -> Column:
    """The media type, with PDF told by its first bytes where nothing else is known."""
    return F.when(extension.isNull() & mimetype.isNull() & (F.substring(content, 1, 5) == F.lit(b"%PDF-")), "application/pdf").otherwise(mimetype)


def candidates(extension: Column, mimetype: Column, url: Column) -> Column:
    """Names of the converters that take a document, in the order they are tried."""
    return F.filter(F.array(*(F.when(accepts(r, extension, mimetype, url), r.name) for r in rules())), lambda c: c.isNotNull())


def routed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``candidates`` and ``route``, the first of them."""
    e, m, u = F.col("extension"), F.col("mimetype"), F.col("url")
    kind = sniffed(F.col("content"), e, m) if "content" in documents.columns else m
    return documents.withColumn("candidates", candidates(e, kind, u)).withColumn("route", F.try_element_at("candidates", F.lit(1)))


def converter_names(spark: SparkSession) -> DataFrame:
    """``position, name`` of the converters."""
    return spark.createDataFrame([(k, r.name) for k, r in enumerate(rules(), 1)], "position int, name string")


def formats(spark: SparkSession) -> DataFrame:
    """The formats as users are told of them."""
    return spark.createDataFrame([(n, e.split(), True) for n, e in FORMATS], "name string, extensions array<string>, builtin boolean")
