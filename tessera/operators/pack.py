"""Packing files into one document, in XML or Markdown, under a token budget.

The result is a table of rendered parts in their order; putting them together is left to the edge, as
one string can hold 2 GB at most.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import skeleton, text
from tessera.functions.tokens import TokenCounter, by_quarter_bytes
from tessera.operators import latch
from tessera.operators.lineage import checkpointed
from tessera.parsing.languages import Language
from tessera.parsing.tables import with_skeletons, with_symbols

log = logging.getLogger(__name__)
_NO_METADATA = "map<string,string>"


class ContextPlugin(ABC):
    """Adds metadata to the files it applies to; both parts are expressions over path, content and metadata."""

    name = ""

    def detect(self, path: Column) -> Column:
        return F.lit(True)

    @abstractmethod
    def enrich(self, path: Column, content: Column, metadata: Column) -> Column:
        """A map<string,string>; its keys replace equal ones of earlier plugins. ``metadata`` holds what those gave."""


def merged(first: Column, second: Column) -> Column:
    """Union of two maps; the second one's values win."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def enriched(metadata: Column, plugins: Iterable[ContextPlugin], path: Column, content: Column) -> Column:
    for p in plugins:
        metadata = F.when(F.coalesce(p.detect(path), F.lit(False)), merged(metadata, p.enrich(path, content, metadata))).otherwise(metadata)
    return metadata


def cleaned(t: Column, remove_empty_lines: bool = False, truncate_base64: bool = False) -> Column:
    if remove_empty_lines:
        t = text.remove_empty_lines(t)
    return text.truncate_base64(t) if truncate_base64 else t


def map_entry(path: Column, signatures: Column, xml: bool) -> Column:
    """A file's part of the skeleton map; ``signatures`` may be null."""
    lines = F.coalesce(signatures, F.array().cast("array<string>"))
    if xml:
        inner = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("      <signature>"), s, F.lit("</signature>\n"))), "")
        return F.concat(F.lit('    <file path="'), path, F.lit('">\n'), inner, F.lit("    </file>\n"))
    return F.concat(F.lit("- "), path, F.lit("\n"), F.array_join(F.transform(lines, lambda s: F.concat(F.lit("  - "), s, F.lit("\n"))), ""))


def file_block(path: Column, content: Column | None, metadata: Column, xml: bool) -> Column:
    """A file's part of the body; without content where that is None."""
    entries = F.array_sort(F.map_entries(metadata))
    some = F.size(metadata) > 0
    if xml:
        body = F.concat(F.lit("    <content><![CDATA[\n"), text.cdata(content), F.lit("\n]]></content>\n")) if content is not None else F.lit("")
        items = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('      <metadata key="'), e["key"], F.lit('">'), e["value"], F.lit("</metadata>\n"))), "")
        bones = F.when(some, F.concat(F.lit("    <bones>\n"), items, F.lit("    </bones>\n"))).otherwise("")
        return F.concat(F.lit('  <file path="'), path, F.lit('">\n'), body, bones, F.lit("  </file>\n"))
    body = F.concat(F.lit("```\n"), content, F.lit("\n```\n\n")) if content is not None else F.lit("")
    items = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    return F.concat(F.lit("## "), path, F.lit("\n\n"), body, F.when(some, F.concat(F.lit("Bones:\n"), items, F.lit("\n"))).otherwise(""))


@dataclass
class Packer:
    """Options of a pack; ``rows`` gives the parts, ``text`` the document.

    ``format``: "xml" in any case, else Markdown.  ``full`` keeps the bodies of symbols.
    """

    format: str = "xml"
    max_tokens: int | None = None
    no_file_summary: bool = False
    no_files: bool = False
    remove_comments: bool = False
    remove_empty_lines: bool = False
    truncate_base64: bool = False
    full: bool = False
    root: str = "."
    counter: TokenCounter = by_quarter_bytes
    languages: dict[str, Language] | None = None
    plugins: list[ContextPlugin] = field(default_factory=list)

    def register_plugin(self, plugin: ContextPlugin) -> Packer:
        self.plugins.append(plugin)
        return self

    @property
    def xml(self) -> bool:
        return self.format.lower() == "xml"

    def unreadable(self, files: DataFrame) -> DataFrame:
        """(path) of the files that contents() leaves out: null content, or not UTF-8."""
        return files.where(~F.coalesce(text.is_utf8(F.col("content")), F.lit(False))).select("path")

    def contents(self, files: DataFrame) -> DataFrame:
        """(path, content, metadata) of the files of (path, content bytes) that are valid UTF-8, as they are packed."""
        readable = files.where(text.is_utf8(F.col("content"))).select("path", cleaned(F.col("content").cast("string"), self.remove_empty_lines, self.truncate_base64).cast("binary").alias("content"))
        if self.full:
            shown = readable.select("path", F.col("content").cast("string").alias("content"))
        else:
            shown = with_skeletons(readable, languages=self.languages).select("path", F.coalesce("skeleton", "content").cast("string").alias("content"))
        if self.remove_comments:
            shown = shown.select("path", text.strip_comments(F.col("content")).alias("content"))
        return shown.select("path", "content", enriched(F.create_map().cast(_NO_METADATA), self.plugins, F.col("path"), F.col("content")).alias("metadata"))

    def summary(self, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
        """(path, text): the files' parts of the skeleton map. ``symbols``: of the index; parsed anew without it."""
        from tessera.operators.lookup import signatures

        if symbols is not None:
            found = files.select("path").join(signatures(symbols), "path", "left")
        else:
            found = with_symbols(files, languages=self.languages).select("path", F.transform(skeleton.outline_lines(F.col("symbols")), lambda s: F.concat(s["kind"], F.lit(" "), s["name"])).alias("signatures"))
        return found.select("path", map_entry(self._shown(F.col("path")), F.col("signatures"), self.xml).alias("text"))

    def _shown(self, path: Column) -> Column:
        return F.concat(F.lit(self.root.rstrip("/") + "/"), path) if self.root else path

    def rows(self, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
        """(section, path, text) of the document, to be read in the order of section and path."""
        spark = files.sparkSession
        fixed = lambda *rows: spark.createDataFrame(list(rows), "section int, path string, text string")
        out: list[DataFrame] = []
        if self.xml:
            out.append(fixed((0, "", "<repository>\n"), (9, "", "</repository>\n")))
        if not self.no_file_summary:
            opening, closing = ("  <skeleton_map>\n", "  </skeleton_map>\n") if self.xml else ("## Skeleton Map\n\n", "\n")
            entries = checkpointed(self.summary(files, symbols))
            out += [fixed((1, "", opening), (3, "", closing)), entries.select(F.lit(2).alias("section"), "path", "text")]
        if not self.no_files:
            ready = checkpointed(self.contents(files))  # parsed once; sized, latched and rendered from there
            path = self._shown(F.col("path"))
            if self.max_tokens is not None:
                sized = ready.select("path", self.counter(F.col("content")).alias("content_tokens"), self.counter(file_block(path, F.col("content"), F.col("metadata"), self.xml)).alias("rendered_tokens"))
                before = _union(out, fixed()).where("section < 9").select(self.counter(F.col("text")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                # one row, joined to the texts where they are
                flagged = ready.crossJoin(latch.first_over(sized, self.max_tokens, before)).withColumn("degraded", latch.past(F.col("path")))
            else:
                flagged = ready.withColumn("degraded", F.lit(False))
            block = F.when(F.col("degraded"), file_block(path, None, F.col("metadata"), self.xml)).otherwise(file_block(path, F.col("content"), F.col("metadata"), self.xml))
            out.append(flagged.select(F.lit(4).alias("section"), "path", block.alias("text")))
        return _union(out, fixed())

    def text(self, files: DataFrame, symbols: DataFrame | None = None) -> str:
        """The document as one string, streamed to the driver in its order; a file that isn't UTF-8 is skipped with a warning."""
        if not self.no_files:
            skipped = self.unreadable(files).orderBy("path")
            for r in skipped.toLocalIterator():
                log.warning("skipped %s: not UTF-8", r.path)
        return "".join(r.text for r in self.rows(files, symbols).orderBy("section", "path").select("text").toLocalIterator())


def _union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    result = parts[0] if parts else none
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def document(parts: DataFrame, by: list[str], order: str = "path", part: str = "text") -> DataFrame:
    """One document for each group: the parts in their order, put together."""
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part]), "").alias("document"))
