"""Skeletons: a text with the outermost bodies of its symbols elided, as one expression over its spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ELLIPSIS


def outermost(symbols: Column) -> Column:
    """Bodies of an array of symbol structs, by start and order; those inside an earlier one drop out."""
    bodies = F.filter(symbols, lambda s: s["body_start"].isNotNull())
    order = F.array_sort(F.transform(bodies, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["body_start"].alias("s"), s["body_end"].alias("e"))))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x["s"] >= F.try_element_at(acc, F.lit(-1))["e"]), F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))).otherwise(acc)
    return F.aggregate(order, none, step)


def elide(content: Column, symbols: Column) -> Column:
    """Text of a binary column with every outermost body replaced by an ellipsis; offsets are of bytes.

    Without symbols (or with none that has a body) the text is unchanged.
    """
    spans = outermost(symbols)
    cut = lambda begin, end: F.substring(content, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(spans, i.cast("int"))["e"])
    heads = F.transform(spans, lambda x, i: F.concat(cut(before(i), x["s"]), F.lit(ELLIPSIS)))
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["e"], F.lit(0).cast("long"))
    tail = cut(last, F.octet_length(content).cast("long"))
    return F.when(symbols.isNull() | (F.size(spans) == 0), content.cast("string")).otherwise(F.concat(F.array_join(heads, ""), tail))


def outline_lines(symbols: Column) -> Column:
    """(kind, name) of every symbol by its place in the file."""
    order = F.array_sort(F.transform(symbols, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["qualified_name"].alias("name"))))
    return F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name")))
