"""Structural renderings: texts that keep the blocks, links and controls of a page as marks.

A line may start with a prefix (``#`` to ``######``, ``-`` or ``|``) and a vertical tab; cells of
a row are parted by tabs; a line that ends with a tab runs on into the next one without
white space. Inside a line stand ``[text](target)``, ``[button: text]`` and, made from attributes
only, ``[img: ..]``, ``[input ..]``, ``[select ..]`` and ``[textarea ..]``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = r"(?:[^\[\]]++|\[[^\[\]]*+\])*+"  # at most one level of brackets
_CONTROL = r"\[(?:img|input|select|textarea)(?:[: ][^\]]*)?\]"
_BUTTON = rf"\[button: ({_TEXT})\]"
_LINK = rf"\[({_TEXT})\]\(([^)]*)\)"
_PREFIX = r"(#{1,6}|-|\|)\x0B"

LINES = "array<struct<block:string,level:int,joined:boolean,cells:array<array<struct<mark:string,text:string,target:string,label:string>>>>>"


def flattened_text(rendering: Column) -> Column:
    """The words of the page: without marks, on one line."""
    plain = F.regexp_replace(F.regexp_replace(rendering, f"(?md)^{_PREFIX}", ""), r"\t\n", "")
    plain = F.regexp_replace(plain, _CONTROL, "")
    plain = F.regexp_replace(F.regexp_replace(plain, _BUTTON, "$1"), _LINK, "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), "^ | $", "")


def without_link_targets(rendering: Column) -> Column:
    """Links keep their text in brackets and lose their target. Buttons and controls stay."""
    button = rf"\[button: {_TEXT}\]"
    return F.regexp_replace(rendering, rf"({_CONTROL}|{button})|(\[{_TEXT}\])\([^)]*\)", "$1$2")


def prompt_form(rendering: Column, runes: int) -> Column:
    """What a model is shown: no link targets, and at most so many characters."""
    return F.left(without_link_targets(rendering), F.lit(runes))


def scan(rendering: str | None) -> list[dict]:
    """The lines of a rendering: block, level, joined, and cells of pieces (mark, text, target, label)."""
    marks = re.compile(f"(?P<control>{_CONTROL})|{_BUTTON}|{_LINK}")
    piece = lambda mark, text="", target="", label="": {"mark": mark, "text": text, "target": target, "label": label}

    def pieces(cell: str) -> list[dict]:
        out, at = [], 0
        for m in marks.finditer(cell):
            if m.start() > at:
                out.append(piece("text", cell[at : m.start()]))
            at, (_, button, link, target) = m.end(), m.groups()
            out.append(piece("control", label=m[0][1:-1]) if m["control"] else piece("button", button) if button is not None else piece("link", link, target))
        return out + ([piece("text", cell[at:])] if at < len(cell) else [])

    lines = []
    if not rendering:
        return lines
    rows = rendering.split("\n")
    for i, row in enumerate(rows):
        joined = row.endswith("\t") and i + 1 < len(rows)
        row = row[:-1] if joined else row
        found = re.match(_PREFIX, row)
        prefix, body = (found[1], row[found.end() :]) if found else ("", row)
        block = {"": "paragraph", "-": "item", "|": "row"}.get(prefix, "heading")
        cells = body.split("\t") if block == "row" else [body]
        lines.append({"block": block, "level": len(prefix) if block == "heading" else 0, "joined": joined, "cells": [pieces(c) for c in cells]})
    return lines


def scan_renderings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, lines) of each row; no lines for null and for an empty rendering."""

    def scanned(batches):
        import pyarrow as pa

        piece = pa.struct([(n, pa.string()) for n in ("mark", "text", "target", "label")])
        line = pa.struct([("block", pa.string()), ("level", pa.int32()), ("joined", pa.bool_()), ("cells", pa.list_(pa.list_(piece)))])
        for batch in batches:
            found = [scan(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(line))], names=[key, "lines"])

    return rows.select(key, column).mapInArrow(scanned, f"{key} {rows.schema[key].dataType.simpleString()}, lines {LINES}")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def compare_arms(rows: DataFrame) -> DataFrame:
    """One row on two readings of the same pages. ``rows`` has url, label, page_words, and for each
    reading, ``flat`` and ``structural``, a struct(extract, words, runes, truncated).

    Flips are pages on which the readings decide differently; drifted drops are those of them
    that are postings. ``newly_truncated`` counts pages that only the structural reading cuts."""
    flip = F.col("flat.extract") != F.col("structural.extract")
    out = [
        F.count("*").alias("pages"), F.sum("page_words").alias("words"), F.count_if(flip).alias("flips"), F.count_if(flip & (F.col("label") == "detail")).alias("drifted_drops"),
        F.count_if(F.col("structural.truncated") & ~F.col("flat.truncated")).alias("newly_truncated")]
    share = lambda n, d: F.round(F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0)), 4)
    for arm in ("flat", "structural"):
        out += [
            share(F.count_if(F.col(arm + ".extract")), F.count("*")).alias(arm + "_call_rate"), share(F.sum(arm + ".words"), F.sum("page_words")).alias(arm + "_words_share"),
            F.sum(arm + ".runes").alias(arm + "_runes"), F.count_if(F.col(arm + ".truncated")).alias(arm + "_truncated"),
            F.count_if((F.col("label") == "detail") & ~F.col(arm + ".extract")).alias(arm + "_false_drops")]
    return rows.agg(*out)
