"""From contents to units (item_id, unit): sentences, table rows, JSON and XML paths and values, HTML text."""

from __future__ import annotations

import json
import string
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, strip


def sentence_units(docs: DataFrame, id_col: str, text_col: str, ends: str | None = None) -> DataFrame:
    """Sentences without white space at their ends, or without the characters of ends; distinct within each row of docs."""
    return docs.select(F.col(id_col).cast("string").alias("item_id"), F.explode(sentences(F.col(text_col), ends)).alias("unit"))


def row_units(rows: DataFrame, item_id, columns: list[str]) -> DataFrame:
    """Each row's cells, trimmed and joined by ||; NULL is an empty cell."""
    cells = [strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return rows.select(item_id.cast("string").alias("item_id"), F.concat_ws("||", *cells).alias("unit")).distinct()


def _members(data) -> list[tuple[str, object]] | None:
    """Names and values inside a JSON container in document order; None for a leaf."""
    if isinstance(data, dict):
        return list(data.items())
    return [(f"[{k}]", v) for k, v in enumerate(data)] if isinstance(data, list) else None


def _walk(data) -> Iterator[tuple[str, object, bool]]:
    """path, value and whether it is a leaf, of everything below data; an explicit stack, so depth has no limit here."""
    open_ = [("", data)]
    while open_:
        path, value = open_.pop()
        inside = _members(value)
        yield path, value, inside is None
        open_ += [(f"{path}.{name}" if path else name, v) for name, v in reversed(inside or [])]


def json_content(data) -> Iterator[str]:
    """path=value of each leaf, values as Python writes them."""
    return (f"{path}={value}" for path, value, leaf in _walk(data) if leaf)


def json_paths(data) -> Iterator[str]:
    """The paths of all containers and leaves below the whole."""
    return (path for path, _, _ in islice(_walk(data), 1, None))


def _marks_only(text: str) -> bool:
    return all(c.isdigit() or c in string.punctuation for c in text)


def json_values(data) -> Iterator[str]:
    """Leaf values in document order, but for null and those of digits and punctuation."""
    return (str(value) for _, value, leaf in _walk(data) if leaf and value is not None and not _marks_only(str(value)))


class _XmlUnits:
    """Takes the parser's events in one pass: a stack of paths, and the text gathered since the last tag."""

    def __init__(self):
        self.stack, self.content, self.paths = [], [], []
        self.text, self.place = [], None

    def _flush(self) -> None:
        text = "".join(self.text).strip()
        if text and self.place:
            self.content.append(f"{self.place}={text}")
        self.text = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self._flush()
        path = "/".join([*self.stack[-1:], tag.rpartition("}")[2]])
        names = [(name.rpartition("}")[2], value) for name, value in attrs.items()]
        self.paths += [path, *(f"{path}[@{name}]" for name, _ in names)]
        self.content += [f"{path}[@{name}]={value}" for name, value in names]
        self.stack.append(path)
        # Only text before the first child belongs to an element; what follows a child is the child's tail.
        self.place = path

    def end(self, tag: str) -> None:
        self._flush()
        self.place = f"{self.stack.pop()}/tail" if len(self.stack) > 1 else None

    def data(self, text: str) -> None:
        self.text.append(text)

    def close(self) -> _XmlUnits:
        return self


def _xml(content: str) -> _XmlUnits:
    parser = ET.XMLParser(target=_XmlUnits())
    parser.feed(content)
    return parser.close()


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_lines(content: str) -> Iterator[str]:
    """The visible text of a page, piece by piece; scripts and styles are not text."""
    parser = _Text()
    parser.feed(content)
    parser.close()
    yield "\n".join(parser.parts)


_KINDS = {
    "json_content": lambda c: json_content(json.loads(c)), "json_paths": lambda c: dict.fromkeys(json_paths(json.loads(c))),
    "json_text": lambda c: [" ".join(json_values(json.loads(c)))], "xml_content": lambda c: _xml(c).content,
    "xml_paths": lambda c: dict.fromkeys(_xml(c).paths), "html": html_lines,
}


def parsed_units(docs: DataFrame, id_col: str, content_col: str, kind: str) -> DataFrame:
    """Units of each content by a parser, in Arrow batches. Empty contents give none; those that don't parse are left out."""

    def run(batches):
        parse = _KINDS[kind]
        for batch in batches:
            ids, out = [], []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = [str(u) for u in parse(content)] if content and content.strip() else []
                except (ValueError, ET.ParseError, RecursionError):
                    continue
                ids += [k] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["item_id", "unit"])

    return docs.select(F.col(id_col).cast("string"), F.col(content_col).cast("string")).mapInArrow(run, "item_id string, unit string")


def coerced(rows: DataFrame, id_col: str, units_col: str, include_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Arrays of units as (item_id, unit), and one row of counts: items, empty (no unit but nulls and blanks) and skipped (no id or
    a null array). An item without units is left out, or has the unit NULL with include_empty."""
    given = rows.select(F.col(id_col).cast("string").alias("item_id"), F.col(units_col).cast("array<string>").alias("given"))
    kept = F.array_distinct(F.filter(F.transform("given", strip), lambda u: u.isNotNull() & (u != "")))
    sets = given.select("item_id", kept.alias("units"))
    fit = F.col("item_id").isNotNull() & F.col("units").isNotNull()
    counts = sets.agg(F.count_if(fit).alias("items"), F.count_if(fit & (F.size("units") == 0)).alias("empty"), F.count_if(~fit).alias("skipped"))
    spread = F.explode_outer if include_empty else F.explode
    return sets.where(fit).select("item_id", spread("units").alias("unit")).distinct(), counts


def register(spark) -> None:
    """SQL table functions json_units, json_path_units, xml_units, xml_path_units and html_units of (content)."""
    from pyspark.sql.functions import udtf

    def make(kind):
        class Units:
            def eval(self, content: str):
                try:
                    for unit in _KINDS[kind](content) if content else ():
                        yield (str(unit),)
                except (ValueError, ET.ParseError):
                    return

        return udtf(Units, returnType="unit string")

    for name, kind in (("json_units", "json_content"), ("json_path_units", "json_paths"), ("xml_units", "xml_content"), ("xml_path_units", "xml_paths"), ("html_units", "html")):
        spark.udtf.register(name, make(kind))
