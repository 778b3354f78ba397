"""Readers: Parquet tables, delimited and plain text, JSON lines, qrels, node and link files."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a CSV header at most.
MAX_COLUMNS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Encodings tried in turn; the last one reads anything.
ENCODINGS = ("UTF-8", "ISO-8859-1")


def csv_rows(spark: SparkSession, path: str, schema: str, encoding: str | None = None, tolerant: bool = True) -> DataFrame:
    """Rows of a CSV file with header; malformed rows are left out when tolerant. Ids are what the schema says, never guessed.
    Without an encoding, files that aren't valid UTF-8 are read as Latin-1."""
    if encoding is None:
        valid = spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
        encoding = ENCODINGS[0] if valid else ENCODINGS[1]
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").csv(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The trimmed, non-empty column names of a CSV file, quoted ones too; no rows are read."""
    row = spark.read.text(path).limit(1).select(F.from_csv("value", F.lit(", ".join(f"c{k} string" for k in range(MAX_COLUMNS)))).alias("c")).first()
    return sorted({c.strip() for c in row.c if c is not None} - {""}) if row else []


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines, of an array or of a single object, each file by its own form; no file goes to the driver.
    A file whose first line is a whole value holds lines, else one value. Records that don't parse are null in all fields."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v")).where("v <> ''")
    lines = F.col("v").startswith("{") & F.try_parse_json(F.substring_index("v", "\n", 1)).isNotNull()
    one = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{_struct(schema)}>>")).otherwise(F.array(F.from_json("v", schema)))
    several = F.transform(F.filter(F.split("v", r"\r?\n"), lambda r: F.trim(r) != ""), lambda r: F.from_json(r, schema))
    return text.select(F.explode(F.when(lines, several).otherwise(one)).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def queries(lines: DataFrame) -> DataFrame:
    """qid and text of 'id TAB text' lines; lines without a tab are left out."""
    part = F.split("value", "\t", 2)
    return lines.where(F.size(part) == 2).select(F.trim(part[0]).alias("qid"), part[1].alias("text"))


def ntriples(lines: DataFrame) -> DataFrame:
    """s, p, o and o_kind (iri, blank or literal) of N-Triples lines; comments and malformed lines are left out."""
    form = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'
    part = lambda k: F.regexp_extract("value", form, k)
    plain = part(5)
    for escaped, meant in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"')):
        plain = F.replace(F.replace(plain, F.lit("\\\\"), F.lit("\x00")), F.lit(escaped), F.lit(meant))
    plain = F.replace(plain, F.lit("\x00"), F.lit("\\"))
    kind = F.when(part(3) != "", "iri").when(part(4) != "", "blank").otherwise("literal")
    o = F.when(kind == "iri", part(3)).when(kind == "blank", part(4)).otherwise(plain)
    return lines.where(F.col("value").rlike(form)).select(F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), o.alias("o"), kind.alias("o_kind"))


def graph(spark: SparkSession, vertices: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The saved vertices and edges, and the next local id of each node type."""
    nodes = spark.read.parquet(vertices)
    return nodes, spark.read.parquet(edges), nodes.groupBy("node_type").agg((F.max("local_id") + 1).alias("next_id"))


#: Names of WordprocessingML in a DOCX file.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes that a DOCX or XLSX member may unfold to.
MAX_MEMBER = 256 << 20


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MAX_MEMBER:
        raise ValueError(f"{name} is too large")
    return archive.read(name)


def _docx_text(data: bytes) -> str:
    """Paragraphs, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ET.fromstring(_member(archive, "word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))


def docx(spark: SparkSession, path: str) -> DataFrame:
    """path and content (paragraphs, a line each; null where the file doesn't parse) of DOCX files."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(_docx_text(data))
                except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, content string")


def qrels(lines: DataFrame, form: str = "tab") -> DataFrame:
    """qid, docid and rel of lines (value): four tab-parted fields, or three space-parted whose last character is the grade."""
    if form == "tab":
        part = F.split("value", "\t")
        kept = lines.where(F.size(part) >= 4)
        return kept.select(part[0].alias("qid"), part[2].alias("docid"), part[3].try_cast("int").alias("rel"))
    part = F.split("value", " ")
    kept = lines.where(F.size(part) >= 3)
    return kept.select(part[0].alias("qid"), part[1].alias("docid"), F.substring(part[2], -1, 1).try_cast("int").alias("rel"))


def patterns(lines: DataFrame) -> DataFrame:
    """item_id and unit of 'id TAB a,b,c' lines; lines of another shape are left out."""
    part = F.split("value", "\t")
    good = lines.where(F.size(part) == 2).select(part[0].alias("item_id"), F.explode(F.split(part[1], ",")).alias("unit"))
    return good.select("item_id", F.trim("unit").alias("unit")).where("unit <> ''").distinct()


def nodes(lines: DataFrame) -> DataFrame:
    """id, name, type and attr of 'id TAB name TAB type [TAB floats]' lines; malformed lines have a NULL id."""
    part = F.split("value", "\t")
    good = F.size(part).isin(3, 4)
    return lines.select(F.when(good, part[0].try_cast("long")).alias("id"), F.when(good, part[1]).alias("name"), F.when(good, part[2].try_cast("int")).alias("type"), F.when(F.size(part) == 4, F.split(F.get(part, F.lit(3)), ",").try_cast("array<double>")).alias("attr"))


def links(lines: DataFrame) -> DataFrame:
    """head, tail, type and weight of 'head TAB tail TAB type TAB weight' lines; parts that are no numbers are NULL."""
    part = F.split("value", "\t")
    good = lines.where(F.size(part) == 4)
    return good.select(part[0].try_cast("long").alias("head"), part[1].try_cast("long").alias("tail"), part[2].try_cast("int").alias("type"), part[3].try_cast("double").alias("weight"))
