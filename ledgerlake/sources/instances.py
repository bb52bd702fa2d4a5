"""Instance documents from files and archives, read by a pull parser: facts and contexts leave it as they come."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A parser gets so many bytes at a time and passes its rows on in batches of so many.
CHUNK, ROWS = 1 << 20, 5_000
#: Where an archive has its public documents, and what annual reports' names hold.
PUBLIC, ANNUAL = "XBRL/PublicDoc/", "-asr-"
FACTS = "path string, filing_id string, fact_seq long, tag string, context_ref string, unit_ref string, decimals string, value_raw string"
CONTEXTS = "path string, filing_id string, context_id string, start_date date, end_date date, instant date, is_consolidated boolean, duration_days int"


def instance_in(names: list[str]) -> str | None:
    """An archive's instance document: public documents before others, annual reports, the shortest name, A to Z."""
    found = [n for n in names if n.lower().endswith((".xbrl", "_htm.xml"))] or [n for n in names if n.lower().endswith(".xml") and "/" not in n]
    return min(found, key=lambda n: (PUBLIC not in n, ANNUAL not in n.lower(), len(n), n.lower()), default=None)


def _opened(path: str, content: memoryview) -> io.IOBase | None:
    raw = io.BytesIO(content)
    if not path.lower().endswith(".zip"):
        return raw
    try:
        archive = zipfile.ZipFile(raw)
        name = instance_in(archive.namelist())
        return archive.open(name) if name else None
    except zipfile.BadZipFile:
        return None


class _Facts:
    """Elements with a contextRef in the order in which they begin; their own text up to a first child."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.done, self.n, self.open, self.text = 0, 0, [], []

    def begin(self, name: str, attributes: dict[str, str]) -> None:
        if self.open and self.open[-1] is not None and self.open[-1][1] is None:
            self.open[-1][1] = "".join(self.text)
        self.text = []
        if "contextRef" not in attributes:
            self.open.append(None)
            return
        self.open.append([(self.n, name.rsplit(":", 1)[-1], attributes["contextRef"], attributes.get("unitRef"), attributes.get("decimals")), None])
        self.n += 1

    def data(self, text: str) -> None:
        if self.open and self.open[-1] is not None and self.open[-1][1] is None:
            self.text.append(text)

    def end(self, _: str) -> None:
        fact = self.open.pop()
        if fact is not None:
            self.rows.append((*fact[0], ("".join(self.text) if fact[1] is None else fact[1]).strip()))
        self.text = []


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text.strip()) if text else None
    except ValueError:
        return None


class _Contexts:
    """Contexts with their dates; consolidated ones have no segment."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.now, self.segment, self.dates, self.text = None, False, {}, []

    def begin(self, name: str, attributes: dict[str, str]) -> None:
        name, self.text = name.rsplit(":", 1)[-1], []
        if name == "context":
            self.now, self.segment, self.dates = attributes.get("id"), False, {}
        elif name == "segment":
            self.segment = True

    def data(self, text: str) -> None:
        self.text.append(text)

    def end(self, name: str) -> None:
        name = name.rsplit(":", 1)[-1]
        if name in ("startDate", "endDate", "instant"):
            self.dates[name] = _day("".join(self.text))
        elif name == "context":
            start, end = self.dates.get("startDate"), self.dates.get("endDate")
            self.rows.append((self.now, start, end, self.dates.get("instant"), not self.segment, (end - start).days if start and end else None))
        self.text = []


def _rows_of(stream: io.IOBase, kind: type) -> Iterator[list[tuple]]:
    """The document's rows in batches; a document that isn't well-formed gives those before its fault."""
    found, parser = kind(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = found.begin, found.data, found.end
    while True:
        chunk = stream.read(CHUNK)
        try:
            parser.Parse(chunk, not chunk)
        except expat.ExpatError:
            chunk = b""
        while len(found.rows) >= ROWS or (found.rows and not chunk):
            yield found.rows[:ROWS]
            del found.rows[:ROWS]
        if not chunk:
            return


def _read(kind: type, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, filing, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stream = _opened(path, memoryview(content.as_buffer()))
                for rows in _rows_of(stream, kind) if stream else ():
                    columns = [[path] * len(rows), [filing] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return work


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "date": pa.date32(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in text.split(", "))])


def instance_files(spark: SparkSession, path: str, names: str = "*", filing: str = r"([^/]+?)(?:_htm)?\.[^./]+$") -> DataFrame:
    """path, filing_id (the part of the path that the pattern `filing` catches: by default the name without its ending) and
    content of all files below a folder; Spark lists and reads them, from any store that it reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return rows.select("path", F.regexp_extract("path", filing, 1).alias("filing_id"), "content")


def write_bundles(documents: DataFrame, path: str) -> None:
    """Instance documents (filing_id, xml) as JSON lines, many a file: a file for each would cost its own listing and opening."""
    documents.select(F.col("filing_id").cast("string").alias("filing_id"), "xml").write.json(path)


def instance_bundles(spark: SparkSession, path: str) -> DataFrame:
    """What instance_files gives, of what write_bundles wrote: path is the bundle's."""
    rows = spark.read.schema("filing_id string, xml string").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "filing_id", F.encode("xml", "UTF-8").alias("content"))


def read_facts(files: DataFrame) -> DataFrame:
    """Facts of instance documents (path, filing_id, content: XML or a zip archive that holds one) in document order.

    A task holds one document's bytes and some thousand rows. Broken archives, archives without an instance document and
    empty files give no row; a document that isn't well-formed gives what comes before its fault. Values are trimmed;
    elements without a text give an empty one.
    """
    return files.select("path", "filing_id", "content").mapInArrow(_read(_Facts, _schema(FACTS)), FACTS)


def read_contexts(files: DataFrame) -> DataFrame:
    """Contexts of the same files with their dates (null where they are none), duration, and whether they are consolidated."""
    return files.select("path", "filing_id", "content").mapInArrow(_read(_Contexts, _schema(CONTEXTS)), CONTEXTS)
