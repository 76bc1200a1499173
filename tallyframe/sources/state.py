"""Sources and sinks: saved states, descriptions, level-preserving Parquet, sheets."""

from __future__ import annotations

import datetime
import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import with_levels


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, levels: dict[str, list] | None = None, mode: str = "errorifexists") -> None:
    """Write with ordered levels in the columns' metadata, which Parquet keeps; texts lose blanks at their ends."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.trim(f"`{c}`") for c in strings})
    for c, x in (levels or {}).items():
        df = with_levels(df, c, x)
    df.write.mode(mode).parquet(path)


def save_state(spark: SparkSession, state: dict, path: str) -> list[str]:
    """Save frames as Parquet and plain values as JSON under a folder; returns the names saved. Other objects are left out."""
    values, frames = {}, []
    for name, x in state.items():
        if not re.fullmatch(r"[A-Za-z]\w*", name):
            continue
        if isinstance(x, DataFrame):
            x.write.mode("overwrite").parquet(f"{path}/frames/{name}")
            frames.append(name)
        else:
            try:
                values[name] = json.loads(json.dumps(x))
            except (TypeError, ValueError):
                continue
    manifest = json.dumps({"frames": frames, "values": values})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return sorted([*frames, *values])


def load_state(spark: SparkSession, path: str, into: dict | None = None) -> dict:
    """Read a saved state into a dict; nothing in it is executed."""
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    into = {} if into is None else into
    into.update(manifest["values"])
    for name in manifest["frames"]:
        into[name] = spark.read.parquet(f"{path}/frames/{name}")
    return into


def add_description(df: DataFrame, text: str) -> DataFrame:
    """Put a description into the metadata of the first column."""
    first = df.columns[0]
    return df.withMetadata(first, {**(df.schema[first].metadata or {}), "description": text})


def describe(df: DataFrame) -> str | DataFrame:
    """The description, or else a summary of the columns."""
    found = (df.schema[0].metadata or {}).get("description") if df.columns else None
    return found if found is not None else df.summary()


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    """The place of a cell like BC12, from 0."""
    n = 0
    for c in ref:
        if c.isdigit():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
    known = {*range(14, 23), *range(45, 48)} | {k for k, v in own.items() if re.search("[dmyhs]", v.lower()) and "0" not in v.split(".")[0]}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId") or 0) in known}


def sheet_rows(data: bytes, sheet: int | str = 0) -> list[list]:
    """The cells of a sheet (by place or name) of an .xlsx file, row by row: numbers, texts, booleans, datetimes and None."""
    if data[:2] != b"PK":
        raise ValueError("Not an .xlsx file (older formats are not read)")
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        found = [(s.get("name"), s.get(_LINK)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        pick = [x for i, x in enumerate(found) if sheet in (i, x[0])]
        if not pick:
            raise ValueError(f"No sheet {sheet}; there are: {', '.join(n for n, _ in found)}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[pick[0][1]]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book)
        out: list[list] = []
        for row in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            cells: list = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None or kind == "e":
                    continue
                elif kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = v.text == "1"
                elif kind == "str":
                    cells[at] = v.text
                elif int(c.get("s") or 0) in dates:
                    cells[at] = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v.text))
                else:
                    x = float(v.text)
                    cells[at] = int(x) if x.is_integer() and abs(x) < 1 << 53 else x
            at = int(row.get("r") or len(out) + 1)
            out += [[] for _ in range(at - 1 - len(out))] + [cells]
    return out


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of an .xlsx file, its first row the names, as a frame. Columns are bigint, double, boolean, timestamp or string
    by what their cells have; mixed ones are strings. Read through Spark, from any file system; a sheet fits the driver."""
    rows = sheet_rows(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), sheet)
    if not rows:
        raise ValueError("The sheet is empty")
    names = [str(n) if n is not None else f"column_{i}" for i, n in enumerate(rows[0])]
    body = [(r + [None] * len(names))[: len(names)] for r in rows[1:] if any(x is not None for x in r)]
    kinds = []
    for i in range(len(names)):
        have = {type(r[i]) for r in body if r[i] is not None}
        one = "bigint" if have <= {int} and have else "double" if have <= {int, float} and have else "boolean" if have == {bool} else "timestamp" if have == {datetime.datetime} else "string"
        kinds.append(one)
        fix = {"double": float, "string": lambda x: x if isinstance(x, str) else str(x)}.get(one, lambda x: x)
        for r in body:
            r[i] = None if r[i] is None else fix(r[i])
    schema = T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {k}")[0].dataType) for n, k in zip(names, kinds, strict=True)])
    return spark.createDataFrame([tuple(r) for r in body], schema)
