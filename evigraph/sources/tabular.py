"""Sources: tables whose format is found from their first bytes, workbooks as cells, headers under many names."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.store import kept

# Words of a header -> its name, first hit wins.
EXPRESSION_HEADERS = [
    (["symbol", "gene name"], [], "Symbol"),
    (["fold change", "log2fc"], [], "Log2FoldChange"),
    (["p-value", "pvalue"], [], "PValue"),
    (["adj", "fdr"], [], "Padj"),
    (["id"], ["gene"], "GeneID"),
]


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, read through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not files:
            raise FileNotFoundError(f"no data files in {path}")
        at = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> str:
    """xlsx, parquet, gzip, json, tsv or csv, from the first bytes of a file (or of the first data file of a folder, by name).

    Four kilobytes are read, however large the file; an empty file is csv, a folder without files an error."""
    head = _head(spark, path, 4096)
    if head[:2] == b"PK":
        return "xlsx"
    if head[:4] == b"PAR1":
        return "parquet"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    line = head.split(b"\n", 1)[0]
    if line.lstrip()[:1] in (b"{", b"["):
        return "json"
    return "tsv" if line.count(b"\t") > line.count(b",") else "csv"


def read_flexible(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table from a file of any of these formats, whatever its name ends in; without a schema all columns are text."""
    kind = sniff(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "xlsx":
        return first_sheet(workbook_cells(spark, path))
    if kind == "gzip":
        kind = "tsv"  # gzip cannot be split; repartition what is read if it is large
    reader = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def rename_headers(df: DataFrame, rules: list = EXPRESSION_HEADERS) -> DataFrame:
    """Columns by the first rule that their header meets; a name is given to the first column only."""
    names, taken = [], set()
    for c in df.columns:
        low = c.strip().lower()
        new = next((name for words, also, name in rules if any(w in low for w in words) and all(w in low for w in also)), c.strip())
        names.append(c.strip() if new in taken else new)
        taken.add(new)
    return df.toDF(*names)


def glimpse(df: DataFrame, k: int = 3) -> tuple[list[str], int, DataFrame]:
    """(columns, rows, the first k rows)."""
    return df.columns, df.count(), df.limit(k)


def glimpses(spark: SparkSession, paths: list[str], schema: str = "file string, method string, columns array<string>, n long, error string") -> DataFrame:
    """(file, method, columns, n, error): how each of a few files is read and what it holds; one that can't be read has its error."""
    rows = []
    for path in paths:
        try:
            df = read_flexible(spark, path)
            rows.append((path, sniff(spark, path), df.columns, df.count(), None))
        except Exception as e:  # noqa: BLE001  a file that can't be read is a row of the report
            rows.append((path, None, None, None, type(e).__name__))
    return spark.createDataFrame(rows, schema)


def like_column(df: DataFrame, *words: str) -> str | None:
    """The first column whose name holds all the words."""
    return next((c for c in df.columns if all(w in c.lower() for w in words)), None)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_workbook(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the cells of an xlsx file, rows and columns from 0."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
    # sheets may stand in another order than their files, and files may be missing
    links = "xl/_rels/workbook.xml.rels"
    files = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target"))).lstrip("/") for r in ElementTree.fromstring(book.read(links)).iter() if r.get("Id")} if links in book.namelist() else {}
    for i, s in enumerate(sheets, 1):
        file = files.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None), f"xl/worksheets/sheet{i}.xml")
        if file not in book.namelist() or "/worksheets/" not in file:
            continue
        for c in ElementTree.fromstring(book.read(file)).iter(f"{_NS}c"):
            letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            v = c.find(f"{_NS}v")
            if c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif v is None or v.text is None:
                continue
            else:
                value = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield s.get("name"), int(row) - 1, col - 1, value


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, value) of all workbooks of a path; each is read on an executor."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for file, raw in zip(p["path"], p["content"]):
                yield pd.DataFrame([(file, *cell) for cell in parse_workbook(bytes(raw))], columns=["file", "sheet", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, row int, col int, value string")


def sheet_table(cells: DataFrame, header_row: int = 0) -> DataFrame:
    """A sheet's cells as a table: one row is the headings; their number is the sheet's width."""
    heads = {r["col"]: r["value"] for r in cells.where(F.col("row") == header_row).select("col", "value").collect()}
    cols = sorted(heads)
    wide = cells.where((F.col("row") > header_row) & F.col("col").isin(cols)).groupBy("row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"_{c}") for c in cols])
    return wide.orderBy("row").select("row", *[F.col(f"_{c}").alias(heads[c]) for c in cols])


def first_sheet(cells: DataFrame) -> DataFrame:
    name = cells.select("sheet").first()
    return sheet_table(cells.where(F.col("sheet") == name[0])) if name else cells


def with_headings(cells: DataFrame) -> DataFrame:
    """Cells below the first row of their sheet, with the column's heading."""
    heads = cells.where("row = 0").select("file", "sheet", "col", F.col("value").alias("column"))
    return cells.where("row > 0").join(heads, ["file", "sheet", "col"])


def dump_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, text): the cells of each row as ``C0:a | C2:b``."""
    one = F.struct("col", F.concat(F.lit("C"), F.col("col").cast("string"), F.lit(":"), "value").alias("t"))
    rows = cells.where("value IS NOT NULL").groupBy("sheet", "row").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return rows.select("sheet", "row", F.array_join(F.transform("c", lambda x: x["t"]), " | ").alias("text"))


def is_key_value(cells: DataFrame) -> bool:
    """Whether a workbook is of the older layout, a sheet of Category, Field and Value."""
    heads = cells.where("row = 0").groupBy("sheet").agg(F.collect_set("value").alias("h"))
    return not heads.where(F.array_contains("h", "Category") & F.array_contains("h", "Field") & F.array_contains("h", "Value")).isEmpty()


def event_sheets(cells: DataFrame) -> DataFrame:
    return cells.where(F.contains("sheet", F.lit("Adverse Events")))


def merge_workbooks(base: DataFrame, others: DataFrame, width: int = 31, room: int = 25) -> DataFrame:
    """The cells of all files: sheets of others are prefixed by their file's name; names that are taken get a number."""
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = base.withColumn("_rank", F.lit(0)).withColumn("_name", F.col("sheet")).unionByName(others.withColumn("_rank", F.lit(1)).withColumn("_name", F.concat(stem, F.lit("_"), "sheet")))
    from evigraph.operators.resolve import uniquify

    sheets = uniquify(named.select("file", F.col("sheet").alias("_old"), "_rank", "_name").distinct(), "_name", ["_rank", "file", "_old"], width, room)
    return named.withColumnRenamed("sheet", "_old").join(sheets.select("file", "_old", "sheet"), ["file", "_old"]).select("file", "sheet", "row", "col", "value")


def cached(spark: SparkSession, folder: str, content_key: str, make) -> DataFrame:
    """The table under ``folder``/``content_key``, made and written if it is not there; the key is a hash of the input."""
    path = f"{folder}/{content_key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def class_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes (iri, label), links (child, parent)) of OWL files in RDF/XML; entities of the DTD are replaced."""
    owl, rdf, rdfs = "{http://www.w3.org/2002/07/owl#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for raw in p["content"]:
                for c in ElementTree.fromstring(bytes(raw)).iter(f"{owl}Class"):
                    iri = c.get(f"{rdf}about")
                    if not iri:
                        continue
                    label = c.find(f"{rdfs}label")
                    out.append((iri, label.text if label is not None else None, None))
                    out += [(iri, None, s.get(f"{rdf}resource")) for s in c.iter(f"{rdfs}subClassOf") if s.get(f"{rdf}resource")]
            yield pd.DataFrame(out, columns=["iri", "label", "parent"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "iri string, label string, parent string")
    return rows.where("parent IS NULL").select("iri", "label"), rows.where("parent IS NOT NULL").select(F.col("iri").alias("child"), "parent")


def ancestors(links: DataFrame) -> DataFrame:
    """(child, ancestor, steps): the closure of (child, parent) with the fewest steps. Each round doubles the reach and keeps one row
    of each pair, so diamonds and cycles end, however long the chains; a node of a cycle is an ancestor of its own."""
    first = links.where("child IS NOT NULL AND parent IS NOT NULL").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct()
    found = kept(first)
    while True:
        far = found.alias("a").join(found.alias("b"), F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor", (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        more = kept(found.unionByName(far).groupBy("child", "ancestor").agg(F.min("steps").alias("steps")))
        if more.agg(F.count("*"), F.sum("steps")).first() == found.agg(F.count("*"), F.sum("steps")).first():
            return more
        found = more
