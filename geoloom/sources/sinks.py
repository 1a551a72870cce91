"""Writers: chunked layers, delimited text, statistical files, fingerprints, partial overwrite, saved tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import layers

#: Rows that a driver-side file (workbook, statistical file) may have.
MOST_FILE_ROWS = 1_000_000


def write_layer(df: DataFrame, path: str, chunk: str = "chunk") -> DataFrame:
    """Feature lines in a folder for each chunk; returns the index (chunk, box, areas), written beside them."""
    df.repartition(F.col(chunk)).write.mode("overwrite").partitionBy(chunk).json(f"{path}/features")
    index = layers.index(df, chunk).orderBy("chunk")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/index")
    return index


def csv_line(*columns: Column) -> Column:
    """A CSV line: cells with commas, quotes or line breaks are quoted, quotes doubled; nulls are empty."""
    cell = lambda c: F.coalesce(F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))
    return F.concat_ws(",", *(cell(c.cast("string")) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files for spreadsheets: each begins with a byte order mark and the header, and its lines end with CRLF."""
    header = "\ufeff" + ",".join(f'"{c}"' if "," in c else c for c in df.columns)

    def lines(batches):
        first = True
        for b in batches:
            body = b["line"].tolist()
            yield pd.DataFrame({"value": ([header + "\r"] if first else []) + [x + "\r" for x in body]})
            first = False

    df.select(csv_line(*(F.col(f"`{c}`") for c in df.columns)).alias("line")).mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def write_session(path: str, data: DataFrame, script: list[str], log: list[str], maps: dict[str, DataFrame]) -> None:
    """A session's folder: data and maps as CSV, the lines that were asked and what became of them as text."""
    spark = data.sparkSession
    write_csv(data, f"{path}/data.csv")
    for name, lines in (("script.txt", script), ("log.txt", log)):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    for name, df in maps.items():
        write_csv(df, f"{path}/map_{name}.csv")


def write_tsv(df: DataFrame, path: str, total: DataFrame | None = None) -> None:
    """Tab-separated rows, a total row last if there is one."""
    out = df.withColumn("_last", F.lit(0))
    if total is not None:
        out = out.unionByName(total.withColumn("_last", F.lit(1)))
    out.orderBy("_last").drop("_last").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df has; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def fingerprint(*columns: Column, salt: str = "") -> Column:
    """The first twelve hex digits of a salted SHA-256 of the values, nulls as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256), 1, 12)


def encrypted(text: Column, key: bytes) -> Column:
    return F.base64(F.aes_encrypt(text, F.lit(key), F.lit("GCM")))


def decrypted(data: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(data), F.lit(key), F.lit("GCM")).cast("string")


def legal(names: list[str]) -> dict[str, str]:
    """Names that statistical programs accept (32 characters, no reserved word), unique; renamed ones map to the new."""
    taken, out = set(), {}
    for n in names:
        base = re.sub(r"[^A-Za-z0-9_]", "_", n)[:32] or "v"
        if not re.match(r"[A-Za-z_]", base) or base.lower() in ("if", "in", "using", "with", "byte", "int", "long", "float", "double"):
            base = ("v_" + base)[:32]
        new, k = base, 2
        while new.lower() in taken:
            new = f"{base[: 31 - len(str(k))]}_{k}"
            k += 1
        taken.add(new.lower())
        out[n] = new
    return out


def _bounded(df: DataFrame, most: int = MOST_FILE_ROWS) -> pd.DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    return df.toPandas()


def stata(df: DataFrame, labels: dict[str, dict[int, str]] | None = None) -> tuple[bytes, dict[str, str]]:
    """A Stata file (118) of a bounded table, and the renamed columns."""
    return stata_bytes(_bounded(df), labels)


def stata_bytes(x: pd.DataFrame, labels: dict[str, dict[int, str]] | None = None) -> tuple[bytes, dict[str, str]]:
    names = legal(list(x.columns))
    x = x.rename(columns=names)
    for c in x.columns:
        if x[c].dtype == object or str(x[c].dtype) in ("str", "string"):
            x[c] = x[c].astype(object).where(x[c].notna(), "")
    out = io.BytesIO()
    x.to_stata(out, write_index=False, version=118, value_labels={names[k]: v for k, v in (labels or {}).items()} or None)
    return out.getvalue(), {k: v for k, v in names.items() if k != v}


def workbook(sheets: dict[str, pd.DataFrame]) -> bytes:
    """An XLSX workbook with inline texts, a sheet for each table."""

    def column(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(r: int, c: int, v) -> str:
        ref = f"{column(c)}{r}"
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {space} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, x in enumerate(sheets.values(), 1):
            rows = [list(x.columns), *x.astype(object).values.tolist()]
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {space}><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def bundle(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


class Saved:
    """Tables that a user keeps, as managed tables of one database."""

    def __init__(self, spark: SparkSession, database: str = "saved"):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").saveAsTable(f"{self.database}.{name}")

    def list(self) -> list[str]:
        return sorted(x.name for x in self.spark.catalog.listTables(self.database))

    def get(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")
