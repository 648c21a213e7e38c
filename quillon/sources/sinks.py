"""Exports: CSV folders written by Spark, and small XLSX files written by the driver."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str) -> int:
    """Write one CSV file with a header below ``path``; no rows: no file.  Returns the number of rows."""
    n = df.count()
    if n:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return n


def export_xlsx(df: DataFrame, path: str, links: tuple[int, ...] = (), most: int = 1_048_575) -> int:
    """Write a sheet, which holds ``most`` rows at the utmost, a row at a time; ``links``: columns (from 0) of addresses.

    More rows than a sheet can hold are an error, and nothing is written.
    """
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows; a sheet holds {most}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Export" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')

        def cell(v, link: bool) -> str:
            s = "" if v is None else str(v)
            if link and s.startswith("http"):
                q = s.replace('"', '""')
                return f"<c t=\"str\"><f>{escape(f'HYPERLINK({chr(34)}{q}{chr(34)})')}</f><v>{escape(s)}</v></c>"
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(s)}</t></is></c>'

        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(("<row>" + "".join(cell(c, False) for c in df.columns) + "</row>").encode())
            for row in df.toLocalIterator():
                f.write(("<row>" + "".join(cell(v, i in links) for i, v in enumerate(row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    return n


def schools_sheet(schools: DataFrame) -> DataFrame:
    """The schools' seven columns as a sheet shows them, by name."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return schools.orderBy("school_name", "id").select(F.col("school_name").alias("School"), F.col("city").alias("City"), F.col("state").alias("State"), F.col("district_name").alias("District"), blank("website_url").alias("Website"), F.when(F.col("scraped") != 0, "Yes").otherwise("No").alias("Scraped"), blank("scrape_status").alias("Status"))


def payloads(schools: DataFrame, records: DataFrame) -> DataFrame:
    """``nces_id`` and ``payload``, the JSON document of a school with its ``records`` (``nces_id``, ``pos`` and the fields); nulls are written.

    This is what :mod:`quillon.streaming.ingest` reads.
    """
    fields = [c for c in records.columns if c not in ("nces_id", "pos")]
    got = records.groupBy("nces_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", *fields))), lambda x: x.dropFields("pos")).alias("records"))
    keys = ["nces_id", "school_name", "city", "state", "district_name", "website_url", "school_level", "is_arts_school"]
    school = F.struct(*[F.col(k) if k in schools.columns else F.lit(None).cast("string").alias(k) for k in keys])
    about = [F.col(c) if c in schools.columns else F.lit(None).cast("string").alias(c) for c in ("status", "directory_url", "paths_attempted", "resolution")]
    doc = F.struct(school.alias("school"), *about, F.coalesce("records", F.array().cast(got.schema["records"].dataType)).alias("records"))
    return schools.join(got, "nces_id", "left").select("nces_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))
