"""Documents to markdown: routing by name and media type, plain text, office files behind a size guard, and PDF where a reader is at hand."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings and media types of each route.
ENDINGS = {"pdf": ("pdf",), "office": ("docx", "xlsx", "pptx"), "markup": ("html", "htm", "xhtml"), "text": ("md", "markdown", "txt", "text", "csv", "log")}
TYPES = {"pdf": r"^application/pdf$", "office": r"^application/vnd\.openxmlformats-officedocument\.", "markup": r"^(text/html|application/xhtml\+xml)$", "text": r"^text/(?!html)"}
#: Bytes that an archive may hold unpacked, as declared and as read.
MAX_UNPACKED = 250 << 20


def routed(filename: Column, mime: Column) -> Column:
    """route (pdf, office, markup, text or null) and conflict: whether the name's ending and the media type mean different
    routes; text/plain beside a special ending is none, as uploads often say no better."""
    ending = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    by_name, by_type = F.lit(None).cast("string"), F.lit(None).cast("string")
    for route in ENDINGS:
        by_name = F.when(ending.isin(*ENDINGS[route]), route).otherwise(by_name)
        by_type = F.when(kind.rlike(TYPES[route]), route).otherwise(by_type)
    by_type = F.when((by_type == "text") & by_name.isNotNull(), None).otherwise(by_type)
    clash = F.coalesce(by_name != by_type, F.lit(False))
    return F.struct(F.when(~clash, F.coalesce(by_name, by_type)).alias("route"), clash.alias("conflict"))


def _office(data: bytes, most: int) -> str:
    """The paragraphs, cells or slides of an office archive; ValueError when it unpacks to more than most bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError("declared size over the limit")
        wanted = sorted((n for n in z.namelist() if re.fullmatch(r"word/document\.xml|xl/sharedStrings\.xml|ppt/slides/slide\d+\.xml", n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        room, out = most, []
        for name in wanted:
            with z.open(name) as f:
                xml = f.read(room + 1)  # the size that an archive declares may be wrong
            room -= len(xml)
            if room < 0:
                raise ValueError("actual size over the limit")
            for part in ElementTree.fromstring(xml).iter():
                if part.tag.rsplit("}", 1)[-1] in ("p", "si"):
                    text = "".join(t.text or "" for t in part.iter() if t.tag.rsplit("}", 1)[-1] == "t").strip()
                    if text:
                        out.append(text)
    return "\n\n".join(out)


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def extracted(files: DataFrame, most: int = MAX_UNPACKED) -> DataFrame:
    """filename, route, markdown, error of uploads (filename, mime, content): text as UTF-8 with replacements, office files
    and PDF by their readers; what cannot be read has its reason, and no row is lost."""
    r = routed(F.col("filename"), F.col("mime"))
    rows = files.select("filename", r.alias("r"), "content").select("filename", "r.route", "r.conflict", "content")
    why = F.when(F.col("conflict"), "name and media type disagree").when(F.col("route").isNull(), "unknown kind").when(F.col("content").isNull(), "no content")
    rows = rows.withColumn("error", why)
    text = rows.where("error is null and route in ('text', 'markup')").select("filename", "route", F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"), "error")

    @F.pandas_udf("markdown string, error string")
    def read(routes: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for route, data in zip(routes, contents):
            try:
                out.append((_pdf(data) if route == "pdf" else _office(data, most), None))
            except Exception as e:  # a broken file is a row with its reason
                out.append((None, str(e)[:200] or type(e).__name__))
        return pd.DataFrame(out, columns=["markdown", "error"])

    other = rows.where("error is null and route in ('pdf', 'office')").withColumn("x", read("route", "content")).select("filename", "route", "x.markdown", "x.error")
    bad = rows.where("error is not null").select("filename", "route", F.lit(None).cast("string").alias("markdown"), "error")
    return text.unionByName(other).unionByName(bad)


def within_caps(uploads: DataFrame, each: int = 25 << 20, count: int = 50, total: int = 200 << 20) -> DataFrame:
    """pos, verdict of one batch of uploads (pos, size): ok, too large, or over the batch's count or bytes, which fall on all of it."""
    sums = uploads.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    verdict = F.when(F.col("n") > count, "too many files").when(F.col("s") > total, "batch too large").when(F.col("size") > each, "file too large").otherwise("ok")
    return uploads.join(F.broadcast(sums), how="inner").select("pos", verdict.alias("verdict"))  # one row
