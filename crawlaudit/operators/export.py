"""Spreadsheet-safe exports and text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U

BOM = "﻿"


def guarded(v: Column) -> Column:
    """Cell text that a spreadsheet will not run as a formula."""
    s = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_cell(v: Column) -> Column:
    """Guarded cell, quoted where it needs to be."""
    quoted = lambda s: F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    return T.let(guarded(v), quoted)


def csv_lines(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    """One ``csv_line`` per row for the given column -> label map."""
    return df.select(*keep, F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("csv_line"))


def csv_header(columns: dict[str, str]) -> str:
    """Header line with the byte-order mark."""
    cells = [f"'{v}" if v[:1] in "=+-@\t\r" and v else v for v in columns.values()]
    return BOM + ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in cells)


def write_csv(df: DataFrame, path: str, columns: dict[str, str], partition_by: list[str] | None = None) -> None:
    """Distributed CSV: guarded cells, CRLF, RFC quoting, one header per file."""
    parts = partition_by or []
    out = df.select(*parts, *[guarded(F.col(c)).alias(label) for c, label in columns.items()])
    w = out.write.mode("overwrite")
    w = w.partitionBy(*parts) if parts else w
    w.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", encoding="UTF-8")


def write_exact_csv(df: DataFrame, path: str, columns: dict[str, str], order_by: list[str]) -> None:
    """Byte-exact rendering for spreadsheet-sized extracts.

    Rows are range-partitioned, so the parts in name order make one file; the first carries
    the marked header line.
    """
    lines = csv_lines(df, columns, *order_by)
    head = df.sparkSession.createDataFrame([(csv_header(columns),)], "csv_line string")
    body = lines.orderBy(*order_by).select("csv_line")
    head.coalesce(1).unionByName(body).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_name(kind: str, url: Column, day: Column) -> Column:
    """host-kind-YYYY-MM-DD.csv with unsafe characters replaced."""
    host = F.coalesce(U.bare_host(url), F.lit("page"))
    name = F.concat(host, F.lit(f"-{kind}-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv"))
    return F.regexp_replace(name, r"(?i)[^a-z0-9.\-_]", "_")


# Columns and labels of each export.
LINK_COLUMNS = {
    "href": "URL", "raw": "Href as written", "text": "Anchor text", "text_source": "Anchor source", "kind": "Type",
    "rel": "Rel", "target": "Target", "visible": "Visible",
}
IMAGE_COLUMNS = {
    "src": "Image URL", "raw": "src as written", "alt_text": "Alt text", "alt_status": "Alt status", "title": "Title",
    "natural": "Natural size", "displayed": "Displayed size", "loading": "Loading", "visible": "Visible",
}
HREFLANG_COLUMNS = {
    "lang": "hreflang", "href": "URL", "source": "Declared in", "status": "Status", "final_url": "Final URL", "links_back": "Links back",
}
QUESTION_COLUMNS = {"question": "Question", "answer": "Answer snippet", "source_title": "Source title", "source": "Source URL"}


def _visible(df: DataFrame) -> Column:
    """yes / no from the optional rendered boxes; visible when unknown."""
    return F.when(F.coalesce("shown", F.lit(True)), "yes").otherwise("no") if "shown" in df.columns else F.lit("yes")


def links_export(links: DataFrame) -> DataFrame:
    """Rows of the links export."""
    return links.select("page_id", "idx", *[c for c in LINK_COLUMNS if c != "visible"], _visible(links).alias("visible"))


def images_export(flagged: DataFrame) -> DataFrame:
    """Rows of the images export."""
    size = lambda w, h: F.when(F.coalesce(F.col(w), F.lit(0)) > 0, F.concat_ws("x", w, h)).otherwise("") if w in flagged.columns else F.lit("")
    return flagged.select(
        "page_id", "idx", "src", "raw", F.coalesce("alt", F.lit("")).alias("alt_text"),
        F.when(F.col("missing_alt"), "missing").when(F.col("empty_alt"), "empty").otherwise("present").alias("alt_status"),
        "title", size("width", "height").alias("natural"), size("shown_width", "shown_height").alias("displayed"), "loading",
        _visible(flagged).alias("visible"),
    )


def hreflang_export(checked: DataFrame) -> DataFrame:
    """Rows of the alternates export."""
    back = F.when(F.col("return_link"), "yes").when(~F.col("return_link"), "no").otherwise("")
    return checked.select("page_id", "idx", "lang", "href", "source", "status", "final_url", back.alias("links_back"))


def questions_export(questions: DataFrame) -> DataFrame:
    """Rows of the questions export."""
    return questions.select("page_id", "idx", *QUESTION_COLUMNS)


def outline(records: DataFrame) -> DataFrame:
    """(page_id, outline): headings indented by level, one per line."""
    line = lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("H"), h["level"].cast("string"), F.lit("  "), h["text"])
    return records.select("page_id", F.array_join(F.transform("headings", line), "\n").alias("outline"))


def url_list(records: DataFrame) -> DataFrame:
    """(page_id, urls): link addresses, one per line."""
    return records.select("page_id", F.array_join(F.transform("links", lambda l: l["href"]), "\n").alias("urls"))


def _lines(df: DataFrame, order: list, text: Column, name: str) -> DataFrame:
    """Join the report lines of one page."""
    per = df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))).alias("l"))
    return per.select("page_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias(name))


def tracker_list(rows: DataFrame) -> DataFrame:
    """(page_id, trackers): ``Tracker: ID`` lines."""
    note = F.when(F.col("id_note") != "No ID found", F.col("id_note"))
    value = F.coalesce("id", note)
    return _lines(rows, ["row_no"], F.concat("name", F.coalesce(F.concat(F.lit(": "), value), F.lit(""))), "trackers")


def tech_list(tab_rows: DataFrame) -> DataFrame:
    """(page_id, tech): ``Tech version`` lines in report order."""
    text = F.concat("name", F.coalesce(F.concat(F.lit(" "), "version"), F.lit("")), F.when(F.col("kind") == "theme", " (theme)").otherwise(""))
    return _lines(tab_rows, ["group_no", "row_ord"], text, "tech")
