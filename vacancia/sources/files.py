"""Text files of the tracker: pipe tables, additions, follow-ups, TSV lists and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import classify

TRACKER = ["date", "company", "role", "score", "status", "pdf", "report", "notes"]
HISTORY = "url string, first_seen string, portal string, title string, company string, status string, location string"
BATCH_INPUT = "id string, url string, source string, notes string"
BATCH_STATE = ("id string, url string, status string, started string, completed string, report_num string, score string, "
               "error string, retries int")
LEDGER = "key string, name string, scan_version int, hit string, missed string, last_probe string, hit_conf string, rejected string"


def read_lines(spark, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_tsv(spark, path: str, schema: str) -> DataFrame:
    """Tab-separated list; missing trailing columns read as NULL, comment lines are skipped."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="PERMISSIVE", comment="#", quote="")


def _cells(line: Column, sep: str = r"\|") -> Column:
    return F.transform(F.split(line, sep), lambda c: F.trim(c))


def leading_int(c: Column) -> Column:
    """Integer a cell opens with, as parseInt reads it."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("long")


def _table(lines: DataFrame, least: int, names: list[str]) -> DataFrame:
    """Rows of a pipe table: enough parts and an integer first cell; a missing last cell is blank."""
    cells = lines.filter(F.startswith("line", F.lit("|"))).withColumn("cells", _cells(F.col("line")))
    rows = cells.withColumn("num", leading_int(F.get("cells", F.lit(1)))).filter((F.size("cells") >= least) & F.col("num").isNotNull())
    keep = [c for c in lines.columns if c != "line"]
    return rows.select(*keep, "num", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names, 2)])


def tracker_rows(lines: DataFrame) -> DataFrame:
    return _table(lines, 9, TRACKER)


def follow_up_rows(lines: DataFrame) -> DataFrame:
    rows = _table(lines, 8, ["appNum", "date", "company", "role", "channel", "contact", "notes"])
    return rows.withColumn("appNum", leading_int(F.col("appNum")))


_SCORE = r"^\d+\.?\d*/5$"
_STATUS_WORD = ("(?i)^(evaluated|applied|responded|interview|offer|rejected|discarded|skip|evaluada|aplicado|respondido|entrevista"
                "|oferta|rechazado|descartado|no aplicar|cerrada|duplicado|repost|condicional|hold|monitor)")


def addition_rows(contents: DataFrame) -> DataFrame:
    """Additions from a pipe row or a tab row of eight or nine cells; status and score are told apart by content."""
    text = F.trim("content")
    piped = F.startswith(text, F.lit("|"))
    cells = F.when(piped, F.filter(_cells(text), lambda c: c != "")).otherwise(F.split(text, "\t"))
    rows = contents.withColumns({"cells": cells, "piped": piped}).filter(F.size("cells") >= 8)

    def cell(i: int) -> Column:
        return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))

    def like_score(c: Column) -> Column:
        return F.rlike(c, F.lit(_SCORE)) | c.isin("N/A", "DUP")

    c4, c5 = F.trim(cell(4)), F.trim(cell(5))
    opens_status = F.rlike(c4, F.lit(_STATUS_WORD)) & ~like_score(c4)
    swapped = F.col("piped") | (~opens_status & like_score(c4) & F.rlike(c5, F.lit(_STATUS_WORD)))
    keep = [c for c in contents.columns if c != "content"]
    num = leading_int(cell(0))
    return rows.filter(F.coalesce(num, F.lit(0)) != 0).select(
        *keep, num.alias("num"), cell(1).alias("date"), cell(2).alias("company"), cell(3).alias("role"),
        F.when(swapped, c4).otherwise(c5).alias("score"), classify.merge_status(F.when(swapped, c5).otherwise(c4)).alias("status"),
        cell(6).alias("pdf"), cell(7).alias("report"), cell(8).alias("notes"))


def harvest_urls(lines: DataFrame, checkbox_only: bool = False) -> DataFrame:
    """Distinct urls of free text, or only those of checkbox lines."""
    pattern = r"- \[[ x]\] (https?://\S+)" if checkbox_only else r"(https?://[^\s|)]+)"
    return lines.select(F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("url")).distinct()


def company_roles(lines: DataFrame) -> DataFrame:
    """Employer and role pairs of table rows in lower case, header left out."""
    cells = _cells(F.col("line"))
    rows = lines.filter(F.startswith("line", F.lit("|"))).select(
        F.lower(F.get(cells, F.lit(3))).alias("company"), F.lower(F.get(cells, F.lit(4))).alias("role"))
    return rows.filter("company <> '' and role <> '' and company <> 'company'").distinct()


# --- reports ------------------------------------------------------------------------------------

_FENCE = r"(?is)##\s*Machine Summary\s*\n+```(?:yaml|yml|json)?\s*\n(.*?)\n```"
# Summary keys and the table labels that carry the same field.
SUMMARY = {"company": None, "role": None, "archetype": "Archetype|Arquetipo", "legitimacy_tier": None, "final_decision": None,
           "seniority": "Seniority|Nivel|Level", "remote": "Remote|Remoto|Location", "team_size": "Team|Team size|Equipo",
           "comp": "Comp|Salary|Salario|Listed salary", "domain": "Domain|Dominio|Industry", "risk_level": None,
           "confidence": None, "next_action": None}
SCORES = {"cvMatch": "CV Match|Match con CV", "northStar": "North Star", "comp": "Comp", "cultural": "Cultural signals|Cultural",
          "global": "Global"}


def _scalar(block: Column, key: str) -> Column:
    """Value of a top-level key; quotes are taken off, a hash inside quotes stays."""
    raw = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    quoted = F.regexp_extract(raw, r"""^(["'])(.*)\1\s*(?:#.*)?$""", 2)
    plain = F.trim(F.regexp_replace(raw, r"\s+#.*$", ""))
    return F.nullif(F.when(F.rlike(raw, F.lit("^[\"']")), quoted).otherwise(plain), F.lit(""))


def _items(block: Column, key: str) -> Column:
    body = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]+-.*(?:\n|\z))*)", 1)
    found = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]+-[ \t]*(.*)$"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(F.trim(s), "^[\"']|[\"']$", ""))), lambda s: s != "")


def gap_table(content: Column) -> Column:
    """array<struct<description,severity,mitigation>> of the gap table."""
    body = F.regexp_extract(content, r"(?is)\|\s*Gap\s*\|\s*Severity\s*\|[^\n]*\n\|[-|\s]+?\n(.*?)(?:\n\n|\n##|\n\*\*|\z)", 1)
    rows = F.filter(F.split(body, "\n"), lambda r: F.startswith(r, F.lit("|")))
    cells = F.transform(rows, lambda r: F.filter(_cells(r), lambda c: c != ""))
    return F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.struct(
        F.get(c, F.lit(0)).alias("description"), F.lower(F.get(c, F.lit(1))).alias("severity"),
        F.coalesce(F.get(c, F.lit(2)), F.lit("")).alias("mitigation")))


def distinct_gaps(gaps: Column) -> Column:
    """Gaps whose description was not seen before, whatever its case."""
    return F.filter(gaps, lambda g, i: F.array_position(F.transform(gaps, lambda x: F.lower(x["description"])), F.lower(g["description"])) == i + 1)


def report_rows(reports: DataFrame, content: str = "content") -> DataFrame:
    """Report fields: the fenced summary wins, table cells fill what it leaves out."""
    keep = [c for c in reports.columns if c != content]
    cut = reports.withColumns({"_sum": F.regexp_extract(content, _FENCE, 1), "_plain": F.replace(F.col(content), F.lit("**"), F.lit(""))})

    def cell(label: str | None, value: str = "(.*?)") -> Column:
        if label is None:
            return F.lit(None).cast("string")
        return F.nullif(F.trim(F.regexp_extract("_plain", rf"(?i)\|[ \t]*(?:{label})[ \t]*\|[ \t]*{value}[ \t]*\|", 1)), F.lit(""))

    fields = [F.coalesce(_scalar(F.col("_sum"), key) if key != "comp" else F.lit(None), cell(label)).alias(key) for key, label in SUMMARY.items()]
    scores = {n: cell(label, r"([\d.]+)/5").try_cast("double") for n, label in SCORES.items()}
    scores["global"] = F.coalesce(_scalar(F.col("_sum"), "score").try_cast("double"), scores["global"])
    scores["redFlags"] = cell("Red flags", r"([-+]?[\d.]+)").try_cast("double")

    def gaps_of(key: str, severity: str) -> Column:
        return F.transform(_items(F.col("_sum"), key), lambda d: F.struct(d.alias("description"), F.lit(severity).alias("severity"), F.lit("").alias("mitigation")))

    gaps = F.concat(gaps_of("hard_stops", "hard stop"), gaps_of("soft_gaps", "soft gap"), gap_table(F.col(content)))
    return cut.select(*keep, *fields, F.struct(*[c.alias(n) for n, c in scores.items()]).alias("scores"), gaps.alias("_gaps"),
                      _items(F.col("_sum"), "top_strengths").alias("top_strengths")).withColumn("gaps", distinct_gaps(F.col("_gaps"))).drop("_gaps")


def header_preview(content: Column) -> Column:
    """struct(archetype, tldr, remote, comp, url, batch_id) as the dashboard previews a report.

    The url and batch id are read in the whole header, up to the first section.
    """
    def field(*patterns: str) -> Column:
        hits = [F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(content, "(?i)" + p + r"(.+)", 1)), r"\|+$", "")), F.lit("")) for p in patterns]
        return F.coalesce(*hits, F.lit(""))

    tldr = field(r"\*\*TL;DR\*\*\s*\|\s*", r"\*\*TL;DR:\*\*\s*")
    head = F.substring_index(content, "\n## ", 1)
    return F.struct(
        field(r"\*\*Arquetipo(?:\s+detectado)?\*\*\s*\|\s*", r"\*\*Arquetipo:\*\*\s*").alias("archetype"),
        F.when(F.length(tldr) > 120, F.concat(F.substring(tldr, 1, 117), F.lit("..."))).otherwise(tldr).alias("tldr"),
        field(r"\*\*Remote\*\*\s*\|\s*").alias("remote"), field(r"\*\*Comp\*\*\s*\|\s*").alias("comp"),
        F.nullif(F.regexp_extract(head, r"(?m)^\*\*URL:\*\*\s*(https?://\S+)", 1), F.lit("")).alias("url"),
        F.nullif(F.regexp_extract(head, r"(?m)^\*\*Batch ID:\*\*\s*(\d+)", 1), F.lit("")).alias("batch_id"))
