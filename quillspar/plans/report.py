"""The Markdown report: small ranked and summed tables, formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.functions.text import markdown_cell
from quillspar.plans import inventory, migration, readiness


def _table(rows: DataFrame, columns: list[str], most: int = 50) -> list[str]:
    """A Markdown table of at most `most` rows; the report shows heads of tables and says so, the tables hold all."""
    cells = rows.select(*[markdown_cell(F.col(c).cast("string")).alias(c) for c in columns]).limit(most + 1).collect()
    note = [f"The first {most} of {rows.count()} rows.", ""] if len(cells) > most else []
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(r) + " |" for r in cells[:most]), "", *note]


def markdown(ranked: DataFrame, services: DataFrame, title: str) -> str:
    """Summary, bands, services, first priorities, plan, readiness; every figure is a count of findings."""
    totals = inventory.totals(ranked)
    out = [f"# {title}", "", "## Totals", "", *_table(totals, totals.columns)]
    out += ["## Bands", "", *_table(inventory.by_band(ranked), ["band", "n"])]
    out += ["## Algorithms", "", *_table(inventory.by_algorithm(ranked), ["algorithm", "n"])]
    out += ["## Services", "", *_table(inventory.by_service(ranked, services), ["service", "findings", "quantum_vulnerable", "critical", "high", "hndl", "migration_status"])]
    out += ["## First priorities", "", *_table(inventory.top_findings(ranked, 5), ["id", "algorithm", "operation", "file", "line_start", "band", "qmp"])]
    out += ["## Migration", "", *_table(migration.planner_rows(ranked), ["rank", "id", "algorithm", "role", "migration_rule", "direction", "human_review"])]
    out += ["## Readiness", "", *_table(readiness.level(inventory.live(ranked)), ["level"]), *_table(readiness.categories(inventory.live(ranked)).orderBy("category"), ["category", "n", "files", "services"])]
    return "\n".join(out)
