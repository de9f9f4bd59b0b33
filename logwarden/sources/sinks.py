"""Report outbox and firewall plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report_outbox(reports: DataFrame, folder: str, batch: int) -> None:
    """Put reports out for delivery. A batch written again replaces itself."""
    reports.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def write_firewall_plan(plan: DataFrame, folder: str) -> None:
    """Commands of a plan as text, one per line; nothing is executed."""
    plan.filter("command is not null").select("command").write.mode("overwrite").text(folder)
