"""The report of all projects: which tables it shows, by which column their best row is marked, and the frames behind its figures."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.plans import demand_queries, ladders, model_queries, pair_queries, rec_queries, txn_queries
from tidemark.session import drop_stages
from tidemark.sources import sinks

#: project -> tables (query and the column of the best row, and whether more is better) and figures (query, x, y, series).
PROJECTS = {
    "Fraud": {
        "tables": {"models": (ladders.fraud_ladder, "average_precision", True)},
        "figures": {"calibration of the rule score": (txn_queries.calibration_bins, "mean_predicted", "observed", None)},
    },
    "Demand": {
        "tables": {"models": (model_queries.learned_backtest_summary, "wape", False), "categories": (demand_queries.metrics_by_category, "wape", False)},
        "figures": {"error by days ahead": (model_queries.learned_by_horizon_day, "days_ahead", "wape", "model")},
    },
    "Question pairs": {
        "tables": {"models": (ladders.pair_ladder, "roc_auc", True), "split": (pair_queries.split_report, None, True)},
        "figures": {"duplicates by number of tokens": (pair_queries.duplicates_by_tokens, "n_tokens", "duplicate_rate", None)},
    },
    "Recommendation": {
        "tables": {"models": (ladders.rec_ladder, "recall", True), "log": (rec_queries.interaction_summary, None, True)},
        "figures": {"recall by activity": (ladders.rec_ladder_by_activity, "median_history", "recall", "model")},
    },
}


def plot_frames(spark: SparkSession, d: str, project: str) -> dict:
    """The frames behind a project's figures, by figure."""
    return {name: f[0](spark, d) for name, f in PROJECTS[project]["figures"].items()}


def write_report(spark: SparkSession, d: str, folder: str, projects: tuple[str, ...] = tuple(PROJECTS)) -> Path:
    """Computes the tables of the projects, writes them as metrics.json, and the page with tables and figures as report.html."""
    shown, numbers = {}, {}
    for project in projects:
        p = PROJECTS[project]
        with drop_stages():
            tables = {n: [r.asDict() for r in q(spark, d).limit(1000).collect()] for n, (q, _, _) in p["tables"].items()}
            frames = {n: [r.asDict() for r in df.limit(10_000).collect()] for n, df in plot_frames(spark, d, project).items()}
        best = {n: (column, more) for n, (_, column, more) in p["tables"].items() if column}
        shown[project] = {"tables": tables, "best": best, "figures": {n: sinks.svg_lines(frames[n], x, y, s) for n, (_, x, y, s) in p["figures"].items()}}
        numbers[project] = {"tables": tables, "figures": frames}
    sinks.write_metrics(f"{folder}/metrics.json", numbers)
    page = Path(folder) / "report.html"
    page.write_text(sinks.project_report(shown, "Report"))
    return page
