"""Reports as Markdown: every report is a list of small tables, each collected from an aggregate of fixed size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hours, sampling

RETENTION = 0.9
DENSITY_FLOOR = 25
FOCUS = 24


def corpus_totals(corpus: DataFrame) -> DataFrame:
    """One row: shows, total hours, shows with byte-estimated durations, mean estimated share."""
    return corpus.agg(
        F.count(F.lit(1)).alias("n_shows"),
        F.coalesce(F.round(F.sum("hours_available"), 1), F.lit(0.0)).alias("total_hours"),
        F.count_if(F.col("hours_estimated_share") > 0).alias("n_estimated"),
        F.avg("hours_estimated_share").alias("mean_share"),
    )


@dataclass
class Sheet:
    """A titled table; rows are cells of any kind."""

    title: str
    columns: tuple[str, ...]
    rows: list[tuple] = field(default_factory=list)

    def text(self) -> str:
        line = lambda cells: "| " + " | ".join(map(shown, cells)) + " |"
        return "\n".join([f"## {self.title}", "", line(self.columns), "|" + " --- |" * len(self.columns), *map(line, self.rows), ""])


def shown(cell) -> str:
    """A cell as text: thousands apart, one decimal, a dash for what is not known."""
    if cell is None:
        return "-"
    if isinstance(cell, bool):
        return "yes" if cell else "no"
    return f"{cell:,.1f}" if isinstance(cell, float) else f"{cell:,}" if isinstance(cell, int) else str(cell)


def percent(part: float, whole: float) -> str:
    return f"{part / whole:.0%}" if whole else "-"


def document(title: str, sheets: list[Sheet]) -> str:
    return "\n".join([f"# {title}", "", *(s.text() for s in sheets if s.rows)])


def tally(df: DataFrame, column: str) -> list[tuple]:
    """(value, rows) of a column with few values, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return [(r[column], r["n"]) for r in counts.collect()]


QUARTILES = ("min", "p25", "median", "p75", "max")


def run_summary(corpus: DataFrame, exclusions: DataFrame, labels: DataFrame | None = None, **params) -> str:
    """What a run took and left: parameters, shows by stage and by rule, their hours and, with labels(match_status, label_value), the matches."""
    total, rules = corpus_totals(corpus).first(), tally(exclusions, "rule")
    kept, out = total["n_shows"], sum(n for _, n in rules)
    sheets = [
        Sheet("Parameters", ("name", "value"), list(params.items())),
        Sheet("Shows by stage", ("stage", "shows", "of frame"), [("frame", kept + out, percent(1, 1)), ("rejected", out, percent(out, kept + out)), ("corpus", kept, percent(kept, kept + out))]),
        Sheet("Rejections by rule", ("rule", "shows", "of rejected"), [(r, n, percent(n, out)) for r, n in rules]),
    ]
    if kept:
        q = hours.quartiles(corpus, "hours_available").first()
        sheets.append(Sheet("Hours of audio", ("corpus", *(f"show {k}" for k in QUARTILES)), [(total["total_hours"], *(q[k] for k in QUARTILES))]))
        sheets.append(Sheet("Durations taken from file sizes", ("shows with some", "mean share of hours"), [(total["n_estimated"], f"{total['mean_share']:.1%}")]))
    if labels is not None:
        sheets.append(Sheet("Label matches", ("status", "shows"), tally(labels, "match_status")))
        sheets.append(Sheet("Values of matched labels", ("value", "shows"), tally(labels.where("match_status = 'matched'"), "label_value")))
    return document("Corpus run", sheets)


def recommendation(show_hours: DataFrame, target: float = RETENTION, floor: int = DENSITY_FLOOR, focus: int = FOCUS) -> DataFrame:
    """One row: shows, dormant ones, the largest H that keeps the target share, its shows, the floor's shows, and the knee."""
    near = show_hours.where(F.col("window_months") == focus)
    total = near.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("total_hours") == 0).alias("n_dormant"))
    survival = hours.survival_table(near)
    best = hours.retention_argmax(survival, total.select("n_total"), target).select("best_h")
    kept = survival.agg(F.max(F.when(F.col("H") == floor, F.col("n_surviving"))).alias("n_floor"))
    bend = hours.knee(survival).select("knee_h", "knee_rate", "mean_rate", "sharp")
    one = total.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(bend))  # a row each
    at_best = survival.select(F.col("H").alias("best_h"), F.col("n_surviving").alias("n_best"))
    return one.join(F.broadcast(at_best), "best_h", "left").withColumn("floor_ok", F.col("n_floor") >= target * F.col("n_total"))


def chosen_hours(r, floor: int) -> tuple[int, int]:
    """(hours a show, shows that have them): the density floor if it keeps enough shows or nothing else does, else the most that does."""
    return (floor, r["n_floor"]) if r["floor_ok"] or r["best_h"] is None else (r["best_h"], r["n_best"])


def budget_report(show_hours: DataFrame, log: DataFrame, names: DataFrame | None = None, target: float = RETENTION, floor: int = DENSITY_FLOOR, focus: int = FOCUS) -> str:
    """How many shows reach which hours, how the focus window is spread, and the hours a show that follow from it."""
    near = show_hours.where(F.col("window_months") == focus)
    r = recommendation(show_hours, target, floor, focus).first()
    if r is None or not r["n_total"]:
        return document("Hours budget", [Sheet("Scope", ("shows",), [(0,)])])
    n, q = r["n_total"], hours.quartiles(near).first()
    logged = log.agg(F.sum("duration_missing_or_unparseable").alias("missing"), F.sum("duration_byte_estimated").alias("estimated")).first()
    young = near.agg(F.count_if("feed_truncated").alias("n")).first()["n"]
    reach = {(x["window_months"], x["H"]): x["n_surviving"] for x in hours.survival_table(show_hours).collect()}
    sides = {x["side"]: x for x in hours.quartile_diagnostics(near).collect()}
    thin = (near if names is None else near.join(names, "show_id", "left")).orderBy("total_hours", "show_id").limit(5).collect()
    pick, stay = chosen_hours(r, floor)
    scope = [("shows", n), ("focus window, months", focus), ("episodes left out for want of a duration", logged["missing"] or 0), ("episodes timed by file size", logged["estimated"] or 0), ("shows younger than the widest window", young), ("shows silent in the focus window", r["n_dormant"])]
    decision = [
        ("shows to keep", f"{target:.0%}"), ("most hours that keep them", r["best_h"]), ("density floor, hours", floor), ("shows at the floor", f"{r['n_floor']:,} ({percent(r['n_floor'], n)})"),
        ("floor keeps enough", r["floor_ok"]), ("steepest loss, shows an hour", r["knee_rate"]), ("it begins at, hours", r["knee_h"]), ("mean loss, shows an hour", r["mean_rate"]), ("that is a sharp bend", r["sharp"]),
        ("**hours a show**", pick), ("shows in the sample", stay), ("hours in the sample", stay * pick),
    ]
    compared = [("lowest quarter" if k == "low" else "all others", x["n_shows"], x["median_minutes"], x["median_episodes"]) for k, x in sides.items()]
    return document("Hours budget", [
        Sheet("Scope", ("figure", "value"), scope),
        Sheet("Shows that reach", ("hours", *(f"{w} months" for w in hours.WINDOWS), "hours of audio in focus"), [(h, *(reach[w, h] for w in hours.WINDOWS), reach[focus, h] * h) for h in hours.GRID]),
        Sheet("Hours a show in focus", QUARTILES, [tuple(q[k] for k in QUARTILES)]),
        Sheet("Short shows against others", ("shows", "number", "median minutes", "median episodes"), sorted(compared, reverse=True)),
        Sheet("Fewest hours", ("show", "hours"), [(x.asDict().get("show_name") or x["show_id"], x["total_hours"]) for x in thin]),
        Sheet("Decision", ("figure", "value"), decision),
    ])


def sample_report(summary: DataFrame, budget: float) -> str:
    """Hours and episodes a show of a sample, and whether every show fills the budget."""
    c = sampling.sample_check(summary).first()
    if c["min_hours"] is None:
        return document("Sample", [Sheet("Shows", ("shows",), [(0,)])])
    row = lambda name, column: (name, *(float(c[f"{k}_{column}"]) for k in ("min", "median", "max")))
    return document("Sample", [
        Sheet("A show", ("figure", "min", "median", "max"), [row("hours", "hours"), row("episodes", "n_eps")]),
        Sheet("Budget", ("hours", "filled by all"), [(float(budget), c["min_hours"] >= budget - 0.01)]),
    ])
