"""Commands: sets of summary queries whose tables are saved together, with the record of the run.

Every query of a command gives a summary whose size does not grow with the data. A step that fails is recorded and
does not stop the others.
"""

from __future__ import annotations

import csv
import json
import os
import time

from pyspark.sql import SparkSession

from . import results, settings

COMMANDS: dict[str, tuple[str, ...]] = {
    "inspect": ("corpus_inspect", "hour_histogram", "dow_profile", "heading_residual", "frame_mean", "grid_angle", "pca_angle", "orientation_choice", "geometric_median"),
    "audit": ("translation_error", "rotation_audit", "time_shift_audit", "empirical_lipschitz", "saturation_curve", "noise_saturation", "gram_distortion", "procrustes_error", "rigid_sweep"),
    "tokens": ("lattice_shifts", "lattice_period", "permutation_agreement", "permutation_transfer", "permutation_match", "token_perplexity", "gauge_defect"),
    "probe": ("ridge_probe", "degenerate_targets"),
    "anomaly": ("anomaly_counts", "auroc_by_type", "hanley_mcneil"),
    "similarity": ("mr_mrr_mp", "kp_at_k", "hit_ratio", "tie_fraction", "acc_at_k"),
    "downstream": ("destination_error", "regression_metrics", "eta_linear", "classification_metrics", "tul_majority"),
    "relocate": ("sweep_moves", "rigid_sweep"),
    "compare": ("critical_difference", "rank_cliques", "improvements", "paired_tests", "spearman_rank", "paired_differences"),
}


def run(spark: SparkSession, command: str, data: str, out: str, options: dict | None = None, given: dict | None = None) -> dict:
    """The command's tables as JSON at out/command.json, its settings beside it; returns what was saved."""
    from .. import catalogue

    if command not in COMMANDS:
        raise ValueError(settings._hint(command, COMMANDS))
    queries, record, found, failed = catalogue.queries(), results.record(command, (options or {}) | {"data": data}), {}, {}
    for name in COMMANDS[command]:
        began = time.time()
        try:
            found[name] = [r.asDict() for r in queries[name](spark, data).collect()]
        except Exception as error:  # one step's failure is a result of its own
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
        record.setdefault("seconds", {})[name] = round(time.time() - began, 3)
    record["failed"] = failed
    results.save(found, os.path.join(out, f"{command}.json"), record, settings.checked(given or {}))
    return found


def run_all(spark: SparkSession, data: str, out: str, only: tuple[str, ...] = tuple(COMMANDS)) -> dict[str, str]:
    """Every command; what became of each."""
    state = {}
    for command in only:
        run(spark, command, data, out)
        with open(os.path.join(out, f"{command}.json")) as f:
            failed = json.load(f)["_run"]["failed"]
        state[command] = f"failed: {', '.join(failed)}" if failed else "done"
    return state


def tidy(out: str, path: str) -> int:
    """All saved tables as one long CSV (command, table, row, column, value), from which figures and tables can be drawn; its number of rows."""
    n = 0
    with open(path, "w", newline="") as f:
        rows = csv.writer(f)
        rows.writerow(["command", "table", "row", "column", "value"])
        for name in sorted(os.listdir(out)):
            if not name.endswith(".json"):
                continue
            with open(os.path.join(out, name)) as g:
                tables = json.load(g)
            for table, lines in tables.items():
                if table != "_run":
                    for k, line in enumerate(lines):
                        for column, value in line.items():
                            rows.writerow([name[:-5], table, k, column, value])
                            n += 1
    return n


def latex(out: str, command: str, table: str) -> str:
    """A saved table as LaTeX."""
    with open(os.path.join(out, f"{command}.json")) as f:
        lines = json.load(f)[table]
    if not lines:
        return ""
    names = [*lines[0]]
    text = lambda v: ("--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)).replace("_", r"\_").replace("#", r"\#").replace("%", r"\%")
    body = [" & ".join(text(x[c]) for c in names) + r" \\" for x in lines]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(names)}}}", " & ".join(map(text, names)) + r" \\ \hline", *body, r"\end{tabular}"]) + "\n"
