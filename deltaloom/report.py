"""The text report of a comparison."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from deltaloom.spec import DiffSummary


def top_drift(mismatches: dict[str, int], limit: int) -> list[tuple[str, int]]:
    """The columns with most mismatches; columns with equal counts keep their order."""
    return sorted(mismatches.items(), key=lambda item: -item[1])[:limit]


def render(summary: DiffSummary) -> str:
    verdict = "PASSED" if summary.is_match else "FAILED"
    facts = {
        "Status": verdict + (" (Perfect Match)" if summary.is_perfect_match else ""),
        "Match Rate": f"{summary.match_rate_percentage}%",
        "Source Rows": f"{summary.total_rows_source:,}",
        "Target Rows": f"{summary.total_rows_target:,}",
        "Volume Shift": f"{summary.volume_shift:+,} rows",
    }
    rows = {
        "Added": summary.added_count,
        "Removed": summary.removed_count,
        "Changed": summary.changed_count,
        "Total Issues": summary.total_mismatches,
    }
    blocks = [
        ("Dataset comparison", [f"{name + ':':<15}{value}" for name, value in facts.items()]),
        ("Rows that differ", [f"{name + ':':<15}{value:,}" for name, value in rows.items()]),
    ]
    if drift := top_drift(summary.column_mismatches, summary.report_limit):
        blocks.append(("Columns that drift most", [f"- {name}: {count:,} mismatches" for name, count in drift]))
    return "\n\n".join("\n".join([title, "-" * len(title), *lines]) for title, lines in blocks) + "\n"
