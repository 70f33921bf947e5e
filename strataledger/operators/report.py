"""Statistics as text: a formatter over small result tables, never read back."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a report shows of a table.
MOST = 1000


def number(x) -> str:
    if x is None:
        return "-"
    if isinstance(x, float):
        return f"{x:,.2f}"
    return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def section(title: str, table: DataFrame, order: str | None = None) -> str:
    """One row as name: value lines, several as columns; at most MOST rows come to the driver, and the text says how many are left out."""
    rows = (table.orderBy(order) if order else table).limit(MOST + 1).collect()
    more = table.count() - MOST if len(rows) > MOST else 0
    rows = rows[:MOST]
    lines = [title, "=" * len(title)]
    if len(rows) == 1:
        lines += [f"{c}: {number(rows[0][c])}" for c in table.columns]
    else:
        cells = [list(table.columns), *([number(v) for v in r] for r in rows)]
        widths = [max(len(r[k]) for r in cells) for k in range(len(table.columns))]
        lines += ["  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in cells]
    if more:
        lines.append(f"... and {more:,} more rows")
    return "\n".join(lines) + "\n"


def labelled(edges, right: bool) -> list[str]:
    """Names of bins, by their edges and rule."""
    marks = ("(", "]") if right else ("[", ")")
    return [f"{marks[0]}{a:g}, {b:g}{marks[1]}" for a, b in zip(edges, edges[1:])]


def write(path: str, *sections: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n".join(sections))


def ledger_report(txo: DataFrame) -> str:
    """Global, spent, unspent and comparative statistics of a history."""
    from strataledger.operators import stats

    return "\n".join(
        (
            section("Spent outputs", stats.spent_stats(txo)), section("Unspent outputs", stats.amount_stats(txo)), section("Spent outputs by segment", stats.spent_stats(stats.by_segment(txo), ["segment"]), "segment"),
            section("Unspent outputs by segment", stats.amount_stats(stats.by_segment(txo), ["segment"]), "segment"), section("Spent against unspent", stats.compare_spent_unspent(txo)), section("Segments", stats.compare_segments(txo), "segment"),
            section("Segment medians", stats.segment_medians(txo), "segment"), section("Lifespans by bins of equal width", stats.equal_width_histogram(txo.where("event AND duration > 0"), "duration", 20), "bin"),
        )
    )
