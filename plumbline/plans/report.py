"""Sections as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalar import efficiency_band, score_band
from .scan import COMMANDS, Scan
from .topics import TOPICS

LEGENDS = {t[0].removeprefix("clone-"): t[3] for t in TOPICS}


def with_band(df: DataFrame) -> DataFrame:
    """A display band next to scores and efficiencies."""
    if "score" in df.columns:
        return df.withColumn("band", score_band(df["score"]))
    return df.withColumn("band", efficiency_band(df["efficiency"])) if "efficiency" in df.columns else df


def table(df: DataFrame) -> str:
    """The rows of a short frame in columns."""
    names = df.columns
    rows = [[", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v) for v in r] for r in df.collect()]
    if not rows:
        return "  none"
    widths = [max(len(n), *(len(r[i]) for r in rows)) for i, n in enumerate(names)]
    return "\n".join("  " + "  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in [names, *rows])


def render(scan: Scan, command: str = "all") -> str:
    """The sections of a command with counts, legends and the first rows."""
    names, out = COMMANDS[command], []
    if not names:
        return f"{command}: not available; bug findings come from other tools"
    for name in names:
        total = scan.section(name).count()
        out.append(f"{name}: {total}")
        if scan.config.legend and name in LEGENDS:
            out.append("  " + LEGENDS[name])
        out += [table(with_band(scan.top(name))), ""]
    return "\n".join(out)
