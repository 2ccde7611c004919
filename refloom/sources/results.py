"""Result artifacts: a summary as JSON with two blanks of indent, and its table as Markdown, beside the full rows as Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: A summary is for people to read: one of more rows is an error, not a cut.
MOST_ROWS = 1000


def write_result(folder: str, name: str, summary: DataFrame, about: dict, rows: DataFrame | None = None) -> None:
    """Write ``<name>.json``, ``<name>.md`` and, if given, ``<name>.parquet`` into a local ``folder``."""
    got = [r.asDict(recursive=True) for r in summary.limit(MOST_ROWS + 1).collect()]
    if len(got) > MOST_ROWS:
        raise ValueError(f"a summary has at most {MOST_ROWS} rows")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / f"{name}.json").write_text(json.dumps({**about, "results": got}, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    cells = [summary.columns, ["---"] * len(summary.columns), *([str(r[c]).replace("|", "\\|") for c in summary.columns] for r in got)]
    head = "".join(f"- {k}: {v}\n" for k, v in about.items())
    (out / f"{name}.md").write_text(f"# {name}\n\n{head}\n" + "".join("| " + " | ".join(row) + " |\n" for row in cells), encoding="utf-8")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{out.resolve().as_uri()}/{name}.parquet")
