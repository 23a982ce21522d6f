"""Writers of logs, manifests, score tables, splits and reports."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report is a small table; more rows than this is an error.
REPORT_ROWS = 10_000

#: Timestamps without zone keep their microseconds.
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_log(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the commit protocol makes the write whole or not at all."""
    rows.write.mode("append" if append else "overwrite").option("timestampNTZFormat", MICROSECONDS).json(path)


def write_ascii_log(rows: DataFrame, path: str) -> None:
    """JSON lines in which every character beyond ASCII is escaped."""

    def escaped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            plain = [json.dumps(json.loads(line), ensure_ascii=True) for line in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(plain, pa.string())], names=["value"])

    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(escaped, "value string").write.mode("overwrite").text(path)


def write_with_anchors(rows: DataFrame, anchors: DataFrame, path: str, anchor_weight: float) -> None:
    """Preference rows at weight 1 and replayed anchors at a lower one, in one manifest."""
    tagged = rows.select(F.lit("preference").alias("kind"), "*", F.lit(1.0).alias("weight"))
    again = anchors.select(F.lit("anchor").alias("kind"), "*", F.lit(anchor_weight).alias("weight"))
    write_log(tagged.unionByName(again, allowMissingColumns=True), path)


def write_table(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header: the given columns, or all in their order."""
    (rows.select(*columns) if columns else rows).write.mode("overwrite").option("header", True).csv(path)


def write_union(parts: Sequence[DataFrame], path: str) -> None:
    """CSV of tables with different columns: all columns, in the order first seen."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    write_table(out, path)


def write_splits(rows: DataFrame, column: str, path: str) -> None:
    """One folder per value of the column."""
    rows.write.mode("overwrite").partitionBy(column).json(path)


def write_outcomes(rows: DataFrame, path: str, accepted: str) -> None:
    """Accepted and rejected rows side by side, from one pass over the rows."""
    rows.withColumn("outcome", F.when(F.col(accepted), "selected").otherwise("rejected")).write.mode("overwrite").partitionBy("outcome").json(path)


def write_manifest(rows: DataFrame, path: str, names: dict[str, str], root: str = "") -> None:
    """Columns renamed, paths under ``root`` made relative."""
    kinds = dict(rows.dtypes)
    cut = lambda c: F.regexp_replace(F.col(c), f"^{root}/", "") if root and kinds[c] == "string" else F.col(c)
    rows.select(*[cut(a).alias(b) for a, b in names.items()]).write.mode("overwrite").json(path)


def save_document(value: dict, path: str) -> None:
    """A JSON document, replaced as a whole."""
    part = f"{path}.part"
    with open(part, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def collected(rows: DataFrame) -> list[dict]:
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in found]


def markdown(rows: DataFrame) -> str:
    """A small table as Markdown."""
    head = rows.columns
    body = [[("" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c])).replace("|", "\\|") for c in head] for r in collected(rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in (head, ["---"] * len(head), *body)) + "\n"


def latex(rows: DataFrame) -> str:
    """A small table as a LaTeX tabular."""
    clean = lambda x: "".join({"_": r"\_", "%": r"\%", "&": r"\&", "#": r"\#"}.get(ch, ch) for ch in x)
    head = rows.columns
    body = [["" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else clean(str(r[c])) for c in head] for r in collected(rows)]
    return "\\begin{tabular}{" + "l" * len(head) + "}\n" + "".join(" & ".join(x) + " \\\\\n" for x in ([clean(h) for h in head], *body)) + "\\end{tabular}\n"


def dashboard(rows: DataFrame, title: str) -> str:
    """A small table as a page of HTML."""
    from html import escape

    cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in xs) + "</tr>"
    return f"<!doctype html><title>{escape(title)}</title><table>{cells('th', rows.columns)}{''.join(cells('td', r.values()) for r in collected(rows))}</table>"
