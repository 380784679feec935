"""SNK1-SNK6: datasets, tables, reports and text exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qbank.functions.geometry import yolo_line


def write_splits(rows: DataFrame, reason: str, path: str) -> DataFrame:
    """SNK1: admitted rows as JSON lines by ``split``, rejects beside them; returns the manifest of counts."""
    good, bad = rows.where(F.col(reason).isNull()), rows.where(F.col(reason).isNotNull())
    good.drop(reason).write.mode("overwrite").partitionBy("split").json(f"{path}/splits")
    bad.write.mode("overwrite").json(f"{path}/skipped")
    return rows.groupBy(F.coalesce(F.col(reason), F.col("split")).alias("what")).agg(F.count("*").alias("n"))


def csv_view(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SNK2: the columns in fixed order as text, missing values blank."""
    have = set(rows.columns)
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    csv_view(rows, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_records(new: DataFrame, old: DataFrame | None, key: str, path: str) -> None:
    """SNK3: a keyed table with the new records in place of the old ones, into a fresh folder."""
    out = new if old is None else new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
    out.write.mode("overwrite").parquet(path)


def report(rows: DataFrame, most_rows: int = 1000) -> dict[str, str]:
    """SNK4: a small aggregate as JSON, CSV and Markdown; a larger one is refused."""
    got = [r.asDict() for r in rows.limit(most_rows + 1).collect()]
    if len(got) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows")
    names = rows.columns
    line = lambda r, mark: mark.join("" if r[c] is None else str(r[c]) for c in names)
    return {
        "json": json.dumps(got, ensure_ascii=False, default=str),
        "csv": "\n".join([",".join(names), *(line(r, ",") for r in got)]),
        "markdown": "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + line(r, " | ") + " |" for r in got)]),
    }


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str, mark: str = "\n\n") -> DataFrame:
    """SNK5: each group's texts in order as one; groups are files, of bounded size."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), mark).alias("document"))


def yolo_labels(boxes: DataFrame, images: DataFrame, image: str, width: Column, height: Column, digits: int = 6) -> DataFrame:
    """SNK6: label lines of every image, in reading order; images without boxes get an empty file."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    line = F.struct("y1", "x1", "y2", "x2", yolo_line(box, width, height, digits).alias("line"))
    lines = boxes.groupBy(image).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["line"]), "\n").alias("labels"))
    return images.select(image).join(lines, image, "left").select(image, F.coalesce("labels", F.lit("")).alias("labels"))
