"""Admission cascades and gates of training records: one reason per reject, or the list of what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.status import STATUS_ALIASES, first_reason, issues, normal_status

#: Spellings of a true flag, and the editor whose reviews count as human.
TRUE = ("1", "true", "yes", "si", "sí")
HUMAN_EDITOR = "human_raw_ocr_editor"
#: Fixed format: the head of a rendered item.
ITEM_HEAD = r"^\s*\\item\s*\[\s*\\textbf\s*\{\s*\d+\s*\.?\s*\}\s*\]"


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def golden_reason(record: Column, status: Column, allowed: tuple[str, ...], text: Column, tag_issues: Column, image: Column) -> Column:
    """why a golden record is no sample: not readable, status, no corrected text, suspect image tags, no image; null admits."""
    low = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return first_reason(
        ("invalid_json", record.isNull()), ("status", ~low.isin(*allowed) if allowed else F.lit(False)), ("missing_corrected_text", blank(text)),
        ("suspect_image_tags", F.size(tag_issues) > 0), ("missing_image", image.isNull()),
    )


def human_reviewed(review_source: Column, step_source: Column) -> Column:
    return F.coalesce(review_source == HUMAN_EDITOR, F.lit(False)) | F.coalesce(step_source == HUMAN_EDITOR, F.lit(False))


def staging_reason(record: Column, raw: Column, reviewed: Column, crop: Column, include_unreviewed: bool = False) -> Column:
    """why a staged record is no sample."""
    return first_reason(
        ("invalid_json", record.isNull()), ("missing_raw_ocr", blank(raw)),
        ("raw_ocr_not_human_reviewed", F.lit(False) if include_unreviewed else ~reviewed), ("missing_crop", crop.isNull()),
    )


def stale(downstream: Column, *flags: Column) -> Column:
    """F16: invalidated downstream, or one of the flags is a spelling of true."""
    out = F.lower(F.trim(F.coalesce(downstream, F.lit("")))) == "invalidated"
    for flag in flags:
        out = out | F.coalesce(F.lower(F.trim(flag.cast("string"))).isin(*TRUE), F.lit(False))
    return out


def input_issues(page: Column, source_page: Column, box: Column, ids: tuple[Column, ...], paths: tuple[Column, ...]) -> Column:
    """F16: what a normaliser's input lacks."""
    none = lambda cs: F.trim(F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in cs), F.lit(""))) == ""
    return issues(
        ("missing:source.page_number", none((page,)) & none((source_page,))), ("invalid:source.bbox_px", F.coalesce(F.size(box) != 4, F.lit(True)) | box.isNull()),
        ("missing:crop_id", none(ids)), ("missing:crop_path", none(paths)),
    )


def input_reason(record: Column, is_stale: Column, crop: Column, raw: Column, missing: Column) -> Column:
    """F16: why a record is no input of the normaliser."""
    return first_reason(
        ("invalid_json", record.isNull()), ("source_stale", is_stale), ("missing_crop", crop.isNull()), ("missing_raw_ocr", blank(raw)),
        ("metadata_incomplete", F.size(missing) > 0),
    )


STAGE_FIELDS = ("model_id", "provider", "version", "fallback")


def metadata_issues(source: dict[str, Column], box: Column, crop: Column, stages: Column, confidence: Column, status: Column) -> Column:
    """what a staged record's metadata lack; ``stages`` is an array of struct(stage, fields...), null without models."""
    plain = issues(
        *((f"missing:source.{name}", blank(source[name])) for name in ("book_code", "instance_type", "pdf_path", "page_number")),
        ("invalid:source.bbox_px", box.isNull() | F.coalesce(F.size(box) != 4, F.lit(True))), ("missing:crop_path", blank(crop)), ("missing:models", stages.isNull()),
    )
    lacks = lambda s: F.filter(
        F.array(*(F.when(blank(s[f]), F.concat(F.lit("missing:models.stages."), s["stage"], F.lit(f".{f}"))) for f in STAGE_FIELDS)), lambda x: x.isNotNull()
    )
    of_stages = F.coalesce(F.flatten(F.transform(stages, lacks)), F.array().cast("array<string>"))
    late = F.filter(
        F.array(
            F.when(confidence.isNull(), F.lit("missing:confidence")),
            F.when(normal_status(F.coalesce(status, F.lit("")), STATUS_ALIASES, "") == "", F.concat(F.lit("invalid:status:"), F.coalesce(status, F.lit("")))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(plain, of_stages, late)


def blocking_issues(metadata: Column, normalized: Column, latex: Column, continues: Column, status: Column) -> Column:
    """what keeps a record from promotion."""
    mine = issues(
        ("missing:normalized", ~normalized), ("missing:final_latex", normalized & blank(latex)),
        ("invalid:final_latex_item", ~blank(latex) & ~F.rlike(F.trim(latex), F.lit(ITEM_HEAD))), ("continuacion:fusionada_con_anterior", F.coalesce(continues, F.lit(False))),
        ("not_ready:human_review", normal_status(F.coalesce(status, F.lit("")), STATUS_ALIASES) != "ready"),
    )
    return F.concat(metadata, mine)
