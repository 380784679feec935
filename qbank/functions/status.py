"""Status vocabularies and their reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qbank.functions.text import text_key

#: The three verdicts, and the spellings that mean them.
GOOD, BAD, OPEN = "Consistente", "Inconsistente", "Sin revisar"
GOOD_ALIASES = ("consistente", "bien planteado", "bien")
BAD_ALIASES = ("inconsistente", "mal planteado", "mal", "ambiguo")
OPEN_ALIASES = ("sin revisar", "pendiente", "pendiente revision", "pendientes")


def canonical_verdict(c: Column) -> Column:
    """any spelling as one of three verdicts; anything else, and null, is unreviewed."""
    k = text_key(c)
    return F.when(k.isin(*GOOD_ALIASES), GOOD).when(k.isin(*BAD_ALIASES), BAD).otherwise(OPEN)


def verdict_filter(c: Column, wanted: str | None, unknown_policy: str = "all") -> Column:
    """the filter for a verdict; an unknown one filters nothing, or means pending."""
    k = (wanted or "").strip().lower()
    pending = c.isNull() | (c == OPEN)
    if k in ("", "todos"):
        return F.lit(True)
    if k in OPEN_ALIASES:
        return pending
    if k in GOOD_ALIASES:
        return c == GOOD
    if k in BAD_ALIASES:
        return c == BAD
    return pending if unknown_policy == "pending" else F.lit(True)


def normal_status(c: Column, aliases: dict[str, str], default: str = "pending") -> Column:
    """A status by its alias map; unknown values get the default."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))), F.lit(default))


#: Spellings of stage statuses.
STATUS_ALIASES = {
    "pendiente": "pending", "pending": "pending", "procesando": "processing", "processing": "processing", "listo": "ready", "ready": "ready",
    "done": "ready", "complete": "ready", "revision_humana": "ready", "revisado": "ready", "requiere_revision": "needs_review",
    "needs_review": "needs_review", "review": "needs_review", "pending_review": "needs_review", "error": "error", "failed": "error",
}
#: Spellings of pipeline steps.
STEP_ALIASES = {
    "pages": "paginas", "page_selection": "paginas", "pdf_pages": "paginas", "pdf_box_detection": "boxes", "box_detection": "boxes",
    "crop": "crops", "crops_staging": "crops", "figure_segmentation": "segmentacion", "segmentation": "segmentacion",
    "normalization": "normalizacion", "review": "revision",
}


def normal_step(c: Column) -> Column:
    """A step by its alias; other names stay, in lower case."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STEP_ALIASES.items() for x in kv)), low), low)


def reduced_status(total: Column, errors: Column, processing: Column, review: Column, ready: Column) -> Column:
    """A10: the status of a group from its counts."""
    return (
        F.when(total == 0, "pending").when(errors > 0, "error").when(processing > 0, "processing")
        .when(review > 0, "needs_review").when(ready == total, "ready").otherwise("pending")
    )


def first_stage(*stages: tuple[str, Column]) -> Column:
    """The first stage whose count is not zero, else ``none``."""
    out = None
    for name, n in stages:
        out = F.when(n > 0, name) if out is None else out.when(n > 0, name)
    return out.otherwise("none")


def issues(*checks: tuple[str, Column]) -> Column:
    """The codes of the checks that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(code)) for code, c in checks)), lambda x: x.isNotNull())


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The first check of a cascade that holds; null admits the row."""
    out = F.lit(None).cast("string")
    for code, c in reversed(checks):
        out = F.when(c, F.lit(code)).otherwise(out)
    return out
