"""Parts as rows of the section classifier, and the same in SQL: used by S28 and A29."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qbank.functions import classify
from qbank.functions.text import search_key


def classify_sql() -> str:
    hit = {s: "(" + "|".join(words) + ")" for s, words in classify.KEYWORDS.items()}
    score = ", ".join(f"struct_pack(l := -(4 * cast(regexp_matches(b, '{p}') as integer) + cast(regexp_matches(t, '{p}') as integer)), s := '{s}')" for s, p in hit.items())
    return f"""with k as (select p_partkey, p_partkey % 7 c, case p_partkey % 5 when 0 then 'algebra' when 1 then 'seno' when 2 then 'rectas' else 'x' end b, case p_partkey % 3 when 0 then 'mcm y seno' when 1 then 'parabola' else '' end t from part),
m as (select *, list_min([{score}]) best from k)
select p_partkey, case when c = 0 then 'Geometria' when best.l < 0 then best.s else 'General' end section, case when c = 0 or best.l <= -4 then 'alta' when best.l <= -2 then 'media' else 'baja' end confidence from m"""


def sections(parts: DataFrame) -> DataFrame:
    """``p_partkey, s``: the classifier over made-up courses, books and texts; the keys come first, in their own projection."""
    k = F.col("p_partkey")
    course = F.when(k % 7 == 0, " Geometría PLANA ")
    book = F.when(k % 5 == 0, "ÁLGEBRA").when(k % 5 == 1, "Seno").when(k % 5 == 2, "rectas").otherwise("x")
    words = F.when(k % 3 == 0, "MCM y seno").when(k % 3 == 1, "Parábola").otherwise("")
    keyed = parts.select(k, search_key(course).alias("course"), search_key(book).alias("book_code"), search_key(words).alias("text"))
    return keyed.select("p_partkey", classify.training_section(F.col("course"), book_code=F.col("book_code"), text=F.col("text")).alias("s"))
