"""Raw items of an archive to whole sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def parse_sections(raw: DataFrame) -> DataFrame:
    """Sections of raw items (act_id, pos, section_number, title, body_html, footnote_html, is_repealed): act_id, section_no, marginal_note, text_verbatim, text_raw, footnotes, amendment_note, is_omitted, order_idx.

    The number loses blanks and its full stop; an empty note is null; notes are cut from
    the footnotes' own text. Omitted: the source says so, or note or text do. order_idx
    counts from 0 in each act by `pos`. Null markup counts as empty.
    """
    plain = lambda c: T.html_to_text(F.coalesce(F.col(c), F.lit("")))
    notes = T.footnotes(plain("footnote_html"))
    p = raw.select(
        "act_id", "pos", F.regexp_replace(F.trim("section_number"), r"\.+$", "").alias("section_no"), F.nullif(plain("title"), F.lit("")).alias("marginal_note"),
        plain("body_html").alias("text_verbatim"), F.col("body_html").alias("text_raw"), notes.alias("footnotes"), F.coalesce("is_repealed", F.lit(False)).alias("is_repealed"),
    )
    omitted = F.col("is_repealed") | T.looks_omitted(F.coalesce("marginal_note", F.lit("")), F.col("text_verbatim"))
    order = F.row_number().over(W.partitionBy("act_id").orderBy("pos")) - 1
    return p.select("act_id", "section_no", "marginal_note", "text_verbatim", "text_raw", "footnotes", T.amendment_note(F.col("footnotes")).alias("amendment_note"), omitted.alias("is_omitted"), order.alias("order_idx"))
