"""Labelled-block parsing (EX-19): 'Title / For ... / Duration: / Frequency: / Value: / Deadline/Opening:'.

The page text (joined by newlines) is split into blocks on a blank line before a capitalised word;
each block is matched once and its named parts are parsed with Catalyst regex / cast expressions.
The deadline part is the rest of its line (the intent; ``faithful_deadline=True`` keeps the
one-character lazy capture of the source system, see SURVEY D4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .text import WS

_MONTHS = "|".join(rules.MONTHS)
BLOCK_SPLIT = rules.BLOCK_SPLIT
BLOCK_INTENT = rules.BLOCK_HEAD + rules.BLOCK_DEADLINE_LINE
BLOCK_FAITHFUL = rules.BLOCK_HEAD + rules.BLOCK_DEADLINE_LAZY
DURATION_RANGE, VALUE = rules.BLOCK_DURATION_RANGE, rules.BLOCK_VALUE
DEADLINE_NAMED_PLAIN = rf"(\d{{1,2}}\s(?:{_MONTHS})\s\d{{4}})"


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def _groups(match: Column, pattern: str, n: int) -> Column:
    """Groups 1..n of ``pattern`` re-read from its own full match, in one regex pass."""
    template = "\u0001".join(f"${i}" for i in range(1, n + 1))
    one_pass = F.split(F.regexp_replace(match, pattern, template), "\u0001")
    per_group = F.array(*[F.regexp_extract(match, pattern, i) for i in range(1, n + 1)])
    return F.when(match.contains("\u0001"), per_group).otherwise(one_pass)


def split_blocks(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BLOCK_SPLIT)


def matched_blocks(text: Column, faithful_deadline: bool = False) -> Column:
    """The matches (EX-19a) of the text's blocks, '' for a block without one; the position is the block's.

    A block without a line that begins with 'For' has no match; the pattern would find that out in the square of its length."""
    p = BLOCK_FAITHFUL if faithful_deadline else BLOCK_INTENT
    return F.transform(split_blocks(text), lambda blk: F.when(blk.contains("\nFor"), F.regexp_extract(blk, p, 0)).otherwise(F.lit("")))


def labelled_blocks(df: DataFrame, id_col: str, text_col: str = "text", faithful_deadline: bool = False
                    ) -> DataFrame:
    """EX-19a..d: one row per matched block with its parsed fields.

    Staged: the block pattern scans each block once (group 0); a single replace over that match
    then yields all named parts (no per-group re-scan); the duration, value and deadline parsers
    are staged the same way, so every regex runs once per part.
    """
    # the match is taken inside the explode, so the filter on it stays above the generator (the
    # optimizer cannot push it down and evaluate the block regex a second time)
    m = df.select(id_col, F.posexplode(matched_blocks(F.col(text_col), faithful_deadline)).alias("block_no", "_m"))
    m = m.filter(F.col("_m") != "").withColumn("block_no", F.col("block_no") + 1)
    parts = with_block_fields(m, "_m", faithful_deadline)
    return parts.select(id_col, "block_no", "title", "description", "frequency", "duration_years", "amount_min", "amount_max",
                        "deadline", "duration_text", "value_text", "deadline_text")


def with_block_fields(m: DataFrame, match_col: str, faithful_deadline: bool = False) -> DataFrame:
    """EX-19b..d: the parsed fields of the match in ``match_col``, beside the row's other columns."""
    p = BLOCK_FAITHFUL if faithful_deadline else BLOCK_INTENT
    own = [c for c in m.columns if c != match_col]
    # one more pass over the (short) match yields all six groups at once, separated by \x01
    # (a block that itself holds \x01 falls back to one extraction per group)
    m = m.select(*own, _groups(F.col(match_col), p, 6).alias("_g"))

    def g(i):
        return F.try_element_at(F.col("_g"), F.lit(i))

    parts = m.select(*own, _strip(g(1)).alias("title"), _strip(g(2)).alias("description"),
                     _nz(g(3)).alias("duration_text"), _nz(g(4)).alias("frequency_text"),
                     _nz(g(5)).alias("value_text"), _nz(g(6)).alias("deadline_text"))
    # staged parsers: each regex runs once per block part, later steps reference the staged columns
    dur, val, dl = (F.coalesce(F.col(c), F.lit("")) for c in ("duration_text", "value_text", "deadline_text"))
    parts = parts.withColumns({
        "_dm": F.regexp_extract(dur, DURATION_RANGE, 0),
        "_vm": F.regexp_extract(val, VALUE, 0),
        "_vs": F.when(val.contains("million") | val.contains("m"), F.lit(1000000.0)).otherwise(F.lit(1.0)),
        "_dn": F.regexp_extract(dl, DEADLINE_NAMED_PLAIN, 1),
        "_dy": _nz(F.regexp_extract(dl, r"(\d{4})", 1)),
    })
    parts = parts.withColumns({
        "_dab": _groups(F.col("_dm"), DURATION_RANGE, 2),
        "_d1": F.when(F.col("_dm") == "", _nz(F.regexp_extract(dur, r"(\d+)\s*year", 1)).try_cast("int")),
        "_vab": _groups(F.col("_vm"), VALUE, 2),
    })
    parts = parts.withColumn("_vlo", F.replace(F.element_at("_vab", 1), F.lit(","), F.lit("")).try_cast("double")
                             * F.col("_vs"))
    vhit = F.col("_vm") != ""
    v2 = _nz(F.element_at("_vab", 2))
    vhi = F.when(v2.isNull(), F.col("_vlo")).otherwise(F.replace(v2, F.lit(","), F.lit("")).try_cast("double")
                                                        * F.col("_vs"))
    years = F.when(F.col("_dm") != "", F.coalesce(_nz(F.element_at("_dab", 2)).try_cast("int"),
                                                   F.element_at("_dab", 1).try_cast("int"))) \
        .otherwise(F.coalesce(F.col("_d1"), F.lit(0)))
    parsed = F.date_format(F.try_to_date(F.regexp_replace(F.col("_dn"), r"\s", " "), "d MMMM yyyy"), "yyyy-MM-dd")
    status = (F.when(F.col("deadline_text").isNull(), F.lit("N/A"))
              .when(dl.contains("Currently closed"), F.lit("Closed"))
              .when(dl.contains("Open all year"), F.lit("Rolling"))
              .when(F.col("_dn") != "", F.coalesce(parsed, F.lit("N/A")))
              .when(F.col("_dy").isNotNull(), F.col("_dy"))
              .otherwise(F.lit("N/A")))
    return parts.select(
        *own, "title", "description",
        F.coalesce(F.col("frequency_text"), F.lit("N/A")).alias("frequency"),
        years.alias("duration_years"),
        F.when(vhit, F.col("_vlo")).otherwise(F.lit(0.0)).alias("amount_min"),
        F.when(vhit, vhi).otherwise(F.lit(0.0)).alias("amount_max"),
        status.alias("deadline"),
        "duration_text", "value_text", "deadline_text")
