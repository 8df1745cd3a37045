"""What a page viewer shows of a result, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

DOT = " · "


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def order_rank(page: str, order: str) -> Column:
    """Rank from 0 of a row's order among the page's distinct ones; null without one."""
    ranked = F.dense_rank().over(Window.partitionBy(page, F.col(order).isNull()).orderBy(order))
    return F.when(F.col(order).isNotNull(), (ranked - 1).cast("bigint"))


def decimals(value: Column, digits: int) -> Column:
    """Fixed decimals of a float's shortest form."""
    return F.format_string(f"%.{digits}f", value.cast("string").cast("double"))


def display_label(rank: Column, label: Column, score: Column) -> Column:
    prefix = F.when(rank.isNull(), "").otherwise(F.concat(rank.cast("string"), F.lit(DOT)))
    return F.concat(prefix, label, F.lit(" "), decimals(score, 3))


def draw_plan(page_width: Column, x: Column, y: Column) -> dict[str, Column]:
    """Line width, font and tag geometry of a block; the tag's width depends on a font and is not here."""
    tag = F.greatest(F.lit(18).cast("bigint"), round_half_up(page_width / 45))
    top = F.greatest(F.lit(0.0), y.cast("double") - tag)
    return {
        "line_width": F.greatest(F.lit(2).cast("bigint"), round_half_up(page_width / 500)),
        "font_px": F.greatest(F.lit(12).cast("bigint"), round_half_up(page_width / 60)),
        "tag_height": tag,
        "tag_y": top,
        "text_x": x.cast("double") + 4,
        "text_y": top + 2,
        "fill_alpha": F.lit(0.12),
    }


def progress_percent(done: Column, total: Column) -> Column:
    safe_total = F.greatest(total, F.lit(0).cast("bigint"))
    safe_done = F.least(F.greatest(done, F.lit(0).cast("bigint")), safe_total)
    return F.when(safe_total == 0, F.lit(0).cast("bigint")).otherwise(round_half_up(safe_done / F.when(safe_total == 0, 1).otherwise(safe_total) * 100))


def elapsed(ms: Column) -> Column:
    """Seconds with one decimal, halves up."""
    tenths = F.floor((ms + 50) / 100).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))


def caption(source: Column, blocks: Column) -> Column:
    return F.concat(source, F.lit(DOT), blocks.cast("string"), F.lit(" blocks"))


def page_source(name: Column, page_index: Column) -> Column:
    return F.concat(name, F.lit("#page="), (page_index + 1).cast("string"))
