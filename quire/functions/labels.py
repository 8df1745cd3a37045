"""The closed set of block labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and display colour by class id, then what any other id gets.
LABELS = (
    ("Abstract", "#7c3aed"),
    ("Algorithm", "#0891b2"),
    ("AsideText", "#64748b"),
    ("Chart", "#db2777"),
    ("Content", "#475569"),
    ("DisplayFormula", "#9333ea"),
    ("DocTitle", "#dc2626"),
    ("FigureTitle", "#f97316"),
    ("Footer", "#6b7280"),
    ("FooterImage", "#a16207"),
    ("Footnote", "#4b5563"),
    ("FormulaNumber", "#8b5cf6"),
    ("Header", "#374151"),
    ("HeaderImage", "#ca8a04"),
    ("Image", "#ea580c"),
    ("InlineFormula", "#a855f7"),
    ("Number", "#0f766e"),
    ("ParagraphTitle", "#c2410c"),
    ("Reference", "#0369a1"),
    ("ReferenceContent", "#0284c7"),
    ("Seal", "#e11d48"),
    ("Table", "#16a34a"),
    ("Text", "#2563eb"),
    ("VerticalText", "#4f46e5"),
    ("VisionFootnote", "#52525b"),
)
UNKNOWN = ("Unknown", "#111827")


def label_of(class_id: Column) -> Column:
    """Label of a BIGINT class id."""
    names = F.array(*(F.lit(name) for name, _ in LABELS))
    known = (class_id >= 0) & (class_id < len(LABELS))
    return F.when(known, F.get(names, F.when(known, class_id.cast("int")).otherwise(0))).otherwise(F.lit(UNKNOWN[0]))


def color_of(label: Column) -> Column:
    """Display colour; a name outside the set has that of Unknown."""
    colors = F.create_map(*(F.lit(x) for pair in LABELS for x in pair))
    return F.coalesce(F.try_element_at(colors, label), F.lit(UNKNOWN[1]))


def parse_label(name: Column, strict: bool = False) -> Column:
    """The name if it is a label (case matters); else null, or an error if ``strict``."""
    known = name.isin(*(n for n, _ in LABELS), UNKNOWN[0])
    bad = F.raise_error(F.concat(F.lit("unknown layout label: "), name)) if strict else F.lit(None)
    return F.when(known, name).otherwise(bad.cast("string"))
