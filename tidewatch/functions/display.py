"""What the user interface shows of a decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spaced(name: Column) -> Column:
    """Underscores as spaces."""
    return F.replace(name, F.lit("_"), F.lit(" "))


def escaped(text: Column) -> Column:
    """text as the content of an HTML element: & < > and the no-break space as character references, quotes as they are."""
    for sign, reference in (("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def percent(confidence: Column) -> Column:
    """A confidence of 0 to 1 as a whole percentage; halves go up."""
    return F.floor(confidence * 100 + 0.5)


def bar_width(confidence: Column) -> Column:
    """Percent of the width that the bar of a confidence takes, 5 at least; null stays null."""
    return F.when(confidence.isNotNull(), F.greatest(F.lit(5.0), confidence * 100))


def joined(values: Column) -> Column:
    """The values with commas between; null or none: 'None detected'."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, ", ")).otherwise("None detected")


def reason_items(reasons: Column) -> Column:
    """A list item of HTML for each reason, one after the other."""
    return F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("<li>"), escaped(spaced(r)), F.lit("</li>"))), "")
