"""Forms and their inputs from HTML: nesting that flat patterns can't see."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = ("input", "select", "textarea")
_ATTRIBUTES = ("name", "id", "autocomplete", "placeholder", "aria-label", "accept", "capture")
_INPUT = pa.struct({k: pa.string() for k in ("input_type", "name", "id_attribute", "autocomplete", "placeholder", "label", "accept", "capture")})
SCHEMA = "form_no int, action string, method string, inputs array<struct<input_type:string,name:string,id_attribute:string,autocomplete:string,placeholder:string,label:string,accept:string,capture:string>>"


class _Collector(HTMLParser):
    """Attributes only, never values. An input (no select, no textarea) outside every form counts only where a page has no form at all."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.forms: list[dict] = []
        self.orphans: list[dict] = []
        self.open = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.open = {"action": given.get("action", ""), "method": given.get("method", "GET").upper(), "inputs": []}
            self.forms.append(self.open)
        elif tag in _FIELDS:
            values = [given.get(a, "") for a in _ATTRIBUTES]
            kind = given.get("type", "")
            names = ("name", "id_attribute", "autocomplete", "placeholder", "label", "accept", "capture")
            rest = dict(zip(names, values, strict=True))
            if self.open is not None:
                self.open["inputs"].append({"input_type": kind or tag, **rest})
            elif tag == "input":
                self.orphans.append({"input_type": kind or "text", **rest})

    def handle_endtag(self, tag: str) -> None:
        if tag == "form":
            self.open = None


def collected(html: str | None) -> list[dict]:
    parser = _Collector()
    parser.feed(html or "")
    parser.close()
    if parser.forms or not parser.orphans:
        return parser.forms
    return [{"action": "", "method": "GET", "inputs": parser.orphans}]


def forms(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, form_no, action, method, inputs): a row a form, in page order; rows on their own, no shuffle."""
    source = pages.select(id_column, html_column)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for n, page in enumerate(batch.column(1).to_pylist()):
                for k, form in enumerate(collected(page)):
                    rows.append(n)
                    found.append((k, form["action"], form["method"], form["inputs"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.list_(_INPUT))],
                [id_column, "form_no", "action", "method", "inputs"],
            )

    return source.mapInArrow(parse, f"`{id_column}` {source.dtypes[0][1]}, {SCHEMA}")


def with_types(found: DataFrame) -> DataFrame:
    """found with types: the data types that each form's inputs ask for, in order, and has_password and has_otp."""
    from tidewatch.functions import classifier

    lists = F.transform("inputs", lambda i: classifier.data_types(i["input_type"], i["name"], i["id_attribute"], i["autocomplete"], i["placeholder"], i["label"], i["accept"], i["capture"]))
    out = found.withColumn("types", classifier.folded(lists))
    kinds = F.transform("inputs", lambda i: F.lower(i["input_type"]))
    return out.withColumn("has_password", F.array_contains("types", "PASSWORD") | F.array_contains(kinds, "password")).withColumn("has_otp", F.array_contains("types", "OTP") | F.array_contains(kinds, "one-time-code"))
