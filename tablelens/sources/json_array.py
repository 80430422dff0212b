"""One large JSON array (S06) cut into its elements by many tasks.

The text is split at every ``}``, which ends each object, so also an array on a single line has many
pieces. A piece's braces and brackets outside strings change the depth; an element ends where the depth is one
again (see ``splits``). Elements are written as one line each, and read back as JSON Lines.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablelens.session import checkpoint_dir
from tablelens.sources import splits

#: what is left at a file's end: the array's bracket, and the brace that stands for the piece's end
_END = re.compile(r"\]?\s*\}?")
_STRING, _TO_QUOTE = re.compile(r'"(?:[^"\\]|\\.)*"', re.S), re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def step(piece: str, inside: bool, depth: int) -> tuple[bool, int, bool]:
    """State after a piece and the ``}`` that ended it."""
    text = piece + "}"
    if inside:
        end = _TO_QUOTE.match(text)
        if not end:
            return True, depth, False
        text = text[end.end():]
    bare = _STRING.sub("", text)
    open_ = bare.find('"')
    if open_ >= 0:
        bare = bare[:open_]
    depth += bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    return open_ >= 0, depth, open_ < 0 and depth == 1


def elements(text: str) -> list[str]:
    """The objects of a stretch of whole elements, each without line breaks; what else there is comes last."""
    out, open_, inside, depth = [], [], False, 1
    *parts, tail = text.split("}")
    for piece in parts:
        open_.append(piece + "}")
        inside, depth, ends = step(piece, inside, depth)
        if ends:
            out.append("".join(open_))
            open_ = []
    out.append("".join(open_) + tail)
    cleaned = [re.sub(r"[\r\n]+", " ", e.strip(" \t\r\n,")) for e in out]
    return [e for e in cleaned if e and not _END.fullmatch(e)]


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The table of files that each hold one JSON array of objects."""
    parts = splits.pieces(spark, path, "}")
    starts = splits.entries(parts, "}", step, lambda piece: False)

    def parse(text: str, begins: bool) -> list[tuple]:
        return [(e,) for e in elements(text.lstrip().removeprefix("[") if begins else text)]

    lines = splits.records(parts, starts, "}", step, lambda inside, depth: not inside and depth == 1, (False, 1), parse, ["value"])
    place = os.path.join(checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    lines.write.text(place)
    return spark.read.json(place)
