"""Text of HTML pages."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Pages that are Python objects at the same time.
AT_ONCE = 64


class _Pieces(HTMLParser):
    """Keeps each run of character data, script and style bodies included."""

    def reset(self):
        super().reset()
        self.pieces: list[str] = []

    def handle_data(self, data: str):
        self.pieces.append(data)


def page_text(page: str | None) -> str | None:
    """All character data up to the end of the page, also what an element that is never closed holds.

    Entities are resolved twice, as pages often carry text that was escaped before: `&amp;amp;` gives `&`.
    """
    if page is None:
        return None
    reader = _Pieces()
    reader.feed(page)
    reader.close()
    if reader.rawdata:  # held back by the parser: the body of a script or style element without an end
        reader.handle_data(reader.rawdata)
    return unescape("\n".join(reader.pieces))


@arrow_udf(StringType())
def html_to_text(pages: pa.Array) -> pa.Array:
    """Character data of a page, one line per run, entities resolved. A batch stays in Arrow's form but for a few pages."""
    parts = [pa.array(map(page_text, pages.slice(at, AT_ONCE).to_pylist()), pa.string()) for at in range(0, len(pages), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
