"""Main text of HTML pages by the distribution of line blocks.

Markup is stripped, block-level tags end lines, and each line i gets the summed
length of the lines i .. i + window - 1. Where that sum surges above `surge`
main text begins; where it dives below `dive` it ends; the text in between is
kept, without the short lines (menus, by-lines) that the window drew in at
either end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>", re.I | re.S)
_BREAK = re.compile(
    r"</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|thead|tbody|section|article|header|footer|nav|main|aside|blockquote|pre|form|fieldset|figure|figcaption|hr|body|html|option|select|address)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"<[A-Za-z/][^>]*>")
_SPACE = re.compile(r"[^\S\n]+")

SCHEMA = "page_id long, url string, text string, n_lines int, kept_lines int"


def _closed(pattern: re.Pattern, to: str, page: str) -> str:
    """pattern.sub(to, page) for patterns that end in '>': no mark opens behind the last one, where each would be sought to the end of the page."""
    end = page.rfind(">") + 1
    return pattern.sub(to, page[:end]) + page[end:]


def _dropped(page: str) -> str:
    """The page without comments, scripts and declarations. Marks behind the last '>', but for comments, open nothing and are hidden from the pattern."""
    end = page.rfind(">") + 1
    if "<" not in page[end:]:
        return _DROP.sub(" ", page)
    hidden = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in page)
    return _DROP.sub(" ", page[:end] + re.sub("<(?!!--)", hidden, page[end:])).replace(hidden, "<")


def lines_of(page: str) -> list[str]:
    """The stripped lines of a page; lines without text are empty strings."""
    bare = _closed(_TAG, "", _closed(_BREAK, "\n", _dropped(page)))
    if "&" in bare:
        bare = html.unescape(bare)
    return [x.strip() for x in _SPACE.sub(" ", bare).split("\n")]


def block_sums(lengths: np.ndarray, window: int) -> np.ndarray:
    """Sum of lengths[i : i + window] for every i."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    i = np.arange(len(lengths))
    return total[np.minimum(i + window, len(lengths))] - total[i]


def kept_lines(lengths: np.ndarray, window: int, surge: int, dive: int) -> np.ndarray:
    """Mask of the lines between surge and dive points."""
    keep = np.zeros(len(lengths), bool)
    sums = block_sums(lengths, window)
    least = surge / window
    inside, start = False, 0
    for i, s in enumerate([*sums.tolist(), -1]):
        if not inside and s >= surge:
            inside, start = True, i
        elif inside and s < dive:
            long = np.flatnonzero(lengths[start:i] >= least)
            if len(long):
                keep[start + long[0] : start + long[-1] + 1] = True
            inside = False
    return keep


def main_text(page: str | None, window: int = 3, surge: int = 120, dive: int = 60) -> tuple[str | None, int, int]:
    """(text, lines with text, lines kept); (None, 0, 0) for null."""
    if page is None:
        return None, 0, 0
    lines = [x for x in lines_of(page)]
    lengths = np.array([len(x) for x in lines], np.int64)
    keep = kept_lines(lengths, window, surge, dive) & (lengths > 0)
    return "\n".join(x for x, k in zip(lines, keep) if k), int((lengths > 0).sum()), int(keep.sum())


def extract(pages: DataFrame, window: int = 3, surge: int = 120, dive: int = 60) -> DataFrame:
    """page_id, url, text, n_lines, kept_lines of pages(page_id, url, html, ...).

    A null page has a null text and no lines; an empty page, or one whose blocks
    never reach `surge`, an empty text. Unclosed comments and scripts run to the
    end of the page. Null ids and addresses stay null, repeated rows are
    extracted each, an empty table gives an empty result, and other columns are
    not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [main_text(p if isinstance(p, str) else None, window, surge, dive) for p in rows["html"]]
            text, lines, kept = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"page_id": rows["page_id"].astype("Int64"), "url": rows["url"], "text": list(text), "n_lines": list(lines), "kept_lines": list(kept)})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, SCHEMA)
