"""Hyphenation by patterns and breaking paragraphs into lines at least cost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def patterns(texts: list[str]) -> dict[str, list[int]]:
    """Hyphenation patterns such as `.ab3c` as letters and the values between them."""
    out = {}
    for t in texts:
        letters, values = "", [0]
        for c in t:
            if c.isdigit():
                values[-1] = int(c)
            else:
                letters += c
                values.append(0)
        out[letters] = values
    return out


def hyphenate(word: str, known: dict[str, list[int]], left: int = 2, right: int = 3) -> list[int]:
    """Places in a word where it may be cut: where the largest value of all matching patterns is odd."""
    padded = f".{word.lower()}."
    best = [0] * (len(padded) + 1)
    for i in range(len(padded)):
        for j in range(i + 1, len(padded) + 1):
            for k, v in enumerate(known.get(padded[i:j], ())):
                best[i + k] = max(best[i + k], v)
    return [i for i in range(max(left, 1), len(word) - right + 1) if best[i + 1] % 2]


def break_lines(widths: list[float], space: float, line: float, stretch: float = 0.5, shrink: float = 0.33, tolerance: float = 2.0) -> list[int]:
    """Indices of the first word of each line: least total demerits over all ways to break a paragraph.

    Spaces may stretch and shrink by a share of their width; the last line may be
    short. Where no way keeps to the tolerance a line is as full as it can be.
    """
    n = len(widths)
    best = [(0.0, -1)] + [(float("inf"), -1)] * n
    for end in range(1, n + 1):
        total = 0.0
        for start in range(end - 1, -1, -1):
            total += widths[start]
            gaps = end - start - 1
            natural = total + gaps * space
            if natural - gaps * space * shrink > line and end - start > 1:
                break
            room = line - natural
            if end == n and room >= 0:
                cost = 0.0
            elif gaps == 0:
                cost = 1e7 if room < 0 else (room / line * 100) ** 2 + 1e4
            else:
                ratio = room / (gaps * space * (stretch if room >= 0 else shrink))
                cost = (1 + 100 * abs(ratio) ** 3) ** 2 + (1e6 if ratio > tolerance else 0)
            if best[start][0] + cost < best[end][0]:
                best[end] = (best[start][0] + cost, start)
    out, at = [], n
    while at > 0:
        at = best[at][1]
        out.append(at)
    return out[::-1]


def paragraphs(df: DataFrame, width: int = 72) -> DataFrame:
    """(doc_id, paragraph, line, text): paragraphs (doc_id, paragraph, text) in lines of `width` characters."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, number, text in pdf[["doc_id", "paragraph", "text"]].itertuples(index=False):
                words = (text or "").split()
                starts = break_lines([float(len(w)) for w in words], 1.0, float(width)) if words else []
                rows += [(doc_id, number, i, " ".join(words[a:z])) for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(words)]))]
            yield pd.DataFrame(rows, columns=["doc_id", "paragraph", "line", "text"])

    return df.select("doc_id", "paragraph", "text").mapInPandas(run, "doc_id long, paragraph long, line long, text string")
