"""Bibliographies: BibTeX, RIS, CSL-JSON, EndNote and Atom texts to one table of entries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "doc_id long, node int, key string, kind string, title string, year string, doi string, author string, fields array<string>, line int"
_RIS = {"TI": "title", "T1": "title", "PY": "year", "Y1": "year", "DO": "doi", "AU": "author", "A1": "author", "JO": "journal", "JF": "journal", "T2": "booktitle", "VL": "volume", "SP": "pages", "PB": "publisher", "UR": "url"}
_ENW = {"%T": "title", "%D": "year", "%R": "doi", "%A": "author", "%J": "journal", "%B": "booktitle", "%V": "volume", "%P": "pages", "%I": "publisher", "%U": "url"}
_KINDS = {"JOUR": "article", "BOOK": "book", "CONF": "inproceedings", "CPAPER": "inproceedings", "CHAP": "incollection", "THES": "thesis", "article-journal": "article", "paper-conference": "inproceedings", "chapter": "incollection", "Journal Article": "article", "Book": "book", "Conference Proceedings": "inproceedings"}


def detect(text: str) -> str:
    """The format of a text by what it starts with."""
    head = text.lstrip("\ufeff \t\r\n")
    if head[:1] in "[{" and head[:1]:
        return "csl"
    if head.startswith("<"):
        return "atom"
    if re.match(r"TY  -", head):
        return "ris"
    if re.match(r"%[0A-Z] ", head):
        return "endnote"
    return "bibtex"


def _balanced(text: str, at: int) -> int:
    """The place behind the brace or quote that closes the value at `at`."""
    depth, i, quote = 0, at, text[at] == '"'
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and not quote:
                return i + 1
        elif c == '"' and quote and depth == 0 and i > at:
            return i + 1
        i += 1
    return len(text)


def bibtex(text: str) -> Iterator[dict]:
    """Entries with their fields; @string names are put in, # joins values, @comment and @preamble are passed over."""
    strings: dict[str, str] = {}
    i = 0
    while (m := re.compile(r"@\s*(\w+)\s*([{(])").search(text, i)) is not None:
        kind, i = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            i = _balanced(text, m.end() - 1) if m[2] == "{" else i
            continue
        entry = {"kind": kind, "line": text.count("\n", 0, m.start()) + 1, "fields": {}}
        if kind != "string" and (k := re.compile(r"\s*([^,\s{}]*)\s*,?").match(text, i)):
            entry["key"], i = k[1], k.end()
        while (f := re.compile(r"[\s,]*([\w:+-]+)\s*=\s*").match(text, i)) is not None:
            name, i, value = f[1].lower(), f.end(), []
            while i < len(text):
                if text[i] in '{"':
                    end = _balanced(text, i)
                    value.append(text[i + 1 : end - 1])
                    i = end
                elif w := re.compile(r"[\w.:+-]+").match(text, i):
                    value.append(strings.get(w[0].lower(), w[0]))
                    i = w.end()
                if not (j := re.compile(r"\s*#\s*").match(text, i)):
                    break
                i = j.end()
            joined = re.sub(r"\s+", " ", "".join(value)).strip()
            if kind == "string":
                strings[name] = joined
            else:
                entry["fields"].setdefault(name, joined)
        if kind != "string":
            yield entry


def _tagged(text: str, start: str, line: re.Pattern, names: dict[str, str], kind_tag: str) -> Iterator[dict]:
    entry: dict | None = None
    for no, row in enumerate(text.splitlines(), 1):
        m = line.match(row.strip("\ufeff"))
        if not m:
            continue
        tag, value = m[1], m[2].strip()
        if tag == start:
            if entry:
                yield entry
            entry = {"kind": "misc", "line": no, "key": "", "fields": {}}
        if entry is None:
            continue
        if tag == kind_tag:
            entry["kind"] = _KINDS.get(value, "misc")
        elif tag in ("ID", "%F"):
            entry["key"] = value
        elif tag in names:
            name = names[tag]
            if name == "author" and "author" in entry["fields"]:
                entry["fields"]["author"] += " and " + value
            else:
                entry["fields"].setdefault(name, value[:4] if name == "year" else value)
    if entry:
        yield entry


def csl(text: str) -> Iterator[dict]:
    data = json.loads(text)
    for row in data if isinstance(data, list) else data.get("items", [data]):
        issued = (row.get("issued") or {}).get("date-parts") or [[""]]
        author = " and ".join(a.get("literal") or ", ".join(x for x in (a.get("family"), a.get("given")) if x) for a in row.get("author", []))
        fields = {"title": row.get("title"), "year": str(issued[0][0]) if issued[0] else "", "doi": row.get("DOI"), "author": author, "journal": row.get("container-title"), "volume": row.get("volume"), "pages": row.get("page"), "publisher": row.get("publisher"), "url": row.get("URL")}
        yield {"kind": _KINDS.get(row.get("type", ""), row.get("type", "misc")), "line": 1, "key": str(row.get("id", "")), "fields": {k: str(v) for k, v in fields.items() if v}}


def atom(text: str) -> Iterator[dict]:
    space = "{http://www.w3.org/2005/Atom}"
    root = ElementTree.fromstring(text)
    for e in [root] if root.tag == space + "entry" else root.iter(space + "entry"):
        get = lambda n: re.sub(r"\s+", " ", (e.findtext(space + n) or "").strip())  # noqa: E731,B023
        author = " and ".join((a.findtext(space + "name") or "").strip() for a in e.iter(space + "author"))
        doi = next((x.text for x in e.iter() if x.tag.endswith("}doi")), None)
        fields = {"title": get("title"), "year": get("published")[:4], "author": author, "doi": doi, "url": get("id")}
        yield {"kind": "misc", "line": 1, "key": get("id").rsplit("/", 1)[-1], "fields": {k: v for k, v in fields.items() if v}}


def parse(text: str | None) -> list[dict]:
    """The entries of a text in any of the formats; what can't be read has none."""
    if not text or not text.strip():
        return []
    kind = detect(text)
    try:
        if kind == "csl":
            return list(csl(text))
        if kind == "atom":
            return list(atom(text))
        if kind == "ris":
            return list(_tagged(text, "TY", re.compile(r"([A-Z][A-Z0-9])  -\s?(.*)"), _RIS, "TY"))
        if kind == "endnote":
            return list(_tagged(text, "%0", re.compile(r"(%[0A-Z]) (.*)"), _ENW, "%0"))
        return list(bibtex(text))
    except (ValueError, ElementTree.ParseError):
        return []


def names(authors: str) -> list[dict]:
    """People of an author list: first, von, last and jr parts."""
    out = []
    for person in re.split(r"\s+and\s+", authors.strip()):
        parts = [p.strip() for p in person.split(",")]
        if len(parts) >= 2:
            words = parts[0].split()
            k = next((i for i, w in enumerate(words) if not w[:1].islower()), max(0, len(words) - 1))
            out.append({"first": parts[-1], "von": " ".join(words[:k]), "last": " ".join(words[k:]), "jr": parts[1] if len(parts) > 2 else ""})
        elif person.strip():
            words = person.split()
            low = [i for i, w in enumerate(words[:-1]) if w[:1].islower()]
            a, b = (low[0], low[-1] + 1) if low else (len(words) - 1, len(words) - 1)
            out.append({"first": " ".join(words[:a]), "von": " ".join(words[a:b]), "last": " ".join(words[b:]), "jr": ""})
    return out


def entries(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """ENTRY rows of bibliography texts, in the order they stand."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text in pdf[["doc_id", "text"]].itertuples(index=False):
                for node, e in enumerate(parse(text)):
                    f = e["fields"]
                    out.append((doc_id, node, e.get("key", ""), e["kind"], f.get("title"), f.get("year"), f.get("doi"), f.get("author"), sorted(f), e["line"]))
            yield pd.DataFrame(out, columns=["doc_id", "node", "key", "kind", "title", "year", "doi", "author", "fields", "line"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, ENTRY)
