"""Results as JSON, text, CSV, Markdown, SQLite or Parquet.

The textual formats are single files by nature: they are made on the driver from the
ordered result, which ranking has cut to what people read. Parquet stays distributed.
"""

from __future__ import annotations

import csv
import io
import json
import sqlite3
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame

FORMATS = ("json", "text", "csv", "markdown", "sqlite", "parquet")
CSV_COLUMNS = ("url", "title", "relevance_score", "keyword_score", "semantic_score", "language")
BY_EXTENSION = {"json": "json", "csv": "csv", "txt": "text", "md": "markdown", "db": "sqlite", "sqlite": "sqlite", "parquet": "parquet"}


def to_dicts(rows: DataFrame | list[dict]) -> list[dict]:
    """Rows as dicts, nested ones too, in the result's order."""
    return rows if isinstance(rows, list) else [r.asDict(recursive=True) for r in rows.toLocalIterator()]


def to_json(rows: DataFrame | list[dict], indent: int = 2) -> str:
    return json.dumps(to_dicts(rows), indent=indent, ensure_ascii=False, default=str)


def _preview(row: dict, most: int) -> str:
    text = row.get("text") or ""
    return text[:most].replace("\n", " ") + ("..." if len(text) > most else "")


def to_text(rows: DataFrame | list[dict], preview: int = 300) -> str:
    """Numbered blocks of labelled lines."""
    out = []
    for n, r in enumerate(to_dicts(rows), 1):
        score = lambda k, r=r: "N/A" if r.get(k) is None else r[k]
        lines = {"Title": r.get("title") or "N/A", "Language": r.get("language") or "N/A", "Relevance": score("relevance_score"), "Keyword": score("keyword_score"), "Semantic": score("semantic_score"), "Preview": _preview(r, preview)}
        out += [f"[{n}] {r.get('url', 'N/A')}", *(f"    {k:<10}: {v}" for k, v in lines.items()), ""]
    return "\n".join(out)


def to_csv(rows: DataFrame | list[dict]) -> str:
    data = to_dicts(rows)
    if not data:
        return ""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(CSV_COLUMNS)
    w.writerows([r.get(c) for c in CSV_COLUMNS] for r in data)
    return out.getvalue()


def to_markdown(rows: DataFrame | list[dict], preview: int = 500, heading: str = "Results") -> str:
    out = [f"# {heading}", ""]
    for n, r in enumerate(to_dicts(rows), 1):
        url, graph = r.get("url") or "", (r.get("structured") or {}).get("open_graph") or {}
        facts = [("URL", f"[{url}]({url})"), ("Relevance", f"`{r.get('relevance_score', 0)}`"), ("Language", f"`{r.get('language') or 'unknown'}`")]
        facts += [(label, f"`{r[k]}`") for label, k in (("Keyword score", "keyword_score"), ("Semantic score", "semantic_score")) if r.get(k) is not None]
        facts += [(f"OG {k.title()}", graph[k]) for k in ("description", "image") if graph.get(k)]
        out += [f"## {n}. {r.get('title') or 'Untitled'}", "", *(f"- **{k}**: {v}" for k, v in facts), ""]
        if (text := _preview(r, preview).strip()) :
            out += [f"> {text}", ""]
        out += ["---", ""]
    return "\n".join(out)


_COLUMNS = {"url": "TEXT NOT NULL", "title": "TEXT", "text": "TEXT", "language": "TEXT", "relevance_score": "REAL", "keyword_score": "REAL", "semantic_score": "REAL", "depth": "INTEGER", "page_num": "INTEGER", "structured": "TEXT"}


def to_sqlite(rows: DataFrame | list[dict], path: str) -> int:
    """Append to the table ``pages`` of a database that is made if missing; returns the number of rows.

    Rows stream through the driver, which is the one writer that SQLite admits.
    """
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    data = iter(rows) if isinstance(rows, list) else (r.asDict(recursive=True) for r in rows.toLocalIterator())

    def values():
        for r in data:
            s = r.get("structured")
            yield [json.dumps(s, ensure_ascii=False, default=str) if c == "structured" and s else None if c == "structured" else r.get(c, "") or "" if c in ("url", "text") else r.get(c) for c in _COLUMNS]

    with closing(sqlite3.connect(path)) as db, db:
        own = ", ".join(f"{c} {kind}" for c, kind in _COLUMNS.items())
        db.execute(f"CREATE TABLE IF NOT EXISTS pages (id INTEGER PRIMARY KEY AUTOINCREMENT, {own}, crawled_at DATETIME DEFAULT CURRENT_TIMESTAMP)")
        for c in ("url", "relevance_score"):
            db.execute(f"CREATE INDEX IF NOT EXISTS by_{c} ON pages({c})")
        before = db.total_changes
        db.executemany(f"INSERT INTO pages ({', '.join(_COLUMNS)}) VALUES ({', '.join('?' * len(_COLUMNS))})", values())
        return db.total_changes - before


def render(rows: DataFrame | list[dict], fmt: str) -> str:
    makers = {"json": to_json, "text": to_text, "csv": to_csv, "markdown": to_markdown}
    if fmt not in makers:
        raise ValueError(f"{fmt!r} isn't a format that can be printed: {', '.join(makers)}")
    return makers[fmt](rows)


def save(rows: DataFrame | list[dict], path: str, fmt: str | None = None) -> None:
    """Write a file; without ``fmt`` its extension decides, else JSON."""
    fmt = fmt or BY_EXTENSION.get(path.rpartition(".")[2].lower(), "json")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}: one of {', '.join(FORMATS)}")
    if fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
    elif fmt == "sqlite":
        to_sqlite(rows, path)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(render(rows, fmt), encoding="utf-8", newline="")
