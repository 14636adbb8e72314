"""Markdown as rows: blocks of a text and the segments of their lines, for previews of files that nobody vouches for.

Blocks are found by a table of states and kinds of lines, one line after the
other. Segments don't nest. Links are kept only if their address is relative, a
web or a mail address; of others the text stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of lines, tried in this order where no block is open.
LINES = {
    "code": re.compile(r"\s{0,3}(?:`{3}|~{3})\s*([\w+-]*)\s*"),
    "blank": re.compile(r"\s*"),
    "rule": re.compile(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*"),
    "heading": re.compile(r"\s{0,3}(#{1,6})\s+(.*)"),
    "quote": re.compile(r"\s{0,3}>\s?(.*)"),
    "numbers": re.compile(r"\s{0,3}\d+[.)]\s+(.*)"),
    "bullets": re.compile(r"\s{0,3}[-*+]\s+(.*)"),
}
_DEEP = re.compile(r"\s{2,}\S")
# Patterns of segments, of which the first that fits at a place is taken, and of addresses that are safe.
SEGMENTS = re.compile(r"`(?P<code>[^`]+)`|\[(?P<link>[^\]]*)\]\((?P<href>[^)\s]+)\)|\*\*(?P<bold>[^*]+)\*\*|\*(?P<italic>[^*]+)\*|~~(?P<struck>[^~]+)~~")
_SAFE = re.compile(r"[#/?]|[\w.\-]+/|(?:https?:|mailto:)", re.IGNORECASE)
BLOCKS = "block int, kind string, level int, lang string, item int, text string, segments array<struct<style: string, text: string, href: string>>"


@dataclass
class Block:
    kind: str
    level: int = 0
    lang: str = ""
    items: list[list[str]] = field(default_factory=list)


def blocks(text: str) -> list[Block]:
    """The blocks of a text in order; a list has an item for each of its own, others one or none."""
    out: list[Block] = []
    now: Block | None = None

    def begin(kind: str, *line: str, level: int = 0, lang: str = "") -> Block:
        out.append(Block(kind, level, lang, [list(line)] if line or kind == "code" else []))
        return out[-1]

    for line in re.split(r"\r\n?|\n", text):
        found = {}
        if now and now.kind == "code":
            if LINES["code"].fullmatch(line):
                now = None
            else:
                now.items[0].append(line)
            continue
        if now and now.kind in ("bullets", "numbers", "quote"):
            own = LINES[now.kind].fullmatch(line)
            if own and now.kind == "quote":
                now.items[0].append(own[1])
                continue
            if own:
                now.items.append([own[1].strip()])
                continue
            if now.kind != "quote" and _DEEP.match(line):
                now.items[-1].append(line.strip())
                continue
            now = None
        kind = next((k for k, pattern in LINES.items() if (found := pattern.fullmatch(line))), "paragraph")
        if kind == "paragraph":
            if now:
                now.items[0].append(line.strip())
            else:
                now = begin("paragraph", line.strip())
        elif kind == "blank":
            now = None
        elif kind == "rule":
            begin("rule")
            now = None
        elif kind == "heading":
            begin("heading", found[2].strip(), level=len(found[1]))
            now = None
        elif kind == "code":
            now = begin("code", lang=found[1] or "")
        else:
            now = begin(kind, found[1].strip() if kind != "quote" else found[1])
    return out


def segments(text: str) -> list[tuple[str, str, str | None]]:
    """``style, text, href`` of what follows each other in a line."""
    out: list[tuple[str, str, str | None]] = []
    at = 0
    for m in SEGMENTS.finditer(text):
        if m.start() > at:
            out.append(("plain", text[at : m.start()], None))
        style, href = m.lastgroup, m["href"]
        if href is not None:
            safe = _SAFE.match(href) is not None
            out.append(("link", m["link"], href) if safe else ("plain", m["link"], None))
        else:
            out.append((style, m[style], None))
        at = m.end()
    return [*out, ("plain", text[at:], None)] if at < len(text) else out


def rows(text: str) -> Iterator[tuple]:
    """``block, kind, level, lang, item, text, segments`` of each item of each block; a rule has an empty text, code has no segments."""
    for k, b in enumerate(blocks(text)):
        for i, lines in enumerate(b.items or [[]]):
            own = "\n".join(lines) if b.kind == "code" else " ".join(lines).strip()
            yield k, b.kind, b.level, b.lang, i, own, [] if b.kind in ("code", "rule") else segments(own)


def parsed(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """``<id_col>`` and ``BLOCKS``: a row for each item of each block of ``texts``; a null or empty text has none."""
    kind = texts.schema[id_col].dataType.simpleString()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, *(c.split()[0] for c in BLOCKS.split(", ")[:6]), "segments"]
        seg = pa.list_(pa.struct([("style", pa.string()), ("text", pa.string()), ("href", pa.string())]))
        types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            for r in range(batch.num_rows):
                found = list(rows(batch.column(1)[r].as_py()))
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    columns = list(zip(*part, strict=True))
                    segs = [[dict(zip(("style", "text", "href"), s, strict=True)) for s in x] for x in columns[6]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r] * len(part))), *(pa.array(c, t) for c, t in zip(columns[:6], types, strict=True)), pa.array(segs, seg)], names)

    return texts.where(F.col(text).isNotNull()).select(id_col, text).mapInArrow(one, f"`{id_col}` {kind}, {BLOCKS}")
