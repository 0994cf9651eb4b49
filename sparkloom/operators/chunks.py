"""Chunking operators: documents, lines, tokens, gaps and symbol snippets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def document_chunks(text: str, least: int = 200, most: int = 1500, overlap: int = 100) -> list[tuple[int, int, list[str], str]]:
    """(start, end, headings above, content): paragraphs under headings, short ones joined, long ones cut with overlap.

    Headings are lines of one to six ``#``, in their order in the text; a heading's own line starts its section.
    """
    sections, at, stack = [], 0, []
    for line in text.splitlines(keepends=True):
        mark = len(line) - len(line.lstrip("#"))
        if 1 <= mark <= 6:
            stack = [h for h in stack if h[0] < mark] + [(mark, line.strip("#").strip())]
            sections.append((at, [h[1] for h in stack]))
        elif not sections:
            sections.append((at, []))
        at += len(line)
    out = []
    for k, (lo, heads) in enumerate(sections):
        hi = sections[k + 1][0] if k + 1 < len(sections) else len(text)
        parts, p = [], lo
        while p < hi:
            q = text.find("\n\n", p, hi)
            end = hi if q < 0 else q + 2
            if parts and parts[-1][1] - parts[-1][0] < least:
                parts[-1][1] = end
            elif text[p:end].strip():
                parts.append([p, end])
            p = end
        for a, b in parts:
            while b - a > most:
                out.append((a, a + most, heads, text[a : a + most]))
                a += most - overlap
            out.append((a, b, heads, text[a:b]))
    return out


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, least: int = 200, most: int = 1500, overlap: int = 100) -> DataFrame:
    """(id, chunk_no, start, end, headings, content); a fold over lines, so it runs on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, a, b, h, c) for i, t in zip(pdf["id"], pdf["text"]) for n, (a, b, h, c) in enumerate(document_chunks(t or "", least, most, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "start", "end", "headings", "content"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, chunk_no long, start long, end long, headings array<string>, content string")


def window_chunks(text: Column, most: int, overlap: int) -> Column:
    """Array of (start, content): windows of ``most`` characters, each ``most - overlap`` after the last, as an expression."""
    step = most - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - most) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("long").alias("start"), F.substring(text, i * step + 1, F.lit(most)).alias("content")))


def token_split(lines: list[str], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Line ranges (first, last + 1) of at most ``most`` words, closed at ``target``; each next one starts about ``overlap`` words back."""
    size = [len(s.split()) for s in lines]
    out, a = [], 0
    while a < len(lines):
        b, total = a, 0
        while b < len(lines) and (b == a or total + size[b] <= most) and total < target:
            total += size[b]
            b += 1
        out.append((a, b))
        if b >= len(lines):
            break
        back, words = b, 0
        while back - 1 > a and words + size[back - 1] <= overlap:
            back -= 1
            words += size[back]
        a = back
    return out


def joined_parts(ranges: list[tuple[int, int]], lines: list[str], target: int, most: int) -> list[tuple[int, int]]:
    """``ranges`` with a part of fewer than max(target / 3, 24) words joined to the one before, if both fit ``most``."""
    words = lambda a, b: sum(len(s.split()) for s in lines[a:b])
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and words(a, b) < max(target // 3, 24) and words(out[-1][0], b) <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def pack_lines(lines: list[str], most: int, overlap: int = 2) -> list[tuple[int, int]]:
    """Line ranges of at most ``most`` characters (one line at least), each starting ``overlap`` lines back."""
    out, a = [], 0
    while a < len(lines):
        b, total = a, 0
        while b < len(lines) and (b == a or total + len(lines[b]) + 1 <= most):
            total += len(lines[b]) + 1
            b += 1
        out.append((a, b))
        if b >= len(lines):
            break
        a = max(a + 1, b - overlap)
    return out


def split_long(chunks: DataFrame, target: int = 800, most: int = 4096, overlap: int = 96) -> DataFrame:
    """(chunk_id, part, first_line, last_line, snippet): chunks with too many words as parts of whole lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["chunk_id"], pdf["snippet"]):
                lines = (t or "").split("\n")
                ranges = token_split(lines, target, most, overlap) if sum(len(s.split()) for s in lines) > most else [(0, len(lines))]
                rows += [(i, n, a, b, "\n".join(lines[a:b])) for n, (a, b) in enumerate(ranges)]
            yield pd.DataFrame(rows, columns=["chunk_id", "part", "first_line", "last_line", "snippet"])

    return chunks.select("chunk_id", "snippet").mapInPandas(run, "chunk_id long, part long, first_line long, last_line long, snippet string")


def symbol_snippets(symbols: DataFrame, files: DataFrame, context: int = 2, least: int = 3, most: int = 4000) -> DataFrame:
    """(id, lo, hi, snippet): a symbol's lines with ``context`` lines around, ``least`` lines and at most ``most`` characters."""
    joined = symbols.select("id", "file_id", "start_line", "end_line").join(files.select("file_id", F.split("content", "\n").alias("lines")), "file_id")
    lo = F.greatest(F.lit(1), F.col("start_line") - context)
    hi = F.least(F.size("lines"), F.greatest(F.col("end_line") + context, lo + least - 1))
    return joined.withColumns({"lo": lo, "hi": hi}).select("id", "lo", "hi", F.substring(F.array_join(F.slice("lines", F.col("lo"), F.col("hi") - F.col("lo") + 1), "\n"), 1, most).alias("snippet"))


def gaps(symbols: DataFrame) -> DataFrame:
    """(file_id, lo, hi): lines between consecutive symbols, each compared with the one right before it."""
    order = Window.partitionBy("file_id").orderBy("start_line", "id")
    return symbols.withColumn("next", F.lead("start_line").over(order)).where(F.col("next") > F.col("end_line") + 1).select("file_id", (F.col("end_line") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))


def dedup_chunks(chunks: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first chunk of each key in ``order``."""
    return chunks.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def line_range(start: Column, end: Column, count: Column) -> tuple[Column, Column]:
    """A range of lines, counted from 0, within ``count`` lines: ranges that count from 1 at the end are moved, others cut; null without lines."""
    moved = lambda x: F.when((x >= count) & (x > 0), x - 1).otherwise(x)
    lo = F.when((count > 0) & (moved(start) < count), moved(start))
    return lo, F.when(lo.isNotNull(), F.greatest(lo, F.least(count - 1, moved(end))))


def comment_block(lines: list[str], first_symbol: int) -> tuple[int, int] | None:
    """(first, last) line of the comment at a file's head, before line ``first_symbol``; all counted from 0."""
    start = 1 if lines and lines[0].lstrip().startswith("#!") and first_symbol > 1 else 0
    last, closing = None, None
    for i in range(start, min(first_symbol, len(lines))):
        line = lines[i].strip()
        if not line:
            last = i if last is not None else None
            continue
        if closing:
            closing = None if closing in line else closing
        elif line.startswith("/*"):
            closing = None if "*/" in line else "*/"
        elif line[:3] in ('"""', "'''"):
            closing = None if line.count(line[:3]) > 1 else line[:3]
        elif line.startswith("<!--"):
            closing = None if "-->" in line else "-->"
        elif not line.startswith(("//", "#", ";", "*")):
            break
        last = i
    return None if last is None else (start, last)


def module_comments(files: DataFrame, symbols: DataFrame, most: int = 4000) -> DataFrame:
    """(path, line_start, line_end, snippet): the comment at the head of each file (path, content) before its first symbol (file_path, start_line from 1)."""
    first = symbols.groupBy(F.col("file_path").alias("path")).agg(F.min("start_line").alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text, at in zip(pdf["path"], pdf["content"], pdf["first"]):
                lines = (text or "").split("\n")
                found = comment_block(lines, len(lines) if at is None or at != at else int(at) - 1)
                if found and (snippet := "\n".join(lines[found[0] : found[1] + 1])[:most]).strip():
                    rows.append((path, found[0] + 1, found[1] + 1, snippet))
            yield pd.DataFrame(rows, columns=["path", "line_start", "line_end", "snippet"])

    return files.select("path", "content").join(first, "path", "left").mapInPandas(run, "path string, line_start long, line_end long, snippet string")


def gap_chunks(files: DataFrame, symbols: DataFrame, most: int = 4000, least: int = 6) -> DataFrame:
    """(file_path, line_start, line_end, chunk_type, snippet): lines between symbols with ``least`` letters or digits; ``imports_gap`` if all of them import."""
    own = gaps(symbols.select(F.col("file_path").alias("file_id"), "id", "start_line", "end_line")).withColumnRenamed("file_id", "file_path")
    joined = own.join(files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("lines")), "file_path").where("hi <= size(lines)")
    part = F.slice("lines", F.col("lo").cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int"))
    filled = F.filter(F.transform(part, lambda x: F.ltrim(x)), lambda x: x != "")
    imports = F.forall(filled, lambda x: x.rlike("^(?:import |from |export |use |#include)"))
    snippet = F.left(F.array_join(part, "\n"), F.lit(most))
    rows = joined.select("file_path", F.col("lo").cast("long").alias("line_start"), F.col("hi").cast("long").alias("line_end"), F.when(imports, "imports_gap").otherwise("inter_symbol_gap").alias("chunk_type"), snippet.alias("snippet"))
    return rows.where(F.length(F.regexp_replace("snippet", r"[^\p{L}\p{N}]", "")) >= least)


#: Least characters of a chunk, most chunks of a file, and most bytes of one.
DOC_LEAST, CONFIG_LEAST, FILE_CHUNKS, FILE_BYTES = 80, 20, 24, 512 << 10


def text_file_chunks(files: DataFrame, most: int = 4000, overlap: int = 2) -> DataFrame:
    """(path, chunk_type, chunk_no, line_start, line_end, snippet): documents and configuration files (path, content) in packed lines.

    Documents give doc_chunk of 80 characters at least, configuration config_chunk of 20. Files over FILE_BYTES have none, and of longer ones the first
    FILE_CHUNKS count: the feature's own limits.
    """
    rows = files.select("path", "content", T.file_kind(F.col("path")).alias("kind")).where(F.col("kind").isNotNull() & (F.octet_length("content") <= FILE_BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text, kind in zip(pdf["path"], pdf["content"], pdf["kind"]):
                lines, n = (text or "").split("\n"), 0
                for a, b in pack_lines(lines, most, overlap):
                    snippet = "\n".join(lines[a:b])
                    if n < FILE_CHUNKS and len(snippet.strip()) >= (DOC_LEAST if kind == "doc" else CONFIG_LEAST):
                        out.append((path, f"{kind}_chunk", n, a + 1, b, snippet))
                        n += 1
            yield pd.DataFrame(out, columns=["path", "chunk_type", "chunk_no", "line_start", "line_end", "snippet"])

    return rows.mapInPandas(run, "path string, chunk_type string, chunk_no long, line_start long, line_end long, snippet string")


def flow_chunks(blocks: DataFrame, files: DataFrame, per_symbol: int = 6, most: int = 4000) -> DataFrame:
    """(block_id, symbol_id, chunk_type, snippet): the first ``per_symbol`` flow blocks of each symbol, by line: the feature's own limit.

    ``blocks`` (block_id, symbol_id, file_path, kind, start_line, end_line), lines from 1.
    """
    order = Window.partitionBy("symbol_id").orderBy("start_line", "block_id")
    own = blocks.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_symbol)
    joined = own.join(files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("lines")), "file_path")
    part = F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return joined.select("block_id", "symbol_id", F.concat(F.lit("flow_"), "kind").alias("chunk_type"), F.left(F.array_join(part, "\n"), F.lit(most)).alias("snippet"))


def embedding_text(path: Column, scope: Column, kind: Column, title: Column, doc: Column, snippet: Column, members: Column | None = None) -> Column:
    """What a chunk's vector is made from: lines for its file, scope and title, then doc and snippet; members of a class are named, too."""
    lines = [F.concat(F.lit("# "), path), F.when(scope.isNotNull(), F.concat(F.lit("# Scope: "), scope)), F.concat(F.lit("# "), kind, F.lit(" "), title)]
    if members is not None:
        lines.append(F.when(F.size(members) > 0, F.concat(F.lit("# Methods: "), F.array_join(members, ", "))))
    return F.array_join(F.filter(F.array(*lines, doc, snippet), lambda x: x.isNotNull()), "\n")


def all_chunks(*families: DataFrame) -> DataFrame:
    """The chunks of all families (file_path, line_start, line_end, chunk_type, snippet), the first of equal places and types; ids follow file, lines and type."""
    columns = ["file_path", "line_start", "line_end", "chunk_type", "snippet"]
    rows = families[0].select(*columns)
    for x in families[1:]:
        rows = rows.unionByName(x.select(*columns))
    own = dedup_chunks(rows, ["file_path", "line_start", "line_end", "chunk_type"], [F.col("snippet")])
    return own.withColumn("chunk_id", F.xxhash64("file_path", "line_start", "line_end", "chunk_type"))
