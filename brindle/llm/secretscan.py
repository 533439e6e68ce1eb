"""Secrets in texts, also below layers of encoding: a worklist of layers, each scanned, unwrapped and mapped back to the text.

A layer is a piece of text as bytes with, for every byte, the span of the original text that it stems from. The first layer is
the text itself. Four decoders (percent escapes, Unicode escapes, base64, compressed streams) look at each layer; the lines
that hold what a decoder can unwrap, with that unwrapped in place, are new layers, so a match may begin outside an encoded
piece and end in it. A layer whose bytes and spans were met before is not taken again, which merges the orders of independent
decoders and ends cycles; every other step shortens a layer, or is an inflation, whose bytes are limited, so a fixpoint comes.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import blocks, fresh, read

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")

# Percent signs that are themselves escaped, however often, are unwrapped at once; so are escaped backslashes.
PERCENT = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE = re.compile(
    rb"\\(?:u005[cC])*u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\(?:u005[cC])*u([0-9A-Fa-f]{4})|%u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}"
    rb"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\x([0-9A-Fa-f]{2})|\xef\xbc([\x81-\xbf])|\xef\xbd([\x80-\x9e])"
)
UNICODE_SIGNS = (b"\\u", b"%u", b"\\U", b"&#", b"\\x", b"\xef\xbc", b"\xef\xbd")
#: Shorter runs of base64 letters are taken for words.
BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{32,}\r?\n[\x20\t]*)+[A-Za-z0-9+/]{2,}={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINE = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: Bytes that the compressed streams of one text may inflate to in all, so that no archive fills a worker; streams beyond
#: stay wrapped and are counted in n_refused.
INFLATE_BYTES = 1 << 24
#: Texts are scanned in slices of about so many bytes.
BATCH_BYTES = 1 << 22


@dataclass(frozen=True)
class Piece:
    """body[start:end] unwraps to data; byte i of data stems from body[first[i] : last[i] + 1] (all of the piece where these are None)."""

    start: int
    end: int
    data: bytes
    first: np.ndarray | None = None
    last: np.ndarray | None = None


class Budget:
    """What the streams of one text may still inflate to, and how many went beyond."""

    def __init__(self, left: int) -> None:
        self.left, self.refused = left, 0


def matches(body: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the secrets in a layer, in bytes: leftmost and non-overlapping within a kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(body)]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(body)]


def percent(body: bytes, budget: Budget) -> list[Piece]:
    return [Piece(m.start(), m.end(), bytes([int(m[1], 16)])) for m in PERCENT.finditer(body)] if b"%" in body else []


def unicode_escapes(body: bytes, budget: Budget) -> list[Piece]:
    """Escapes of code points; lone surrogates and numbers that are no code point stay. Full-width forms count as ASCII."""
    out: list[Piece] = []
    if not any(s in body for s in UNICODE_SIGNS):
        return out
    for m in UNICODE.finditer(body):
        k = m.lastindex
        if k == 2:
            data = chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00).encode()
        elif k == 9:
            data = bytes([int(m[9], 16)])
        elif k in (10, 11):
            data = bytes([m[k][0] - 0x80 + (0x20 if k == 10 else 0x60)])
        else:
            point = int(m[k], 10 if k == 8 else 16)
            if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
                continue
            data = chr(point).encode()
        out.append(Piece(m.start(), m.end(), data))
    return out


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return not CONTROL.search(data)


def _unbase64(body: bytes, start: int, end: int) -> Piece | None:
    token = body[start:end]
    letters = token.rstrip(b"=").translate(None, b"\r\n\t ")
    if len(letters) % 4 == 1:
        return None
    data = binascii.a2b_base64(letters.replace(b"-", b"+").replace(b"_", b"/") + b"=" * (-len(letters) % 4))
    if not data or not (_is_text(data) or MAGIC.match(data)):
        return None
    places = start + np.flatnonzero(~np.isin(np.frombuffer(token, np.uint8), np.frombuffer(b"\r\n\t =", np.uint8)))
    at = np.arange(len(data))
    last = places[np.minimum((8 * at + 7) // 6, len(places) - 1)]
    last[-1] = end - 1  # with the padding
    return Piece(start, end, data, places[8 * at // 6], last)


def base64(body: bytes, budget: Budget) -> list[Piece]:
    """Tokens, and blocks of lines, of base64 (also its URL alphabet, padded or not) that hold text or begin a compressed stream."""
    out = []
    for m in BASE64.finditer(body):
        found = [_unbase64(body, m.start(), m.end())]
        if found[0] is None and b"\n" in m[0]:
            found = [_unbase64(body, x.start(), x.end()) for x in BASE64_LINE.finditer(body, m.start(), m.end())]
        out += [x for x in found if x]
    return out


def _inflated(body: bytes, at: int, budget: Budget) -> tuple[int, bytes] | None:
    """(end, data) of the compressed stream at a place, or None if there is no whole one or it is too large."""
    head = body[at : at + 2]
    tool = zlib.decompressobj(31) if head == b"\x1f\x8b" else bz2.BZ2Decompressor() if head == b"BZ" else lzma.LZMADecompressor(memlimit=1 << 27) if head == b"\xfd7" else zlib.decompressobj(15)
    view, out, size, end = memoryview(body), [], 0, at
    try:
        while not tool.eof and end < len(body):
            fed = view[end : end + (1 << 16)]
            end += len(fed)
            data = tool.decompress(fed, budget.left - size + 1)
            size += len(data)
            out.append(data)
            while size <= budget.left and not tool.eof and (more := getattr(tool, "unconsumed_tail", b"") or not getattr(tool, "needs_input", True)):
                data = tool.decompress(more if isinstance(more, bytes) else b"", budget.left - size + 1)
                size += len(data)
                out.append(data)
                if not data:
                    break
            if size > budget.left:
                budget.refused += 1
                return None
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return None
    if not tool.eof or not size:
        return None
    budget.left -= size
    return end - len(tool.unused_data), b"".join(out)


def compressed(body: bytes, budget: Budget) -> list[Piece]:
    """gzip, zlib, bzip2 and xz streams; all that one inflates to stems from all of it."""
    out, at = [], 0
    while m := MAGIC.search(body, at):
        found = _inflated(body, m.start(), budget)
        if found:
            out.append(Piece(m.start(), found[0], found[1]))
        at = found[0] if found else m.start() + 1
    return out


DECODERS = (percent, unicode_escapes, base64, compressed)


def _windows(body: bytes, pieces: list[Piece]) -> Iterator[tuple[int, int, list[Piece]]]:
    """The lines of body that hold pieces: (start, end, pieces), lines that a piece spans taken together. No match spans lines."""
    at = 0
    while at < len(pieces):
        start = body.rfind(b"\n", 0, pieces[at].start) + 1
        end, k = start, at
        while k < len(pieces) and (k == at or pieces[k].start < end):
            if pieces[k].end > end:
                stop = body.find(b"\n", pieces[k].end)
                end = len(body) if stop < 0 else stop
            k += 1
        yield start, end, pieces[at:k]
        at = k


def unwrapped(body: bytes, lo: np.ndarray | None, hi: np.ndarray | None, pieces: list[Piece]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The layers below a layer: its windows with their pieces unwrapped, and the spans of their bytes."""
    for start, end, inside in _windows(body, pieces):
        data, first, last, at = [], [], [], start
        for p in inside:
            data += [body[at : p.start], p.data]
            gap, n = np.arange(at, p.start), len(p.data)
            first += [gap, np.full(n, p.start) if p.first is None else p.first]
            last += [gap, np.full(n, p.end - 1) if p.last is None else p.last]
            at = p.end
        data.append(body[at:end])
        first.append(np.arange(at, end))
        last.append(np.arange(at, end))
        a, b = np.concatenate(first).astype(np.int32), np.concatenate(last).astype(np.int32)
        yield b"".join(data), a if lo is None else lo[a], b + 1 if hi is None else hi[b]


def layers(text: bytes, budget: Budget) -> Iterator[tuple[int, bytes, np.ndarray | None, np.ndarray | None]]:
    """(depth, body, lo, hi) of every layer of a text, breadth first; lo and hi are None for the text itself."""
    work, seen = deque([(0, text, None, None)]), set()
    while work:
        depth, body, lo, hi = work.popleft()
        yield depth, body, lo, hi
        for decode in DECODERS:
            for below in unwrapped(body, lo, hi, decode(body, budget)):
                name = hashlib.blake2b(below[0], digest_size=16)
                name.update(below[1])
                name.update(below[2])
                if name.digest() not in seen:
                    seen.add(name.digest())
                    work.append((depth + 1, *below))


def secrets(text: bytes, inflate_bytes: int = INFLATE_BYTES) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """((start, kind, end, depth) in code points, sorted; layers; streams refused). A span found at several depths has the least."""
    budget, found, n = Budget(inflate_bytes), {}, 0
    for depth, body, lo, hi in layers(text, budget):
        n += 1
        for kind, a, b in matches(body):
            span = (a, b) if lo is None else (int(lo[a]), int(hi[b - 1]))
            found.setdefault((span[0], kind, span[1]), depth)
    if found and not text.isascii():
        points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
        # the code points that begin before a byte; an end within a character takes all of it
        spans = {(int(points[a]), kind, int(points[b])): d for (a, kind, b), d in sorted(found.items(), key=lambda x: -x[1])}
    else:
        spans = found
    return sorted((a, kind, b, d) for (a, kind, b), d in spans.items()), n, budget.refused


FOUND = "array<struct<kind:string,start:bigint,end:bigint,depth:int>>"
RESULTS = ("found", "n_layers", "n_refused")


def scan(docs: DataFrame, keep: list[str], text: str = "text", inflate_bytes: int = INFLATE_BYTES) -> DataFrame:
    """keep, and found, n_layers, n_refused for every row of docs.

    found holds the distinct (kind, start, end, depth) by start, then kind in the order of KINDS, then end: spans of the text in
    code points, end exclusive, and the depth of the first layer that shows it, 0 for the text itself. Null and empty texts hold
    none. Texts of any length are scanned whole. Repeated rows are scanned one by one, rows may have null ids, an empty table
    gives an empty table, and columns of keep that have the name of a result are replaced by it.
    """
    keep = [c for c in keep if c.lower() not in RESULTS]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, len(keep), BATCH_BYTES):
                rows = [secrets(t.as_py() or b"", inflate_bytes) for t in part.column(len(keep))]
                spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "depth": d} for a, k, b, d in r[0]] for r in rows], kind)
                out = [*part.columns[:-1], spans, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, *RESULTS])

    kept = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"found {FOUND}", "n_layers bigint", "n_refused bigint"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(fresh(keep, "t"))).mapInArrow(run, kept)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", inflate_bytes: int = INFLATE_BYTES) -> DataFrame:
    """docs with every secret of its text column replaced by mask, overlapping and touching spans by one; other texts stay as they are."""

    def clean(t: bytes | None) -> str | None:
        if t is None:
            return None
        out, at, s = [], 0, t.decode(errors="replace")
        for a, _, b, _ in secrets(t, inflate_bytes)[0]:
            if a > at or not out:
                out += [s[at:a], mask]
            at = max(at, b)
        return "".join([*out, s[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at, BATCH_BYTES):
                texts = pa.array([clean(t.as_py()) for t in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], texts, *part.columns[at + 1 :]], names=names)

    names, at = docs.columns, docs.columns.index(text)
    return docs.withColumn(text, F.col(f"`{text}`").cast("binary")).mapInArrow(run, docs.schema)


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("found", lambda x: x["depth"] == 0)
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"), "n_layers", "n_refused")
