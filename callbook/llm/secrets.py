"""Secret scans with a worklist of decoded layers.

Each text is scanned for three kinds of secrets; then every encoding found in it is
unwrapped and the result, a layer, is put on a worklist, scanned and unwrapped in turn:
URL escapes and Unicode escapes are replaced in the whole layer, base64 runs become layers
of their own, and compressed bytes inside them are inflated. A base64 run may go on over
line ends; one that gives no whole text is read from each of its first four characters, as
others may be glued in front, and bytes that are no UTF-8 stand as marks between what is
readable. Compressed streams are looked for all along the bytes. The worklist ends at the
fixpoint, as a layer that has been seen in the same document is not taken up again (this
also ends data that inflates to itself). Every character of a layer knows the span of the
original text that it came from, so findings are spans of the original text; all of an
inflated stream came from the same span.

Nulls and empty texts have no findings. Texts are scanned whole, each by itself; repeated
rows get equal results. The worklist goes by depth: inflated data is taken in pieces that end at
white space, and each is scanned and unwrapped before the next one is inflated. So
memory follows the text and the depth of its layers, not what they inflate to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbook.llm.common import long_rows, map_batches, texts

#: The patterns of the kinds, in the order in which they are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Runs of one or more lines, of which the last is no word of a sentence that goes on in its line.
WRAPPED_RUN = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?![\x20\t]+[^\s]))+")
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/_-]+")
#: What gzip and zlib data begin with.
HEADS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
LONE = re.compile("[\udc80-\udcff]")
INFLATE_PIECE, INFLATE_INPUT = 4 << 20, 1 << 16

Span = tuple[int, int, str]     # start, end, kind


def scan(text: str) -> list[Span]:
    """The spans of every kind in one string, leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hex digits is a match as a whole, so asking for 24 of them at once drops the short ones.
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded string. starts and ends hold the original span of each character (None: itself);
    all of an inflated layer and those in it came from one span, whose end is filled in once the stream has ended."""

    __slots__ = ("text", "starts", "ends", "path", "span")

    def __init__(self, text: str, starts=None, ends=None, path: str = "", span: list | None = None):
        self.text, self.starts, self.ends, self.path, self.span = text, starts, ends, path, span

    def origin(self, start: int, end: int) -> tuple[int, int] | list:
        if self.span is not None:
            return self.span
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original starts and ends of parts of the layer."""
        return (lo, hi) if self.starts is None else (self.starts[lo], self.ends[hi - 1])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            n = len(self.text)
            return np.arange(n), np.arange(1, n + 1)
        return self.starts, self.ends


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with each escape replaced. decode: match -> [(text, start, end in the layer)]."""
    pieces, starts, ends, at = [], [], [], 0
    s, e = None, None
    for m in pattern.finditer(layer.text):
        parts = decode(m)
        if parts is None:
            continue
        pieces.append(layer.text[at:m.start()])
        if layer.span is not None:
            pieces += [text for text, _, _ in parts]
            at = m.end()
            continue
        if s is None:
            s, e = layer.places()
        starts.append(s[at:m.start()])
        ends.append(e[at:m.start()])
        for text, a, b in parts:
            pieces.append(text)
            lo, hi = s[a:b].min(), e[a:b].max()
            starts.append(np.full(len(text), lo))
            ends.append(np.full(len(text), hi))
        at = m.end()
    if not pieces:
        return None
    pieces.append(layer.text[at:])
    if layer.span is not None:
        return Layer("".join(pieces), path=layer.path + "/" + name, span=layer.span)
    starts.append(s[at:])
    ends.append(e[at:])
    return Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends), layer.path + "/" + name)


def _from_url(m: re.Match) -> list | None:
    raw, out, i, at = bytes.fromhex(m[0].replace("%", "")), [], 0, m.start()
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[i:i + n].decode(), at + 3 * i, at + 3 * min(i + n, len(raw))))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:       # not UTF-8: this escape stands for itself
            out.append((m[0][3 * i:3 * i + 3], at + 3 * i, at + 3 * i + 3))
            i += 1
    return out if any(len(t) != b - a for t, a, b in out) else None


def _from_unicode(m: re.Match) -> list | None:
    text, at = m[0], m.start()
    if text.startswith("\\u") and not text.startswith("\\u{"):
        units, out, i = [int(x, 16) for x in text.split("\\u")[1:]], [], 0
        while i < len(units):
            pair = i + 1 < len(units) and 0xD800 <= units[i] < 0xDC00 <= units[i + 1] < 0xE000
            if pair:
                code = 0x10000 + (units[i] - 0xD800 << 10) + units[i + 1] - 0xDC00
            else:
                code = units[i] if not 0xD800 <= units[i] < 0xE000 else 0xFFFD
            out.append((chr(code), at + 6 * i, at + 6 * (i + 1 + pair)))
            i += 1 + pair
        return out
    digits = text.strip("\\&#;{}").lstrip("uUxX").lstrip("{")
    code = int(digits, 10 if text.startswith("&#") and text[2] not in "xX" else 16)
    return [(chr(code), at, m.end())] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _readable(raw: bytes) -> tuple[str, bool]:
    """The bytes as text, with a lone surrogate for each byte that is no UTF-8; and whether they are text as a whole."""
    text = raw.decode(errors="surrogateescape")
    return text, len(text) >= 6 and all(c.isprintable() or c in "\t\n\r\x0b\x0c" for c in text)


def _stream(raw: memoryview, at: int, end: list[int]) -> Iterator[str]:
    """The texts of the compressed stream that begins at a place, in pieces that end at white space; end gets its end."""
    unpack, held, gave = zlib.decompressobj(31 if raw[at] == 0x1F else 15), b"", False
    try:
        while at < len(raw) and not unpack.eof:
            rest = raw[at:at + INFLATE_INPUT]
            at += len(rest)
            while len(rest) and not unpack.eof:
                held += unpack.decompress(rest, INFLATE_PIECE - min(len(held), INFLATE_PIECE - 1))
                rest = unpack.unconsumed_tail
                if len(held) >= INFLATE_PIECE:
                    cut = max(held.rfind(b) for b in (b" ", b"\n", b"\t")) + 1 or len(held)
                    yield held[:cut].decode(errors="replace")
                    held, gave = held[cut:], True
        held += unpack.flush()
    except zlib.error:
        pass
    if unpack.eof or held or gave:
        end.append(at - len(unpack.unused_data) if unpack.eof else len(raw))
    if held:
        yield held.decode(errors="replace")


def _streams(raw: bytes) -> Iterator[tuple[int, Iterator[str], list[int]]]:
    """(start, texts, end) of the compressed streams in bytes, one after another until the bytes end.

    The texts must be taken before the next stream is asked for; then end holds the stream's end, if it was one.
    """
    view, at = memoryview(raw), 0
    while m := HEADS.search(raw, at):
        end: list[int] = []
        yield m.start(), _stream(view, m.start(), end), end
        # A stream that breaks off may have been none.
        at = end[0] if end and end[0] < len(raw) else m.start() + 1


def _sizes(text: str) -> np.ndarray:
    """Bytes that each character came from; a lone surrogate stands for one byte."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return sizes


def _children(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (new := _replaced(layer, URL_ESCAPES, _from_url, "url")):
        yield new
    if ("\\" in text or "&#" in text) and (new := _replaced(layer, UNICODE_ESCAPES, _from_unicode, "unicode")):
        yield new
    if "\n" in text:
        for m in WRAPPED_RUN.finditer(text):
            run = NOT_BASE64.sub("", m[0])
            if len(run) >= 16:
                held = np.ones(m.end() - m.start(), bool)
                for gap in NOT_BASE64.finditer(m[0]):
                    held[gap.start():gap.end()] = False
                yield from _from_base64(layer, run, m.start() + np.flatnonzero(held), False)
    for m in BASE64_RUN.finditer(text):
        yield from _from_base64(layer, m[0], np.arange(m.start(), m.end()))


def _from_base64(layer: Layer, run: str, places: np.ndarray, parts: bool = True) -> Iterator[Layer]:
    """The layers in a run; places: those of its characters in the layer."""
    code, stop = run.replace("-", "+").replace("_", "/"), int(places[-1]) + 1
    filled = stop + len(re.match("={0,2}", layer.text[stop:stop + 2])[0])

    def decoded(text: str, at: np.ndarray, shift: int) -> Layer:
        if layer.span is not None:
            return Layer(text, path=layer.path + "/base64", span=layer.span)
        # Three bytes come from four characters.
        lo = places[shift + at[:-1] // 3 * 4]
        hi = places[np.minimum(shift + (at[1:] - 1) // 3 * 4 + 4, len(places)) - 1] + 1
        hi[hi == stop] = filled
        return Layer(text, *layer.spans(lo, hi), layer.path + "/base64")

    rough = []
    for shift in range(4):
        some = code[shift:]
        some = some[:-1] if len(some) % 4 == 1 else some
        raw = base64.b64decode(some + "=" * (-len(some) % 4))
        text, whole = _readable(raw)
        at = np.concatenate(([0], np.cumsum(_sizes(text))))
        if whole:
            yield decoded(text, at, shift)
            return
        rough.append((LONE.sub("\ufffd", text), at, shift))
        headed = False
        for first, pieces, end in _streams(raw):
            origin = layer.origin(int(places[shift + first // 3 * 4]), filled)
            span = layer.span if layer.span is not None else [origin[0], origin[1]]
            for piece in pieces:
                headed |= first == 0
                yield Layer(piece, path=layer.path + "/inflate", span=span)
            if layer.span is None and end:
                last = int(places[min(shift + (end[0] - 1) // 3 * 4 + 4, len(places)) - 1]) + 1
                span[1] = layer.origin(int(places[shift + first // 3 * 4]), filled if last == stop else last)[1]
        if headed:
            rough = rough[-1:]
            parts = False
            break
    for x in rough:
        yield decoded(*x)
    if parts:       # a longer run may hold one between separators that base64 also uses
        for m in re.finditer(r"[A-Za-z0-9+/]{16,}", run):
            if m.end() - m.start() < len(run):
                yield from _from_base64(layer, m[0], places[m.start():m.end()], False)


def _mark(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def find(text: str) -> tuple[list[Span], list[tuple[int, int, str, str]]]:
    """Base spans, and all spans with the path of the layer where each was found first."""
    order = KINDS.index
    base = sorted(set(scan(text)), key=lambda x: (x[0], order(x[2]), x[1]))
    found: dict[tuple, tuple] = {}      # spans that are not closed yet are told apart as objects
    seen, work = {_mark(text)}, [_children(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif (mark := _mark(layer.text)) not in seen:
            seen.add(mark)
            for start, end, kind in scan(layer.text):
                span = layer.origin(start, end)
                found.setdefault((id(span) if layer.span is not None else span, kind), (span, kind, layer.path))
            work.append(_children(layer))
    every = {x: "" for x in base}
    for span, kind, path in found.values():
        every.setdefault((span[0], span[1], kind), path)
    return base, [(*x, every[x]) for x in sorted(every, key=lambda x: (x[0], order(x[2]), x[1]))]


SPANS = "array<struct<kind: string, start: int, end: int, layer: string>>"


def scan_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base: the spans found in the text itself; spans: those and the ones in decoded layers."""
    def make():
        def step(batch: pa.RecordBatch):
            found = [find(x) for x in texts(batch)]
            named = lambda spans: [{"kind": x[2], "start": x[0], "end": x[1], "layer": (*x, "")[3]} for x in spans]
            return {"key": batch.column("key"), "base": [named(b) for b, _ in found], "spans": [named(a) for _, a in found]}
        return step

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, base {SPANS}, spans {SPANS}"
    return map_batches(narrow, schema, "text", make).withColumnRenamed("key", key)


def masked(text: str | None) -> str | None:
    """The text with every found span replaced by the kind of the secret."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind, _ in find(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with secrets masked; the column of the length, where there is one, follows the text."""
    long_rows(docs.sparkSession)
    masked_text = F.pandas_udf(lambda s: s.map(masked, na_action="ignore").astype(object).where(s.notna(), None), "string")
    out = docs.withColumn(text, masked_text(F.col(text)))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(length).isNotNull(), F.coalesce(F.char_length(text), F.lit(0))).cast(kind))
    return out.select(*docs.columns)
