r"""Secret scan with a recursive decoding worklist.

Base patterns run over the text as it is. Then a worklist unwraps layers until nothing new appears: URL and Unicode escapes
(character by character), base64 runs, and gzip, zlib, bzip2, xz or zstd data inside of either. Each layer is scanned with the same
patterns and its spans are mapped back to code points of the original text: escapes map character by character, base64 by the
characters that hold the bytes, compressed data to the whole run that held it. A layer seen before at the same place is not
unwrapped again, which ends cycles (a compressed stream may contain itself).

Decoding is tolerant: bytes that are no UTF-8 stand for themselves; bytes are read as UTF-16 too where 16 letters look like it; a base64
run is decoded at each of its four alignments, as it may be glued to other letters; lines of base64 of one width (MIME, PEM) are one run, with line
breaks as they are or as escapes, and spans reach over these; compressed data may begin anywhere in a run. A
reading without 16 plain characters in a row is left out: no pattern and no further encoding fits into fewer.

One row stays in one task. Compressed runs are unfolded as streams to the end of their last member and scanned in chunks that end
where no pattern or run can go on, so memory follows one text and some chunks, and time follows what the runs unfold to. Where that
must be bounded (decompression bombs), ``max_layer_bytes`` stops a run there. ``cut_layers`` counts the runs that were stopped, are
damaged behind some readable part, or hold an unbroken run of over MAX_RUN_BYTES, which is scanned in overlapping parts (a secret in
it is found, another encoding in it is decoded only within a part). Redaction replaces all such runs as a whole.

Edge cases: null and empty texts have no spans; repeated rows are scanned one by one; equal spans from several layers count once.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, record_batch, rewrite_batches

# Fixed values of the op2 contract, in its order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_CLASS = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_B64_CLASS = bytes(98 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_-") else 32 for c in range(256))
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Base64 over several lines: each line of an unbroken run up to its end, and line breaks, which may themselves be written as escapes.
_B64_BREAK = r"(?:\r\n|\n|\\r\\n|\\n)[ \t]*"
_B64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}+(?:{_B64_BREAK}(?!-----)[A-Za-z0-9+/_-]++)++={{0,2}}")
_B64_SPLIT = re.compile(_B64_BREAK)
_B64_LINE = re.compile(rb"[ \t]*[A-Za-z0-9+/_-]{20,}\r?\n")
_ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
#: Tokens that may write bytes with escapes, and the escapes.
_ESCAPED = re.compile(r"[A-Za-z0-9_.~/%\\+!*'()-]{12,}")
_BYTE = re.compile(rb"(?:%|\\x)([0-9A-Fa-f]{2})")
_PLAIN_RUN = re.compile(rb"[\x20-\x7e\t\r\n]{16}")
_WIDE_RUN = re.compile(rb"(?:[\x20-\x7e\t\r\n]\x00){15}[\x20-\x7e\t\r\n]")
#: Where compressed data may begin.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Characters at which no pattern, escape or base64 run goes on.
_BREAKS = bytes(10 if c < 128 and not chr(c).isalnum() and chr(c) not in "+/_.=-\"' :%\\{}" else 32 for c in range(256))
_PIECE = 1 << 16
CHUNK_BYTES, MAX_RUN_BYTES, OVERLAP = 1 << 20, 16 << 20, 4096
#: What redaction unfolds a compressed run to before it replaces the run as a whole.
REDACT_LAYER_BYTES = 1 << 30

Span = tuple[int, int, int]  # start, index in KINDS, end


def find(text: str, raw: bytes | None = None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass their length, sorted. ``raw``: the text's UTF-8, if at hand."""
    if raw is None:
        raw = text.encode("utf-8", "surrogatepass")
    spans: list[Span] = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"h" * 16 in raw.translate(_HEX_CLASS):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Layer:
    """A text and, for each of its characters, where the source of it begins and ends in the original (None: itself)."""

    def __init__(self, text: str, begin: np.ndarray | None, end: np.ndarray | None):
        self.text, self.begin, self.end = text, begin, end

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return (start, stop) if self.begin is None else (int(self.begin[start]), int(self.end[stop - 1]))


def _utf8(data: bytes) -> tuple[str, np.ndarray]:
    """Text of bytes, and the bytes of each character; a byte that is no UTF-8 is a character of its own."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return text, np.ones(len(text), np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return text, sizes


def _utf16(data: bytes, order: str) -> tuple[str, np.ndarray]:
    """The same for an even number of bytes of UTF-16; half a pair is a character of its own."""
    text = data.decode(order, "surrogatepass")
    return text, np.fromiter((4 if ord(c) > 0xFFFF else 2 for c in text), np.int64, len(text))


def _readings(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts that bytes may be, with where the bytes of each character begin and end."""
    if _PLAIN_RUN.search(data):
        text, sizes = _utf8(data)
        stops = np.cumsum(sizes)
        yield text, stops - sizes, stops
    if b"\x00" in data:
        for parity in sorted({m.start() % 2 for m in _WIDE_RUN.finditer(data)}):
            text, sizes = _utf16(data[parity : parity + (len(data) - parity) // 2 * 2], "utf-16-le")
            stops = parity + np.cumsum(sizes)
            yield text, stops - sizes, stops


def _unescape(layer: Layer) -> Layer | None:
    """One step of URL and Unicode unescaping; None if nothing changes."""
    parts: list[str] = []
    begins: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at = 0

    def keep(stop: int) -> None:
        if stop > at:
            parts.append(layer.text[at:stop])
            run = np.arange(at, stop)
            begins.append(run)
            ends.append(run + 1)

    for m in _ESCAPE.finditer(layer.text):
        if m[1]:
            unit, width = binascii.unhexlify(m[1].replace("%", "")), 3
            text, sizes = _utf8(unit)
        elif m[2]:
            unit, width = binascii.unhexlify(m[2].replace("\\u", "")), 3  # two bytes for six characters
            text, sizes = _utf16(unit, "utf-16-be")
        else:
            code = int(m[3] or m[4] or m[5], 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            keep(m.start())
            parts.append(chr(code))
            begins.append(np.array([m.start()]))
            ends.append(np.array([m.end()]))
            at = m.end()
            continue
        keep(m.start())
        stops = m.start() + np.cumsum(sizes) * width
        parts.append(text)
        begins.append(np.concatenate([[m.start()], stops[:-1]]))
        ends.append(stops)
        at = m.end()
    if not at:
        return None
    keep(len(layer.text))
    begin, end = np.concatenate(begins), np.concatenate(ends)
    if layer.begin is not None:
        begin, end = layer.begin[begin], layer.end[end - 1]
    return Layer("".join(parts), begin, end)


class _Stream:
    """Bytes that come piece by piece, with a look ahead."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.ahead = iter(pieces), b""

    def peek(self, size: int) -> bytes:
        more = [self.ahead]
        have = len(self.ahead)
        while have < size and (piece := next(self.pieces, None)) is not None:
            more.append(piece)
            have += len(piece)
        self.ahead = b"".join(more)
        return self.ahead[:size]

    def read(self, size: int = _PIECE) -> bytes:
        if not self.ahead:
            self.ahead = next((x for x in self.pieces if x), b"")
        out, self.ahead = self.ahead[:size], self.ahead[size:]
        return out


def _sliced(data: bytes) -> Iterator[bytes]:
    return (data[at : at + _PIECE] for at in range(0, len(data), _PIECE))


def _packing(head: bytes) -> str | None:
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and not (head[0] * 256 + head[1]) % 31:
        return "zlib"
    return next((k for k, magic in (("bz2", b"BZh"), ("xz", b"\xfd7zXZ\x00"), ("zstd", b"\x28\xb5\x2f\xfd")) if head.startswith(magic)), None)


def _one_member(source: _Stream, kind: str) -> Iterator[bytes]:
    """The content of the first member or stream of ``source`` (of all frames of zstd), whose rest is left there. Empty pieces: input was read."""
    if kind == "zstd":
        with zstandard.ZstdDecompressor().stream_reader(source, read_size=_PIECE, read_across_frames=True, closefd=False) as reader:
            while out := reader.read(_PIECE):
                yield out
        return
    unpack = {"zlib": lambda: zlib.decompressobj(47), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
    data = b""
    while not unpack.eof:
        if kind == "zlib":
            data = data or source.read()
            if not data:
                yield unpack.flush()
                return
            out, data = unpack.decompress(data, _PIECE), unpack.unconsumed_tail
        else:
            if unpack.needs_input and not (data := source.read()):
                return
            out, data = unpack.decompress(data, _PIECE), b""
        yield out
    source.ahead = unpack.unused_data + source.ahead


class _Unpacked(_Stream):
    """The contents of all members that follow each other in ``source``, and the bytes behind them. ``plain``: it was not compressed, and is
    passed on as it is. ``cut``: some of it could not be read, or came after ``most`` bytes (``stopped``)."""

    def __init__(self, source: _Stream, most: int | None):
        super().__init__(self._run(source, most))
        self.plain = self.cut = self.stopped = False

    def _run(self, source: _Stream, most: int | None) -> Iterator[bytes]:
        total, first = 0, True
        while (kind := _packing(source.peek(6))) is not None:
            held: list[bytes] | None = []  # what a member that turns out to be none has taken
            taken = _Stream(())
            taken.pieces = self._noted(source, held)
            got = False
            try:
                for out in _one_member(taken, kind):
                    if out:
                        got = True
                        held.clear()
                        if most is not None and total + len(out) > most:
                            self.cut = self.stopped = True
                            yield out[: most - total]
                            return
                        total += len(out)
                        yield out
                    elif got:
                        held.clear()
            except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
                if got:
                    self.cut = True
                    return
                self.plain = first
                source.ahead = b"".join(held) + source.ahead
                break
            source.ahead = taken.ahead + source.ahead
            first = False
        while piece := source.read():
            yield piece

    @staticmethod
    def _noted(source: _Stream, held: list[bytes]) -> Iterator[bytes]:
        while piece := source.read():
            held.append(piece)
            yield piece


def _unfold(data: bytes, most: int | None) -> tuple[_Stream, list[_Unpacked]] | None:
    """What compressed data unfolds to, through all its layers, and these layers; None if it is not compressed."""
    if _packing(data) is None:
        return None
    stream, through, seen = _Stream(_sliced(data)), [], {xxhash.xxh3_128_digest(data[:CHUNK_BYTES])}
    while _packing(stream.peek(6)) is not None:
        inner = _Unpacked(stream, most)
        head = inner.peek(CHUNK_BYTES + 1)
        if inner.plain:
            if not through:
                return None
            return inner, through
        through.append(inner)
        key = xxhash.xxh3_128_digest(head[:CHUNK_BYTES])
        stream = inner
        if key in seen:  # it contains itself
            inner.cut |= len(head) > CHUNK_BYTES
            break
        seen.add(key)
        if len(head) <= CHUNK_BYTES:
            stream = _Stream(_sliced(head))
    return stream, through


def _chunks(stream: _Stream) -> Iterator[tuple[bytes, bool]]:
    """The stream in chunks that end where no pattern, escape or base64 run can go on. The flag: a run of over MAX_RUN_BYTES was divided; its
    parts overlap."""
    rest = b""
    while True:
        new = stream.peek(CHUNK_BYTES)
        stream.ahead = stream.ahead[len(new) :]
        buffer = rest + new
        if not new:
            if buffer:
                yield buffer, False
            return
        cut = buffer.translate(_BREAKS).rfind(b"\n") + 1
        while cut and _B64_LINE.fullmatch(buffer, line := buffer.rfind(b"\n", 0, cut - 1) + 1, cut):  # base64 may go on in the next line
            cut = line
        if cut:
            yield buffer[:cut], False
            rest = buffer[cut:]
        elif len(buffer) >= MAX_RUN_BYTES:
            yield buffer, True
            rest = buffer[-OVERLAP:]
        else:
            rest = buffer


class _Found:
    """What a scan of one text has met."""

    def __init__(self) -> None:
        self.cut, self.unread = 0, set()


def _begins(head: bytes) -> bool:
    """Whether zlib can read these first bytes; those of other kinds are told by longer marks."""
    if _packing(head) != "zlib":
        return True
    try:
        zlib.decompressobj(47).decompress(head)
    except zlib.error:
        return False
    return True


def _unfolded(data: bytes, begin: int, end: int, most: int | None, met: _Found) -> Iterator[Layer]:
    """The layers inside compressed data that begins anywhere in the bytes of a run. Damage counts where the data begins the run; further
    inside, what looks like a beginning may be none."""
    starts = [0] if _packing(data) is not None else []
    for at in [*starts, *(m.start() for m in _MAGIC.finditer(data, 1))]:
        if at and not _begins(data[at : at + 64]) or (unfolded := _unfold(data[at:], most)) is None:
            continue
        stream, through = unfolded
        divided = False
        for chunk, forced in _chunks(stream):
            divided |= forced
            for text, _, _ in _readings(chunk):
                yield Layer(text, np.broadcast_to(np.int64(begin), len(text)), np.broadcast_to(np.int64(end), len(text)))
        stopped = most is not None and any(x.stopped for x in through)
        if at == 0 or stopped or divided:
            if cut := sum(x.cut for x in through) + divided:
                met.cut += cut
                met.unread.add((begin, end))


def _wrapped(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs that line breaks divide, without these, and the place of each character: all lines but the first and the last are of one
    width, which the last one does not pass; a first line may be longer or shorter, by what stands before it."""
    for m in _B64_LINES.finditer(text):
        lines, at = [], m.start()
        for gap in _B64_SPLIT.finditer(text, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, m.end()))
        first = 0
        while first < len(lines) - 1:
            last = first + 1
            width = len(text[slice(*lines[last])].rstrip("="))
            while last + 1 < len(lines) and lines[last][1] - lines[last][0] == width >= 20 and lines[last + 1][1] - lines[last + 1][0] <= width:
                last += 1
            if last > first + 1 or width <= lines[first][1] - lines[first][0]:
                places = np.concatenate([np.arange(s, e) for s, e in lines[first : last + 1]])
                yield "".join(text[s:e] for s, e in lines[first : last + 1]), places
            first = last


def _decoded_runs(layer: Layer, most: int | None, met: _Found) -> Iterator[Layer]:
    """The layers inside base64 runs, one at a time; in one line, and over several."""
    runs = ((m[0], np.arange(m.start(), m.end())) for m in _B64.finditer(layer.text))
    for found, places in chain(runs, _wrapped(layer.text)):
        whole = found.rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):
            run = whole[shift:]
            run = run[:-1] if len(run) % 4 == 1 else run
            data = base64.b64decode(run + "=" * (-len(run) % 4))
            yield from _unfolded(data, *layer.source(int(places[shift]), int(places[-1]) + 1), most, met)
            for text, begin, end in _readings(data):
                begin, end = places[shift + begin * 4 // 3], places[shift - (-end * 4 // 3) - 1] + 1
                if layer.begin is not None:
                    begin, end = layer.begin[begin], layer.end[end - 1]
                yield Layer(text, begin, end)


def _escaped_runs(layer: Layer, most: int | None, met: _Found) -> Iterator[Layer]:
    """The layers inside compressed data that is written with escapes of bytes."""
    for m in _ESCAPED.finditer(layer.text):
        if "%" in m[0] or "\\x" in m[0]:
            data = _BYTE.sub(lambda x: bytes([int(x[1], 16)]), m[0].encode())
            if not data.isascii():
                yield from _unfolded(data, *layer.source(m.start(), m.end()), most, met)


def _inner(layer: Layer, most: int | None, met: _Found) -> Iterator[Layer]:
    if (plain := _unescape(layer)) is not None:
        yield plain
        yield from _escaped_runs(layer, most, met)
    yield from _decoded_runs(layer, most, met)


def _scan(text: str, raw: bytes, most: int | None) -> tuple[set[Span], int, _Found]:
    met = _Found()
    coded = b"%" in raw or b"\\u" in raw or b"\\U" in raw or b"\\x" in raw
    if not coded and b"b" * 20 not in raw.translate(_B64_CLASS):
        return set(), 0, met
    work, seen, spans, layers = [_inner(Layer(text, None, None), most, met)], set(), set(), 0
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        if not x.text:
            continue
        key = (xxhash.xxh3_128_digest(x.text.encode("utf-8", "surrogatepass")), *x.source(0, len(x.text)))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for start, kind, end in find(x.text):
            begin, stop = x.source(start, end)
            spans.add((begin, kind, stop))
        work.append(_inner(x, most, met))
    return spans, layers, met


def decoded_spans(text: str, raw: bytes, most: int | None = None) -> tuple[set[Span], int, int]:
    """Spans found in decoded layers, mapped to the text; the numbers of layers and of cut ones."""
    spans, layers, met = _scan(text, raw, most)
    return spans, layers, met.cut


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _structs(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_layer_bytes: int | None = None) -> DataFrame:
    """(doc_id, base, decoded, layers, cut_layers): spans (kind, start, end) of the text itself, and those that only layers show."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more, layers, cuts = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                raw = raw or b""
                plain = raw.decode("utf-8", "replace")
                own = find(plain, raw)
                extra, n, cut = decoded_spans(plain, raw, max_layer_bytes)
                base.append(_structs(own))
                more.append(_structs(sorted(extra - set(own))))
                layers.append(n)
                cuts.append(cut)
            return record_batch({"doc_id": batch.column(0), "base": pa.array(base, _SPANS), "decoded": pa.array(more, _SPANS), "layers": pa.array(layers, pa.int64()), "cut_layers": pa.array(cuts, pa.int64())})

        return each

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(kept, make, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, base {spans}, decoded {spans}, layers bigint, cut_layers bigint")


def redact(text: str, mark: str = "[SECRET]", most: int | None = REDACT_LAYER_BYTES) -> str:
    """The text with every found span, decoded ones included, replaced, and so every compressed run that could not be read whole;
    overlapping spans as one."""
    raw = text.encode("utf-8", "surrogatepass")
    extra, _, met = _scan(text, raw, most)
    spans = sorted({*find(text, raw), *extra, *((begin, -1, end) for begin, end in met.unread)})
    if not spans:
        return text
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_documents(docs: DataFrame, *, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with secrets replaced in the texts; a ``chars`` column is set to the new number of code points. Null stays null."""
    place = docs.columns.index(text)
    counted = docs.columns.index(chars) if chars in docs.columns else None

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = batch.column(place).to_pylist()
            new = [None if x is None else redact(x) for x in old]
            columns = list(batch.columns)
            columns[place] = pa.array(new, columns[place].type)
            if counted is not None:
                kept = columns[counted].to_pylist()
                columns[counted] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)], columns[counted].type)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return each

    return rewrite_batches(docs, make)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "decoded"), order))
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
        F.size("decoded").cast("long").alias("n_decoded"), "layers", "cut_layers",
    )
