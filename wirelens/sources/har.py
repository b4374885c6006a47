"""The capture source: HTTP Archive files, complete or cut short, as rows without sensitive fields.

Everything that a row may hold is picked here, inside the reader, so that no
header, cookie, query value, posted data, body or title reaches Spark. A file
is read through a buffer of fixed size and its rows leave as they are found,
so a task's memory does not grow with a capture, a page or an entry.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from typing import BinaryIO
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from wirelens.schema import PHASES, RAW

#: Request methods and media classes that are passed on by name; anything else is "other".
METHODS = frozenset("GET HEAD POST PUT PATCH DELETE OPTIONS CONNECT TRACE".split())
MEDIA = (("html", "html"), ("css", "css"), ("javascript", "script"), ("ecmascript", "script"), ("json", "json"), ("xml", "xml"), ("image/", "image"), ("font", "font"), ("video/", "video"), ("audio/", "audio"), ("text/", "text"))
VERSION = re.compile(r"\d{1,3}(\.\d{1,3}){0,3}")
INSTANT = re.compile(r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)(?:\.(\d{1,6})\d*)?(Z|[+-]\d\d:?\d\d)?")
LONG_SEGMENT = 40

#: Bytes that are read at a time; characters up to which a value is decoded whole, larger ones being walked through; characters of a string that is looked at, longer ones counting as unknown.
CHUNK, MOST_HELD, MOST_LEAF = 1 << 18, 1 << 20, 1 << 16
#: Bytes of small captures that one task reads; a larger capture has a task of its own.
TOGETHER = 4 << 20
#: Objects and arrays within each other.
DEEPEST = 500
SPACE = re.compile(r"[ \t\r\n]*")
PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
LONGEST_NUMBER = 4000
DECODER = json.JSONDecoder()

#: What is kept of a value that is too large to decode whole.
TIMES = {"startedDateTime": True}
PAGE = {"id": True, "pageTimings": {"onContentLoad": True, "onLoad": True}} | TIMES
ENTRY = {
    "pageref": True, "time": True, "request": {"url": True, "method": True, "bodySize": True},
    "response": {"status": True, "bodySize": True, "content": {"mimeType": True, "size": True}}, "timings": dict.fromkeys(PHASES, True),
} | TIMES


class Cut(Exception):
    """The text ends, or breaks, here."""


class Json:
    """A JSON text that is read once, front to back, through a buffer.

    Holds ``MOST_HELD`` characters and two chunks at most, whatever the text.
    UTF-8 with or without a mark; bytes that aren't are left out.
    """

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.bytes = source, codecs.getincrementaldecoder("utf-8")("ignore")
        self.text, self.at, self.ended = "", 0, False
        self.more()
        while len(self.text) < 1 and not self.ended:
            self.more()
        self.text = self.text.removeprefix("\ufeff")

    def more(self) -> None:
        """Let go of what is behind and read on."""
        data = self.source.read(CHUNK)
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.bytes.decode(data, self.ended), 0

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            self.at = SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.more()

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise Cut
        self.at += 1
        return found

    def members(self) -> Iterator[str | None]:
        """Keys of an object, each when its value is next; the consumer reads the value. A key too long to hold is None."""
        self.take("{")
        mark = self.take('"}')
        while mark != "}":
            self.at -= 1
            key = self.string(MOST_LEAF)
            self.take(":")
            yield key
            mark = self.take(",}")
            if mark == ",":
                mark = self.take('"')

    def items(self) -> Iterator[None]:
        """One turn for each item of an array, when it is next."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        mark = ","
        while mark == ",":
            yield
            mark = self.take(",]")

    def string(self, most: int) -> str | None:
        """A string, or None if it is longer than ``most``; its pieces are let go of as they pass."""
        self.take('"')
        pieces, held = [], 0
        while True:
            m = PLAIN.match(self.text, self.at)
            if m[0] or (m := ESCAPE.match(self.text, self.at)):
                self.at = m.end()
                held += len(m[0])
                if held <= 6 * most:
                    pieces.append(m[0])
                continue
            rest = len(self.text) - self.at
            if rest and self.text[self.at] == '"':
                self.at += 1
                break
            # The end of the buffer may fall into an escape.
            if self.ended or rest and (self.text[self.at] != "\\" or rest >= 6):
                raise Cut
            self.more()
        found = json.loads(f'"{"".join(pieces)}"') if held <= 6 * most else None
        return found if found is not None and len(found) <= most else None

    def scalar(self) -> object:
        """A number or a literal."""
        self.peek()
        while len(self.text) - self.at <= LONGEST_NUMBER and not self.ended:
            self.more()
        m = SCALAR.match(self.text, self.at)
        if not m or len(m[0]) > LONGEST_NUMBER:
            raise Cut
        self.at = m.end()
        return json.loads(m[0])

    def skip(self) -> None:
        """Step over a value of any size, checking that it is well-formed."""
        closing: list[str] = []
        while True:
            c = self.peek()
            if c and c in "{[":
                self.at += 1
                end = "}" if c == "{" else "]"
                if self.peek() != end:
                    closing.append(end)
                    if len(closing) > DEEPEST:
                        raise Cut
                    if c == "{":
                        self._key()
                    continue
                self.at += 1
            elif c == '"':
                self.string(0)
            else:
                self.scalar()
            while closing:
                if self.take("," + closing[-1]) == ",":
                    if closing[-1] == "}":
                        self._key()
                    break
                closing.pop()
            else:
                return

    def _key(self) -> None:
        self.string(0)
        self.take(":")

    def sift(self, wanted: object) -> object:
        """A value of any size, of which only what is wanted is kept: True for a string or number, a dict for members; others are stepped over and None."""
        c = self.peek()
        if wanted is True and c == '"':
            return self.string(MOST_LEAF)
        if wanted is True and c and c not in "{[":
            return self.scalar()
        if isinstance(wanted, dict) and c == "{":
            found = {}
            for key in self.members():
                value = self.sift(wanted.get(key))
                if key in wanted:
                    found[key] = value
            return found
        self.skip()
        return None

    def value(self, wanted: object) -> object:
        """The next value: decoded whole if it is small, else sifted."""
        self.peek()
        while True:
            try:
                found, end = DECODER.raw_decode(self.text, self.at)
                # A number may go on behind the buffer.
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except (ValueError, RecursionError):
                if self.ended:
                    raise Cut from None
            if len(self.text) - self.at > MOST_HELD:
                return self.sift(wanted)
            self.more()


def walk(source: Json, kinds: frozenset[str] = frozenset({"pages", "entries"})) -> Iterator[tuple[str, object]]:
    """Parts of a capture in the order in which they are complete: version, pages and entries, one by one; at last the status.

    The walk steps through the members of the root and of ``log``, and through
    the arrays of pages and entries one by one, so a cut loses the part that
    it falls into and what follows. ``unreadable`` until ``log`` opens,
    ``truncated`` after that, ``complete`` once the root closes. Parts of a
    kind that isn't asked for are checked all the same, and given as None.
    """
    status, wanted = "unreadable", {"pages": PAGE, "entries": ENTRY}
    try:
        for key in source.members():
            if key == "log" and source.peek() == "{":
                status = "truncated"
                for name in source.members():
                    if name in wanted and source.peek() == "[":
                        for _ in source.items():
                            value = source.value(wanted[name] if name in kinds else None)
                            yield name, value if name in kinds else None
                    else:
                        value = source.value(True)
                        if name == "version":
                            yield "version", value
            else:
                source.value(None)
        yield "status", "complete" if status == "truncated" else "unreadable"
    except Cut:
        yield "status", status


def _get(value: object, *path: str) -> object:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _number(value: object, most: float = 2**62) -> float | None:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and abs(value) < most else None


def _integer(value: object, most: float = 2**62) -> int | None:
    n = _number(value, most)
    return None if n is None else int(n)


def _string(value: object) -> str | None:
    return value if isinstance(value, str) and len(value) <= MOST_LEAF else None


def _float(value: object) -> float | None:
    n = _number(value)
    return None if n is None else float(n)


def instant(value: object) -> str | None:
    """An ISO instant as Spark reads it: digits below microseconds are cut; UTC where no offset is given."""
    m = INSTANT.fullmatch(value) if isinstance(value, str) else None
    return m and f"{m[1].replace(' ', 'T')}.{(m[2] or '0').ljust(6, '0')}{m[3] or 'Z'}"


def address(value: object) -> tuple[str | None, str | None]:
    """Host and path template of a URL: no user, port, query or fragment; numbers and long or addressed segments are replaced."""
    if not isinstance(value, str):
        return None, None
    try:
        parts = urlsplit(value)
        host = parts.hostname
    except ValueError:
        return None, None
    if parts.scheme not in ("http", "https", "ws", "wss") or not host:
        return None, None
    segments = ("{s}" if len(s) > LONG_SEGMENT or "@" in s or "%40" in s or ";" in s else re.sub("[0-9]+", "{n}", s) for s in parts.path.split("/"))
    return host.lower(), "/".join(segments)


def media(value: object) -> str | None:
    low = value.lower() if isinstance(value, str) else None
    return low and next((name for part, name in MEDIA if part in low), "other")


def page_key(value: object) -> int | None:
    """A number for a page's name, by which entries find their page; the name itself may hold anything and stays here."""
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if isinstance(value, str) else None


def rows(source: BinaryIO, capture_id: str, kinds: frozenset[str] = frozenset({"page", "entry", "capture"})) -> Iterator[tuple]:
    """Rows of the source for one capture as they are found, the capture's own last; it alone has the status and the version."""
    version, status, ix = None, "unreadable", {"pages": 0, "entries": 0}
    parts = frozenset({f"{k[:-1]}ies" if k == "entry" else f"{k}s" for k in kinds})
    for kind, value in walk(Json(source), parts):
        if kind == "version":
            version = value if isinstance(value, str) and VERSION.fullmatch(value) else None
        elif kind == "status":
            status = value
        else:
            if kind == "pages" and "page" in kinds:
                times = (_float(_get(value, "pageTimings", "onContentLoad")), _float(_get(value, "pageTimings", "onLoad")))
                yield (capture_id, "page", ix[kind], None, None, page_key(_string(_get(value, "id"))), instant(_get(value, "startedDateTime")), *[None] * 10, *times)
            elif kind == "entries" and "entry" in kinds:
                request, response, timings = _get(value, "request"), _get(value, "response"), _get(value, "timings")
                content = _get(response, "content")
                host, path = address(_string(_get(request, "url")))
                method = _string(_get(request, "method"))
                yield (
                    capture_id, "entry", ix[kind], None, None, page_key(_string(_get(value, "pageref"))), instant(_get(value, "startedDateTime")), _float(_get(value, "time")), method and (method.upper() if method.upper() in METHODS else "other"), host, path,
                    _integer(_get(response, "status"), 1000), media(_string(_get(content, "mimeType"))),
                    _integer(_get(request, "bodySize")), _integer(_get(response, "bodySize")), _integer(_get(content, "size")),
                    {p: _float(_get(timings, p)) for p in PHASES}, None, None,
                )
            ix[kind] += 1
    if "capture" in kinds:
        yield (capture_id, "capture", 0, status, version, *[None] * 14)


class HarPartition(InputPartition):
    """Captures that one task reads, one after the other: (uri, capture_id)."""

    def __init__(self, captures: list[tuple[str, str]]) -> None:
        super().__init__(None)
        self.captures = captures


def _together(captures: list[tuple[str, str, int]]) -> list[HarPartition]:
    """Partitions of captures (uri, capture_id, bytes), in their order: ``TOGETHER`` bytes each at most, or one capture."""
    found, held = [], TOGETHER
    for uri, capture_id, size in captures:
        if not found or held + size > TOGETHER:
            found.append(HarPartition([]))
            held = 0
        found[-1].captures.append((uri, capture_id))
        held += size
    return found


def _system(path: str) -> tuple[object, str]:
    """The file system of a path or URI, without listing anything, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _paths(options: dict[str, str]) -> list[str]:
    given = json.loads(options["paths"]) if options.get("paths") else [options.get("path")]
    if not any(given):
        raise ValueError("the capture source needs a path")
    return [p for p in given if p]


def _files(path: str, missing: bool = False) -> dict[str, int]:
    """The files that a path names, and their sizes: itself, those of a folder, or those that match it as a pattern. Without any an error, unless they may be ``missing``."""
    from pyarrow import fs

    fixed, wild = path, ""
    if m := re.search(r"[^/]*[*?\[]", path):
        fixed, wild = path[: m.start()].rstrip("/") or "/", path[m.start() :]
    system, root = _system(fixed)
    # Names are passed on as they were given, so that a task opens the same file system.
    given = lambda name: fixed.rstrip("/") + name[len(root.rstrip("/")) :]
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        names = {given(f.path): f.size or 0 for f in found}
        if wild:
            steps = wild.split("/")
            inside = lambda name: name[len(fixed.rstrip("/")) + 1 :].split("/")
            # A pattern names files, or folders of which all files are read.
            names = {n: size for n, size in names.items() if len(inside(n)) >= len(steps) and all(fnmatchcase(x, y) for x, y in zip(inside(n), steps, strict=False))}
        if names or not wild:
            return names
    elif info.type != fs.FileType.NotFound and not wild:
        return {path: info.size or 0}
    if missing:
        return {}
    raise FileNotFoundError("no capture at the path given")


KINDS = frozenset({"page", "entry", "capture"})


class HarReader(DataSourceReader):
    """With the option ``pushdown``, filters on ``kind`` and ``capture_id`` are applied here: a capture that isn't asked for is not opened, and of one that is no row of another kind is made.

    Spark keeps one set of pushed filters for each loaded DataFrame, so one
    loaded with ``pushdown`` must be filtered in one way only within a query;
    load it again for another filter, as ``normalise`` does with a function.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.label = _paths(options), options.get("capture_id", "capture")
        self.pushed = options.get("pushdown", "false").lower() == "true"
        self.wanted: dict[str, set | None] = {"kind": None, "capture_id": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 else None
            if self.pushed and isinstance(f, IsNotNull) and f.attribute[0] in self.wanted:
                continue  # every row has both
            if not self.pushed or column not in self.wanted:
                yield f
                continue
            values = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            self.wanted[column] = values if self.wanted[column] is None else self.wanted[column] & values

    def partitions(self) -> list[HarPartition]:
        sizes = {name: size for path in self.paths for name, size in _files(path).items()}
        found = [(n, self.label if len(sizes) == 1 else f"{self.label}-{i:06d}", sizes[n]) for i, n in enumerate(sorted(sizes))]
        ids = self.wanted["capture_id"]
        found = [c for c in found if ids is None or c[1] in ids] if self.wanted["kind"] is None or self.wanted["kind"] & KINDS else []
        # Without a partition Spark would still run a task.
        return _together(found) or [HarPartition([])]

    def read(self, partition: HarPartition) -> Iterator[tuple]:
        kinds = KINDS if self.wanted["kind"] is None else KINDS & self.wanted["kind"]
        yield from _read(partition, kinds)


def _read(partition: HarPartition, kinds: frozenset[str] = KINDS) -> Iterator[tuple]:
    for uri, capture_id in partition.captures:
        system, path = _system(uri)
        with system.open_input_stream(path) as f:
            yield from rows(f, capture_id, kinds)


class HarStreamReader(DataSourceStreamReader):
    """New captures of the paths given, each taken once.

    An offset is the number of captures taken so far. Which they are is
    written in the folder ``log``, a file a batch, before Spark learns the new
    offset; a restarted stream reads it, so a capture that a batch has named
    is named by no other, and one that was named is given again until the
    batch is done. Files must appear whole (moved into place), and keep their
    names.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.label = _paths(options), options.get("capture_id", "capture")
        if not options.get("log"):
            raise ValueError("a stream of captures needs the option log: a folder that outlives the stream")
        self.system, self.log = _system(options["log"])
        self.system.create_dir(self.log, recursive=True)
        self.batches = {int(f.base_name[:-5]): f.path for f in self._logged()}
        self.taken = {n for k in self.batches for n in self._names(k)}

    def _logged(self) -> list:
        from pyarrow import fs

        return [f for f in self.system.get_file_info(fs.FileSelector(self.log)) if re.fullmatch(r"\d+\.json", f.base_name)]

    def _names(self, first: int) -> list[str]:
        """The captures of the batch that begins with the capture of this number."""
        with self.system.open_input_stream(self.batches[first]) as f:
            return json.loads(f.read())

    def _size(self, name: str) -> int:
        system, path = _system(name)
        return system.get_file_info(path).size or 0

    def initialOffset(self) -> dict[str, int]:
        return {"captures": 0}

    def latestOffset(self) -> dict[str, int]:
        fresh = sorted({n for path in self.paths for n in _files(path, missing=True)} - self.taken)
        if fresh:
            first = len(self.taken)
            path = f"{self.log}/{first:012d}.json"
            with self.system.open_output_stream(f"{path}.part") as f:
                f.write(json.dumps(fresh).encode())
            self.system.move(f"{path}.part", path)
            self.batches[first] = path
            self.taken |= set(fresh)
        return {"captures": len(self.taken)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[HarPartition]:
        low, high = start["captures"], end["captures"]
        named = [(n, f"{self.label}-{i:06d}") for first in sorted(self.batches) if low <= first < high for i, n in enumerate(self._names(first), first)]
        return _together([(n, capture_id, self._size(n)) for n, capture_id in named])

    def read(self, partition: HarPartition) -> Iterator[tuple]:
        return _read(partition)


class HarDataSource(DataSource):
    """``spark.read.format("har").option("capture_id", label).load(path)``: a file, a folder or a pattern, or a list of these, one capture a file; small captures share a task.

    The label names the capture; where there are several files, a file's
    number in order of names is added to it. File names are never passed on.
    The option ``pushdown`` lets the source apply filters, see ``HarReader``.
    ``spark.readStream`` with the option ``log`` takes new captures as they
    appear, numbered in the order in which they are taken (by names where
    several are new), always with their number.
    """

    @classmethod
    def name(cls) -> str:
        return "har"

    def schema(self) -> StructType:
        return RAW

    def reader(self, schema: StructType) -> HarReader:
        return HarReader(self.options)

    def streamReader(self, schema: StructType) -> HarStreamReader:
        return HarStreamReader(self.options)
