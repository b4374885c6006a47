"""Secret scans: fixed patterns, and the novelty of strings in sensitive places by dictionary-primed zstandard."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import batches, least_count, save

#: Fixed patterns and least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HEXES = re.compile(r"[0-9a-f]+|[0-9A-F]+")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"passw|pwd|secret|token|api_?key|key|auth|bearer|credential|private|signature|salt", re.ASCII | re.IGNORECASE)
SENSITIVE_HINTS = ("passw", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "salt")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Identifiers that code and settings hold often; they prime the compressor, before those of the corpus.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret session cookie username user_id "
    "authorization bearer basic signature credential certificate example placeholder changeme default undefined null true false function return import "
    "export const class public static void string integer boolean number value name type index length config settings environment production development "
    "localhost http https www example com org net html json xml utf-8 base64 encode decode encrypt decrypt hash salt random uuid timestamp version "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx"
)
#: Words that count as identifiers of the corpus, and how many of them, the most frequent ones, prime the compressor.
IDENTIFIER, MOST_IDENTIFIERS = re.compile(r"[A-Za-z_][A-Za-z0-9_]{5,39}"), 8192
#: Different words that a task holds before it passes their counts on.
MOST_HELD = 300_000
#: Characters of context on either side; how far behind a sensitive word's end a candidate may begin, on its line.
AROUND, BEFORE = 256, 48
#: A string is new from this share of the bytes on that random strings like it add in its place, and random strings it is measured against.
NOVEL, STANDINS = 0.88, 4
#: Known text before the surroundings: where little else is compressed, a compressor would store all of it as it is, and known strings would look new.
FILLER = IDENTIFIERS[: len(IDENTIFIERS) // 2].encode()


@cache
def _packer(identifiers: str) -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(identifiers.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_checksum=False, write_content_size=False)


@lru_cache(maxsize=512)  # 8 MB at most, however many shapes a corpus has
def _standins(shape: str) -> tuple[str, ...]:
    """Random strings of a shape: ``a``, ``A``, ``f`` and ``0`` stand for a letter, a capital, a hex letter and a digit; others are kept."""
    rng = random.Random(shape)
    letters = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "f": "abcdef", "F": "ABCDEF", "0": "0123456789"}
    return tuple("".join(rng.choice(letters.get(c, c)) for c in shape) for _ in range(STANDINS))


def _shape(s: str) -> str:
    """Letters as ``a`` or ``A``, digits as ``0``; in a string of hex digits alone its letters are ``f`` or ``F``."""
    small, large = ("f", "F") if HEXES.fullmatch(s) else ("a", "A")
    return "".join(small if c.islower() else large if c.isupper() else "0" if c.isdigit() else c for c in s)


def novelty(candidate: str, before: str, after: str = "", identifiers: str = IDENTIFIERS) -> float:
    """Marginal compressed bytes of a candidate, given its surroundings and the identifiers, as a share of what random strings of its shape add.

    The surroundings are compressed behind the dictionary of identifiers, with
    the candidate in its place and without it; the difference is what it adds.
    The share is about 1 for a random string of any alphabet and length, and
    lower the more of it is known.
    """
    own, left, right = (x.encode("utf-8", "surrogatepass") for x in (candidate, before, after))
    left = FILLER + left
    size = lambda data: len(_packer(identifiers).compress(data))
    without = size(left + right)
    shape = _shape(candidate[:4096])  # the surest strings are long; the share of their start tells enough of the rest
    usual = sum(size(left + x.encode() + right) - without for x in _standins(shape)) / STANDINS * (len(candidate) / max(1, len(shape)))
    return max(0, size(left + own + right) - without) / max(1.0, usual)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern finds, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of strings that begin at most ``BEFORE`` characters behind a sensitive word, on its line, and touch no pattern find; one pass over all three."""
    low = text.lower()
    if not any(h in low for h in SENSITIVE_HINTS):
        return
    words, last, k = SENSITIVE.finditer(text), -1, 0
    word = next(words, None)
    reach = 0  # the end of the pattern finds that begin before the candidate's end
    for m in CANDIDATE.finditer(text):
        while word is not None and word.start() <= m.start():
            last, word = word.end(), next(words, None)
        while k < len(found) and found[k][0] < m.end():
            reach, k = max(reach, found[k][2]), k + 1
        if last >= 0 and m.start() - last <= BEFORE and reach <= m.start() and text.find("\n", last, m.start()) < 0:
            yield m.span()


def spans(text: str | None, identifiers: str = IDENTIFIERS) -> list[tuple[int, str, int, float | None]]:
    """(start, kind, end, novelty) of all finds, by start and then kind. Offsets count code points; null is empty.

    Other copies of a candidate are left out of its surroundings, so that a
    secret that stands twice is as new as one that stands once. Pattern finds
    are reported whatever they add, and have no novelty.
    """
    text = text or ""
    found = base_spans(text)
    out: list[tuple[int, int, int, float | None]] = [(a, k, b, None) for a, k, b in found]
    for a, b in candidates(text, found):
        own = text[a:b]
        near = (text[max(0, a - AROUND) : a].replace(own, ""), text[b : b + AROUND].replace(own, ""))
        if (share := novelty(own, *near, identifiers)) >= NOVEL:
            out.append((a, 3, b, share))
    return [(a, KINDS[k], b, share) for a, k, b, share in sorted(out, key=lambda x: x[:3])]


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = MOST_IDENTIFIERS) -> str:
    """The identifiers that most texts hold, the most frequent last, where a compressor finds them nearest, behind the fixed ones.

    All texts are counted; tasks count their own texts before anything moves,
    and the driver gets ``most`` words or fewer, those from some count on.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in parts:
            for text in part.column(0):
                held.update({w for w in IDENTIFIER.findall(text.as_py() or "") if not HEXES.fullmatch(w)})
                if len(held) > MOST_HELD:
                    yield from batches(held.items(), schema)
                    held.clear()
        yield from batches(held.items(), schema)

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = save(counted)
    found = [r["word"] for r in sorted(counted.where(F.col("n") >= least_count(counted, most)).collect(), key=lambda r: (-r["n"], r["word"]))]
    return " ".join([IDENTIFIERS, *reversed(found)])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most_identifiers: int = MOST_IDENTIFIERS) -> DataFrame:
    """id and ``spans`` (array of kind, start, end, novelty and, if asked for, the string) of every row, also of rows without finds.

    Kinds: assign, access and hex by pattern; novel: other strings near a
    sensitive word that stay as long as random ones when compressed among
    their surroundings and the corpus's identifiers. Null texts are empty;
    repeated rows each give a row; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    identifiers = corpus_identifiers(docs, text_col, most_identifiers)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64()), ("string", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                yield i, [{"kind": k, "start": a, "end": b, "novelty": rate, "string": text[a:b] if with_text else None} for a, k, b, rate in spans(text, identifiers)]

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        lambda it: batches(rows(it), schema), "doc_id long, spans array<struct<kind string, start long, end long, novelty double, string string>>"
    )
    return out.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a hash of the pattern finds, and all finds as one string."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        id_col, *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
