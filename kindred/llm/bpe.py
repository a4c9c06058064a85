"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Documents stand in chunks, consecutive rows of a scan partition with about CHUNK characters. The distinct pre-tokens of
each chunk are numbered and shuffled by word: a word's hash names its bucket, where it meets itself from all chunks and is
encoded once, and its ids travel back to the chunk by number. A document waits for them as its pre-tokens' numbers in order
of position, and is reassembled by position. No word is hot: it is shuffled once for a chunk that has it, not once for
each occurrence, and buckets are alike. Decoding looks every id up in the token-byte table. What travels is packed: a row
holds a chunk's words of a bucket, or the numbers of some documents, compressed.

The scan is read twice, once for the words and once for the documents' numbers; a written table of both would cost as much
disk as the shuffles themselves. Both times the same rows have to make a chunk, so the scans are pinned (common.pinned_scans)
and results are written before they are returned. Each chunk's words and documents carry a checksum of its numbering:
should the two not agree, a task raises an error instead of returning other words.

Ranks and pattern are those of a published vocabulary; its path is a parameter, read on the driver.

Defined results: null counts as empty; an empty text has no tokens; rows are never merged, also with equal or null ids;
columns other than doc_id and text are never read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import durable, map_batches, pinned_scans, scanned, shuffles_removed

CHUNK = 12_000_000
ROWS = 512
#: Words that a bucket remembers; beyond it, it starts anew.
MEMO = 500_000
#: Rows of words stand before the rows of their chunk's documents.
WORDS = -1


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of unsigned numbers below 2^32 and some bytes, compressed; the four bytes of all numbers stand in planes, of which the high ones are nearly constant."""
    sizes = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    planes = [np.asarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zs.ZstdCompressor(level=3).compress(sizes + b"".join(planes) + tail)


def unpack(body: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zs.ZstdDecompressor().decompress(body)
    k = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<u4", k, 4).tolist(), 4 * (k + 1), []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, -1).T).view("<u4").ravel())
        at += 4 * n
    return out, raw[at:]


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    """data in pieces of the given sizes."""
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[x:y] for x, y in zip([0, *ends[:-1]], ends)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


class Splitter:
    """Pre-tokens of a text, as pattern.findall gives them.

    The pattern has no look-behind, and a match never runs over a blank or line end that stands between two visible
    characters but starts at it (blank) or is a match by itself (line end). So a text is cut there first, and the pieces,
    of which most are frequent, are matched once each.
    """

    def __init__(self, pattern: str):
        import regex

        self.findall = regex.compile(pattern).findall

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(True, line) for a line that is cut at its single blanks, (False, piece) for what has other white space."""
        for line in self.lines(text):
            yield not (line == "\n" or "  " in line or line[0] == " " or line[-1] == " " or not line.isprintable()), line

    def pieces(self, text: str) -> list[str]:
        """The pieces that are matched on their own, in order (for tests; chunks keep words after a blank apart)."""
        out: list[str] = []
        for plain, piece in self.parts(text):
            words = piece.split(" ") if plain else [piece]
            out.append(words[0])
            out.extend([" " + w for w in words[1:]])
        return out

    def matches(self, words: list[str], blank: bool) -> tuple[list[str], list[int]]:
        """The pre-tokens of words (visible characters alone) after a blank, or at the start of a line, matched in one go; how many each word has."""
        if not words:
            return [], []
        if blank:
            found = self.findall(" " + " ".join(words))
            starts = np.flatnonzero(np.fromiter([w[0] == " " for w in found], bool, len(found)))
            return found, np.diff(starts, append=len(found)).tolist()
        found = self.findall("\n".join(words))
        ends = np.flatnonzero(np.fromiter([w == "\n" for w in found], bool, len(found)))
        return [w for w in found if w != "\n"], (np.diff(ends, prepend=-1, append=len(found)) - 1).tolist()

    @staticmethod
    def lines(text: str) -> list[str]:
        """Lines and line ends as pieces; a line end with white space beside it stays with its neighbours."""
        out: list[str] = []
        held = ""
        parts = text.split("\n")
        for k, p in enumerate(parts):
            if k:
                before = held if held else (out[-1] if out else "")
                if before and not before[-1].isspace() and p and not p[0].isspace():
                    if held:
                        out.append(held)
                    out.append("\n")
                    held = p
                else:
                    held += "\n" + p
            else:
                held = p
        if held:
            out.append(held)
        return out


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def listed(words: pa.Array) -> list[str]:
    """Strings without blanks as a list (some times faster than one after the other)."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(words) else []


class Chunk:
    """The distinct pre-tokens of some documents, numbered in order of appearance; those of the first texts by frequency."""

    def __init__(self, splitter: Splitter):
        self.splitter = splitter
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.entry: tuple[dict[str, int], ...] = ({}, {}, {})  # of a word after a blank, a line's first word, and a piece with other white space
        self.pool, self.ends = array("I"), array("I", [0])  # the numbers of all entries, and where each entry's end

    def add(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Take in the pre-tokens of texts: how many each text has, and their numbers. Equal words of these texts are looked up once."""
        lines: list[str] = []
        odd: list[str] = []
        parts = np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            for plain, piece in self.splitter.parts(t or ""):
                if plain:
                    lines.append(piece)
                else:
                    lines.append("")  # no line is empty
                    odd.append(piece)
            parts[k + 1] = len(lines)
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        at = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, codes = listed(coded.dictionary), np.asarray(coded.indices).astype(np.int64)
        codes[at[:-1]] += len(words)
        names = list(dict.fromkeys(odd))
        if odd:
            code = {w: 2 * len(words) + k for k, w in enumerate(names)}
            codes[at[:-1][codes[at[:-1]] == len(words) + words.index("")]] = [code[w] for w in odd]
        entries = self._entries(codes, words, names)[codes]
        ends = np.array(self.ends, np.int64)
        sizes = np.diff(ends)[entries]
        until = np.concatenate([[0], np.cumsum(sizes)])
        where = np.arange(until[-1]) + np.repeat(ends[entries] - until[:-1], sizes)
        return np.diff(until[at[parts]]), np.array(self.pool, np.uint32)[where]

    def _entries(self, codes: np.ndarray, words: list[str], odd: list[str]) -> np.ndarray:
        """The entry of each code that occurs; codes count words after a blank, then first words of lines, then odd pieces."""
        n = len(words)
        often = np.bincount(codes, minlength=2 * n + len(odd))
        order = np.arange(len(often)) if self.number else np.argsort(-often, kind="stable")
        order = order[often[order] > 0]
        out = np.zeros(len(often), np.int64)
        for kind, base, names in zip(range(3), (0, n, 2 * n), (words, words, odd), strict=True):
            mine = order[(order >= base) & (order < base + len(names))]
            own = [names[c] for c in (mine - base).tolist()]
            known = np.fromiter(map(self.entry[kind].get, own, repeat(-1)), np.int64, len(own))
            new = np.flatnonzero(known < 0)
            known[new] = np.arange(len(new)) + len(self.ends) - 1
            self._learn([own[k] for k in new.tolist()], kind)
            out[mine] = known
        return out

    def _learn(self, new: list[str], kind: int) -> None:
        """Entries for these words, in this order."""
        if kind == 2:
            each = [self.splitter.findall(w) for w in new]
            found, sizes = [x for e in each for x in e], list(map(len, each))
        else:
            found, sizes = self.splitter.matches(new, kind == 0)
        self.entry[kind].update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(sizes)), strict=True))
        self.pool.extend(map(self.number.__getitem__, found))
        self.ends.extend(accumulate(sizes, initial=self.ends.pop()))


def _chunks(batches: Iterator[pa.RecordBatch], pattern: str, chars: int) -> Iterator[tuple[int, Chunk, list, tuple, bool]]:
    """(chunk id, chunk, doc_ids, counts and numbers of their pre-tokens, whether the chunk ends here) for slices of a scan partition, alike in every pinned pass."""
    splitter = Splitter(pattern)
    part = TaskContext.get().partitionId()
    k, size, chunk = 0, 0, Chunk(splitter)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            texts = b.column("text").to_pylist()
            numbered = chunk.add(texts)
            size += sum(len(t or "") for t in texts)
            yield (part << 20) + k, chunk, b.column("doc_id").to_pylist(), numbered, size >= chars
            if size >= chars:
                k, size, chunk = k + 1, 0, Chunk(splitter)
    if chunk.number:
        yield (part << 20) + k, chunk, [], (), True


def distinct_words(docs: DataFrame, pattern: str, chars: int = CHUNK) -> DataFrame:
    """bucket, chunk, mark, body: the distinct pre-tokens of each chunk by bucket; packed numbers (their differences), sizes and bytes."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("mark", pa.int64()), ("body", pa.binary())])
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for k, chunk, _, _, ends in _chunks(batches, pattern, chars):
            if not ends or not chunk.number:
                continue
            words = [w.encode() for w in chunk.number]
            of = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
            order = np.argsort(of, kind="stable")
            found, starts = np.unique(of[order], return_index=True)
            bodies = []
            for numbers in np.split(order, starts[1:]):
                own = [words[n] for n in numbers.tolist()]
                bodies.append(pack(np.diff(numbers, prepend=0), np.fromiter(map(len, own), np.int64, len(own)), tail=b"".join(own)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), k)), pa.array(np.full(len(found), mark_of(words))), pa.array(bodies, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "bucket int, chunk long, mark long, body binary")


_BACK = pa.schema([("chunk", pa.int64()), ("at", pa.int64()), ("mark", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary())])
_BACK_SQL = "chunk long, at long, mark long, doc_ids array<long>, body binary"


def mark_of(words: list[bytes]) -> int:
    """A checksum of a chunk's numbering."""
    return zlib.crc32(b"\0".join(words))


def numbered_documents(docs: DataFrame, pattern: str, chars: int = CHUNK) -> DataFrame:
    """chunk, at, mark, doc_ids, body: some documents, from row `at` of the partition on; packed counts of pre-tokens, and their numbers. The last row of a chunk has its mark."""

    def run(batches):
        row = 0
        for k, chunk, ids, numbered, ends in _chunks(batches, pattern, chars):
            body = pack(*(numbered or [np.zeros(0, np.uint32)] * 2))
            mark = mark_of([w.encode() for w in chunk.number]) if ends else None
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([row]), pa.array([mark], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.binary())], schema=_BACK)
            row += len(ids)

    return docs.mapInArrow(run, _BACK_SQL)


def encoded_words(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """chunk, at (WORDS), mark, doc_ids (null), body: packed numbers (their differences), counts of ids, and ids; equal words meet and are encoded once."""
    vocab = words.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary file, of fixed size
    met = words.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        encoded = _encoder(vocab.value, pattern)._encode_single_piece  # a word is one match
        memo: dict[bytes, bytes] = {}
        now = None
        for b in batches:
            bodies = []
            for bucket, body in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True):
                if bucket != now or len(memo) > MEMO:
                    now, memo = bucket, {}
                (steps, sizes), data = unpack(body)
                own = cut(data, sizes)
                for w in own:
                    if w not in memo:
                        memo[w] = array("I", encoded(w)).tobytes()
                each = [memo[w] for w in own]
                bodies.append(pack(steps, np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), np.uint32)))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(np.full(n, WORDS)), b.column("mark"), pa.nulls(n, pa.list_(pa.int64())), pa.array(bodies, pa.binary())], schema=_BACK)

    return met.mapInArrow(run, _BACK_SQL)


def strings(data: pa.Buffer, ends: np.ndarray) -> pa.LargeBinaryArray:
    """data cut at 0 and the given ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), data])


def joined(of: pa.LargeBinaryArray, at: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The strings at these places one after the other, and where each ends."""
    out = of.take(pa.array(at))
    _, ends, data = out.buffers()
    return data or pa.py_buffer(b""), np.frombuffer(ends, np.int64, len(out), 8) if len(out) else np.zeros(0, np.int64)


def _reassembled(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chars: int, schema: str, start: Callable, finish: Callable) -> DataFrame:
    """finish(rid, doc_id, strings) for each document, which has a string for each array of start(ids, ends): the ids of some words, and their ends."""
    rows = scanned(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    back = numbered_documents(rows, pattern, chars).unionByName(encoded_words(distinct_words(rows, pattern, chars), ranks, pattern))
    back = back.repartition("chunk").sortWithinPartitions("chunk", "at")

    def run(parts):
        now, found, words, marks = None, [], None, set()
        for b in parts:
            for chunk, at, mark, doc_ids, body in zip(b["chunk"], b["at"], b["mark"], b["doc_ids"], b["body"], strict=True):
                if chunk != now:
                    now, found, words, marks = chunk, [], None, set()
                if mark is not None:
                    marks.add(mark)
                    if len(marks) > 1:
                        raise RuntimeError(f"the words and the documents of chunk {chunk} come from different rows: files or settings changed while they were read")
                if at == WORDS:
                    found.append(body)
                    continue
                if words is None:
                    each = [unpack(packed)[0] for packed in found] or [[np.zeros(0, np.uint32)] * 3]
                    order = np.argsort(np.concatenate([np.cumsum(steps, dtype=np.int64) for steps, _, _ in each]))
                    ends = np.cumsum(np.concatenate([counts for _, counts, _ in each]), dtype=np.int64)
                    words, found = [x.take(pa.array(order)) for x in start(np.concatenate([own for _, _, own in each]), ends)], []
                (counts, numbers), _ = unpack(body)
                until = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                cuts = []
                for x in words:
                    data, ends = joined(x, numbers)
                    at_end = np.concatenate([[0], ends])[until].tolist()
                    view = memoryview(data)
                    cuts.append([view[y:z] for y, z in zip(at_end[:-1], at_end[1:], strict=True)])
                yield [finish((chunk >> 20 << 33) + at + k, i, *own) for k, (i, *own) in enumerate(zip(doc_ids, *cuts, strict=True))]

    with pinned_scans(docs.sparkSession), shuffles_removed(docs.sparkSession):
        return durable(map_batches(back, schema, run, rows=64), "bpe-documents")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chars: int = CHUNK) -> DataFrame:
    """rid, doc_id, ids (binary, four bytes each, little-endian): one row for each row of docs."""

    def start(ids, ends):
        return [strings(pa.py_buffer(ids.astype("<u4")), 4 * ends)]

    def finish(rid, doc_id, ids):
        return rid, doc_id, bytes(ids)

    return _reassembled(docs, ranks, pattern, chars, "rid long, doc_id long, ids binary", start, finish)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """rid, doc_id, bytes: every id looked up in the token-byte table, which has the vocabulary's fixed size and is broadcast."""
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(parts):
        of = table.value
        for b in parts:
            yield [(r, d, b"".join(map(of.__getitem__, array("I", ids)))) for r, d, ids in zip(b["rid"], b["doc_id"], b["ids"], strict=True)]

    return map_batches(encoded, "rid long, doc_id long, bytes binary", run, rows=256)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chars: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs: encoding, and decoding of its ids, in one pass.

    The ids of each word are looked up in the token-byte table once for a chunk; documents join ids and bytes by position.
    """
    table = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    sha = hashlib.sha256

    def start(ids, ends):
        of = table.value
        last = ends - 1  # every word has an id
        out = [strings(pa.py_buffer(ids.astype("<u4")), 4 * ends)]
        for names in ([b"%d," % k for k in range(len(of))], of):
            data, until = joined(pa.array(names, pa.large_binary()), ids)
            out.append(strings(data, until[last]))
        return out

    def finish(rid, doc_id, ids, decimal, raw):
        return doc_id, len(ids) // 4, sha(decimal[:-1]).hexdigest(), sha(raw).hexdigest()

    return _reassembled(docs, ranks, pattern, chars, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start, finish)
