"""Operator 13: fill-in-the-middle transformation of texts that are held as seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME_CHARS code points, followed by a skippable frame that
holds, for each frame, its compressed size and the code points and line ends up to its end. So a place in a text is found
by a search in the index and the decompression of one frame: `transform` draws its two cuts among the lines, decompresses
only the frames that a cut goes through, copies all others as they are, and `digests` stream ordered frames through SHA-256.
No text is whole in memory after it has been packed, and the original is rebuilt from the output and its form alone.

A unit is a line with its end (`[^\\n]*\\n|[^\\n]+`). Null texts count as empty; an empty text, and one that holds a marker, is
plain: its output is the text. A null id draws as an empty one. Repeated rows give repeated results; very long texts have
many frames, whether their lines are short or long; empty tables give no rows; extra columns of clashing names (frames, n,
form, prefix_chars, middle_chars, output) are replaced by the operator's own. Row-local: nothing is shuffled.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lotwise.llm.common import read_table

FRAME_CHARS, LEVEL = 1 << 15, 3
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts of the draws: the seed, and how many of 100 texts are transformed, and have the suffix first.
SEED, FIM_PERCENT, SPM_PERCENT = "7", 100, 50
#: Rows that a worker holds at once.
ROWS = 500
# Fixed values of the format: a skippable frame's magic number, its head, an entry of the index, and the end of the index.
SKIPPABLE = 0x184D2A5E
HEAD, ENTRY, FOOT = struct.Struct("<II"), struct.Struct("<IQQ"), struct.Struct("<I")


class Writer:
    """Frames of a text that comes in pieces of UTF-8 bytes."""

    def __init__(self, frame_chars: int = FRAME_CHARS):
        self.frame_chars, self.zip = frame_chars, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.index: list[bytes] = []
        self.held: list[bytes] = []
        self.held_chars = self.chars = self.units = 0

    def add(self, piece: bytes) -> None:
        text = piece.decode()
        for at in range(0, len(text), self.frame_chars):
            part = text[at : at + self.frame_chars]
            if self.held_chars + len(part) > self.frame_chars:
                self.flush()
            self.held.append(part.encode())
            self.held_chars += len(part)

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            self.copy(self.zip.compress(raw), self.held_chars, raw.count(b"\n"))
            self.held, self.held_chars = [], 0

    def copy(self, frame: bytes, chars: int, units: int) -> None:
        """Take over a frame as it is, which holds so many code points and line ends."""
        self.frames.append(frame)
        self.chars, self.units = self.chars + chars, self.units + units
        self.index.append(ENTRY.pack(len(frame), self.chars, self.units))

    def done(self) -> bytes:
        self.flush()
        index = b"".join(self.index) + FOOT.pack(len(self.index))
        return b"".join([*self.frames, HEAD.pack(SKIPPABLE, len(index)), index])


class Frames:
    """A packed text, of which single frames are decompressed as they are asked for."""

    def __init__(self, packed: bytes):
        (n,) = FOOT.unpack_from(packed, len(packed) - FOOT.size)
        at = len(packed) - FOOT.size - n * ENTRY.size
        entries = list(ENTRY.iter_unpack(packed[at : len(packed) - FOOT.size]))
        self.packed, self.unzip = packed, zstandard.ZstdDecompressor()
        self.starts = [0]
        for size, _, _ in entries:
            self.starts.append(self.starts[-1] + size)
        self.chars, self.ends = [c for _, c, _ in entries], [u for _, _, u in entries]
        self.n_chars = self.chars[-1] if n else 0
        self.opened = 0

    def zipped(self, k: int) -> bytes:
        return self.packed[self.starts[k] : self.starts[k + 1]]

    def frame(self, k: int) -> bytes:
        self.opened += 1
        return self.unzip.decompress(self.zipped(k))

    def before(self, k: int) -> tuple[int, int]:
        """Code points and line ends before frame k."""
        return (self.chars[k - 1], self.ends[k - 1]) if k else (0, 0)

    @property
    def n_units(self) -> int:
        """Lines, of which the last may lack its end."""
        return (self.ends[-1] + (self.frame(len(self.chars) - 1)[-1:] != b"\n")) if self.chars else 0

    def unit_end(self, units: int) -> int:
        """Code points of the first so many units; decompresses one frame at most."""
        if units == 0:
            return 0
        k = bisect.bisect_left(self.ends, units)
        if k == len(self.ends):
            return self.n_chars
        chars, ends = self.before(k)
        raw, at = self.frame(k), -1
        for _ in range(units - ends):
            at = raw.index(b"\n", at + 1)
        return chars + len(raw[: at + 1].decode())

    def parts(self, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
        """(frame, bytes) of a range of code points in order; bytes are None where the frame lies within it as a whole."""
        k = bisect.bisect_right(self.chars, start)
        while start < end:
            first, last = self.before(k)[0], self.chars[k]
            whole = first == start and last <= end
            yield k, None if whole else self.frame(k).decode()[start - first : end - first].encode()
            start, k = last, k + 1

    def read(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Pieces of a range of code points in order, one frame at a time."""
        for k, piece in self.parts(start, self.n_chars if end is None else end):
            yield self.frame(k) if piece is None else piece

    def find(self, marker: str, start: int = 0) -> int:
        """Where a marker comes first from a place on; ValueError where it doesn't."""
        at, kept = start, ""
        for piece in self.read(start):
            text = kept + piece.decode()
            found = text.find(marker)
            if found >= 0:
                return at + found
            kept = text[-(len(marker) - 1) :]
            at += len(text) - len(kept)
        raise ValueError(f"no {marker}")

    def into(self, out: Writer, start: int, end: int) -> None:
        """Write a range: whole frames as they are, cut ones anew."""
        for k, piece in self.parts(start, end):
            if piece is None:
                out.flush()
                chars, ends = self.before(k)
                out.copy(self.zipped(k), self.chars[k] - chars, self.ends[k] - ends)
            else:
                out.add(piece)


def pack_text(text: str | None, frame_chars: int = FRAME_CHARS) -> bytes:
    out = Writer(frame_chars)
    out.add((text or "").encode())
    return out.done()


def marked(frames: Frames) -> bool:
    """Whether a text holds a marker; one that spans frames counts."""
    kept = ""
    for piece in frames.read():
        text = kept + piece.decode()
        if any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return True
        kept = text[-(max(map(len, (PREFIX, SUFFIX, MIDDLE))) - 1) :]
    return False


def draws(key: object) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the row's key alone."""
    h = hashlib.sha256(f"{SEED}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def fill_in_middle(key: object, packed: bytes, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """(n units, form, code points of prefix and middle, packed output) of one packed text."""
    frames, (h1, h2, h3, h4) = Frames(packed), draws(key)
    n = frames.n_units
    if n == 0 or h3 % 100 >= fim_percent or marked(frames):
        return n, "plain", None, None, packed
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = frames.unit_end(first), frames.unit_end(second)
    spm = h4 % 100 < spm_percent
    out = Writer()
    order = ((SUFFIX, b, frames.n_chars), (PREFIX, 0, a)) if spm else ((PREFIX, 0, a), (SUFFIX, b, frames.n_chars))
    for marker, start, end in (*order, (MIDDLE, a, b)):
        out.add(marker.encode())
        frames.into(out, start, end)
    return n, "spm" if spm else "psm", a, b - a, out.done()


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """Pieces of the original text, from the output and its form alone."""
    if form == "plain":
        yield from output.read()
        return
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if output.find(first) != 0:
        raise ValueError(f"output doesn't start with {first}")
    cut = output.find(second, len(first))
    last = output.find(MIDDLE, cut + len(second))
    one, two, middle = (len(first), cut), (cut + len(second), last), (last + len(MIDDLE), output.n_chars)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    for start, end in (prefix, middle, suffix):
        yield from output.read(start, end)


def _by_rows(df: DataFrame, inputs: list[str], made: list[tuple[str, T.DataType, pa.DataType]], one: Callable[..., tuple], without: tuple[str, ...] = ()) -> DataFrame:
    """df (less `without` and columns of the names that are made) with the columns that one() makes of each row's inputs."""
    keep = [c for c in df.columns if c not in without and c not in [m[0] for m in made]]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in made)])
    read = [*keep, *(c for c in inputs if c not in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                rows = [one(*values) for values in zip(*(b.column(read.index(c)).to_pylist() for c in inputs))]
                columns = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), made)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *columns], names=schema.names)

    return df.select(*read).mapInArrow(run, schema)


def pack(df: DataFrame, text: str = "text", out: str = "frames", frame_chars: int = FRAME_CHARS) -> DataFrame:
    """df with its text as packed frames (binary column `out`) in place of the text."""
    return _by_rows(df, [text], [(out, T.BinaryType(), pa.binary())], lambda x: (pack_text(x, frame_chars),), (text,))


def transform(df: DataFrame, key: str = "doc_id", frames: str = "frames", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and the packed output in place of the packed text."""
    made = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()),
        ("output", T.BinaryType(), pa.binary())]
    return _by_rows(df, [key, frames], made, lambda k, x: fill_in_middle(k, x, fim_percent, spm_percent), (frames,))


def output_texts(df: DataFrame) -> DataFrame:
    """df of transform() with output_text and restored_text, unpacked, in place of the packed output."""
    made = [("output_text", T.StringType(), pa.string()), ("restored_text", T.StringType(), pa.string())]
    return _by_rows(df, ["output", "form"], made, lambda x, form: tuple(b"".join(p).decode() for p in (Frames(x).read(), restored(Frames(x), form))), ("output",))


def digests(df: DataFrame) -> DataFrame:
    """df of transform() with the SHA-256 of the output and of the text rebuilt from it, each as a stream of frames, in place of the output."""
    def one(packed: bytes, form: str) -> tuple[str, str]:
        sums = []
        for pieces in (Frames(packed).read(), restored(Frames(packed), form)):
            h = hashlib.sha256()
            for p in pieces:
                h.update(p)
            sums.append(h.hexdigest())
        return sums[0], sums[1]

    return _by_rows(df, ["output", "form"], [(n, T.StringType(), pa.string()) for n in ("output_sha256", "restored_sha256")], one, ("output",))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(transform(pack(docs)))
