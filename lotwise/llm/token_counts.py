"""Operator 7: token counts by whole-token shortcut.

Offline, once per vocabulary and worker, every vocabulary string that is one whole pre-token is encoded by the library;
those that come back as exactly one token are proven to count 1. A text is cut into pre-tokens, matching ones are
counted directly, and only the distinct rest is merged by the library. Stretches with characters outside `_PLAIN` (where
two regex engines' Unicode tables might disagree) are cut out between a letter or digit and a space of ASCII, which no
pre-token spans, and counted by the library, so results never differ from it.

Null counts as an empty text; empty texts have 0 tokens; special strings inside texts are handled as the library does by
default (one token each). Texts of any length are counted whole, in pieces of bounded length unless a single pre-token is
longer. Rows that repeat, in key or text, give a row each; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lotwise.llm.byte_bpe import safe_pieces
from lotwise.llm.common import read_table

#: ASCII, Latin-1, Latin Extended-A/B, Greek, Cyrillic, common punctuation, symbols and CJK: old blocks whose classes no table disputes.
_PLAIN = regex.compile(r"[\x00-\x7F\xA0-ɁΑ-ΡΣ-ώА-я‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]*+")
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z0-9])(?= )")
#: Merged pre-tokens that one worker remembers at most; forgetting some only costs time.
REMEMBERED = 500_000


class Counts:
    """Counts tokens of texts for one tokenizer file with a byte-level pre-tokenizer."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path}: the shortcut is only proven for byte-level pre-tokenizers without normaliser or prefix space")
        self.pattern = regex.compile(pattern)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = self.prove(spec["model"]["vocab"])
        self.merged: dict[str, int] = {}
        self.letters = {b: c for c, b in self.alphabet().items()}

    def prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """Strings of the vocabulary that are one pre-token and that the library encodes as one token."""
        texts = []
        for t in map(self.plain, vocab):
            if t is not None and t not in self.special and (m := self.pattern.match(t)) and m.end() == len(t):
                texts.append(t)
        return frozenset(t for t, e in zip(texts, self.library.encode_batch(texts, add_special_tokens=False)) if len(e) == 1)

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def alphabet() -> dict[str, int]:
        """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}

    def plain(self, token: str) -> str | None:
        """The text of a vocabulary string, or None where its bytes are no text of their own."""
        try:
            return bytes(self.alphabet()[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None

    def merge(self, pre_tokens: list[str]) -> None:
        """Let the library merge pre-tokens that are not whole tokens, and remember how many tokens each gives."""
        merges, letters = self.library.model.tokenize, self.letters
        self.merged.update((t, len(merges(t.encode().decode("latin-1").translate(letters)))) for t in pre_tokens)

    def count_plain(self, text: str) -> int:
        total = 0
        for piece in safe_pieces(text):
            found = self.pattern.findall(piece)
            rest = [t for t in found if t not in self.whole]
            total += len(found) - len(rest)
            if not rest:
                continue
            seen = Counter(rest)
            if len(self.merged) > REMEMBERED:  # before this piece asks for any, lest it lose those that it has found
                self.merged.clear()
            if new := [t for t in seen if t not in self.merged]:
                self.merge(new)
            total += sum(n * self.merged[t] for t, n in seen.items())
        return total

    def count_part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return self.count_plain(text)
        total = 0
        for plain, pieces in itertools.groupby(_BETWEEN_WORDS.split(text), lambda x: _PLAIN.fullmatch(x) is not None):
            stretch = "".join(pieces)
            total += self.count_plain(stretch) if plain else sum(len(self.library.encode(x, add_special_tokens=False)) for x in safe_words(stretch))
        return total

    def count(self, text: str | None) -> int:
        """Tokens of one text, as the library counts them without begin and end tokens."""
        text = text or ""
        if self.cut is None or not any(s in text for s in self.special):
            return self.count_part(text)
        return len(self.cut.findall(text)) + sum(map(self.count_part, self.cut.split(text)))


def safe_words(text: str, most: int = 50_000) -> Iterator[str]:
    """Pieces of at most about `most` characters, cut where _BETWEEN_WORDS is."""
    at = 0
    while len(text) - at > most and (m := _BETWEEN_WORDS.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@functools.lru_cache(maxsize=4)
def counts(path: str, pattern: str) -> Counts:
    return Counts(path, pattern)


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit. Row-local: no shuffle."""
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counts(path, pattern).count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024)
