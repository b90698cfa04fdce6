"""Where a snippet stands in a text, told exactly, by its longest phrase, or by one distinctive word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.text import ODD_CHARACTERS, PLAIN_CHARACTERS

_PLAIN_OF = dict(zip(ODD_CHARACTERS, PLAIN_CHARACTERS))
#: What may stand between two words of a phrase, one or more.
_GAP = re.compile(r"[\s\-–—:;,]+")
_NUMBER, _NAME = re.compile(r"\d+(?:\.\d+)?"), re.compile(r"[A-Za-z][A-Za-z\-]{5,}")
_GAP_CHARACTER = re.compile(r"[\s\-–—:;,]")
#: Characters whose lower case has two of them, or depends on what is around.
_UNEVEN = re.compile("[\u0130\u03a3]")
#: ASCII word characters of lower case.
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
LEAST_WORDS, MOST_WORDS = 3, 30
PLACE = "start int, `end` int, tier string"


def _occurrences(word: str, text: str) -> list[int]:
    """Where a word starts in a text, overlapping occurrences included."""
    out, p = [], text.find(word)
    while p >= 0:
        out.append(p)
        p = text.find(word, p + 1)
    return out


def _whole(words: list[str], text: str) -> tuple[int, int] | None:
    """First place of all words with gaps between them, where no word but the first starts with what a gap is made of.

    A gap then ends where the next word starts, so a walk from each place of the first word finds what Chains would.
    """
    start = text.find(words[0])
    while start >= 0:
        end = start + len(words[0])
        for w in words[1:]:
            # Most gaps are one space.
            if not text.startswith(w, end + 1) or text[end] != " ":
                gap = _GAP.match(text, end)
                if not gap or not text.startswith(w, gap.end()):
                    break
                end = gap.end() + len(w)
            else:
                end += 1 + len(w)
        else:
            return start, end
        start = text.find(words[0], start + 1)
    return None


def _token(core: str, plain: str, low: str) -> tuple[int, int] | None:
    """First place of an ASCII word in any case, with ASCII word boundaries."""
    if "\u212a" in plain:
        # The one other character whose lower case is an ASCII letter.
        m = re.search(rf"\b{re.escape(core)}\b", plain, re.I | re.A)
        return m.span() if m else None
    edge = lambda k: (k > 0 and low[k - 1] in _WORD) != (k < len(low) and low[k] in _WORD)
    word = core.lower()
    start = low.find(word)
    while start >= 0:
        if edge(start) and edge(start + len(word)):
            return start, start + len(word)
        start = low.find(word, start + 1)
    return None


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if _UNEVEN.search(text) else text.lower()


def _plain(text: str) -> str:
    """The text in plain characters, with one pass for each odd character that there is."""
    if not text.isascii():
        for odd in set(text).intersection(ODD_CHARACTERS):
            text = text.replace(odd, _PLAIN_OF[odd])
    return text


class Chains:
    """Occurrences of a snippet's words in a text, each linked to the next word's occurrence right after a gap."""

    def __init__(self, words: list[str], text: str):
        self.words = words
        found = {w: _occurrences(w, text) for w in set(words)}
        self.at = [found[w] for w in words]
        self.after: list[dict[int, int]] = [{} for _ in words]
        self.length: list[dict[int, int]] = [{} for _ in words]
        for k in reversed(range(len(words))):
            following = set(self.at[k + 1]) if k + 1 < len(words) else set()
            for p in self.at[k]:
                end = p + len(words[k])
                gap = _GAP.match(text, end) if following else None
                q = next((q for q in range(gap.end(), end, -1) if q in following), None) if gap else None
                if q is not None:
                    self.after[k][p] = q
                self.length[k][p] = 1 + (self.length[k + 1][q] if q is not None else 0)

    def place(self, first: int, n: int) -> tuple[int, int] | None:
        """First place of the n words from number `first` on."""
        start = next((p for p in self.at[first] if self.length[first][p] >= n), None)
        if start is None:
            return None
        p = start
        for k in range(first, first + n - 1):
            p = self.after[k][p]
        return start, p + len(self.words[first + n - 1])


def locate(snippet: str | None, text: str | None) -> tuple[int | None, int | None, str | None]:
    """(start, end, tier) in the normalised text: exact, phrase, token; all None where nothing is found."""
    plain = _plain(text or "")
    words = _plain(snippet or "").split()
    if not words or not plain:
        return None, None, None
    low, told = _lower(plain), [w.lower() for w in words]
    one_search = not any(_GAP_CHARACTER.match(w) for w in told[1:])
    if one_search and (found := _whole(told, low)):
        return *found, "exact"
    chains = Chains(told, low)
    if not one_search and (found := chains.place(0, len(words))):
        return *found, "exact"
    for n in range(min(len(words), MOST_WORDS), LEAST_WORDS - 1, -1):
        places = [p for s in range(len(words) - n + 1) if (p := chains.place(s, n))]
        if places:
            return *max(places, key=lambda p: p[1] - p[0]), "phrase"
    cores = [re.sub(r"[^A-Za-z0-9.\-]", "", w) for w in words]
    for core in sorted((c for c in cores if _NUMBER.fullmatch(c) or _NAME.fullmatch(c)), key=len, reverse=True):
        if found := _token(core, plain, low):
            return *found, "token"
    return None, None, None


def locate_snippets(df: DataFrame, snippet: str = "snippet", text: str = "text") -> DataFrame:
    """df with start, end and tier of each row's snippet in its text. Row-local."""
    @F.pandas_udf(PLACE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate(x, y) for x, y in zip(a, b)], columns=["start", "end", "tier"], dtype=object)

    return df.withColumn("_place", run(F.col(snippet), F.col(text))).select("*", "_place.*").drop("_place")
