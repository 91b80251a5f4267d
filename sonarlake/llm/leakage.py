"""Held-out passages in training documents: pieces found exactly by their hashes, verified by bit-parallel edit distance.

Passage and document are folded alike (wrong encodings undone, furniture of subtitles, blanks, punctuation and case removed, letters that
recognition confuses written one way). A window of the least number of words that makes a leak may differ from the document by a
budget of k edits: it holds at least k + 1 whole pieces, so that one of them is left whatever k edits do (pigeonhole). Around a piece that is found the trigrams that
k edits must leave are counted, and windows that have them are verified with Myers' algorithm.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarlake.llm.subtitles import HEADER, MARKUP, repair

MIN_WORDS = 12
MIN_CHARS = 24
MAX_EDITS = 4
PAIR_SLACK = 1  # an edit that makes or breaks a pair read as one letter counts twice; so many may
MAX_EDITS_UNSPACED = 3  # a character says more there, and 24 of them are few
BLOCK_ITEMS = 250_000  # test items in one index; more of them are searched for in several passes
PIECES, PIECES_UNSPACED = (5, 6, 7, 8, 10), (4, 5, 6)  # lengths of pieces; the longest that a budget allows is taken
_DRIFT = 4
_GRAM = 3
_PRIME = 0x9E3779B97F4A7C15

_FURNITURE = re.compile(HEADER.pattern + "|" + MARKUP.pattern)
#: What may be a sound description: brackets that close on their line.
_BRACKETED = re.compile(r"\[[^\]\r\n]*\]|\([^)\r\n]*\)|（[^）\r\n]*）|【[^】\r\n]*】")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")
#: Letters and digits that character recognition takes for each other, written one way, and pairs that are read as one.
_CONFUSED = {"0": "o", "1": "l", "i": "l", "|": "l", "î": "l", "о": "o", "e": "c"}
_CONFUSED_PAIRS = {"rn": "m", "vv": "w", "ll": "h"}
_PAIR = re.compile("|".join(_CONFUSED_PAIRS))


class _Fold(dict):
    """A table for str.translate that drops blanks, punctuation, symbols and controls."""

    def __init__(self, ascii_only: bool):
        super().__init__({ord(a): b for a, b in _CONFUSED.items()})
        self.ascii_only = ascii_only
        if ascii_only:
            self.update({ord(a): None for a in _CONFUSED if not a.isascii()})

    def __missing__(self, code: int):
        keep = not (self.ascii_only and code > 127) and unicodedata.category(chr(code))[0] not in "PZSC"
        self[code] = code if keep else None
        return self[code]


_FOLD, _FOLD_ASCII = _Fold(False), _Fold(True)


def letters_of(text: str, ascii_only: bool = False) -> str:
    """Letters and digits of a text in one row; ``ascii_only`` also loses what a lossy encoding replaces."""
    return text.lower().translate(_FOLD_ASCII if ascii_only else _FOLD)


def fold(text: str, ascii_only: bool = False) -> str:
    """The letters, with pairs that are read as one letter written as that letter."""
    out = letters_of(text, ascii_only)
    for pair, one in _CONFUSED_PAIRS.items():
        out = out.replace(pair, one)
    return out


def fold_document(text: str, all_letters: bool = False) -> tuple[str, bool]:
    """The folded document without what stands in brackets, and whether its encoding was lossy (then only ASCII letters are kept, unless ``all_letters`` are)."""
    body = _FURNITURE.sub(" ", repair(text))
    lossy = "�" in body
    return fold(_BRACKETED.sub(" ", body), lossy and not all_letters), lossy


def around_brackets(body: str, reach: int) -> list[str]:
    """Parts of a document that hold what stands in brackets, with ``reach`` characters on both sides."""
    spans: list[list[int]] = []
    for m in _BRACKETED.finditer(body):
        a, b = max(0, m.start() - reach), m.end() + reach
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [body[a:b] for a, b in spans]


def edit_distance(pattern_bits: dict[str, int], m: int, text: str, stop: int) -> int:
    """The least number of edits between a pattern of ``m`` characters and any part of ``text`` (Myers, bit-parallel); ends early at ``stop`` or less."""
    top, mask = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = mask, 0, m, m
    get = pattern_bits.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if best <= stop:
                    return best
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best


class Passage:
    """One test item in one folding: its windows with their budgets and the pieces that must be found."""

    def __init__(self, item: int, text: str, ascii_only: bool, min_words: int, min_chars: int, most: int):
        self.item, self.ascii_only = item, ascii_only
        self.unspaced = len(_UNSPACED.findall(text)) * 2 > sum(map(str.isalpha, text))
        if self.unspaced:
            words, n = list(letters_of(text, ascii_only)), min_chars
        else:
            words, n = [w for w in (letters_of(t, ascii_only) for t in text.split()) if w], min_words
        plain, at = "".join(words), [0]
        for w in words:
            at.append(at[-1] + len(w))
        # pairs that become one letter move what follows
        self.letters = fold(plain, ascii_only)
        lost = np.zeros(len(plain) + 1, int)
        for pair in _PAIR.finditer(plain):
            lost[pair.end() :] += 1
        at = [a - int(lost[a]) for a in at]
        most = min(most, MAX_EDITS_UNSPACED) if self.unspaced else most
        n = min(n, len(words))  # a shorter passage must be there as a whole
        spans = [(at[i], at[i + n]) for i in range(len(words) - n + 1)] if n else []
        sizes = PIECES_UNSPACED if self.unspaced else PIECES
        shortest = min((b - a for a, b in spans), default=0)
        self.piece = max((p for p in sizes if p <= (shortest + 1) // (most + 2)), default=sizes[0])
        self.windows: list[tuple[int, int, int, int]] = []  # start, end, budget, hits needed
        for a, b in spans:
            pieces = max(0, b // self.piece - ceil(a / self.piece))
            budget = max(0, min(most, pieces - 1))
            self.windows.append((a, b, budget, max(1, pieces - budget)))
        self.longest = max((b - a for a, b in spans), default=0)
        self.starts, self.ends = [w[0] for w in self.windows], [w[1] for w in self.windows]
        self.least_hits = min((w[3] for w in self.windows), default=1)
        self.grams = [self.letters[i : i + _GRAM] for i in range(len(self.letters) - _GRAM + 1)]
        self._bits: dict[tuple[int, int], dict[str, int]] = {}

    def pieces(self) -> list[tuple[int, str]]:
        """(place, piece): every whole piece, side by side; of a passage shorter than one, the passage."""
        if len(self.letters) < self.piece:
            return [(0, self.letters)] if self.letters else []
        return [(i, self.letters[i : i + self.piece]) for i in range(0, len(self.letters) - self.piece + 1, self.piece)]

    def bits(self, a: int, b: int) -> dict[str, int]:
        """Positions of every character in a window, as bits."""
        known = self._bits.get((a, b))
        if known is None:
            known = defaultdict(int)
            for i, c in enumerate(self.letters[a:b]):
                known[c] |= 1 << i
            known = self._bits[(a, b)] = dict(known)
        return known

    def found(self, text: str, hits: list[tuple[int, int]]) -> bool:
        """Whether a window is in ``text`` within its budget. ``hits``: (place in the text, place in the passage) of pieces."""
        hits.sort(key=lambda h: h[0] - h[1])
        gram, slack = _GRAM, 0 if self.unspaced else PAIR_SLACK
        i = 0
        while i < len(hits):
            j, diagonal = i, hits[i][0] - hits[i][1]
            while j < len(hits) and hits[j][0] - hits[j][1] <= diagonal + _DRIFT:
                j += 1
            places = sorted({h[1] for h in hits[i:j]}) if j > i + 1 else [hits[i][1]]
            likely = []
            if len(places) >= self.least_hits:
                for w in range(bisect_left(self.ends, places[0] + self.piece), bisect_right(self.starts, places[-1])):
                    a, b, budget, need = self.windows[w]
                    if bisect_right(places, b - self.piece) - bisect_left(places, a) >= need:
                        likely.append((a, b, budget + slack if budget > slack else budget))
            if likely:
                low, high = likely[0][0], max(w[1] for w in likely)
                region = text[max(0, diagonal + low - 2 * _DRIFT) : max(0, diagonal + high + 3 * _DRIFT)]
                held = {region[x : x + gram] for x in range(len(region) - gram + 1)}
                kept = [0, *accumulate(map(held.__contains__, self.grams[low : max(low, high - gram + 1)]))]
                for a, b, budget in likely:
                    # an edit takes away as many runs of letters as such a run is long
                    if kept[max(a, b - gram + 1) - low] - kept[a - low] < b - a - gram + 1 - gram * budget:
                        continue
                    part = text[max(0, diagonal + a - budget - _DRIFT) : max(0, diagonal + b + budget + 2 * _DRIFT)]
                    if self.letters[a:b] in part or budget and edit_distance(self.bits(a, b), b - a, part, budget) <= budget:
                        return True
            i += 1
        return False


def piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` code points."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h *= np.uint64(_PRIME)
        h += codes[i : n + i]
    return h ^ (h >> np.uint64(29))


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Index:
    """All pieces of all passages by their hashes: sorted, with their passages and places, and a table of bits that most places of a document fail at."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, min_chars: int, most: int):
        self.items, self.rule = items, (min_words, min_chars, most)
        found: list[tuple[int, int, int, str]] = []
        self.versions: list[tuple[int, bool]] = []  # number of the item, folding
        self.longest = 0
        for number, (item, text) in enumerate(items):
            plain = Passage(item, text, False, *self.rule)
            versions = [plain]
            # only scripts that are mostly ASCII can be told after a lossy encoding
            if not plain.unspaced and not text.isascii() and 2 * sum(c.isascii() for c in plain.letters) > len(plain.letters):
                versions.append(Passage(item, text, True, *self.rule))
            for p in versions:
                if p.windows:
                    found.extend((len(piece), len(self.versions), at, piece) for at, piece in p.pieces())
                    self.versions.append((number, p.ascii_only))
                    self.longest = max(self.longest, p.longest)
        self.sizes = sorted({f[0] for f in found})
        hashes = np.empty(len(found), np.uint64)
        size = np.array([f[0] for f in found], int)
        for n in self.sizes:
            of = np.flatnonzero(size == n)
            hashes[of] = piece_hashes(_codes("".join(found[i][3] for i in of)), n)[::n]
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.passage, self.at = np.array([f[1] for f in found], np.int32)[order], np.array([f[2] for f in found], np.int32)[order]
        self.shift = 64 - max(16, int(np.ceil(np.log2(len(found) * 16 + 1))))
        self.seen = np.zeros(1 << (64 - self.shift), bool)
        self.seen[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(_PRIME)) >> np.uint64(self.shift)

    @lru_cache(maxsize=20_000)  # noqa: B019
    def passage_of(self, version: int) -> Passage:
        number, ascii_only = self.versions[version]
        return Passage(*self.items[number], ascii_only, *self.rule)

    def carried(self, letters: str, lossy: bool) -> set[int]:
        """The test items in a folded document."""
        codes = _codes(letters)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n in self.sizes:
            h = piece_hashes(codes, n)
            where = np.flatnonzero(self.seen[self._slot(h)])
            if not len(where):
                continue
            first, last = np.searchsorted(self.hashes, h[where]), np.searchsorted(self.hashes, h[where], side="right")
            for place, i, j in zip(where.tolist(), first.tolist(), last.tolist()):
                for e in range(i, j):
                    hits[int(self.passage[e])].append((place, int(self.at[e])))
        out: set[int] = set()
        for version, places in hits.items():
            number, ascii_only = self.versions[version]
            if ascii_only and not lossy or self.items[number][0] in out:
                continue
            if self.passage_of(version).found(letters, places):
                out.add(self.items[number][0])
        return out


def leaked_items(text: str, index: Index) -> list[int]:
    """The test items that a document carries.

    It is searched without what stands in brackets, and around the brackets with it, since a passage may hold some or stand in some. Of a lossy document
    all letters are searched as well as the ASCII ones: little of it may be lost.
    """
    body = _FURNITURE.sub(" ", repair(text))
    lossy = "�" in body
    parts = [_BRACKETED.sub(" ", body), *around_brackets(body, 2 * index.longest + 16)]
    out: set[int] = set()
    for ascii_only in (True, False) if lossy else (False,):
        # what no passage holds stands between the parts
        out |= index.carried("\x00".join(fold(p, ascii_only) for p in parts), ascii_only)
    return sorted(out)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, most: int = MAX_EDITS) -> DataFrame:
    """doc_id, item_id: documents that carry a passage, or at least ``min_words`` consecutive words of it, within the budget of edits.

    In scripts without blanks, ``min_chars`` consecutive characters without blanks and punctuation count instead. A passage shorter than that must be
    there as a whole. The budget of a window is ``most`` edits, PAIR_SLACK of which may count twice in folded letters (MAX_EDITS_UNSPACED in scripts without blanks), or one less than its number of whole pieces of the least length, if that is smaller.
    Null or empty texts and passages, and null ids, take no part; repeated rows of items count once, repeated
    documents give their rows again; empty tables give an empty result; other columns are ignored. Documents are not shuffled; the index holds some 16 bytes
    for every piece and is broadcast; items beyond BLOCK_ITEMS are searched for in further passes over the documents, so that what every task gets is bounded.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("item_id is not null and passage is not null and passage <> ''").distinct()
    blocks = max(1, ceil(known.count() / BLOCK_ITEMS))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    out = None
    for i in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == i)
        index = documents.sparkSession.sparkContext.broadcast(Index(sorted((r.item_id, r.passage) for r in block.collect()), min_words, min_chars, most))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for b in batches:
                docs: list[int] = []
                found: list[int] = []
                for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                    got = leaked_items(text, held) if held.sizes else []
                    docs.extend([doc_id] * len(got))
                    found.extend(got)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        part = rows.mapInArrow(search, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out
