"""Sentence ends in documents of many languages and scripts by a linear-chain model over characters, decoded with Viterbi.

Every character of the speech is tagged as a boundary or as inside. Only characters that can end a sentence (marks with what closes
after them) have a score for the boundary; all others are inside with certainty, so that the chain is decoded over the candidates alone.
Scores are sums of weights of what stands before and after; the weights, the abbreviations and the words that go on after a
quotation are counted over all documents, the weights learned from a bounded sample. Where letter case tells boundaries apart the learner labels
candidates with it; a second set of weights is learned from the same text with its case removed, for capitals throughout and
scripts without case. Script, marks and case are judged for every stretch of cues of one script, not for a document. Scripts without marks have no such evidence in their own documents: for them the problem defines the
boundary tags by layout, and their emissions are constants.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.llm.subtitles import BRACKETS, MARKUP, cues, is_advert, repair_with_ends
from sonarlake.plans.lineage import keep

LAYOUT_WEIGHT = 50.0  # of the ends of cues, and of Thai blanks, in scripts without marks
SAMPLE_DOCS = 1500  # documents that the weights are fitted on at most
LEAST, LONGEST, DOTTED_SHARE, FINAL_SHARE = 4, 7, 0.9, 0.06  # of abbreviations: times, length, share with a dot, share where only a sentence can end
LEAST_QUOTED, QUOTED_SHARE = 5, 0.15  # of words after a quotation: times, share of those of their script
LEAST_PART = 100_000  # a word with a dot counts if it is one of so many at least
MOST_HELD = 200_000  # words that a task counts before it hands them on
CASED_LETTERS = 40  # a stretch with fewer is judged by the case of its document
MARKED_CUES = 8  # a stretch of fewer cues is judged by the marks of its document
_CLOSERS = "\"”“»«’'」』)）\\]›\ufffd"
_MARKS = re.compile(rf"(?:[.…]+[?!？！؟]*|[?!？！؟]+\.*|[。｡।॥۔]+)(?:[{_CLOSERS}]+|[\xa0\u202f]»)*")
_FULL = re.compile("[。｡！？]")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_THAI = re.compile("[\u0e00-\u0e7f]")
_DASH = re.compile(r"(?:^|(?<=[\r\n]))[ \t]*[-–—](?=[ \t\w\"“«„»'「])[ \t]*")
_SONG = re.compile("[♪♫][^♪♫]*[♪♫]?")
_LOSSY_SONG = re.compile("\ufffd .* \ufffd", re.S)
_THAI_BLANK = re.compile(r"(?<=[^\s\d])[ \xa0]+(?=[^\s\d])")
_LINE = re.compile(r"[^\r\n]+")
_MISREAD_I = re.compile("(?:l(?![aeiouyàáâäèéêëìíîïòóôöùúûü'’l])|1)[a-zà-ÿ]")  # a capital I read as l or 1
_OPENERS = "\"“«„»‹「『([（【-–—♪"
_ASCII = re.compile("[\x00-\x7f]+")
_NO_CAPITALS, _NO_SMALL, _NO_LETTERS = (bytes(c for c in range(128) if not f(chr(c))) for f in (str.isupper, str.islower, str.isalpha))
_KANA = re.compile("[\u3040-\u30ff]")
_QUOTES = "\"”」』»“"
_EDGE = _OPENERS + ".,!?…\"”“»«’'」』)]:;¿¡"  # what is cut off a word
_BETWEEN = "".join(dict.fromkeys(c for c in _EDGE if c not in ".-–—'’")) + "\r\n\t"  # what stands between words as a blank does
_FURNITURE = "\x01"  # put after a dot after which nothing can go on
_CUE = r"(?:\d+[ \t]*[\r\n]+[ \t]*\d+:\d\d:\d\d[^\r\n]*[\r\n]+[ \t]*)?"  # the number and times of the cue that begins there
_LAST_DOT = re.compile(rf"\.(?=[\"”“»«]|\s{{1,40}}{_CUE}(?:[{re.escape(_OPENERS)}]|[\x85\u2028\u2029]?\Z))", re.A)
_FOLLOWER = re.compile(rf"[.?!…。！？؟।،,、，][{_QUOTES}]\s*{_CUE}([^\s\x00-\x40]\S*)", re.A)


class Document:
    """The units of a document that need no model, and the runs of speech between them.

    ``units``: end positions in the repaired text. ``runs``: (speech, piece starts in it, piece starts in the repaired text, ends of cues in it).
    """

    def __init__(self, text: str):
        self.text, self.ends = repair_with_ends(text)
        self.units: list[int] = []
        self.runs: list[tuple[str, list[int], list[int], list[int]]] = []
        self._parts: list[str] = []
        self._at: list[int] = []
        self._from: list[int] = []
        self._cues: list[int] = []
        self._size = 0
        for a, b in cues(self.text):
            self._cue(a, b)
        self._close()

    def stored(self, end: int) -> int:
        """The end position in the text as stored."""
        return end if self.ends is None or end == 0 else self.ends[end - 1]

    def _close(self) -> None:
        if self._parts:
            self.runs.append(("".join(self._parts), self._at, self._from, self._cues))
            self._parts, self._at, self._from, self._cues, self._size = [], [], [], [], 0

    def _say(self, a: int, b: int) -> None:
        """Speech from a to b; markup is left out."""
        body = self.text[a:b]
        if "<" in body or "{" in body:
            last = 0
            for m in MARKUP.finditer(body):
                self._piece(a + last, a + m.start())
                last = m.end()
            self._piece(a + last, b)
        else:
            self._piece(a, b)

    def _piece(self, a: int, b: int) -> None:
        if b > a:
            self._parts.append(self.text[a:b])
            self._at.append(self._size)
            self._from.append(a)
            self._size += b - a

    def _gap(self) -> None:
        if self._parts:
            self._cues.append(self._size)
            self._parts.append("\n")
            self._at.append(self._size)
            self._from.append(self._from[-1] + len(self._parts[-2]) - 1)
            self._size += 1

    def _core(self, a: int, b: int) -> tuple[str, int]:
        """The text between a and b without markup and blanks, and where it ends."""
        body = self.text[a:b]
        if "<" not in body and "{" not in body:
            core = body.rstrip()
            return core.lstrip(), a + len(core)
        end, parts, last = a, [], 0
        for m in [*MARKUP.finditer(body), None]:
            piece = body[last : m.start() if m else len(body)]
            if piece.strip():
                end = a + last + len(piece.rstrip())
            parts.append(piece)
            last = m.end() if m else last
        return "".join(parts).strip(), end

    def _unit(self, end: int) -> None:
        self._close()
        self.units.append(end)

    def _special(self, core: str, end: int) -> bool:
        first = core[0]
        if first in BRACKETS and core.endswith(BRACKETS[first]) and core.count(first) == 1 or first == "\ufffd" and _LOSSY_SONG.fullmatch(core):
            self._unit(end)
            return True
        return False

    def _cue(self, a: int, b: int) -> None:
        core, end = self._core(a, b)
        if not core or core.isdecimal() and a == 0:
            return
        if is_advert(core) or self._special(core, end):
            self._unit(end)
            if len(self.units) > 1 and self.units[-1] == self.units[-2]:
                self.units.pop()
            return
        body = self.text[a:b]
        if core[0] not in BRACKETS and "♪" not in body and "♫" not in body and "\n[" not in body and "\n(" not in body:
            self._speech(a, b, body)
        else:
            for m in _LINE.finditer(body):
                x, y = a + m.start(), a + m.end()
                line, stop = self._core(x, y)
                if not line or self._special(line, stop):
                    continue
                if line[0] in "♪♫":
                    for s in _SONG.finditer(self.text, x, y):
                        self._unit(self._core(s.start(), s.end())[1])
                else:
                    self._speech(x, y, self.text[x:y])
        self._gap()

    def _speech(self, a: int, b: int, body: str) -> None:
        if "-" not in body and "–" not in body and "—" not in body:
            self._say(a, b)
            return
        bare = MARKUP.sub(lambda m: "\x00" * len(m[0]), body)
        last = 0
        for m in re.finditer(r"(?:^|(?<=[\r\n]))[\x00 \t]*[-–—](?![-=])[ \t]*", bare):
            if m.start() > last:
                self._say(a + last, a + m.start())
            self._close()
            last = m.end()
        self._say(a + last, b)


class Model:
    """Weights of the chain, and what was learned beside them."""

    def __init__(self) -> None:
        self.abbreviations: set[str] = set()
        self.finals: set[str] = set()  # abbreviations that sentences end with
        self.goes_on: set[str] = set()
        self.weights: dict[tuple, float] = {}
        self.steps = [[0.0, 0.0], [0.0, 0.0]]
        self._known: dict[tuple, float] = {}

    def score(self, key: tuple) -> float:
        """Score of a boundary over inside for a candidate."""
        known = self._known.get(key)
        if known is None:
            known = self._known[key] = sum(self.weights.get(f, 0.0) for f in features(key))
        return known

    def decode(self, keys: list[tuple], fixed: list[int | None] | None = None) -> list[int]:
        """The best tags of a run's candidates (Viterbi); ``fixed`` holds tags that must be kept."""
        (s00, s01), (s10, s11) = self.steps
        inside, bound = 0.0, 0.0
        back: list[tuple[int, int]] = []
        for i, key in enumerate(keys):
            e = self.score(key)
            if i:
                a0, a1 = inside + s00, bound + s10
                b0, b1 = inside + s01, bound + s11
                back.append((int(a1 > a0), int(b1 >= b0)))
                inside, bound = max(a0, a1), max(b0, b1) + e
            else:
                inside, bound = 0.0, e
            if fixed and fixed[i] is not None:
                if fixed[i]:
                    inside = float("-inf")
                else:
                    bound = float("-inf")
        if not keys:
            return []
        tags = [int(bound > inside)]
        for choice in reversed(back):
            tags.append(choice[tags[-1]])
        return tags[::-1]


def features(key: tuple) -> list[tuple]:
    """What a candidate is scored by. key: (case known, mark, closed, word before, what follows, goes on, words)."""
    cased, mark, closed, before, after, on, words = key
    return [(cased, mark), (cased, mark, closed, after), (cased, mark, before), (cased, before, after), (cased, closed, on), (cased, mark, closed), (cased, mark, after, words)]


def _word_before(speech: str, at: int) -> tuple[str, bool]:
    """The word that a mark stands at, and whether a single letter with a dot stands before it."""
    token = speech[max(0, at - 24) : at].split()
    if not token or speech[at - 1].isspace():
        return "", False
    return token[-1].lstrip(_OPENERS + "(¿¡'"), len(token) > 1 and len(token[-2]) == 2 and token[-2][1] == "." and token[-2][0].isalpha()


def _after(speech: str, at: int) -> tuple[str, str]:
    """The class of what follows a candidate, and the word itself."""
    rest = speech[at : at + 40].lstrip()
    if not rest:
        return ("end", "") if at + 40 >= len(speech) else ("open", "")
    c = rest[0]
    if c in _OPENERS:
        return "open", ""
    word = rest.split(None, 1)[0]
    if c == "\ufffd" and word[1:2].isupper():  # a quotation mark that an encoding lost
        return "open", ""
    if _MISREAD_I.match(word):
        return "upper", word
    if c.isdigit():
        return "digit", word
    if c.isalpha():
        return ("upper" if c.isupper() else "lower" if c.islower() else "letter"), word
    return "other", word


@lru_cache(maxsize=10_000)
def _mark(text: str) -> tuple[bool, str, bool]:
    """Whether a mark is one of full width, its class, and whether something closes after it."""
    full = _FULL.search(text) is not None
    core = text.rstrip("\"”“»«’'」』)）]›\ufffd\xa0\u202f")
    mark = "strong" if any(c in core for c in "?!？！؟") else "ellipsis" if "…" in core or core.startswith("..") else "stop" if full or core[0] in "।॥۔" else "dot"
    return full, mark, len(core) < len(text)


def candidates(speech: str, model: Model, cased: bool) -> list[tuple[int, tuple, tuple]]:
    """(end, key, (mark, word before, what follows, word after)) of every place of a run that may end a sentence."""
    out = []
    n = len(speech)
    for m in _MARKS.finditer(speech):
        s, e = m.start(), m.end()
        text = m[0]
        full, mark, closed = _mark(text)
        if e < n and not full and not speech[e].isspace():
            if not _CJK.match(speech[e]) or text[0] == ".":
                continue
        kind, word = _after(speech, e)
        before, chained = _word_before(speech, s)
        if mark == "dot":
            low = before.lower()
            tail = low.rpartition(".")[2]
            if low in model.abbreviations or tail in model.abbreviations:
                how = "abbreviation"
            elif tail in model.finals:
                how = "final"
            elif len(tail) == 1 and tail.isalpha():
                # in capitals throughout an initial is told from a word of one letter by whether the letter stands alone elsewhere
                how = "initial" if (before[-1:].isupper() if cased else chained or len(word) == 2 and word[1] == "." or f" {before} " not in speech) else "single"
            elif before.isdigit():
                how = "ordinal" if len(before) <= 2 else "number"
            else:
                how = "word"
        else:
            how = "word"
        cjk = full or bool(_CJK.match(word))
        on = (word[:2] if cjk else word) in model.goes_on
        key_after = kind if cased or kind not in ("upper", "lower") else "letter"
        if not cased and kind == "letter" and word and not word.upper() != word.lower():
            key_after = "caseless"
        out.append((e, (cased, mark, closed, how, key_after, on, 0), (mark, before, kind, word)))
    if any(key[1] == "ellipsis" for _, key, _ in out):  # how many words a sentence would have that goes on there
        likely = [0, *[e for e, key, _ in out if key[3] not in ("abbreviation", "initial", "ordinal")], len(speech)]
        for i, (e, key, info) in enumerate(out):
            if key[1] == "ellipsis":
                at = bisect_right(likely, e - 1)
                words = len(speech[likely[at - 1] : likely[min(at + 1, len(likely) - 1)]].split())
                out[i] = (e, (*key[:6], 1 + min(words, 23) // 3), info)
    return out


def _layout(place: str) -> tuple:
    """The key of a candidate that stands at the end of a cue, or at a blank, in a script without marks."""
    return (False, place, False, "layout", "layout", False, 0)


def case_counts(text: str) -> tuple[int, int]:
    """Capitals and small letters of a text."""
    plain = text.encode("ascii", "ignore")
    upper, lower = len(plain.translate(None, _NO_CAPITALS)), len(plain.translate(None, _NO_SMALL))
    if len(plain) < len(text):
        rest = _ASCII.sub("", text)
        upper, lower = upper + sum(map(str.isupper, rest)), lower + sum(map(str.islower, rest))
    return upper, lower


def has_case(speech_parts: list[str]) -> bool:
    """Whether letter case tells anything: not in capitals throughout, nor in scripts without it."""
    counts = [case_counts(s) for s in speech_parts]
    return sum(c[1] for c in counts) > sum(c[0] for c in counts)


def _silver(key: tuple, info: tuple) -> int | None:
    """What letter case and closed classes say for certain about a candidate; None where they don't."""
    _, mark, closed, how, _, on, _ = key
    kind = info[2]
    if kind in ("end", "open") and how not in ("abbreviation", "initial", "ordinal"):
        return 1
    if how in ("abbreviation", "initial", "ordinal"):
        return 0
    if on:
        return 0
    if kind == "lower":
        return 0 if closed or mark == "ellipsis" else 1
    if kind == "upper":
        return 1
    if kind == "letter":  # a script without case
        return 0 if mark == "ellipsis" else 1
    if kind == "digit":
        return 0 if mark == "ellipsis" else 1
    return None


class Counts:
    """Counts of words that the closed classes are made of: word to (times, times with a dot, times with a dot where only a sentence can end), and followers of quotations by script."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.dotted: Counter = Counter()
        self.furniture: Counter = Counter()
        self.quoted: dict[str, Counter] = defaultdict(Counter)

    def classes(self) -> tuple[set[str], set[str], set[str]]:
        """Abbreviations, abbreviations that sentences end with, and words that go on after a quotation."""
        abbreviations: set[str] = set()
        finals: set[str] = set()
        goes_on: set[str] = set()
        for w, n in self.dotted.items():
            # an abbreviation hardly ever stands without its dot; some of them also stand where only a sentence can end
            if n >= LEAST and len(w) <= LONGEST and n >= DOTTED_SHARE * max(self.words[w], 1) and (w.isalpha() or any(c.isalpha() for c in w) and not w.isascii()):
                (abbreviations if self.furniture[w] < FINAL_SHARE * n else finals).add(w)
        for counts in self.quoted.values():
            total = sum(counts.values())
            goes_on.update(w for w, n in counts.items() if n >= LEAST_QUOTED and n > QUOTED_SHARE * total)
        return abbreviations, finals, goes_on


def follower(word: str, speech: str) -> tuple[str, str]:
    """The script that a word after a quotation is counted under, and the word, of Chinese and Japanese its first two characters."""
    short = word[:2] if _CJK.match(word) else word
    if re.match("[\u3400-\u9fff]", short) and not re.search("[\u3040-\u30ff]", speech):
        return "zh", short
    return "ja" if _CJK.match(short) else hex(ord(short[0]) >> 7), short


def count_words(docs: list[list[str]]) -> Counts:
    """The counts of documents given as runs of speech."""
    out = Counts()
    for runs in docs:
        cased = has_case(runs)
        for speech in runs:
            for w in speech.split():
                bare = w.strip(_OPENERS + ".,!?…\"”“»«’'」』)]:;").lower().rpartition(".")[2]
                if bare and len(bare) <= LONGEST:
                    out.words[bare] += 1
            for m in re.finditer(r"(\S{1,24}?)\.(?=[\s\"”“»«])", speech):
                low = m[1].strip(_OPENERS + "\"'¿¡").lower().rpartition(".")[2]
                if low:
                    out.dotted[low] += 1
                    kind, _ = _after(speech, m.end())
                    if kind in ("open", "end") or not speech[m.end() : m.end() + 1].isspace():
                        out.furniture[low] += 1
            if not cased:
                for m in re.finditer("[.?!…。！？؟।،,、，](?:[\"”」』»]|“)(\\s*)(\\S+)", speech):
                    script, word = follower(m[2], speech)
                    out.quoted[script][word] += 1
    return out


def tally(texts: Iterable[str]) -> tuple[dict[str, list[int]], Counter]:
    """Counts of whole texts: word to [times, times with a dot, times with a dot after which nothing can go on], and (script, follower of a quotation) to times.

    Blanks cut a text into tokens, which are counted as they stand; only distinct ones are looked at.
    """
    raw: Counter = Counter()
    said: Counter = Counter()
    for text in texts:
        if "<" in text or "{" in text:
            text = MARKUP.sub("", text)
        if any(q in text for q in _QUOTES):
            kana = None
            for m in _FOLLOWER.finditer(text):
                if kana is None:
                    kana = "j" if _KANA.search(text) else "z"
                w = m[1].rstrip(_EDGE) if "." in m[1] else m[1]
                if "." not in w:
                    said[kana, w] += 1
        text = _LAST_DOT.sub("." + _FURNITURE, text)
        for c in _BETWEEN:
            text = text.replace(c, " ")
        raw.update(text.split(" "))
    words: dict[str, list[int]] = {}
    for t, n in raw.items():
        t = t.lower()
        if not 1 <= len(t) <= 2 * LONGEST:
            continue
        dotted = last = False
        w = t
        if "." in t:
            base = t.rstrip(_FURNITURE)
            dotted = base.endswith(".") and not base.endswith("..")
            last = dotted and t.endswith(_FURNITURE)
            w = base.strip(_EDGE).rpartition(".")[2]
        if 1 <= len(w) <= LONGEST:
            row = words.setdefault(w, [0, 0, 0])
            row[0] += n
            row[1] += n * dotted
            row[2] += n * last
    return words, said


def word_counts(rows: DataFrame) -> DataFrame:
    """script, w, n, d, f: what ``tally`` counts, over all documents, summed before the exchange. script is '' for plain words, else that of the document a follower is in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, list[int]] = {}
        said: Counter = Counter()

        def told() -> pa.RecordBatch:
            cols = [[""] * len(words) + [k for k, _ in said], [*words, *(w for _, w in said)], *([r[i] for r in words.values()] + (list(said.values()) if i == 0 else [0] * len(said)) for i in range(3))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)], ["script", "w", "n", "d", "f"])

        for b in batches:
            some, followers = tally(b["text"].to_pylist())
            for w, r in some.items():
                row = words.get(w)
                words[w] = r if row is None else [x + y for x, y in zip(row, r)]
            said.update(followers)
            if len(words) + len(said) > MOST_HELD:
                yield told()
                words, said = {}, Counter()
        yield told()

    made = rows.select("text").mapInArrow(count, "script string, w string, n long, d long, f long")
    return made.groupBy("script", "w").agg(*[F.sum(c).alias(c) for c in "ndf"])


def corpus_classes(rows: DataFrame) -> tuple[set[str], set[str], set[str]]:
    """The closed classes from counts over all documents.

    A word that is one in ``LEAST_PART`` of all words with a dot is looked at, so that at most so many come to the driver.
    """
    counts = keep(word_counts(rows).where((F.col("d") >= LEAST) | (F.col("script") != "")))
    plainly = counts.where("script = ''")
    total = plainly.agg(F.sum("d")).first()[0] or 0
    out = Counts()
    for r in plainly.where((F.col("d") * LEAST_PART >= total) & (F.col("n") * DOTTED_SHARE <= F.col("d"))).collect():
        out.words[r.w], out.dotted[r.w], out.furniture[r.w] = r.n, r.d, r.f
    said = counts.where("script <> ''").select(F.col("script").alias("kana"), "w", "n").where((F.lower(F.substring("w", 1, 1)) == F.upper(F.substring("w", 1, 1))) & F.col("w").rlike("^\\p{L}"))
    han, cjk = F.col("w").rlike("^[\u3400-\u9fff]"), F.col("w").rlike("^[\u3040-\u30ff\u3400-\u9fff]")
    script = F.when(han & (F.col("kana") == "z"), "zh").when(cjk, "ja").otherwise(F.hex(F.shiftright(F.ascii("w"), 7)))
    short = said.select(script.alias("script"), F.when(cjk, F.substring("w", 1, 2)).otherwise(F.col("w")).alias("w"), "n").groupBy("script", "w").agg(F.sum("n").alias("n"))
    share = short.withColumn("of", F.sum("n").over(Window.partitionBy("script")))
    going_on = share.where((F.col("n") >= LEAST_QUOTED) & (F.col("n") > QUOTED_SHARE * F.col("of"))).collect()  # a few for every script
    abbreviations, finals, _ = out.classes()
    return abbreviations, finals, {r.w for r in going_on}


def fit(texts: list[str], rounds: int = 4, classes: tuple[set[str], set[str], set[str]] | None = None) -> Model:
    """A model from a sample of documents: weights by gradient steps on the likelihood of labels from case; closed classes as given, else counted in the sample.

    The score of a tag depends on the candidate and on the tag before it, as in decoding.
    """
    model = Model()
    docs = [[r[0] for r in Document(t).runs] for t in texts]
    model.abbreviations, model.finals, model.goes_on = count_words(docs).classes() if classes is None else classes
    sequences = []
    for runs in docs:
        true_case = has_case(runs)
        for speech in runs:
            found = candidates(speech, model, true_case)
            labels = [_silver(key, info) for _, key, info in found]
            if true_case:
                sequences.append(([k for _, k, _ in found], labels))
                bare = [k for _, k, _ in candidates(speech.upper(), model, False)]
                if len(bare) == len(labels):
                    sequences.append((bare, labels))
            elif not speech.isupper():
                sequences.append(([k for _, k, _ in found], labels))
    weights: dict[tuple, float] = defaultdict(float)
    after = [0.0, 0.0]
    spread: dict[tuple, list[tuple]] = {}
    for turn in range(rounds):
        rate = 0.3 / (1 + turn)
        for keys, labels in sequences:
            before = 0
            for key, label in zip(keys, labels):
                if label is None:
                    continue
                mine = spread.get(key)
                if mine is None:
                    mine = spread[key] = features(key)
                z = after[before] + sum([weights[f] for f in mine])
                g = rate * (label - (1 / (1 + exp(-z)) if z > -30 else 0.0))
                if abs(g) > 1e-4:
                    after[before] += g
                    for f in mine:
                        weights[f] += g
                before = label
    model.weights = dict(weights) | {(False, place): LAYOUT_WEIGHT for place in ("cue", "blank")}
    model.steps = [[0.0, after[0]], [0.0, after[1]]]
    model._known.clear()
    return model


def script_of(text: str) -> str:
    """'thai', 'cjk' or 'other', by most of the letters; '' without letters."""
    if text.isascii():
        return "other" if any(map(str.isalpha, text)) else ""
    letters = len(text.encode("ascii", "ignore").translate(None, _NO_LETTERS)) + sum(map(str.isalpha, _ASCII.sub("", text)))
    if not letters:
        return ""
    if 2 * len(_THAI.findall(text)) > letters:
        return "thai"
    return "cjk" if 2 * len(_CJK.findall(text)) > letters else "other"


def stretches(speech: str, cue_ends: list[int]) -> list[tuple[int, int, str, list[int]]]:
    """(start, end, script, ends of cues inside) of the stretches of cues of one script that a run is made of."""
    if speech.isascii():
        return [(0, len(speech), "other", cue_ends)]
    out: list[list] = []
    a = 0
    for b in [*(e for e in cue_ends if e < len(speech)), len(speech)]:
        script = script_of(speech[a:b])
        if out and (not script or out[-1][2] in ("", script)):
            out[-1][1], out[-1][2] = b, out[-1][2] or script
            out[-1][3].append(a)
        else:
            out.append([a, b, script, []])
        a = b
    return [(a, b, script or "other", [*ends, b]) for a, b, script, ends in out]


def sentence_ends(text: str, model: Model) -> list[int]:
    """End positions of all units of a document, as stored, in order."""
    doc = Document(text)
    ends = list(doc.units)
    parts = [(s[a:b], a, at, source, script, [e - a for e in inside]) for s, at, source, cue_ends in doc.runs for a, b, script, inside in stretches(s, cue_ends)]
    cjk = [(len(_FULL.findall(s)), len(cues_) or 1) for s, _, _, _, script, cues_ in parts if script == "cjk"]
    whole = 10 * sum(m for m, _ in cjk), sum(c for _, c in cjk)
    case: bool | None = None
    for s, start, at, source, script, cue_ends in parts:
        if script == "cjk":
            marks, cues_ = (10 * len(_FULL.findall(s)), len(cue_ends)) if len(cue_ends) >= MARKED_CUES else whole
        if script == "thai" or script == "cjk" and marks < cues_:
            places = [(e, _layout("cue")) for e in cue_ends]
            if script == "thai":
                places = sorted(places + [(m.start(), _layout("blank")) for m in _THAI_BLANK.finditer(s)])
        else:
            upper, lower = case_counts(s)
            if upper + lower >= CASED_LETTERS:
                cased = lower > upper
            else:
                if case is None:
                    case = has_case([p[0] for p in parts])
                cased = case
            places = [(e, k) for e, k, _ in candidates(s, model, cased)]
        tags = model.decode([k for _, k in places])
        stops = [e for (e, _), t in zip(places, tags) if t]
        stops.append(len(s))
        for e in stops:
            e = len(s[:e].rstrip())
            if e and s[e - 1] != "\x00":
                i = bisect_right(at, start + e - 1) - 1
                ends.append(source[i] + start + e - at[i])
    return sorted({doc.stored(e) for e in ends})


def sentences(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 3) -> DataFrame:
    """doc_id, end_pos: one row per sentence, sound description, song line and advert cue of every document.

    ``end_pos`` counts code points of the text as stored. Words are counted over all documents; weights are fitted on at most ``sample_docs`` documents drawn at
    random; all documents are tagged. A null or empty text gives no rows; rows with a null doc_id take no part; repeated rows give their sentences
    once per row (make them distinct where they may occur); an empty table gives an empty result; other columns are ignored.
    """
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    n = max(1, documents.count())
    sample = [r.text for r in rows.select("text").sample(min(1.0, 1.2 * sample_docs / n), seed).limit(sample_docs).collect()]
    model = fit(sample, classes=corpus_classes(rows))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            ends: list[int] = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                found = sentence_ends(text, model)
                ids.extend([doc_id] * len(found))
                ends.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "end_pos"])

    return rows.mapInArrow(split, "doc_id long, end_pos long")
