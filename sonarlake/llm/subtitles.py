"""Reading subtitle text: undoing wrong encodings with positions kept, and telling cues, furniture and speech apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: The characters that Windows code page 1252 puts on bytes 0x80 to 0x9F; bytes it leaves undefined stay C1 controls.
_CP1252 = {b: bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)}
_HIGH = "".join(_CP1252.values()) + "".join(map(chr, range(0x80, 0x100)))
_BYTE_OF = {ord(c): b for b, c in _CP1252.items()} | {b: b for b in range(0x80, 0x100)}
_LEAD = "".join(map(chr, range(0xC2, 0xF5)))
_TAIL = "".join(c for c in _HIGH if _BYTE_OF[ord(c)] < 0xC0)
_HINT = re.compile(f"[{re.escape(_LEAD)}][{re.escape(_TAIL)}]")
_RUN = re.compile(f"[{re.escape(_HIGH)}]+")


@lru_cache(maxsize=50_000)
def _decoded(run: str) -> str | None:
    """The text whose UTF-8 bytes were read as single characters to give ``run``, or None."""
    try:
        return bytes(_BYTE_OF[ord(c)] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None


def repair(text: str, times: int = 2) -> str:
    """``text`` with runs of wrongly decoded UTF-8 read right, up to ``times`` times over."""
    for _ in range(times):
        if text.isascii() or not _HINT.search(text):
            break
        new = _RUN.sub(lambda m: _decoded(m[0]) or m[0], text)
        if new == text:
            break
        text = new
    return text


def repair_with_ends(text: str, times: int = 2) -> tuple[str, list[int] | None]:
    """The repaired text, and for each of its characters the end position in ``text`` as stored (None: unchanged)."""
    ends: list[int] | None = None
    for _ in range(times):
        if text.isascii() or not _HINT.search(text):
            break
        parts: list[str] = []
        at: list[int] = []
        last = 0
        changed = False
        for m in _RUN.finditer(text):
            good = _decoded(m[0])
            if good is None:
                continue
            changed = True
            parts.append(text[last : m.start()])
            at.extend(range(last + 1, m.start() + 1))
            pos = m.start()
            for c in good:
                pos += len(c.encode())
                at.append(pos)
            parts.append(good)
            last = m.end()
        if not changed:
            break
        parts.append(text[last:])
        at.extend(range(last + 1, len(text) + 1))
        text = "".join(parts)
        ends = at if ends is None else [ends[i - 1] for i in at]
    return text, ends


_EOL = r"(?:\r\n|\r|\n)"
#: A cue's number line (if any) and timing line.
HEADER = re.compile(rf"(?:\ufeff?[ \t]*\d+[ \t]*{_EOL}(?:[ \t]*{_EOL})?)?\ufeff?[ \t]*\d+:\d\d:\d\d[,.]\d+[ \t]*-->[^\r\n]*{_EOL}?")
_TIMES = re.compile(rf"\d\d*:\d\d:\d\d[,.]\d+[ \t]*-->[^\r\n]*{_EOL}?")
_AFTER_NUMBER = re.compile(rf"[ \t]*{_EOL}(?:[ \t]*{_EOL})?")
MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_HOST = r"\bwww\.|https?:|\w[\w-]*\.(?:example|invalid|com|org|net)\b"
#: What gives a cue away as an advert or a credit: a host name, or a frame of those who make subtitle files.
ADVERT = re.compile(rf"(?i){_HOST}|^sync and corrections:|^-= .* =-")
BRACKETS = {"[": "]", "(": ")", "（": "）", "【": "】"}


#: Letters that recognition takes for each other, as the search for leaks has them.
_LOOKS_LIKE = str.maketrans({"1": "i", "l": "i", "|": "i", "0": "o"})


def _as_misread(text: str) -> str:
    return text.lower().translate(_LOOKS_LIKE).replace("rn", "m").replace("vv", "w").replace("ii", "h").replace("c", "e")


_MISREAD = re.compile(r"\bwww\.|https?:|\w\.(?:" + "|".join(map(_as_misread, ("example", "invalid", "com", "org", "net"))) + r")\b|^" + _as_misread("sync and corrections:"))
_HOST_DOT = re.compile(r"\w\.\w|:")
_INNER_DOT = re.compile(r"\.(?:(?<=[\w-]\.)\w|(?<=[wW]\.))")


def is_advert(core: str) -> bool:
    """Whether the text of a cue is an advert or a credit, also one in which letters were misread: it names a host, or has the frame of a credit."""
    if ":" not in core and not core.startswith("-= ") and not _INNER_DOT.search(core):
        return False  # the dearer expressions need one of these
    return bool(ADVERT.search(core)) or bool(_HOST_DOT.search(core) and _MISREAD.search(_as_misread(core)))


def _before_blanks(text: str, least: int, at: int) -> int:
    """Where the blanks that end at ``at`` begin, and a byte-order mark before them."""
    while at > least and text[at - 1] in " \t":
        at -= 1
    return at - 1 if at > least and text[at - 1] == "\ufeff" else at


def headers(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the matches of ``HEADER``: the times are found first, the number line is looked for from there backward."""
    last = 0
    for m in _TIMES.finditer(text):
        start = _before_blanks(text, last, m.start())
        stop = start
        while stop > last and text[stop - 1] in " \t\r\n":
            stop -= 1
        at = stop
        while at > last and text[at - 1].isdecimal():
            at -= 1
        if at < stop < start and _AFTER_NUMBER.fullmatch(text, stop, start):
            start = _before_blanks(text, last, at)
        yield start, m.end()
        last = m.end()


def cues(text: str) -> list[tuple[int, int]]:
    """Spans of the cues' bodies in a text, blanks at both ends left out. What stands before the first timing line is a body too."""
    out = []
    at = 0
    for start, end in headers(text):
        out.append((at, start))
        at = end
    out.append((at, len(text)))
    spans = []
    for a, b in out:
        body = text[a:b]
        core = body.strip(" \t\r\n\ufeff")
        if core:
            a += body.index(core)
            spans.append((a, a + len(core)))
    return spans
