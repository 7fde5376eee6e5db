"""What a text says, however it is written down: markup, escapes, damaged encodings, look-alike letters."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

# Letters of other scripts that look like Latin ones, and the Latin ones.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijshdqwABEKMHOPCTYXIJSoaivpuABEZHIKMNOPTYX",
)
# Characters without width, and the soft hyphen.
INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"))
_ODD = re.compile("[" + "".join(map(chr, [*INVISIBLE, *LOOK_ALIKES])) + "]")
# What bytes 0x80 to 0x9f are in code page 1252, where they are anything.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# Marks within words that don't part them.
APOSTROPHES = re.compile(r"(?<=\w)['’‘ʼ`´](?=\w)")

_FOLDED = {**INVISIBLE, **LOOK_ALIKES}
_TWICE = re.compile(f"[\u00c2-\u00f4][\u0080-\u00bf{CP1252}]{{1,3}}")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbf])|([\"'/\\]))")
_PAIR = re.compile(r"[\ud800-\udbff][\udc00-\udfff]")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_PLAIN = re.compile(r"[&<\\%]")


def _bytes(run: str) -> bytes | None:
    out = bytearray()
    for c in run:
        if ord(c) < 256:
            out.append(ord(c))
        else:
            try:
                out += c.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


def _once(m: re.Match) -> str:
    run = m[0]
    for end in range(len(run), 1, -1):
        raw = _bytes(run[:end])
        try:
            return raw.decode("utf-8") + run[end:]
        except (UnicodeDecodeError, AttributeError):
            continue
    return run


def repair(text: str) -> str:
    """UTF-8 that was read as code page 1252 or Latin-1, once or twice, read rightly."""
    for _ in range(2):
        fixed = _TWICE.sub(_once, text)
        if fixed == text:
            break
        text = fixed
    return text


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " " if m[3] else m[4]


def _unpercent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def plain(text: str) -> str:
    """Escapes, entities, damaged encodings, widths and look-alike letters undone; tags and line breaks stay."""
    if text.isascii() and not _PLAIN.search(text):
        return text
    text = repair(text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
        text = _PAIR.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)
        text = repair(text)
    if "%" in text:
        text = _PERCENT.sub(_unpercent, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _ODD.search(text):
            text = text.translate(_FOLDED)
    return text


#: Characters whose words are taken at a time.
PIECE = 1_000_000


def folded(text: str) -> str:
    """The text without markup, apostrophes, accents and case."""
    text = plain(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = APOSTROPHES.sub("", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return text.lower()


def word_runs(text: str | None) -> Iterator[list[str]]:
    """The words of ``words``, a part of a long text at a time; parts end at white space."""
    text = folded(text or "")
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def words(text: str | None) -> list[str]:
    """The words of a text: letters and digits, folded in case, without accents, apostrophes or markup."""
    return [w for run in word_runs(text) for w in run]
