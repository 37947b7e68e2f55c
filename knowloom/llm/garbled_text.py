"""Text decoded with the wrong character encoding: found, and restored where possible.

Characters are mapped back to the bytes of a legacy code page; an automaton
over the byte structure of UTF-8 (compiled to one pattern of character classes
per code page) finds the maximal well-formed multibyte spans, and only those
spans are decoded.  The pass is repeated, so text garbled twice is restored
too.  A span counts only if it decodes to characters that are plausible in
running text, which keeps words such as NÃO, tree drawings and table frames.

Text whose single bytes were read with the wrong code page has no multibyte
spans.  It is found by words that no script writes (a symbol, a capital or a
letter of another script inside a Latin word); the sentence is converted with
the pair of code pages that makes all such words regular.

Kinds: ``utf8`` (spans decoded), ``page`` (code pages exchanged), ``controls``
(C1 control characters in place of punctuation), ``lost`` (replacement
characters, which no decoding brings back).

Defined results
---------------
* null and empty texts and texts without a non-ASCII character: not affected;
* an affected text whose characters are lost comes out with ``restored`` null
  if nothing could be decoded, else with the decodable parts decoded and
  ``complete`` false;
* repeated rows stay repeated; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code pages a UTF-8 text is commonly read with, in the order they are tried.
SEEN_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")
#: Pairs (read with, written in) of single-byte code pages.
EXCHANGED = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1251"))
PASSES = 3

SCHEMA = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("complete", T.BooleanType())]
)

#: The garbled à whose no-break space became a plain space; read only beside other garbled spans.
_BARE_A = re.compile(r"(?<![A-ZÀ-Þ])Ã (?=[\s,.;:!?a-z\d]|$)")
_CONTROLS = re.compile("[\x80-\x9f]")


@functools.lru_cache(maxsize=16)
def char_of_byte(page: str) -> dict[int, str]:
    """Characters of the upper half of a code page; undefined bytes are C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@functools.lru_cache(maxsize=16)
def byte_of_char(page: str) -> dict[str, int]:
    out = {c: b for b, c in char_of_byte(page).items()}
    if page == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _chars(page: str, low: int, high: int) -> str:
    return "[" + re.escape("".join(c for c, b in byte_of_char(page).items() if low <= b <= high)) + "]"


@functools.lru_cache(maxsize=16)
def sequence_automaton(page: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of one well-formed multibyte sequence and of a maximal span, over characters of ``page``."""
    c = _chars(page, 0x80, 0xBF)
    s = "|".join(
        [
            _chars(page, 0xC2, 0xDF) + c,
            _chars(page, 0xE0, 0xE0) + _chars(page, 0xA0, 0xBF) + c,
            "(?:" + _chars(page, 0xE1, 0xEC) + "|" + _chars(page, 0xEE, 0xEF) + ")" + c + c,
            _chars(page, 0xED, 0xED) + _chars(page, 0x80, 0x9F) + c,
            _chars(page, 0xF0, 0xF0) + _chars(page, 0x90, 0xBF) + c + c,
            _chars(page, 0xF1, 0xF3) + c + c + c,
            _chars(page, 0xF4, 0xF4) + _chars(page, 0x80, 0x8F) + c + c,
        ]
    )
    return re.compile(f"(?:{s})"), re.compile(f"(?:{s})+")


def _plausible(ch: str, page: str) -> bool:
    o = ord(ch)
    if 0xA0 <= o <= 0xFF or 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF or 0x0900 <= o <= 0x097F or o in (0x2122, 0x2022, 0xFEFF, 0x0152, 0x0153, 0x0160, 0x0161, 0x017D, 0x017E):
        return True
    if 0x1F300 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF:
        return True
    if page == "cp1252":
        return 0x80 <= o <= 0x9F or 0x0100 <= o <= 0x017F or o in (0x0178, 0x0192, 0x02C6, 0x02DC) or 0x0386 <= o <= 0x03CE or 0x0400 <= o <= 0x045F or 0x2200 <= o <= 0x22FF or 0x2500 <= o <= 0x257F or 0xFB00 <= o <= 0xFB06 or 0x0300 <= o <= 0x036F
    return page == "mac_roman" and o in (0x0131, 0x0192, 0x011F, 0x015F)


def _decode_spans(text: str, page: str) -> str:
    one, span = sequence_automaton(page)
    to_byte = byte_of_char(page)

    def sequence(m: re.Match) -> str:
        try:
            ch = bytes(to_byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return ch if _plausible(ch, page) else m[0]

    return span.sub(lambda m: one.sub(sequence, m[0]), text)


@functools.lru_cache(maxsize=1)
def _may_hold_spans() -> re.Pattern:
    """A first byte and a next byte of a sequence on any page: texts without such a pair hold no span."""
    classes = ("".join(dict.fromkeys(c for page in SEEN_AS for c, b in byte_of_char(page).items() if low <= b <= high)) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile("".join(f"[{re.escape(c)}]" for c in classes))


@functools.lru_cache(maxsize=1)
def _odd() -> tuple[re.Pattern, re.Pattern]:
    """Characters that may be out of place, and the places, from such a character on, where no script writes it."""
    symbols, capitals, foreign = set(), set(), set()
    for page in ("mac_roman", "cp437", "cp850", "cp1251", "cp1252"):
        for ch in char_of_byte(page).values():
            name = unicodedata.name(ch, "")
            if name.startswith("LATIN CAPITAL"):
                capitals.add(ch)
            elif name.startswith(("GREEK", "CYRILLIC")):
                foreign.add(ch)
            elif not name.startswith("LATIN SMALL") and ch not in "’‘“”–—-…´\xad\xa0«»/​" and not _CONTROLS.match(ch):
                symbols.add(ch)
    foreign |= {"\ufb01", "\ufb02"}
    foreign.discard("μ")
    symbols.discard("·")
    small = "a-zß-öø-ÿœšž"
    sym, up, far = (re.escape("".join(sorted(x))) for x in (symbols, capitals, foreign))
    places = re.compile(
        f"(?<=[A-Za-z{small}])[{sym}]+[A-Za-z{small}]"
        f"|(?<![lL])(?<=[{small}])·(?=[{small}])"
        f"|(?<=[{small}])[{up}](?![A-Z{up}])"
        f"|(?<=[A-Za-z])[{far}]+[a-z]"
        f"|(?<=[a-z][a-z])[{far}]+(?!\\w)"
        f"|(?<!\\w)[{far}]+[a-z]{{2}}"
        f"|(?:(?<=\\d)|(?<=\\d\\s))(?:[ÄÇЂ](?!\\w)|[╡Á](?=m|g\\b|l\\b|L\\b|IU))"
        f"|(?<!\\w)(?:ì\\w[\\w ]*î|ô\\w[\\w ]*ö|Ò\\w[\\w ]*Ó)(?!\\w)"
    )
    return re.compile("[" + re.escape("".join(sorted(symbols | capitals | foreign | set("·ìôÒ╡")))) + "]"), places


def _is_odd(text: str) -> bool:
    """Does a word of the text hold a character that no script puts there?"""
    suspects, places = _odd()
    return any(places.match(text, m.start()) for m in suspects.finditer(text))


@functools.lru_cache(maxsize=16)
def _exchange_table(seen: str, written: str) -> dict[int, str]:
    to_char = char_of_byte(written)
    return {ord(c): to_char[b] for c, b in byte_of_char(seen).items()}


def _regular(word: str) -> bool:
    """Only Latin letters, digits and common punctuation, none of them out of place."""
    for ch in word:
        if ord(ch) < 128:
            continue
        if ch in "’‘“”–—…€£°«»¿¡ªº·§±½¼¾²³µ™®©₹":
            continue
        if not unicodedata.name(ch, "").startswith("LATIN"):
            return False
    return not _is_odd(word)


_WORDS = re.compile(r"\S*[^\x00-\x7f]\S*")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")


def _exchange(text: str) -> str:
    """The text with garbled sentences converted by the best pair of code pages, or the text itself."""
    if not _is_odd(text):
        return text
    out = []
    for sentence in _SENTENCE.findall(text):
        if not sentence or not _is_odd(sentence):
            out.append(sentence)
            continue
        best, score = sentence, 0
        words = _WORDS.findall(sentence)
        for seen, written in EXCHANGED:
            table, known = _exchange_table(seen, written), byte_of_char(seen)
            if not all(c in known for w in words for c in w if ord(c) > 127):
                continue
            new = sentence.translate(table)
            new_words = [w.translate(table) for w in words]
            if _CONTROLS.search(new) or _is_odd(new):
                continue
            good = sum(_regular(w) for w in new_words)
            if good == len(words) and good > score:
                best, score = new, good
        out.append(best)
    return "".join(out)


def repair(text: str | None) -> tuple[str, str | None, bool] | None:
    """(kind, restored text, complete) of an affected text, None if it is not affected."""
    if not text or text.isascii():
        return None
    kind, now = None, text
    for _ in range(PASSES):
        before = now
        if not _may_hold_spans().search(now):
            break
        for page in SEEN_AS:
            now = _decode_spans(now, page)
        if now == before:
            break
        kind = "utf8"
    if kind:
        now = _BARE_A.sub("à", now)
    after = _exchange(now)
    if after != now:
        kind, now = kind or "page", after
    if _CONTROLS.search(now):
        kind = kind or "controls"
        now = _CONTROLS.sub(lambda m: char_of_byte("cp1252")[ord(m[0])], now)
    lost = "\ufffd" in text
    # Irregular words that no pair of code pages explains are reported, not restored.
    if lost or _is_odd(after):
        return (kind or ("lost" if lost else "page"), now if now != text else None, False)
    return (kind, now, True) if kind else None


@F.pandas_udf(SCHEMA)
def _repair(texts: pd.Series) -> pd.DataFrame:
    rows = [repair(t) or (None, None, None) for t in texts]
    return pd.DataFrame(rows, columns=["kind", "restored", "complete"])


def repaired(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the columns kind, restored and complete; kind is null where a text is not affected."""
    return documents.withColumn("_r", _repair(F.when(F.col(text).rlike(r"[^\x00-\x7f]"), F.col(text)))).select(*documents.columns, "_r.kind", "_r.restored", "_r.complete")


def affected(documents: DataFrame) -> DataFrame:
    """The affected documents: doc_id, kind, restored, complete."""
    return repaired(documents.select("doc_id", "text")).filter(F.col("kind").isNotNull()).select("doc_id", "kind", "restored", "complete")


def found(documents: DataFrame) -> DataFrame:
    return affected(documents).select("doc_id").distinct()
