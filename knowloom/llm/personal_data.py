"""Personal data inside free text: found, and replaced by typed placeholders.

Found are e-mail addresses, phone numbers, identity numbers, street addresses
and person names.  E-mail addresses, phone and identity numbers are found by
their formats; plain digit runs count only by what introduces them, and numbers
that no format allows (an area of zeros, a group of a longer card number) do
not count.  Addresses are found from house number to town and
postcode.

Names are found by given names with the tokens around them, by initials with a
surname, after titles and greetings, below closings, and where a text names the
person's role or what a person did.  A name directly followed by a word of firms
is the name of a firm.  Given names are those that people carry in the senders
and recipients of the mails, learned from all of them into one bounded bit set,
beside a short list of common ones.

Placeholders keep equal values linked across documents:
``[TYPE:pseudonym]``.  Numbers keep their format: their digits, and dates as
well, are permuted inside their own domain by a keyed Feistel network, so the
pseudonym of a phone number is a phone number of the same country, that of a
date a date, and that of a number with a valid check digit has one as well.
Equal values, however they are spaced, and with or without their country code,
have equal digits.  Values without a numeric format get a short keyed digest.

Defined results
---------------
* null and empty texts have no personal data and stay as they are;
* e-mail addresses with ``(at)`` and ``(dot)`` spelled out are found as they
  stand, and have the pseudonym of the plain address;
* where finds overlap the earlier, then the longer counts; no find lies inside
  an e-mail address;
* a value repeated in a field counts once; repeated rows count once;
* texts of any length are read whole; further columns are untouched;
* card numbers are replaced too, but are none of the five types of ``found``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import secrets
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.llm import bit_sets
from knowloom.session import materialise

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
# Common given names of several languages.
GIVEN_NAMES = """Adam Ahmed Aisha Alexander Alice Amit Amy Ana Andrea Andreas André Andrew Anil Anita Anna Anne Anthony Antonio Arjun Asha
Barbara Beatriz Benjamin Betty Brian Carlos Carmen Carol Caroline Catherine Charles Charlotte Chloé Christian Christine Christopher Claire
Claudia Daniel David Deepa Deepak Diego Dieter Dirk Elena Elizabeth Emily Emma Eric Eva Fatima Fernando Francisco Frank François Franz
Gabriel Geeta George Grace Hannah Hans Heinz Helen Helga Henry Ibrahim Ines Isabel Jack Jacques James Jane Jean Jennifer Jessica Joana
Johann John Jonathan Jorge José Joseph Joshua Juan Julia Jörg Jürgen Karen Karin Karl Katharina Kavita Kevin Khalid Kiran Klaus Krishna
Lakshmi Laura Linda Lisa Louis Lucas Lucía Luis Manuel Marc Marco Margaret Maria María Marie Mark Markus Marta Martin Mary Matthew Meera
Michael Michel Miguel Mohan Mohammed Monika Nancy Neha Nicolas Nicole Nikhil Oliver Olivia Omar Pablo Patricia Paul Pedro Peter Petra
Philip Pierre Pooja Priya Rachel Rafael Rahul Rajesh Ramesh Ravi Rebecca Renate Ricardo Richard Robert Rohan Rosa Ruth Ryan Sabine Samuel
Sandra Sanjay Sarah Sebastian Sofia Sophie Stefan Stephen Steven Sunil Sunita Susan Suresh Sven Teresa Thomas Ursula Uwe Vijay Vikram
William Wolfgang Yusuf""".split()
# Words that end or continue the name of a firm.
FIRM_WORDS = "Agro Builders Bank Brokers Clinic Consulting Diagnostics Electricals Finance Foods GmbH Hospital Incorporated Insurance Interiors LLP Limited Logistics Ltd Nursing Polyclinic Private Pvt Services Stationers Textiles Traders Travel".split()

_CAP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_SUR = rf"[{_CAP}][{_LOW}]{{2,}}(?:[-'’][{_CAP}][{_LOW}]+)?"
_SURU = rf"[{_CAP}]{{3,}}(?:[-'’][{_CAP}]+)?"
_INI = rf"(?:[{_CAP}]\.[ ]?){{1,2}}"
_FULL = rf"{_SUR}(?:[ ][{_CAP}]\.)*[ ]{_SUR}"
_NOT_FIRM = rf"(?![{_LOW}{_CAP}'’-])(?![ ](?:{'|'.join(FIRM_WORDS)})\b)"
_START = r"(?<![\w@.+’'-])"

#: An e-mail address from its sign on; what stands before is read backwards.
_FROM_AT = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
#: The same with its signs spelled out in brackets.
_FROM_SPELLED_AT = re.compile(r"[(\[]at[)\]][ ]?[\w-]+(?:(?:\.|[ ]?[(\[]dot[)\]][ ]?)[\w-]+)*(?:\.|[ ]?[(\[]dot[)\]][ ]?)[A-Za-z]{2,}", re.I)
_SPELLED = ((re.compile(r"\s*[(\[]at[)\]]\s*", re.I), "@"), (re.compile(r"\s*[(\[]dot[)\]]\s*", re.I), "."))

# Number formats.
_NUMBER = re.compile(
    r"""(?<![\w@/.,+-])(?:
      (?P<p>(?:
          \+\d{1,3}(?:[ -]?\(\d{1,3}\)\d{0,4})?(?:[ -]?\d){7,12}
        | 00\d{2}(?:[ ]\d{2,6}){2,4}
        | \(\d{3,5}\)[ ]?\d{3}[- ]\d{3,5}
        | 1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}
        | \d{3}\.\d{3}\.\d{4}
        | \d{3}-\d{3}-\d{4}
        | 0\d{2,5}[ ]\d{4,6}(?:[ -]\d{2,6})?
        | \d{5}[ ]\d{5}
        )(?:[ ]?(?:ext\.?|x|extn\.?)[ ]?\d{1,5})?)
    | (?P<c>\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:[ -]?\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})
    | (?P<i>
          (?<!\d{4}[ -])\d{4}[ -]\d{4}[ -]\d{4}(?![ -]\d{4})
        | (?!000)\d{3}[ -]\d{2}[ -]\d{4}
        )
    | (?P<d>\d{8,14})(?:(?P<x>[ ]ext\.?[ ]?\d{1,5}))?
    )(?![\w@]|[.,/-]\d)""",
    re.X,
)
#: Where a number may lie, and numbers with letters from their digits on.
_DIGITS = re.compile(r"[+(0-9][\d ().+-]{6,}")
_CODE = re.compile(r"[0-9]\d\d\d(?:(?<=[A-Za-z]{5}\d{4})|(?<=[A-Za-z]{5} \d{4}))[ ]?[A-Za-z](?![\w@]|[.,/-]\d)")
_PASSPORT = re.compile(r"[Zz]\d{2}[ ]?\d{5}(?![\w@]|[.,/-]\d)")
#: What introduces a plain run of digits that is an identity number, or a number of goods and papers.
_ID_LEAD = re.compile(r"(?:\bid|passport|passeport|pasaporte|tax number|identity number|identity|identidad|identité|ausweis\w*|steuer\w*|fiscal|nif|ssn|pan|aadhaar|social security\w*|gave|social|seguro)\W{0,3}(?:(?:no|nr|number|núm|n°)\W{0,2})?$", re.I)
_GOODS_LEAD = re.compile(r"(?:order|consignment|invoice|parcel no|tracking|reference|ref|txn|chq|upi|neft|account|a/c|page|pedido|commande|bestellung|sendung|remessa|envío|colis|número de serie)\W{0,3}(?:(?:no|nr|number)\W{0,2})?$", re.I)

#: A text without any of these holds no address.
_MAY_HOLD_ADDRESS = re.compile(r"Road|Rd|Street|St\.|St,|Avenue|Ave|Lane|Ln|Marg|Cross|Drive|Place|Square|Close|Nagar|Colony|rue |avenue |boulevard |place |chemin |allée |impasse |weg |straße |strasse |str\. |gasse |platz |allee |Main,|Block,")
_STREET = r"(?:Road|Rd\.?|Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Marg|Cross|Drive|Place|Square|Close|Nagar|Colony)"
_WORDS = rf"[{_CAP}][\w'’]+(?:[ ][{_CAP}][\w'’]+)?"
_TOWN = rf"[{_CAP}][{_LOW}{_CAP}]{{2,}}"
_POST = r"(?:[ ]-[ ]\d{3}[ ]?\d{3}(?!\d)|,[ ][A-Z]{2}[ ]\d{5}(?!\d)|,?[ ]\d{5,6}(?!\d))?"
ADDRESS = re.compile(
    rf"""(?<![\w])(?:
      (?:(?:Flat|Apt\.?|Unit|House|Plot)[ ]\w{{1,5}},[ ](?:{_WORDS}[ ](?:Residency|Apartments|Towers|Heights),[ ])?)?\d{{1,4}}[A-Za-z]?,?[ ]{_WORDS}[ ]{_STREET},[ ]{_TOWN}{_POST}
    | No\.?[ ]\d+(?:/\d+)?,[ ]\d+(?:st|nd|rd|th)[ ](?:Main|Cross|Block),[ ]{_WORDS}[ ](?:Layout|Nagar|Colony|Extension),[ ]{_TOWN}{_POST}
    | \d{{1,4}},?[ ](?:bis[ ])?(?:rue|avenue|boulevard|place|chemin|allée|impasse)[ ](?:du|de[ ]la|de[ ]l['’]|des|de)[ ]?{_WORDS},[ ]\d{{5}}[ ]{_TOWN}
    | {_WORDS}(?:weg|straße|strasse|str\.|gasse|platz|allee)[ ]\d{{1,4}}[a-z]?,[ ]\d{{5}}[ ]{_TOWN}
    | [{_CAP}][{_LOW}]+(?:weg|straße|strasse|gasse|platz|allee)[ ]\d{{1,4}}[a-z]?,[ ]\d{{5}}[ ]{_TOWN}
    )""",
    re.X,
)


_LISTED = frozenset(g.lower() for g in GIVEN_NAMES)
#: A capital that no word or address goes before; the patterns that begin with it are found by their first character.
_FIRST = rf"[{_CAP}](?<![\w@/.+’'-][{_CAP}])"
_TOKEN = re.compile(rf"{_FIRST}(?:[{_LOW}]+|[{_CAP}]+)(?![\w@-])")
_SURNAME_AFTER = re.compile(rf"(?:[ ]{_INI})?[ ]{_SUR}{_NOT_FIRM}")
_SURNAME_AFTER_UPPER = re.compile(rf"(?:[ ]{_INI})?[ ]{_SURU}(?![\w-])")
_SURNAME_BEFORE = re.compile(rf"(?<![\w@.+’'-])(?:{_SUR}|{_SURU}), $")
_INITIAL_AFTER = re.compile(rf"[ ][{_CAP}]\.(?![{_CAP}])")
_INITIALS = re.compile(rf"{_FIRST}\.[ ]?(?:[{_CAP}]\.[ ]?)?{_SUR}{_NOT_FIRM}")
_TITLED = re.compile(rf"(?:Dr|Mr|Mrs|Ms|Prof|Herrn|Herr|Frau|Mme|M|Sr|Sra|Shri|Smt|Doctor|Doktor)\.?[ ]((?:{_INI})?(?:{_SUR}|{_SURU})(?:,[ ](?P<g>{_SUR})|[ ]{_SUR})?){_NOT_FIRM}")
# Names in lower case count after such words, or as a line of their own.
_LOWER_NAME = re.compile(rf"(?:as per|As per|laut|Laut|selon|Selon|según|Según|segundo|Segundo|per|Per|by|By|with|With|von|Von|par|Par|por|Por) ([{_LOW}]+)((?: [a-z]\.)? [{_LOW}]{{4,}})(?![\w@-])")
_LOWER_LINE = re.compile(rf"^(?:[A-Z]{{2}}>|[>\s|:~–—-])*([{_LOW}]+)[ \t\r|:~–—-]*$", re.M)
_ROLE = re.compile(rf"(?:Holder:|Patient|Signed by|Passport holder:?|Inhaber:|Titulaire :?|Titular:)[ ]((?:{_INI})?{_SUR}(?:,?[ ]{_SUR})?){_NOT_FIRM}")
#: Capitalised words in a row, and what makes two of them a full name: what is done with a person or what a person did, or a closing above.
_RUN = re.compile(rf"{_FIRST}[{_LOW}]{{2,}}(?:[-'’][{_CAP}][{_LOW}]+)?(?:[ ][{_CAP}]\.)*[ ]{_SUR}(?:(?:[ ][{_CAP}]\.)*[ ]{_SUR})?{_NOT_FIRM}")
_DONE_TO = re.compile(r"(?<!\w)(?:met|met with|(?:spoke|talked) (?:to|with)|called|asked|told|thanked|emailed|reminded|[Aa]ttn\.?:?|[Oo]n behalf of|traf|Kontakt:|[Cc]ontact(?: person)?:) $")
_DID = re.compile(r" (?:said|says|asked|told|wrote|writes|thinks|believes|replied|phoned|schrieb|sagte|a dit|a écrit|dijo|escribió|disse|escreveu)(?!\w)")
_CLOSED = re.compile(r"(?:[Rr]egards|[Ww]ishes|[Tt]hanks|[Cc]heers|[Ss]incerely|Grüßen?|Dank|[Cc]ordialement|[Ss]aludos|[Aa]tenciosamente|[Aa]braços?)[ ]?[,.!]?[ \t]*\r?\n(?:[>\s|]*\n)?[>\s|]*$")
_LINE_END = re.compile(r"[ \t]*\r?$", re.M)
#: One name, or a full one, in a greeting.
_GREETED = re.compile(rf"^[>\s|]*(?:Dear|Hi|Hello|Hey|Hallo|Liebe[r]?|Cher|Chère|Bonjour|Hola|Estimad[oa]|Querid[oa]|Olá|Prezad[oa]|Caro|Cara|Namaste)[ ]({_SUR}(?:[ ]{_SUR})?)[ ]?[,!:]?[ \t]*\r?$", re.M)
# Words that are greeted but are no names, and words at the head of a sentence that look like the surname in "Surname, Given".
_NOT_GREETED = frozenset("Sir Madam Team All Everyone Everybody Colleague Colleagues Customer Member Patient Friend Friends Valued Damen Herren Madame Monsieur Kollegen Kunde Equipo Equipe There Again Both Folks".split())
_NOT_SURNAME = frozenset("Dear Hello Good Hi Thanks Regards Also Then And But So Yes No Well Please Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())


class KnownNames:
    """Given names of the list, and those of a bit set of hashes of lower-case names."""

    def __init__(self, learned: np.ndarray | None = None):
        self.learned = learned
        self._memo: dict[str, bool] = {}

    def given(self, word: str) -> bool:
        low = word.lower()
        got = self._memo.get(low)
        if got is None:
            if len(self._memo) > 500_000:
                self._memo.clear()
            got = low in _LISTED or (self.learned is not None and bit_sets.holds(self.learned, xxhash.xxh64_intdigest(low, seed=42)))
            self._memo[low] = got
        return got


LIST_ONLY = KnownNames()


def _emails(text: str) -> list[tuple[int, int, str]]:
    found = list(_FROM_AT.finditer(text)) if "@" in text else []
    if "(" in text or "[" in text:
        found += _FROM_SPELLED_AT.finditer(text)
    out = []
    for m in found:
        # A spelled sign may have a blank before it.
        end = m.start() - (m[0][0] != "@" and text[m.start() - 1 : m.start()] == " ")
        a = end
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        if a < end and not (out and out[-1][1] > a):
            out.append((a, m.end(), "EMAIL"))
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    out = []
    found = [m.span() for m in _PASSPORT.finditer(text)]
    for m in _CODE.finditer(text):
        a = m.start() - (6 if text[m.start() - 1] == " " else 5)
        letters = text[a : a + 5]
        # In small letters it counts only behind a word that introduces it.
        if letters.isupper() or (letters.islower() and _ID_LEAD.search(text[max(0, a - 28) : a])):
            found.append((a, m.end()))
    for a, b in found:
        if not a or not (text[a - 1].isalnum() or text[a - 1] in "_@/.,+-"):
            out.append((a, b, "ID_NUMBER"))
    last = 0
    for run in _DIGITS.finditer(text):
        for m in _NUMBER.finditer(text, max(run.start(), last), run.end() + 40):
            a, b = m.span()
            if a >= run.end():
                break
            last = b
            kind = m.lastgroup
            lead = text[max(0, a - 28) : a]
            if m["c"] is not None:
                if not luhn_valid(re.sub(r"\D", "", m["c"])):
                    continue
                kind = "c"
            elif m["d"] is not None:
                n = len(m["d"])
                if _GOODS_LEAD.search(lead):
                    continue
                if n == 12 or (n in (8, 9, 10, 11) and _ID_LEAD.search(lead)):
                    kind = "i"
                elif (m["d"][0] == "0" and n in (10, 11)) or (n == 10 and m["x"]):
                    kind = "p"
                else:
                    continue
            elif kind == "p" and _GOODS_LEAD.search(lead):
                continue
            out.append((a, b, {"i": "ID_NUMBER", "p": "PHONE", "c": "CARD_NUMBER"}[kind]))
    return out


def _free(text: str, at: int) -> bool:
    """Does no word and no address go before the position?"""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_@.+’'-")


def _names(text: str, known: KnownNames) -> list[tuple[int, int, str]]:
    out = []
    last = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        s = m[0]
        if a < last or not known.given(s):
            continue
        after = (_SURNAME_AFTER_UPPER if s[1].isupper() else _SURNAME_AFTER).match(text, b)
        if after:
            b = after.end()
        elif text[a - 2 : a] == ", ":
            before = _SURNAME_BEFORE.search(text, max(last, a - 40), a)
            if before and before[0][:-2] not in _NOT_SURNAME and before[0][:-2] not in FIRM_WORDS:
                a = before.start()
                initial = _INITIAL_AFTER.match(text, b)
                b = initial.end() if initial else b
        out.append((a, b, "NAME"))
        last = b
    for m in _LOWER_NAME.finditer(text):
        if known.given(m[1]) and _free(text, m.start()):
            out.append((m.start(1), m.end(), "NAME"))
    for m in _LOWER_LINE.finditer(text):
        if known.given(m[1]):
            out.append((*m.span(1), "NAME"))
    out += [(*m.span(), "NAME") for m in _INITIALS.finditer(text)]
    for m in _TITLED.finditer(text):
        # "Dr. Surname, Word": the word belongs to the name only if it is a given name.
        if _free(text, m.start()):
            out.append((m.start(1), m.end(1) if m["g"] is None or known.given(m["g"]) else m.start("g") - 2, "NAME"))
    out += [(*m.span(1), "NAME") for m in _ROLE.finditer(text)]
    for m in _RUN.finditer(text):
        a, b = m.span()
        words = m[0].split(" ")
        if _FIRM.intersection(words):
            continue
        full = [i for i, w in enumerate(words) if w[-1] != "."]
        before = text[max(0, a - 30) : a]
        if _DONE_TO.search(before) or (_CLOSED.search(before) and _LINE_END.match(text, b)):
            out.append((a, a + len(" ".join(words[: full[1] + 1])), "NAME"))
        elif _DID.match(text, b):
            out.append((b - len(" ".join(words[full[-2] :])), b, "NAME"))
    out += [(*m.span(1), "NAME") for m in _GREETED.finditer(text) if not set(m[1].split()) & (_NOT_GREETED | _FIRM)]
    return out


_FIRM = frozenset(FIRM_WORDS)


def spans(text: str | None, known: KnownNames = LIST_ONLY) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal data of a text, in order and without overlap."""
    if not text:
        return []
    got = _emails(text)
    if _MAY_HOLD_ADDRESS.search(text):
        got += [(*m.span(), "ADDRESS") for m in ADDRESS.finditer(text)]
    got += _numbers(text)
    got += _names(text, known)
    rank = {"EMAIL": 0, "ADDRESS": 1, "PHONE": 2, "ID_NUMBER": 2, "CARD_NUMBER": 2, "NAME": 3}
    fixed, used = [], []
    for a, b, t in sorted(got, key=lambda x: (rank[x[2]], -(x[1] - x[0]))):
        if all(b <= c or a >= d for c, d in used):
            fixed.append((a, b, t))
            used.append((a, b))
    return sorted(fixed)


# Pseudonyms ---------------------------------------------------------------

ROUNDS = 10


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    d = hashlib.blake2b(b"%s|%d|%d|%d" % (tweak, i, value, modulus), key=key[:64], digest_size=16).digest()
    return int.from_bytes(d, "big") % modulus


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """Keyed permutation of 0..size-1: a Feistel network on two halves, walked until the value is in range."""
    if size < 2:
        return value
    half = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, half)
        for i in range(ROUNDS):
            a, b = b, (a + _round(key, tweak, i, b, half)) % half
        value = a * half + b
        if value < size:
            return value


_DATE_FIRST, _DATE_DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def luhn_digit(digits: str) -> int:
    """Check digit that makes the digits before it valid by Luhn's rule."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def luhn_valid(digits: str) -> bool:
    return len(digits) > 1 and luhn_digit(digits[:-1]) == int(digits[-1])


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetries of the pentagon: 0 to 4 are turns, 5 to 9 reflections."""
    turn = (a % 5 + b % 5) % 5 if a < 5 else (a % 5 - b % 5) % 5
    return turn + 5 * ((a >= 5) != (b >= 5))


# Fixed value: the permutation of Verhoeff's rule.
_VERHOEFF = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _verhoeff_sum(digits: str) -> int:
    c = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        for _ in range(i % 8):
            v = _VERHOEFF[v]
        c = _dihedral(c, v)
    return c


def verhoeff_digit(digits: str) -> int:
    """Check digit that makes the digits before it valid by Verhoeff's rule."""
    return next(d for d in range(10) if _verhoeff_sum(digits + str(d)) == 0)


def verhoeff_valid(digits: str) -> bool:
    return _verhoeff_sum(digits) == 0


def _permuted(digits: str, key: bytes, tweak: bytes) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, tweak + b"%d" % len(digits))).zfill(len(digits)) if digits else ""


def _country_length(digits: str) -> int:
    """Digits of the country code at the head of an international number."""
    # The zones of one digit, and the codes of two; all others have three.
    if digits[:1] in ("1", "7"):
        return 1
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
    return 2 if digits[:2] in two else 3


_EXTENSION = re.compile(r"[ ]?(?:ext\.?|x|extn\.?)[ ]?\d{1,5}$")


def _phone_digits(value: str, key: bytes) -> str:
    """New digits of a phone number: prefix and country code kept, the number itself and the extension permuted."""
    digits = re.sub(r"\D", "", value)
    extension = _EXTENSION.search(value)
    tail = re.sub(r"\D", "", extension[0]) if extension else ""
    main = digits[: len(digits) - len(tail)]
    if value.startswith("+"):
        keep = _country_length(main)
    elif main.startswith("00"):
        keep = 2 + _country_length(main[2:])
    elif main.startswith("0"):
        keep = 1
    else:
        keep = 1 if len(main) == 11 and main[0] == "1" else 0
    # A trunk zero in brackets behind the country code belongs to the prefix.
    if keep > 1 and main[keep : keep + 1] == "0":
        keep += 1
    return main[:keep] + _permuted(main[keep:], key, b"PHONE") + _permuted(tail, key, b"EXTENSION")


def _number_digits(digits: str, kind: str, key: bytes) -> str:
    """New digits of an identity or card number; where the old ones have a valid check digit, so have the new ones."""
    for n, valid, check in ((12, verhoeff_valid, verhoeff_digit), (0, luhn_valid, luhn_digit)):
        if (len(digits) == n or (n == 0 and kind == "CARD_NUMBER")) and valid(digits):
            new = _permuted(digits[:-1], key, kind.encode() + b"checked")
            return new + str(check(new))
    return _permuted(digits, key, kind.encode())


@functools.lru_cache(maxsize=200_000)
def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The pseudonym of a value: format preserving for numbers, a keyed digest otherwise."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind in ("PHONE", "ID_NUMBER", "CARD_NUMBER") and digits:
        new = iter(_phone_digits(value, key) if kind == "PHONE" else _number_digits(digits, kind, key))
        letters = "".join(c for c in value.upper() if "A" <= c <= "Z") if kind == "ID_NUMBER" else ""
        code = functools.reduce(lambda n, c: n * 26 + ord(c) - 65, letters, 0)
        moved = permute(code, 26 ** len(letters), key, b"letters%d" % len(letters)) if letters else 0
        alpha = []
        for _ in letters:
            moved, r = divmod(moved, 26)
            alpha.append(chr(65 + r))
        it = iter(reversed(alpha))
        return "".join(next(new) if "0" <= c <= "9" else next(it) if letters and "A" <= c.upper() <= "Z" else c for c in value)
    if kind == "DATE":
        d = (date.fromisoformat(value) - _DATE_FIRST).days
        return (_DATE_FIRST + timedelta(days=permute(d, _DATE_DAYS, key, b"date"))).isoformat()
    for pattern, sign in _SPELLED if kind == "EMAIL" else ():
        value = pattern.sub(sign, value)
    norm = " ".join(value.casefold().split())
    return hashlib.blake2b(f"{kind}|{norm}".encode(), key=key[:64], digest_size=4).hexdigest()


_DATE = re.compile(r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])")


def pieces(text: str | None, key: bytes, dates: bool = False, known: KnownNames = LIST_ONLY) -> list[tuple[int, int, str, str]]:
    """(start, end, type, pseudonym) of what is replaced in a text: personal data, and ISO dates if asked for."""
    got = spans(text, known)
    if dates and text:
        for m in _DATE.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in got):
                got.append((*m.span(), "DATE"))
    out = []
    for a, b, t in sorted(got):
        try:
            out.append((a, b, t, pseudonym(text[a:b], t, key)))
        except ValueError:  # a date that no calendar holds
            continue
    return out


def redact(text: str | None, key: bytes, dates: bool = False, known: KnownNames = LIST_ONLY) -> str | None:
    """The text with placeholders in place of its pieces."""
    if not text:
        return text
    out, at = [], 0
    for a, b, t, p in pieces(text, key, dates, known):
        out += [text[at:a], f"[{t}:{p}]"]
        at = b
    return "".join(out) + text[at:]


# Tables -------------------------------------------------------------------

_PIECES = "record_table string, record_id string, field string, pii_type string, pii_value string, pseudonym string"
#: Session setting that holds the key of the pseudonyms; without it every run draws a key of its own.
KEY_SETTING = "spark.knowloom.pseudonym.key"
#: Different people who must carry a given name in the mail addresses.
LEAST_CARRIERS = 2


def session_key(spark: SparkSession) -> bytes:
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else secrets.token_bytes(32)


def learned_names(messages: DataFrame) -> np.ndarray:
    """Bit set of the given names that people carry in the display names of all senders and recipients."""
    header = F.concat_ws(",", "sender", "recipients")
    pattern = r"(\p{Lu}\p{Ll}+)(?: \p{Lu}\.)* (\p{Lu}[\p{L}'’-]+)[\"']?\s*<"
    both = F.arrays_zip(*(F.regexp_extract_all(header, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "given"), (2, "surname"))))
    carried = messages.select(F.explode(both).alias("p")).select(F.lower("p.given").alias("given"), "p.surname").filter(~F.col("surname").isin(FIRM_WORDS)).distinct()
    names = materialise(carried.groupBy("given").count().filter(F.col("count") >= LEAST_CARRIERS).select(F.xxhash64("given").alias("h")))
    return bit_sets.bit_set(names, names.count())


_BY_WORKER: dict[int, KnownNames] = {}


def _names_of(learned) -> KnownNames:
    """The known names of a broadcast bit set, with one memory for all batches of a worker."""
    words = learned.value
    if id(words) not in _BY_WORKER:
        _BY_WORKER.clear()
        _BY_WORKER[id(words)] = KnownNames(words)
    return _BY_WORKER[id(words)]


def _finder(key: bytes, learned):
    """Map function: fields to their distinct pieces."""

    def run(batches):
        for batch in batches:
            known = _names_of(learned)
            n, kinds, values, pseudonyms = [], [], [], []
            for t in batch.column("text").to_pylist():
                got = dict.fromkeys((k, t[a:b], p) for a, b, k, p in pieces(t, key, False, known))
                n.append(len(got))
                for k, v, p in got:
                    kinds.append(k)
                    values.append(v)
                    pseudonyms.append(p)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            names = ("record_table", "record_id", "field")
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *(pa.array(x, pa.string()) for x in (kinds, values, pseudonyms))], names=[*names, "pii_type", "pii_value", "pseudonym"])

    return run


def _redactor(key: bytes, dates: bool, learned):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        known = _names_of(learned)
        return pd.Series([redact(t, key, dates, known) for t in texts], dtype=object)

    return run


def fields(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_table, record_id, field, text) of all free-text fields."""
    one = messages.select(F.lit("messages").alias("record_table"), F.col("id").alias("record_id"), F.explode(F.array(F.struct(F.lit("body").alias("field"), F.col("body").alias("text")), F.struct(F.lit("recipients").alias("field"), F.col("recipients").alias("text")))).alias("f"))
    two = texts.select(F.lit("attachment_texts").alias("record_table"), F.concat_ws(":", "content_id", F.col("chunk_index").cast("string")).alias("record_id"), F.struct(F.lit("text").alias("field"), F.col("text")).alias("f"))
    return one.unionByName(two).select("record_table", "record_id", "f.field", "f.text").filter(F.length("text") > 0)


def redacted(messages: DataFrame, texts: DataFrame, key: bytes | None = None, dates: bool = True) -> DataFrame:
    """All free-text fields with placeholders in place of their pieces; without a key that of the session."""
    spark = messages.sparkSession
    learned = spark.sparkContext.broadcast(learned_names(messages))
    return fields(messages, texts).withColumn("text", _redactor(key or session_key(spark), dates, learned)("text"))


def replaced(messages: DataFrame, texts: DataFrame, key: bytes | None = None) -> DataFrame:
    """(record_table, record_id, field, pii_type, pii_value, pseudonym): the distinct pieces that ``redacted`` replaces, dates aside."""
    spark = messages.sparkSession
    learned = spark.sparkContext.broadcast(learned_names(messages))
    return fields(messages, texts).mapInArrow(_finder(key or session_key(spark), learned), _PIECES).distinct()


def found(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pieces of the five types per field; a value has one pseudonym, so they are distinct without it too."""
    return replaced(messages, texts).filter(F.col("pii_type").isin(*TYPES)).drop("pseudonym")
