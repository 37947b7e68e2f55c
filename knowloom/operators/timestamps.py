"""Mixed timestamp formats and time zones to one unambiguous form.

A value is cut into a *shape mask*: every digit run becomes its length, every
word its class (month name, weekday, am/pm, zone, filler).  Each distinct mask
is turned into a parse plan once per worker and then applied to all rows of
that mask with vectorised kernels.  Local times become UTC through transition
tables built from the installed zone database, whose version is reported.

Defined results
---------------
* null, empty or unresolvable text (no full valid date, unknown words): null;
* a local time without a zone in the text and without ``timezone``: null, as
  no instant can be named;
* unknown zone names count as absent; malformed metadata counts as null;
* numeric day/month order follows the locale (month first only in en-US,
  also when the locale is missing: day first);
* a local time in a daylight-saving overlap is the earlier instant, one in a
  gap is read with the offset before the gap;
* fractions of a second are dropped, missing seconds are 00;
* years 1 to 9999; local times outside the years of the transition tables
  are converted one by one, by the same rules;
* a value of more than ``MOST_TOKENS`` words, numbers and signs names no date.
"""

from __future__ import annotations

import functools
import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names and abbreviations in the languages of the sources.
_MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
}
# Further written month forms.
_MONTH_FORMS = {"sept": 9, "mrz": 3, "maerz": 3, "okt": 10, "dez": 12, "jän": 1, "fevr": 2, "févr": 2, "juil": 7, "ene": 1, "abr": 4, "ago": 8, "dic": 12, "avr": 4}
# Weekday names, three-letter forms follow from them.
_WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag"
# Words that carry no date or time.
_FILLERS = {"on", "at", "hrs", "hr", "hours", "uhr", "st", "nd", "rd", "th", "um", "the", "of", "de", "le", "am_um", "h"}
# Zone abbreviations in minutes east of UTC, each read as that zone's own offset.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630,
    "awst": 480, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_MONTH_NO: dict[str, int] = dict(_MONTH_FORMS)
for _names in _MONTHS.values():
    for _i, _n in enumerate(_names.split(), 1):
        _MONTH_NO.setdefault(_n, _i)
        _MONTH_NO.setdefault(_n[:3], _i)
_DAYS = set(_WEEKDAYS.split()) | {w[:3] for w in _WEEKDAYS.split()} | {"tues", "thur", "thurs"}

_TOKEN = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.S)
_MERIDIEM = re.compile(r"(?i)(?<![^\W_])([ap])\.\s?m\b\.?")
#: Years of the transition tables.
FIRST_YEAR, LAST_YEAR = 1900, 2100
MOST_TOKENS = 200


def _role(word: str) -> str:
    w = word.lower()
    if w in _MONTH_NO:
        return "M"
    if w == "t":
        return "T"
    if w in ("am", "pm"):
        return "P"
    if w in ZONE_MINUTES:
        return "Z"
    if w in _DAYS:
        return "W"
    return "F" if w in _FILLERS else "U"


def shape_mask(text: str) -> tuple[str, list[str]]:
    """Mask and tokens of one value; ``4`` is a run of four digits, ``M`` a month name."""
    tokens = _TOKEN.findall(_MERIDIEM.sub(r"\1m", text.strip()))
    mask = []
    for t in tokens:
        if t[0].isdigit():
            mask.append(f"{len(t)}" if len(t) < 10 else f"<{len(t)}>")
        elif t[0].isspace():
            mask.append("_")
        elif t[0].isalpha():
            mask.append(_role(t))
        else:
            mask.append(t)
    return "\x00".join(mask), tokens


def _find_date(m: list[str]) -> tuple[dict[str, int], int, int] | None:
    """Positions of year, month and day in a mask, and the span they cover."""
    n = len(m)
    short = ("1", "2")
    for i in range(n):
        t = m[i : i + 5]
        if len(t) == 5 and t[1] == t[3] and t[1] in "-/.":
            if t[0] == "4" and t[2] in short and t[4] in short:
                return {"y": i, "m": i + 2, "d": i + 4}, i, i + 5
            if t[0] in short and t[2] in short and t[4] in ("4", "2") and (i + 5 == n or m[i + 5] not in ("-", "/")):
                return {"n1": i, "n2": i + 2, "y": i + 4}, i, i + 5
    for i in range(n):
        if m[i] != "M":
            continue
        # Day, optional ordinal or dot, month, year.
        b = i - 1
        while b >= 0 and m[b] in ("_", "-", ".", "F", ",", "/"):
            b -= 1
        a = i + 1
        while a < n and m[a] in ("_", "-", ".", ",", "/", "F"):
            a += 1
        if b >= 0 and m[b] in short and a < n and m[a] in ("4", "2") and not (b > 0 and m[b - 1] in (":", ".")):
            return {"d": b, "mn": i, "y": a}, b, a + 1
        # Month, day, year.
        if a < n and m[a] in short:
            c = a + 1
            while c < n and m[c] in ("_", ",", "F", ".", "-", "/"):
                c += 1
            if c < n and m[c] == "4":
                return {"mn": i, "d": a, "y": c}, i, c + 1
    return None


@functools.lru_cache(maxsize=65536)
def plan_for(mask: str) -> dict[str, int] | None:
    """The parse plan of a mask: token positions of its fields, or None if it names no full date."""
    m = mask.split("\x00")
    if m == ["<10>"] or m == ["<13>"]:
        return {"epoch": 0}
    if m and m[0] == "8" and (len(m) == 1 or m[1:3] == ["T", "6"] or m[1:3] == ["T", "4"]):
        plan, rest = {"ymd": 0}, list(range(1, len(m)))
        if len(m) > 1:
            plan["hms"], rest = 2, list(range(3, len(m)))
    else:
        found = _find_date(m)
        if found is None:
            return None
        plan, a, b = found
        rest = [k for k in range(len(m)) if not a <= k < b]
        for k in rest:
            t = m[k : k + 3]
            if len(t) == 3 and m[k] in ("1", "2") and t[1] in (":", ".") and t[2] == "2" and not (k and m[k - 1] in ("+", "-")) and k + 2 in rest:
                plan |= {"H": k, "Mi": k + 2}
                used = {k, k + 1, k + 2}
                if m[k + 3 : k + 5] == [t[1], "2"]:
                    plan["S"] = k + 4
                    used |= {k + 3, k + 4}
                    if len(m) > k + 6 and m[k + 5] in (".", ",") and m[k + 6].strip("<>").isdigit():
                        used |= {k + 5, k + 6}
                rest = [x for x in rest if x not in used]
                break
    for k in list(rest):
        if k not in rest:
            continue
        t = m[k]
        if t in ("+", "-") and ("H" in plan or "hms" in plan):
            nxt = m[k + 1 : k + 4]
            if nxt[:1] == ["4"]:
                plan |= {"sign": k, "off4": k + 1}
                rest = [x for x in rest if x not in (k, k + 1)]
            elif nxt == ["2", ":", "2"]:
                plan |= {"sign": k, "offh": k + 1, "offm": k + 3}
                rest = [x for x in rest if x not in (k, k + 1, k + 2, k + 3)]
            elif nxt[:1] == ["2"]:
                plan |= {"sign": k, "offh": k + 1}
                rest = [x for x in rest if x not in (k, k + 1)]
    for k in rest:
        t = m[k]
        if t == "P" and "H" in plan:
            plan["P"] = k
        elif t == "Z" and ("H" in plan or "hms" in plan):
            plan.setdefault("Z", k)
        elif t not in ("_", ",", ".", "F", "W", "T", "(", ")"):
            return None
    return plan


@functools.lru_cache(maxsize=1)
def zone_table_version() -> str:
    """Version of the zone files that this process builds its tables from: those of the system where there are any, else the package's."""
    import hashlib
    import zoneinfo
    from pathlib import Path

    for folder in map(Path, zoneinfo.TZPATH):
        if not (folder / "Europe").is_dir():
            continue
        for name in ("tzdata.zi", "+VERSION"):
            if (folder / name).is_file():
                with open(folder / name, encoding="utf-8") as f:
                    return "system " + f.readline().strip("# \n").removeprefix("version ")
        digest = hashlib.sha1(b"".join(p.read_bytes() for p in sorted((folder / "Europe").iterdir()) if p.is_file()))
        return f"system files {digest.hexdigest()[:12]}"
    try:
        import tzdata

        return f"package {tzdata.IANA_VERSION}"
    except ImportError:
        return "none"


def _local_offset(second: int, zone: str) -> int | None:
    """Offset of a local time of any year, in seconds."""
    from zoneinfo import ZoneInfo

    try:
        return int((datetime(1970, 1, 1) + timedelta(seconds=second)).replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds())
    except Exception:
        return None


@functools.lru_cache(maxsize=1024)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(switch points in local seconds, offsets in seconds) of a zone, or None if unknown.

    A local time before ``points[i]`` and not before ``points[i-1]`` has ``offsets[i]``;
    the points are placed so that overlaps give the earlier instant.
    """
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(name)
    except Exception:
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def off(second: int) -> int:
        return int((epoch + timedelta(seconds=second)).astimezone(z).utcoffset().total_seconds())

    start = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    points, offsets = [], [off(start)]
    step, s = 7 * 86400, start
    while s < end:
        a, b = s, s + step
        if off(b) != offsets[-1]:
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if off(mid) == offsets[-1] else (a, mid)
            new = off(b)
            points.append(b + max(offsets[-1], new))
            offsets.append(new)
            s = b
        else:
            s += step
    return np.array(points, dtype=np.int64), np.array(offsets, dtype=np.int64)


def _ints(tokens: list[list[str]], k: int) -> np.ndarray:
    return np.array([t[k] for t in tokens], dtype=object).astype(np.int64)


def _convert(plan: dict[str, int], tokens: list[list[str]], zones: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(form, has a time) of all rows of one mask; form is '' where the value is not a valid date."""
    n = len(tokens)
    if "epoch" in plan:
        v = _ints(tokens, 0)
        sec = np.where(v >= 10**12, v // 1000, v)
        return np.char.add(np.datetime_as_string(sec.astype("datetime64[s]")), "Z").astype(object), np.ones(n, bool)
    if "ymd" in plan:
        v = _ints(tokens, plan["ymd"])
        y, mo, d = v // 10000, v // 100 % 100, v % 100
    else:
        y = _ints(tokens, plan["y"])
        if len(tokens[0][plan["y"]]) == 2:
            y = y + np.where(y < 70, 2000, 1900)
        if "n1" in plan:
            a, b = _ints(tokens, plan["n1"]), _ints(tokens, plan["n2"])
            mo, d = np.where(month_first, a, b), np.where(month_first, b, a)
        else:
            mo = np.array([_MONTH_NO[t[plan["mn"]].lower()] for t in tokens]) if "mn" in plan else _ints(tokens, plan["m"])
            d = _ints(tokens, plan["d"])
    ok = (mo >= 1) & (mo <= 12) & (d >= 1) & (y >= 1) & (y <= 9999)
    month = ((np.where(ok, y, 2000) - 1970) * 12 + np.where(ok, mo, 1) - 1).astype("datetime64[M]")
    day = month.astype("datetime64[D]") + np.where(ok, d - 1, 0)
    ok &= day.astype("datetime64[M]") == month
    if "H" not in plan and "hms" not in plan:
        return np.where(ok, np.datetime_as_string(day), "").astype(object), np.zeros(n, bool)
    if "hms" in plan:
        v = _ints(tokens, plan["hms"])
        if len(tokens[0][plan["hms"]]) == 4:
            v = v * 100
        h, mi, s = v // 10000, v // 100 % 100, v % 100
    else:
        h, mi = _ints(tokens, plan["H"]), _ints(tokens, plan["Mi"])
        s = _ints(tokens, plan["S"]) if "S" in plan else np.zeros(n, np.int64)
    if "P" in plan:
        pm = np.array([t[plan["P"]].lower() == "pm" for t in tokens])
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + 12 * pm
    ok &= (h < 24) & (mi < 60) & (s < 60)
    local = day.astype("datetime64[s]").astype(np.int64) + h * 3600 + mi * 60 + s
    if "sign" in plan:
        if "off4" in plan:
            v = _ints(tokens, plan["off4"])
            o = v // 100 * 60 + v % 100
        else:
            o = _ints(tokens, plan["offh"]) * 60 + (_ints(tokens, plan["offm"]) if "offm" in plan else 0)
        o = o * np.array([-1 if t[plan["sign"]] == "-" else 1 for t in tokens]) * 60
    elif "Z" in plan:
        o = np.array([ZONE_MINUTES[t[plan["Z"]].lower()] for t in tokens]) * 60
    else:
        o = np.zeros(n, np.int64)
        for z in set(zones):
            at = zones == z
            tab = zone_table(z) if z else None
            if tab is None:
                ok &= ~at
            else:
                o[at] = tab[1][np.searchsorted(tab[0], local[at], side="right")]
                for i in np.nonzero(at & ok & ((y <= FIRST_YEAR) | (y >= LAST_YEAR)))[0]:
                    own = _local_offset(int(local[i]), z)
                    if own is None:
                        ok[i] = False
                    else:
                        o[i] = own
    text = np.datetime_as_string((local - o).astype("datetime64[s]"))
    return np.where(ok, np.char.add(text, "Z"), "").astype(object), np.ones(n, bool)


def normalise_values(raw: pd.Series, zone: pd.Series, locale: pd.Series) -> pd.Series:
    """Normal forms of a batch of values, null where there is none."""
    out = np.full(len(raw), None, dtype=object)
    groups: dict[str, list[int]] = {}
    tokens: dict[int, list[str]] = {}
    for i, s in enumerate(raw.array):
        if isinstance(s, str) and s:
            mask, t = shape_mask(s)
            if len(t) > MOST_TOKENS:
                continue
            groups.setdefault(mask, []).append(i)
            tokens[i] = t
    zones = zone.fillna("").to_numpy(dtype=object)
    mf = (locale == "en-US").fillna(False).to_numpy(dtype=bool)
    for mask, rows in groups.items():
        plan = plan_for(mask)
        if plan is None:
            continue
        at = np.array(rows)
        form, _ = _convert(plan, [tokens[i] for i in rows], zones[at], mf[at])
        out[at] = np.where(form == "", None, form)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _normal_form(raw: pd.Series, zone: pd.Series, locale: pd.Series) -> pd.Series:
    return normalise_values(raw, zone, locale)


@F.pandas_udf(T.StringType())
def _zone_version(ids: pd.Series) -> pd.Series:
    return pd.Series([zone_table_version()] * len(ids), dtype=object)


def normal_form(raw: Column, zone: Column, locale: Column) -> Column:
    """Column of normal forms (``yyyy-MM-dd`` or ``yyyy-MM-ddTHH:mm:ssZ``), null where unresolvable."""
    return _normal_form(raw, zone, locale)


def normalise_dates(df: DataFrame, raw: str = "date_raw", metadata: str = "metadata") -> DataFrame:
    """``df`` with ``normal_form`` and ``zone_version``; every row is kept, other columns untouched.

    Only the text, the zone and the locale travel to Python; the version is that
    of the worker that converted the row.
    """
    m = F.col(metadata)
    return df.withColumn("normal_form", normal_form(F.col(raw), F.get_json_object(m, "$.timezone"), F.get_json_object(m, "$.locale"))).withColumn("zone_version", _zone_version(F.col(raw)))


#: Fact tables with dates, and their id columns.
DATED_TABLES = {"lab_results": "result_id", "financial_records": "record_id", "medical_events": "event_id"}


def normalise_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All dated fact tables as (record_table, record_id, date_raw, normal_form, zone_version), one row per stored row."""
    parts = []
    for name, df in tables.items():
        parts.append(df.select(F.lit(name).alias("record_table"), F.col(DATED_TABLES[name]).alias("record_id"), "date_raw", "metadata"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return normalise_dates(both).drop("metadata")


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct records whose date can be resolved and is not already written in the normal form."""
    n = normalise_tables(tables)
    return n.filter(F.col("normal_form").isNotNull() & (F.col("normal_form") != F.col("date_raw"))).select("record_table", "record_id", "normal_form").distinct()
