"""Spellings of names typed by people, linked when they name the same person or organisation.

Every distinct value is parsed once: folded (accents, case, letters that look
like digits), freed of titles, legal forms and remarks, and split into a *core*
(the surname, or the coined part of a firm's or facility's name) and its rest
(given name or initials; line of business; place word).  A firm whose line of
business is not known has all its words, sorted, as its core; it is known for a
firm by a legal form in any of its spellings.  Values with the same parse are
one form.

Forms are blocked by the phonetic codes of their sorted tokens: the code of the
rest with the code of the core and every string that lacks one class of it.  So
forms meet that have equal rests and cores of which the codes are one edit
apart, whatever happened to vowels and to letters of one class.  For rests that
differ, forms are blocked by the core and every string that lacks one letter of
it; any two cores one edit apart share such a key.  Pairs in a block are compared
token by token: cores by single-edit distance or, for longer ones, two edits and
a high Jaro-Winkler similarity; given names by a nickname table, as shortened
forms, and by Jaro-Winkler similarity.  Accepted pairs are clustered by connected
components.  A form with initials only joins a person if exactly one person with
that surname and initial is known.

Scale: values are counted down to distinct ones before anything else, so hot
names cost one row; a block with more than ``LARGE_BLOCK`` forms is compared
whole, in pieces of about that size.  Components are found by label
propagation over checkpointed tables; nothing is collected.

Defined results
---------------
* null and blank values, and values without a letter, link to nothing;
* values that differ only in case, space, accents or punctuation are linked;
* all pairs of one entity are given, the smaller string by code point first;
* a value that occurs in several rows counts once per field.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.session import bounded_broadcast, materialise

LARGE_BLOCK = 400
#: Least Jaro-Winkler similarity of two cores one edit apart, of two long ones two edits apart, and of given names.
CORE_SIMILARITY = 0.85
LONG_SIMILARITY, LONG_CORE = 0.9, 8
GIVEN_SIMILARITY = 0.85

# Lines of business, kinds of facilities, place words.
BUSINESS = ("agro foods", "builders", "consulting engineers", "diagnostics", "electricals", "finance", "insurance brokers", "interiors", "logistics", "stationers", "textiles", "traders", "travel services")
FACILITY = ("nursing home", "medical centre", "diagnostic laboratory", "polyclinic", "clinic", "hospital")
PLACES = ("city", "garden", "harbour", "hill", "junction", "lakeside", "memorial", "valley")
# Legal forms and remarks that name nobody.
_FORMS = r"\b(?:private limited|pvt\.? ?ltd\.?|p\.? ?(?:ltd|limited)\.?|limited|ltd\.?|l\.?l\.?p\.?|incorporated|inc\.?|corp\.?|gesellschaft mbh|g\.?m\.?b\.?h\.?|and sons?|und s[öo]hne)(?=[\s,.()]|$)|& ?sons?\b|\bm/s\.?|\bmessrs\b\.?"
_LEGAL_FORM = re.compile(_FORMS)
_LEGAL = re.compile(_FORMS + r"|\(.*?\)")
_TITLES = frozenset("dr mr mrs ms miss prof doctor md mbbs shri smt sri herr frau mme m".split())
# Nicknames and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "andy": "andrew", "annie": "anne", "art": "arthur", "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "bert": "albert", "beth": "elizabeth", "betty": "elizabeth",
    "bess": "elizabeth", "bev": "beverly", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christopher", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "don": "donald", "ed": "edward", "eddie": "edward", "fred": "frederick", "gene": "eugene", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john", "jake": "jacob", "jim": "james",
    "jimmy": "james", "joe": "joseph", "josh": "joshua", "judy": "judith", "ken": "kenneth", "larry": "lawrence", "liz": "elizabeth", "lizzie": "elizabeth", "maria": "mary", "matt": "matthew", "mike": "michael", "molly": "mary",
    "nancy": "anne", "nate": "nathaniel", "ned": "edward", "nell": "helen", "pam": "pamela", "pat": "patricia", "patty": "patricia", "pete": "peter", "phil": "philip", "polly": "mary", "ray": "raymond", "ron": "ronald",
    "sally": "sarah", "sam": "samuel", "sandy": "sandra", "steve": "stephen", "sue": "susan", "ted": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "vinny": "vincent", "wally": "walter",
    "hans": "johannes", "heinz": "heinrich", "fritz": "friedrich", "sepp": "josef", "toni": "anton", "uschi": "ursula", "steffi": "stefanie", "moni": "monika", "paco": "francisco", "pancho": "francisco", "lupe": "guadalupe",
    "chema": "josemaria", "nacho": "ignacio", "lola": "dolores", "manolo": "manuel", "ze": "jose", "tonio": "antonio", "kiki": "enrique", "babu": "balakrishna", "raju": "rajendra", "ramu": "ramachandra", "sonu": "sonia",
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "will": "william", "billy": "william",
    "dick": "richard", "rick": "richard", "kittu": "krishnamurthy", "krish": "krishnamurthy", "hari": "harishankar", "chanda": "chandrika", "padma": "padmavathi", "paddu": "padmavathi",
    "raghu": "raghunath", "venkat": "venkataraman", "venky": "venkataraman", "ulli": "ulrike", "uli": "ulrike", "mina": "wilhelmina", "willa": "wilhelmina", "liza": "elizaveta", "lisa": "elizaveta",
    "gabi": "gabrielle", "gaby": "gabrielle", "benni": "benedikta", "kathi": "katharina", "kate": "katharina", "katja": "katharina", "niko": "nikolaos", "nick": "nikolaos", "leo": "leonardo",
    "sasha": "aleksander", "alek": "aleksander", "alex": "aleksander", "jon": "jonathan", "johnny": "jonathan", "basti": "sebastian", "seb": "sebastian", "theo": "theodora", "dora": "theodora",
    "zac": "zachariah", "zack": "zachariah", "iggy": "ignatius", "fredi": "frederika", "rika": "frederika", "freddie": "frederika", "pepe": "jose", "gita": "gitanjali", "laxmi": "lakshmi", "lucky": "lakshmi",
    "yaso": "yasodhara", "vicky": "vikram", "gretel": "margarethe", "grete": "margarethe", "cami": "camille", "niki": "dominika", "domi": "dominika", "xime": "ximena", "fari": "farida",
}

_LOOKS = str.maketrans("015", "ols")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")

FORM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "core", "rest", "place")])


def fold(text: str) -> str:
    """Lower case without accents."""
    t = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("å", "a")
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()


def one_edit(a: str, b: str) -> bool:
    """Do the strings differ by at most one insertion, deletion, substitution or swap of neighbours?"""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with a prefix weight of 0.1."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    free = [True] * m
    hits_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits_a.append(c)
                break
    k = len(hits_a)
    if not k:
        return 0.0
    hits_b = [b[j] for j in range(m) if not free[j]]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b)) / 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    head = 0
    while head < min(4, n, m) and a[head] == b[head]:
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


def _shortens(short: str, word: str) -> bool:
    """Are the letters of ``short`` those of the word in order, with its first and at least 45 % of them?"""
    if len(short) < 3 or short[0] != word[0] or len(short) < 0.45 * len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


#: Consonant classes; vowels and h carry no class.
_CLASS = {c: k for k, group in enumerate(("bp", "fvw", "gkqcx", "dt", "sz", "jy", "l", "r", "m", "n")) for c in group}


def phonetic_code(word: str) -> str:
    """Consonant classes of a word in order; doubled letters count twice, so one edit of the word is at most one of its code."""
    return "".join(str(_CLASS[c]) for c in word if c in _CLASS)


@functools.lru_cache(maxsize=100_000)
def _means(token: str, word: str) -> bool:
    """Is the token a spelling of the word: equal, one edit off, an abbreviation or its consonants?"""
    t = token.rstrip(".")
    if t == word or t + "s" == word or t == word + "s":
        return True
    if len(t) >= 4 and len(word) >= 4 and (one_edit(t, word) or one_edit(t, word + "s")):
        return True
    if len(t) >= 3 and word.startswith(t) and (token.endswith(".") or len(t) >= len(word) - 2 or len(t) <= 4):
        return True
    return _shortens(t, word)


# Short forms of the words of facilities.
_SHORT = {"hosp": "hospital", "lab": "laboratory", "labs": "laboratory", "dx": "diagnostic", "diag": "diagnostic", "med": "medical", "ctr": "centre", "center": "centre", "nsg": "nursing", "n": "nursing", "poly": "polyclinic", "ins": "insurance", "fin": "finance", "tex": "textiles", "engrs": "engineers", "engg": "engineers", "svcs": "services", "elec": "electricals", "dispensary": "clinic"}


def _take(tokens: list[str], phrases) -> tuple[str | None, list[str]]:
    """The phrase the tokens hold, and the tokens without it."""
    best = None
    for phrase in phrases:
        words, used = phrase.split(), []
        for w in words:
            for i, t in enumerate(tokens):
                if i not in used and (_SHORT.get(t.rstrip(".")) == w or _means(t, w)):
                    used.append(i)
                    break
        if len(used) == len(words) and (best is None or len(used) > len(best[1])):
            best = (phrase, used)
    if best is None:
        return None, tokens
    return best[0], [t for i, t in enumerate(tokens) if i not in best[1]]


def sorted_core(tokens: list[str]) -> str:
    """The words of a firm, sorted and joined."""
    return "".join(sorted(w for t in tokens if (w := t.rstrip(".")) not in ("the", "and", "of")))


def parse(field: str, name: str | None) -> tuple[str, str, str, str] | None:
    """(kind, core, rest, place) of a name, None if it names nobody."""
    if not name:
        return None
    text = _CAMEL.sub(" ", unicodedata.normalize("NFC", name)) if not name.isupper() else name
    low = _LEGAL.sub(" ", re.sub(r"\s+", " ", fold(text)).strip())
    comma = re.match(r"^([^,]+),(.+)$", low.strip(" ,"))
    low = re.sub(r"(?<=[a-z])[015](?=[a-z.\s]|$)|(?<![a-z\d])[015](?=[a-z])", lambda m: m[0].translate(_LOOKS), low)
    low = low.replace("poly-clinic", "polyclinic").replace("poly clinic", "polyclinic").replace("-", " ")
    tokens = _TOKEN.findall(low)
    if not any(c.isalpha() for c in low):
        return None
    if field != "patient" and field != "clinician":
        kinds = FACILITY if field == "facility" else BUSINESS
        kind, left = _take(tokens, kinds)
        if kind is None and field != "facility":
            kind, left = _take(tokens, FACILITY)
        if kind is not None or field == "facility":
            place, rest = _take(left, PLACES) if field == "facility" else (None, left)
            if not rest and place:
                rest = [t for t in left]
                place = None
            core = "".join(t.rstrip(".") for t in rest if t.rstrip(".") not in ("the", "and", "of"))
            return ("o", core, kind or "", place or "") if core else None
        if _LEGAL_FORM.search(" " + re.sub(r"\s+", " ", fold(text)).strip()):
            return "o", sorted_core(tokens), "", ""
    tokens = [t for t in tokens if t.rstrip(".") not in _TITLES or (t == "m." and len(tokens) <= 2)]
    if not tokens:
        return None
    plain = [t.rstrip(".") for t in tokens]
    whole = [p for p in plain if len(p) > 2]
    if len(whole) >= 2:
        known = [p for p in whole if p in NICKNAMES or p in _GIVEN]
        if comma and whole[0] == _TOKEN.findall(fold(comma[1]))[-1].rstrip("."):
            surname, given = whole[0], whole[1]
        elif known and known[0] != whole[-1]:
            given = known[0]
            surname = max((p for p in whole if p != given), key=len)
        elif known:
            given = known[0]
            surname = max((p for p in whole if p != given), key=len)
        else:
            given, surname = whole[0], whole[-1]
        return "p", surname, given, ""
    if len(whole) == 1:
        initials = [p for p in plain if len(p) <= 2]
        return "p", whole[0], initials[0][0] if initials else "", ""
    return "p", "".join(plain), "", ""


# Given names known beside the nicknames, folded.
_GIVEN = frozenset(
    """aleksander andre anika benedikta bharat bjorn camille chandrika chloe deepa devika dominika elizaveta emre eswar farida fatima frederika
    gabrielle gitanjali gunnar harishankar hedda hakan ignatius indu ishaan jonathan jose jorg katharina kavya kiran krishnamurthy lakshmi
    leonardo lucia margaret margarethe maria mohan nikolaos nisha noor oktavia ove padmavathi priya quentin raghunath renee richard robert
    sebastian sunil theodora tilde ulrike uma venkataraman vikram wanda wilhelmina william xaverine ximena yasodhara yusuf zachariah zoe""".split()
)


def two_edits(a: str, b: str) -> bool:
    """Are the strings at most two insertions, deletions, substitutions or swaps of neighbours apart?"""
    if abs(len(a) - len(b)) > 2:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1] <= 2


def same_core(a: str, b: str) -> bool:
    """Equal, one edit apart, or long and alike with two edits."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5:
        return False
    alike = jaro_winkler(a, b)
    if one_edit(a, b):
        return alike >= CORE_SIMILARITY
    return min(len(a), len(b)) >= LONG_CORE and alike >= LONG_SIMILARITY and two_edits(a, b)


def same_given(a: str, b: str) -> bool:
    """Full given names, or a name and its nickname or shortened form."""
    x, y = NICKNAMES.get(a, a), NICKNAMES.get(b, b)
    if x == y:
        return True
    if x in _GIVEN and y in _GIVEN:
        return False
    short, long = sorted((x, y), key=len)
    if len(short) >= 3 and long.startswith(short):
        return True
    return len(short) >= 3 and (one_edit(short, long) or (jaro_winkler(short, long) >= GIVEN_SIMILARITY and len(short) >= 6 and short[0] == long[0] and abs(len(short) - len(long)) < 2))


def accept(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> bool:
    """Do two forms name the same entity? Persons need two full given names here."""
    if a[0] != b[0] or not same_core(a[1], b[1]):
        return False
    if a[0] == "o":
        return a[2] == b[2] and (a[3] == b[3] or not a[3] or not b[3])
    return len(a[2]) > 1 and len(b[2]) > 1 and same_given(a[2], b[2])


@F.pandas_udf(FORM)
def _parse(field: pd.Series, name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(f, n) or (None, None, None, None) for f, n in zip(field, name)], columns=["kind", "core", "rest", "place"])


def _without_one(x: str) -> set[str]:
    return {x} | {x[:i] + x[i + 1 :] for i in range(len(x))}


def block_keys(core: str) -> list[str]:
    """Keys of which any two cores one edit apart share one."""
    return sorted(_without_one(core)) if len(core) >= 5 else [core]


def token_keys(core: str, rest: str) -> list[str]:
    """Phonetic codes of the core, whole and without one class, each sorted with that of the rest."""
    code = phonetic_code(NICKNAMES.get(rest, rest))
    return ["=" + " ".join(sorted((c, code))) for c in sorted(_without_one(phonetic_code(core)))] if len(core) >= LONG_CORE else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(core: pd.Series) -> pd.Series:
    return pd.Series([block_keys(c) for c in core], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_keys(core: pd.Series, rest: pd.Series) -> pd.Series:
    return pd.Series([block_keys(c) + token_keys(c, r) for c, r in zip(core, rest)], dtype=object)


@F.pandas_udf(T.StringType())
def _sorted_words(name: pd.Series) -> pd.Series:
    return pd.Series([sorted_core(_TOKEN.findall(_LEGAL.sub(" ", fold(n)))) for n in name], dtype=object)


@F.pandas_udf(T.BooleanType())
def _accept(ka: pd.Series, ca: pd.Series, ra: pd.Series, pa: pd.Series, cb: pd.Series, rb: pd.Series, pb: pd.Series) -> pd.Series:
    return pd.Series([accept((k, c, r, p), (k, d, s, q)) for k, c, r, p, d, s, q in zip(ka, ca, ra, pa, cb, rb, pb)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _same_core(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_core(x, y) for x, y in zip(a, b)], dtype=bool)


def values(financial: DataFrame, medical: DataFrame) -> DataFrame:
    """Distinct (field, name) of all name fields."""
    parts = [financial.select(F.lit("counterparty").alias("field"), F.col("counterparty").alias("name"))]
    parts += [medical.select(F.lit(c).alias("field"), F.col(c).alias("name")) for c in ("patient", "clinician", "facility")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("name").isNotNull()).distinct()


def _blocked(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms with their block keys, to be joined: a large block is cut in pieces on one side and repeated for each on the other."""
    by = ["field", "kind", "part", "key"]
    keyed = forms.withColumn("key", F.explode(_all_keys("core", "rest"))).withColumn("part", F.when(F.col("kind") == "o", F.col("rest")).otherwise(""))
    keyed = materialise(keyed)
    large = keyed.groupBy(*by).count().filter(F.col("count") > LARGE_BLOCK).select(*by, F.ceil(F.col("count") / LARGE_BLOCK).cast("int").alias("pieces"))
    keyed = keyed.join(bounded_broadcast(materialise(large)), by, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    whole = keyed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return whole, keyed.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from each node.

    ``edges`` holds (a, b) in both directions.  Labels move along edges and jump
    to the label of the label, so a chain of n nodes takes about log n rounds.
    """
    labels = materialise(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "old")
        new = materialise(new)
        labels = new.select("id", "component")
        if new.filter(F.col("component") != F.col("old")).isEmpty():
            return labels


def link(financial: DataFrame, medical: DataFrame) -> DataFrame:
    """(field, name, entity): every distinct value with the entity it names; entity is the least form id."""
    v = values(financial, medical)
    parsed = materialise(v.withColumn("f", _parse("field", "name")).select("field", "name", "f.*").filter(F.col("core").isNotNull()))
    # What looks like a person is a firm where the same words stand with a legal form elsewhere.
    words = F.when((F.col("field") == "counterparty") & (F.col("kind") == "p"), _sorted_words("name"))
    firms = parsed.filter("kind = 'o' and rest = '' and field = 'counterparty'").select("field", F.col("core").alias("words"), F.lit(True).alias("firm")).distinct()
    parsed = parsed.withColumn("words", words).join(firms, ["field", "words"], "left")
    as_firm = {"kind": F.lit("o"), "core": F.col("words"), "rest": F.lit(""), "place": F.lit("")}
    parsed = parsed.select("field", "name", *(F.when(F.col("firm"), v).otherwise(F.col(k)).alias(k) for k, v in as_firm.items()))
    parsed = materialise(parsed.withColumn("id", F.concat_ws("\x1f", "field", "kind", "core", "rest", "place")))
    forms = materialise(parsed.select("id", "field", "kind", "core", "rest", "place").distinct())
    full = forms.filter((F.col("kind") == "o") | (F.length("rest") > 1))
    blocks, pieces = _blocked(full)
    b = pieces.select("field", "kind", "part", "key", "piece", *(F.col(c).alias(f"{c}_b") for c in ("id", "core", "rest", "place")))
    # Equal cores share all their keys and are taken from one.
    once = (F.col("core") != F.col("core_b")) | (F.col("key") == F.col("core"))
    pairs = blocks.join(b, ["field", "kind", "part", "key", "piece"]).filter((F.col("id") < F.col("id_b")) & once)
    pairs = pairs.select("kind", "id", "core", "rest", "place", "id_b", "core_b", "rest_b", "place_b").distinct()
    pairs = pairs.filter(_accept("kind", "core", "rest", "place", "core_b", "rest_b", "place_b")).select(F.col("id").alias("a"), F.col("id_b").alias("b"))
    pairs = materialise(pairs)
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = components(forms, both)
    # Forms with initials, or with a surname only, join the one person they can mean.
    persons = full.filter(F.col("kind") == "p").join(labels, "id").select("field", "core", F.substring("rest", 1, 1).alias("initial"), "component").distinct()
    known = materialise(persons.groupBy("field", "core", "initial").agg(F.count_distinct("component").alias("n"), F.min("component").alias("person")))
    short = forms.filter((F.col("kind") == "p") & (F.length("rest") == 1)).select("id", "field", "core", F.col("rest").alias("initial"))
    direct = short.join(known, ["field", "core", "initial"]).select("id", "n", "person")
    lone = short.join(direct.select("id"), "id", "left_anti").withColumn("key", F.explode(_keys("core")))
    near = known.withColumn("key", F.explode(_keys("core"))).withColumnRenamed("core", "core_b")
    fuzzy = lone.join(near, ["field", "initial", "key"]).filter(_same_core("core", "core_b")).groupBy("id").agg((F.count_distinct("person") + F.max("n") - 1).alias("n"), F.min("person").alias("person"))
    joined = direct.unionByName(fuzzy.select("id", F.col("n").cast("long").alias("n"), "person")).filter(F.col("n") == 1).select("id", "person")
    entity = labels.join(joined, "id", "left").select("id", F.coalesce("person", "component").alias("entity"))
    return parsed.select("field", "name", "id").join(entity, "id").select("field", "name", "entity")


def found(financial: DataFrame, medical: DataFrame) -> DataFrame:
    """All pairs of different values of one field that name the same entity."""
    e = materialise(link(financial, medical))
    b = e.select("field", "entity", F.col("name").alias("name_b"))
    return e.withColumnRenamed("name", "name_a").join(b, ["field", "entity"]).filter(F.col("name_a") < F.col("name_b")).select("field", "name_a", "name_b")
