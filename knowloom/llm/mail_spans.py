"""Each e-mail reduced to the text its sender newly wrote.

The lines of a body are cut into spans by a semi-Markov model.  A span is
authored text, a prefixed quotation, the lines that introduce one, a forwarding
note, copied text without prefix, a closing with signature, or a disclaimer or
device note.  The score of a segmentation is the sum of

* line scores of the span's kind (``LINE_SCORES``), and further ones for lines
  that stand in an earlier mail of the thread (``REPEATED``),
* the transition into the span (``TRANSITIONS``), which holds the order of the
  parts of a mail: what follows an introduction is quoted, what follows the own
  signature is not new, copied text runs to the end,
* boundary cues at the first line of the span (``START_CUES``): a greeting opens
  authored or copied text, a repeated line opens a copy,
* a length score (signatures, notes and introductions are short, and none of
  them follows one of its own kind),
* the place of a copy: one at the head of the body may be followed by the own
  text, if that begins with a greeting, after the end of the copied mail, or
  where the repeated lines end,
* a feature of the whole span: the share of its lines that are repeated
  (``SHARE``) speaks for a copy and against authored text.

The best segmentation is found by dynamic programming over all segments.  All
messages of an Arrow batch are decoded together, one numpy step per line
position, so no Python loop runs over the segments of a message.

Lines are compared within a thread by hashes.  A body is read once: what goes on
is the class of every line and a hash of those that could be own text (no marks,
``LEAST_CHARS`` or more).  The earliest mail that holds a hash counts as its
source; one aggregation and one join by hash find the repeated lines, whatever
the size of a thread, and bodies are never shuffled.

The scores are fixed parameters (log-odds set by hand); nothing is fitted.

Defined results
---------------
* null and empty bodies, and bodies of blank lines only: no lines, new text is
  null or empty as the body;
* blank lines belong to no span; new text keeps those between new lines;
* CRLF counts as LF; a line has no limit of length, a body no limit of lines
  (segments of more than ``LOOK_BACK`` lines are chained);
* without thread or time a message has no repeated lines and is no source; of
  two mails at one time neither is the source of the other;
* repeated rows give equal results; further columns are untouched.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.session import materialise

AUTHORED, QUOTED, INTRO, FORWARD, COPIED, SIGNATURE, NOTE, INTRO_FIRST, COPIED_FIRST, AUTHORED_BELOW = range(10)
KINDS = ("authored", "quoted", "introduction", "forward", "copied", "signature", "note", "introduction", "copied", "authored")
LOOK_BACK = 64

#: Kinds that are newly written; authored text below a copy at the head of a body begins with a greeting or after the copied signature.
NEW = (AUTHORED, AUTHORED_BELOW)

# Line classes.
(PREFIX, NUMBER_GT, WRAPPED, INTRODUCES, FORWARDS, HEADER, HEADER_LIKE, RULE, CLOSING, GREETING, DEVICE, LEGAL, SHORT, SENTENCE, RESTART) = range(15)

#: Score of a line of each class (row) in a span of each kind (column).
LINE_SCORES = np.array(
    [
        # A     Q     I     F     C     S     N
        [-5.0, 3.0, -6.0, -6.0, 3.0, -6.0, -6.0],  # PREFIX
        [1.5, 1.0, -6.0, -6.0, 1.0, -6.0, -6.0],  # NUMBER_GT
        [-1.5, 2.0, -3.0, -3.0, 2.0, -3.0, -3.0],  # WRAPPED
        [-30.0, -60.0, 4.0, 3.5, 3.5, -7.0, -7.0],  # INTRODUCES
        [-30.0, -60.0, 1.0, 5.0, 4.0, -7.0, -7.0],  # FORWARDS
        [-3.0, -60.0, 2.5, 2.5, 2.5, -4.0, -4.0],  # HEADER
        [1.0, -60.0, 0.5, 0.5, 0.5, -4.0, -4.0],  # HEADER_LIKE
        [-3.0, -60.0, 0.0, 0.0, 1.5, 2.5, 1.0],  # RULE
        [-3.5, -60.0, -7.0, -7.0, 2.0, 4.0, -4.0],  # CLOSING
        [-1.0, -60.0, -7.0, -7.0, 0.3, -2.0, -5.0],  # GREETING
        [-4.0, -60.0, -7.0, -7.0, 2.0, 0.5, 4.0],  # DEVICE
        [-4.0, -60.0, -7.0, -7.0, 2.0, -3.0, 4.0],  # LEGAL
        [-2.0, -60.0, -6.0, -6.0, 1.5, 2.0, -1.5],  # SHORT
        [2.0, -60.0, -7.0, -7.0, 0.3, -5.0, -3.0],  # SENTENCE
    ]
)
# RESTART, a sentence right after a short line, a device note or a disclaimer, scores like any sentence.
LINE_SCORES = np.concatenate([LINE_SCORES, LINE_SCORES[[SENTENCE]]])
# The three kinds of a body that begins with a copy score like their plain forms.
LINE_SCORES = np.concatenate([LINE_SCORES, LINE_SCORES[:, [INTRO, COPIED, AUTHORED]]], axis=1)
_NO = -1e9
#: Score of a span of each kind (column) after one of each kind (row); the last row is the start of the body.
TRANSITIONS = np.array(
    [
        # A     Q     I     F     C     S     N     I1    C1    A1
        [-0.5, -1.0, 0.0, 0.0, -6.0, 0.0, -0.5, _NO, _NO, _NO],
        [-0.3, -0.5, -0.5, -0.5, _NO, -1.0, -1.0, _NO, _NO, _NO],
        [_NO, 0.0, _NO, _NO, -0.5, _NO, _NO, _NO, _NO, _NO],
        [_NO, _NO, _NO, _NO, 0.0, _NO, _NO, _NO, _NO, _NO],
        [_NO, _NO, _NO, _NO, 0.0, _NO, _NO, _NO, _NO, _NO],
        [-25.0, -0.5, 0.0, 0.0, -1.0, _NO, 0.0, _NO, _NO, _NO],
        [-25.0, -0.5, 0.0, 0.0, -1.0, -1.5, _NO, _NO, _NO, _NO],
        [_NO, 0.0, _NO, _NO, _NO, _NO, _NO, _NO, -0.5, _NO],
        [_NO, -0.5, _NO, _NO, _NO, _NO, _NO, _NO, 0.0, -4.0],
        [-0.5, _NO, _NO, _NO, _NO, 0.0, -0.5, _NO, _NO, _NO],
        [0.0, -0.5, _NO, 0.0, _NO, -2.0, -2.0, 0.0, -3.0, _NO],
    ]
)
#: Bonus of a span that begins with a line of a class.
START_CUES = {(AUTHORED_BELOW, c): 3.0 if c in (GREETING, RESTART) else -30.0 for c in range(15)} | {(AUTHORED, GREETING): 3.0, (COPIED, GREETING): 3.5, (SIGNATURE, CLOSING): 1.0, (SIGNATURE, RULE): 0.5, (FORWARD, FORWARDS): 1.0}
#: Lines a span of a kind normally has at most, and the cost of each further line.
LENGTHS = {INTRO: (8, 2.0), INTRO_FIRST: (8, 2.0), FORWARD: (8, 1.0), SIGNATURE: (8, 1.5), NOTE: (6, 0.5)}

#: Score of a line that stands in an earlier mail, by kind of span.
REPEATED = np.array([-4.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, -4.0])
#: Share of repeated lines from which a span gets the score below, by kind.
SHARE, SHARE_SCORES = 0.4, np.array([-2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, -2.0])
#: Scores of a copy that begins with a repeated line, and of own text that begins where repeated lines end.
COPY_BEGINS, REPEATS_END = 1.5, 2.5
#: Shortest line that is compared with other mails, and the classes that are.
LEAST_CHARS = 20
COMPARED = frozenset((SENTENCE, RESTART, SHORT, NUMBER_GT, HEADER_LIKE))

_PREFIX = re.compile(r"\s*(?:>|\||:(?:\s|$)|[A-Z]{2}>)")
_NUMBER_GT = re.compile(r">\s?\d[\d.,]*\s+[a-z]")
# How mail programs introduce, forward, close and label, by language.
_LINE = re.compile(
    r"""(?P<i>(?:on|am|le|el|em|il)\s.{5,200}(?:wrote|schrieb|écrit|escribió|escreveu)\b.{0,120}:\s*$
      |.{0,150}(?:wrote|schrieb|a\ écrit|escribió|escreveu)\s*:?\s*$
      |\[\d{1,2}[./-]\d{1,2}[./-]\d{2,4}[ ,]+\d{1,2}[:.]\d{2}\]\s[^:]{2,80}:\s*$
      |on\s\w{3},\s\d{1,2}\s\w{3,9}\s\d{4}\sat\s\d{1,2}:\d{2},\s[^.?!]{2,80}$)
    |(?P<f>begin\sforwarded\smessage:?\s*$|-{3,}\s*(?:forwarded\smessage|weitergeleitete\snachricht|message\stransféré|mensaje\sreenviado|mensagem\sencaminhada)\s*-{3,}\s*$)
    |(?P<o>-{3,}\s*(?:original\smessage|ursprüngliche\snachricht|message\sd'origine|mensaje\soriginal)\s*-{3,}\s*$|_{24,}\s*$)
    |(?P<h>(?:from|von|de|date|datum|sent|gesendet|envoyé|to|an|à|para|cc|subject|betreff|objet|asunto|assunto)\s?:\s)
    |(?P<r>[-_*=~#]{2,}\s*$)
    |(?P<c>(?:(?:with\s)?(?:best|kind|warm|kindest|many)?\s?(?:regards|wishes|thanks)|thanks(?:\s(?:&|and)\sregards)?|thank\syou|warmly|cordialement|bien\sà\svous|cheers|sincerely|yours\s\w+|best|(?:mit\s)?(?:freundlichen|besten|vielen|viele|beste|liebe)\s(?:grüßen|grüße|dank)|saludos(?:\scordiales)?|un\ssaludo|atentamente|atenciosamente|abraços?|cumprimentos|dhanyavaad|धन्यवाद)\s?[,.!]?\s*$)
    |(?P<d>sent\sfrom\s(?:my|a|an)\s|sent\son\sthe\sgo|gesendet\s(?:vom|von\smeinem)\s|von\s(?:unterwegs|meinem)\s|envoyé\s(?:de|depuis)\smon\s|enviado\s(?:desde\smi|do\smeu)\s|get\soutlook\sfor)
    |(?P<g>(?:hi|hello|hey|dear|good\s(?:morning|afternoon|evening|day)|hallo|liebe[r]?|guten\s(?:tag|morgen|abend)|sehr\sgeehrte[r]?|bonjour|bonsoir|cher|chère|hola|buenos\sdías|buenas\stardes|estimad[oa]|olá|bom\sdia|prezad[oa]|namaste|नमस्ते)\b[^.?!:]{0,50}[,!]?\s*$|[^\W\d_][\w'’.-]*\s?,\s*$)
    """,
    re.I | re.X,
)
_LEGAL = re.compile(
    r"confidential|privileged|intended (?:only|solely|recipient)|\baddressee\b|vertraulich|confidentiel|confidencial|\bliab(?:le|ility)\b|malware|\bvirus|scanned and kept|print this|before printing|registered office|trade register|does not bind|disclaimer|delete this message|diffusion non autorisée|think of the forest|viruses|haftung|handelsregister",
    re.I,
)
_GROUP_CLASS = {"i": INTRODUCES, "f": FORWARDS, "o": INTRODUCES, "h": HEADER, "r": RULE, "c": CLOSING, "d": DEVICE, "g": GREETING}


def _class_of(s: str) -> int:
    """Class of a stripped line without prefix, from the line alone."""
    # In a long line runs of white space count as one, which keeps the time of the patterns linear.
    m = _LINE.match(s if len(s) <= 260 else " ".join(s.split()))
    if m:
        c = _GROUP_CLASS[m.lastgroup]
        if c == HEADER and s[-1] in ".!?" and len(s) > 30:
            return HEADER_LIKE
        return c
    if _LEGAL.search(s):
        return LEGAL
    if len(s) < 90 and s[-1] not in ".?!:;" and not (s.startswith("-- ") and s.endswith("--")):
        return SHORT
    return SENTENCE


_short_class = functools.lru_cache(maxsize=200_000)(_class_of)


def _plain_class(s: str) -> int:
    return _short_class(s) if len(s) <= 400 else _class_of(s)


def line_classes(lines: list[str]) -> tuple[list[int], list[int]]:
    """Numbers (from 1) and classes of the lines that are not blank."""
    at, out = [], []
    before, open_quote = -2, False
    n = len(lines)
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if _PREFIX.match(line):
            c = NUMBER_GT if _NUMBER_GT.match(s) else PREFIX
            open_quote = s[-1] not in ".?!:,>" and len(s) > 40
        else:
            c = _plain_class(s)
            if c == GREETING and out and out[-1] in (INTRODUCES, FORWARDS, HEADER, HEADER_LIKE):
                c = SENTENCE
            elif c == SENTENCE and out and out[-1] in (SHORT, DEVICE, LEGAL):
                c = RESTART
            if open_quote and before == i - 1 and c in (SENTENCE, RESTART, SHORT, GREETING):
                follows = lines[i + 1] if i + 1 < n else ""
                if s[0].islower() or s[0].isdigit() or _PREFIX.match(follows) or not follows.strip():
                    c = WRAPPED
            open_quote = False
        at.append(i + 1)
        out.append(c)
        before = i
    return at, out


def _cue_table() -> np.ndarray:
    t = np.zeros((LINE_SCORES.shape[0], len(KINDS)))
    for (kind, cls), v in START_CUES.items():
        t[cls, kind] = v
    return t


_CUES = _cue_table()


def _length_table(n: int) -> np.ndarray:
    t = np.zeros((n + 1, len(KINDS)))
    for kind, (most, cost) in LENGTHS.items():
        t[:, kind] = -cost * np.maximum(0, np.arange(n + 1) - most)
    return t


def decode(classes: np.ndarray, repeated: np.ndarray | None = None) -> np.ndarray:
    """Kinds of all lines of messages with equally many lines: (messages, lines) to (messages, lines)."""
    b, n = classes.shape
    k = len(KINDS)
    rep = np.zeros((b, n), bool) if repeated is None else repeated
    total = np.zeros((b, n + 1, k))
    np.cumsum(LINE_SCORES[classes] + rep[:, :, None] * REPEATED, axis=1, out=total[:, 1:])
    counts = np.zeros((b, n + 1), np.int32)
    np.cumsum(rep, axis=1, out=counts[:, 1:])
    cue = _CUES[classes] + 0.0
    cue[:, :, COPIED] += COPY_BEGINS * rep
    cue[:, :, COPIED_FIRST] += COPY_BEGINS * rep
    cue[:, 0, COPIED_FIRST] = np.where(rep[:, 0], COPY_BEGINS, _NO)
    ends = np.zeros((b, n), bool)
    ends[:, 1:] = rep[:, :-1] & ~rep[:, 1:]
    cue[:, :, AUTHORED_BELOW] = np.where(ends, np.maximum(cue[:, :, AUTHORED_BELOW], REPEATS_END), cue[:, :, AUTHORED_BELOW])
    any_repeated = bool(rep.any())
    lengths = _length_table(min(n, LOOK_BACK))
    # into[j]: best score of a segmentation of the first j lines followed by a transition into each kind.
    into = np.full((b, n + 1, k), _NO)
    came = np.zeros((b, n + 1, k), np.int8)
    into[:, 0] = TRANSITIONS[k]
    came[:, 0] = k
    start = np.zeros((b, n, k), np.int32)
    final = None
    for i in range(1, n + 1):
        low = max(0, i - LOOK_BACK)
        seg = into[:, low:i] + cue[:, low:i] - total[:, low:i] + lengths[i - low : 0 : -1]
        if any_repeated:
            seg += (counts[:, i, None] - counts[:, low:i] >= SHARE * np.arange(i - low, 0, -1))[:, :, None] * SHARE_SCORES
        j = seg.argmax(axis=1)
        best = np.take_along_axis(seg, j[:, None], axis=1)[:, 0] + total[:, i]
        start[:, i - 1] = j + low
        if i < n:
            step = best[:, :, None] + TRANSITIONS[:k]
            came[:, i] = step.argmax(axis=1)
            into[:, i] = step.max(axis=1)
        else:
            final = best
    out = np.empty((b, n), np.int8)
    kind = final.argmax(axis=1)
    end = np.full(b, n)
    rows = np.arange(b)
    live = np.ones(b, bool)
    pos = np.arange(n)
    while live.any():
        s = np.where(live, start[rows, np.maximum(end - 1, 0), np.minimum(kind, k - 1)], end)
        inside = (pos >= s[:, None]) & (pos < end[:, None])
        np.copyto(out, kind[:, None].astype(np.int8), where=inside)
        kind = np.where(live, came[rows, s, np.minimum(kind, k - 1)], kind)
        end = np.where(live, s, end)
        live = end > 0
    return out


def _decoded(lines: list[tuple[list[int], list[int], list[int]]]) -> list[list[int]]:
    """Kinds of the lines of messages given as (numbers, classes, positions of repeated lines)."""
    found: list[list[int]] = [[]] * len(lines)
    by_length: dict[int, list[int]] = {}
    for i, (at, _, _) in enumerate(lines):
        if len(at):
            by_length.setdefault(len(at), []).append(i)
    for n, group in by_length.items():
        size = max(1, 400_000 // (n * n + 1))
        for a in range(0, len(group), size):
            part = group[a : a + size]
            rep = np.zeros((len(part), n), bool)
            for r, i in enumerate(part):
                rep[r, lines[i][2]] = True
            for i, kk in zip(part, decode(np.array([lines[i][1] for i in part]), rep)):
                found[i] = kk.tolist()
    return found


def spans_of(bodies) -> list[tuple[list[int], list[int]]]:
    """For each body, without its thread, the numbers of its lines that are not blank, and their kinds."""
    lines = [(*line_classes(body.split("\n")), []) if body else ([], [], []) for body in bodies]
    return [(at, kinds) for (at, _, _), kinds in zip(lines, _decoded(lines))]


def compared_lines(body: str, at: list[int], classes: list[int]):
    """(position, text) of the lines that are looked for in other mails."""
    lines = body.split("\n")
    for i, (n, c) in enumerate(zip(at, classes)):
        if c in COMPARED:
            text = " ".join(lines[n - 1].split())
            if len(text) >= LEAST_CHARS:
                yield i, text


_READ_SCHEMA = "mid long, id string, at array<int>, classes binary, sent long, positions array<int>, keys array<long>"
_KINDS_SCHEMA = "mid long, id string, at array<int>, kinds binary"


def _mid(key: str | None, body: str) -> int:
    """Key of a message: repeated rows share it, rows of one id with unlike bodies do not."""
    return xxhash.xxh3_64_intdigest(body, seed=xxhash.xxh3_64_intdigest(key or "")) - (1 << 63)


def _read(batches):
    """Every body once: classes of its lines, and the hashes of those that are compared."""
    for pdf in batches:
        rows = []
        for key, thread, sent, body in zip(pdf["id"], pdf["thread_id"], pdf["sent"], pdf["body"]):
            at, classes = line_classes(body.split("\n"))
            if not at:
                continue
            positions, keys = [], []
            if thread is not None and not pd.isna(sent):
                seed = xxhash.xxh3_64_intdigest(thread)
                for i, text in compared_lines(body, at, classes):
                    positions.append(i)
                    keys.append(xxhash.xxh3_64_intdigest(text, seed=seed) - (1 << 63))
            rows.append((_mid(key, body), key, at, bytes(classes), None if pd.isna(sent) else int(sent), positions, keys))
        if rows:
            yield pd.DataFrame(rows, columns=["mid", "id", "at", "classes", "sent", "positions", "keys"]).astype({"sent": "Int64"})


def _kinds(batches):
    for pdf in batches:
        lines = [(a, np.frombuffer(c, np.uint8), [] if r is None else list(r)) for a, c, r in zip(pdf["at"], pdf["classes"], pdf["repeated"])]
        yield pdf[["mid", "id", "at"]].assign(kinds=[bytes(k) for k in _decoded(lines)])


def decoded(messages: DataFrame) -> DataFrame:
    """(mid, id, at, kinds): the numbers of the lines of every message that are not blank, and their kinds."""
    m = messages.select("id", "thread_id", F.unix_micros(F.col("received_at").cast("timestamp")).alias("sent"), "body").filter(F.length("body") > 0)
    read = materialise(m.mapInPandas(_read, _READ_SCHEMA).dropDuplicates(["mid"]))
    asked = read.select("mid", "sent", F.explode(F.arrays_zip("positions", "keys")).alias("a")).select("mid", "sent", F.col("a.positions").alias("position"), F.col("a.keys").alias("key"))
    source = asked.groupBy("key").agg(F.min("sent").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeated = asked.join(source, "key").filter(F.col("sent") > F.col("first")).groupBy("mid").agg(F.collect_list("position").alias("repeated"))
    return read.select("mid", "id", "at", "classes").join(repeated, "mid", "left").mapInPandas(_kinds, _KINDS_SCHEMA)


def _of_lines(kind_of, schema: str):
    """Map function: decoded messages to one row for each line that ``kind_of`` gives a value."""

    def run(batches):
        for pdf in batches:
            ids, nos, values = [], [], []
            for key, at, kinds in zip(pdf["id"], pdf["at"], pdf["kinds"]):
                for n, k in zip(at, kinds):
                    v = kind_of(k)
                    if v is not None:
                        ids.append(key)
                        nos.append(n)
                        values.append(v)
            out = pd.DataFrame({"id": ids, "line_no": nos, "kind": values})
            yield out if "kind" in schema else out[["id", "line_no"]]

    return run


def lines(messages: DataFrame) -> DataFrame:
    """(id, line_no, kind) of every line that is not blank, once per message."""
    schema = "id string, line_no int, kind string"
    return decoded(messages).mapInPandas(_of_lines(lambda k: KINDS[k], schema), schema)


def found(messages: DataFrame) -> DataFrame:
    """(id, line_no) of the lines that are not newly written, once per message id."""
    schema = "id string, line_no int"
    return decoded(messages).mapInPandas(_of_lines(lambda k: None if k in NEW else k, schema), schema).distinct()


def cut(body: str | None, at, kinds) -> str | None:
    """The new lines of a body, with the blank ones between them."""
    if not body:
        return body
    lines = body.split("\n")
    new = {n for n, k in zip(at, kinds) if k in NEW}
    blank = set(range(1, len(lines) + 1)) - set(at)
    kept: list[str] = []
    for n, line in enumerate(lines, 1):
        if n in new:
            kept.append(line.rstrip("\r"))
        elif n in blank and kept and kept[-1] != "":
            kept.append("")
    return "\n".join(kept).strip("\n")


@F.pandas_udf(T.StringType())
def _cut(body: pd.Series, at: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([cut(b, [] if a is None else a, k or b"") for b, a, k in zip(body, at, kinds)], dtype=object)


@F.pandas_udf(T.LongType())
def _mids(key: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([_mid(k, b) if b else None for k, b in zip(key, body)], dtype="Int64")


def new_text(messages: DataFrame) -> DataFrame:
    """``messages`` (id, thread_id, received_at, body and others) with ``new_text``, the newly written part of the body."""
    columns = messages.columns
    d = decoded(messages).select(F.col("mid").alias("_mid"), F.col("at").alias("_at"), F.col("kinds").alias("_kinds"))
    out = messages.withColumn("_mid", _mids("id", "body")).join(d, "_mid", "left")
    return out.select(*columns, _cut("body", "_at", "_kinds").alias("new_text"))
