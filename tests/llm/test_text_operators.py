import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knowloom.llm import bit_sets, eval_leaks, garbled_text, mail_spans, mixing, personal_data, splitting

# Mail spans ------------------------------------------------------------------

REPLY = """Dear Anna,
The parcel came today.

> 7.0 is the cut-off they use, so we are fine.

Regards,
Bo Li

This e-mail is confidential and intended only for the addressee.

On Fri, 03 May 2019 at 13:37, Anna K <a@x.example> wrote:
> The home loan statement lists four charges that nobody at Kastor Traders
can explain.
>
> Regards,
"""


def old_lines(body):
    ((at, kinds),) = mail_spans.spans_of([body])
    return [n for n, k in zip(at, kinds) if k != mail_spans.AUTHORED]


def test_reply():
    assert old_lines(REPLY) == [6, 7, 9, 11, 12, 13, 14, 15]
    assert old_lines(REPLY.replace("\n", "\r\n")) == [6, 7, 9, 11, 12, 13, 14, 15]


def test_other_layouts():
    assert old_lines("On Mon, 01 Jan 2024 at 10:00, A B <a@b.example> wrote:\n> Shall we meet in the old place?\n\nYes, gladly, at noon.\n") == [1, 2]
    assert old_lines("See below.\n\n---------- Forwarded message ---------\nFrom: X\nSubject: y\n\nAll of this is old text.\n> so is this.\nand this line as well.") == [3, 4, 5, 7, 8, 9]
    assert old_lines("Sent from the counter today: 14 copies.") == []
    assert old_lines("") == [] and old_lines(None) == [] and old_lines(" \n\t\n") == []


def test_long_bodies_and_batches():
    body = "\n".join(["This is one more sentence of my own."] * 500)
    assert old_lines(body) == []
    assert mail_spans.spans_of([body, None, REPLY])[2] == mail_spans.spans_of([REPLY])[0]


def test_lines_of_any_length_are_classified():
    legal = "This message and its parts are confidential and meant for the named reader. " + "Whoever else reads it is asked to tell the sender and to keep no copy of it. " * 26
    assert len(legal) > 2000
    assert old_lines(f"Yes, gladly, at noon.\n\n{legal}") == [3]
    late = "Whoever else reads it is asked to tell the sender and to keep no copy of it. " * 26 + "This message is confidential."
    assert old_lines(f"Yes, gladly, at noon.\n\n{late}") == [3]
    c = mail_spans.line_classes(["To: " + ", ".join(f"p{i} <p{i}@x.example>" for i in range(100)), "Sent from my telephone " + "x" * 400])[1]
    assert c == [mail_spans.HEADER, mail_spans.DEVICE]


def test_time_of_long_lines_is_linear():
    import time

    for s in ("on " + "wrote " * 40_000, "wrote " * 40_000 + ".", "a" * 240_000, "-" * 240_000 + "x", "hi " + "\u00a0 " * 80_000 + "x", "le " + "schrieb \t" * 30_000 + "x", "wrote " + " " * 200_000 + "x"):
        began = time.perf_counter()
        mail_spans.line_classes([s])
        assert time.perf_counter() - began < 1, s[:20]


def span_score(classes, rep, i, j, y):
    """Score of one span of kind y over lines i to j, its transition aside."""
    import numpy as np

    c, r = np.array(classes), np.array(rep, bool)
    s = mail_spans.LINE_SCORES[c[i:j], y].sum() + r[i:j].sum() * mail_spans.REPEATED[y] + mail_spans._length_table(len(c))[j - i, y]
    s += mail_spans.SHARE_SCORES[y] if r.any() and r[i:j].sum() >= mail_spans.SHARE * (j - i) else 0
    cue = mail_spans._CUES[c[i], y]
    if y in (mail_spans.COPIED, mail_spans.COPIED_FIRST) and r[i]:
        cue += mail_spans.COPY_BEGINS
    if y == mail_spans.COPIED_FIRST and i == 0:
        cue = mail_spans.COPY_BEGINS if r[0] else -1e9
    if y == mail_spans.AUTHORED_BELOW and i and r[i - 1] and not r[i]:
        cue = max(cue, mail_spans.REPEATS_END)
    return s + cue


def brute_best(classes, rep):
    """Best score of all segmentations by plain recursion."""
    k, n = len(mail_spans.KINDS), len(classes)

    def best(i, before):
        if i == n:
            return 0.0
        return max(mail_spans.TRANSITIONS[before, y] + span_score(classes, rep, i, j, y) + best(j, y) for j in range(i + 1, n + 1) for y in range(k))

    return best(0, k)


def score(classes, rep, kinds):
    """Score of the best segmentation that has these kinds."""
    k, n = len(mail_spans.KINDS), len(classes)
    best = {(0, k): 0.0}
    for j in range(1, n + 1):
        for i in range(j):
            if len(set(kinds[i:j])) == 1:
                y = kinds[i]
                for b in [b for (p, b) in best if p == i]:
                    s = best[(i, b)] + mail_spans.TRANSITIONS[b, y] + span_score(classes, rep, i, j, y)
                    best[(j, y)] = max(best.get((j, y), -1e18), s)
    return max(v for (p, _), v in best.items() if p == n)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.booleans()), min_size=1, max_size=4))
def test_decoder_against_all_segmentations(lines):
    import numpy as np

    classes, rep = [c for c, _ in lines], [r for _, r in lines]
    kinds = mail_spans.decode(np.array([classes]), np.array([rep]))[0].tolist()
    assert score(classes, rep, kinds) == pytest.approx(brute_best(classes, rep))


def test_spans_with_a_length_do_not_follow_their_own_kind():
    import numpy as np

    for kind in mail_spans.LENGTHS:
        assert mail_spans.TRANSITIONS[kind, kind] < -1e8
    many = mail_spans.decode(np.array([[mail_spans.HEADER] * 15]))[0].tolist()
    assert many.count(mail_spans.INTRO) + many.count(mail_spans.INTRO_FIRST) <= 10


MAILS = "id string, thread_id string, received_at timestamp, body string"


def test_copies_without_marks_are_known_by_the_thread(spark):
    from datetime import datetime

    first = "Hi Ann,\nThe parcel for the office came on Monday and is complete.\nPlease check the bill of the carrier again."
    second = "Dear Bo,\nMany thanks, the bill is paid since this morning.\n\nThe parcel for the office came on Monday and is complete.\nPlease check the bill of the carrier again."
    third = "The parcel for the office came on Monday and is complete.\nPlease check the bill of the carrier again.\n\nI have looked at it and found nothing wrong with it."
    at = lambda h: datetime(2020, 1, 1, h)
    rows = [("1", "t", at(1), first), ("2", "t", at(2), second), ("2", "t", at(2), second), ("3", "t", at(3), third), ("4", "other", at(4), first), ("5", None, at(5), first), ("6", "t", None, first)]
    df = spark.createDataFrame(rows, MAILS).withColumn("kinds", F.lit("clash")).withColumn("mid", F.lit(1))
    assert {tuple(r) for r in mail_spans.found(df).collect()} == {("2", 4), ("2", 5), ("3", 1), ("3", 2)}
    out = {(r.id, r.new_text) for r in mail_spans.new_text(df).collect()}
    assert ("2", "Dear Bo,\nMany thanks, the bill is paid since this morning.") in out and ("3", "I have looked at it and found nothing wrong with it.") in out and ("5", first) in out


def test_mail_tables(spark):
    from datetime import datetime

    at = datetime(2020, 1, 1)
    df = spark.createDataFrame([("1", "t", at, REPLY), ("1", "t", at, REPLY), ("2", None, None, None), ("3", "t", None, ""), ("4", "t", at, " \n\t")], MAILS)
    assert mail_spans.found(df).count() == 8
    out = {r.id: r.new_text for r in mail_spans.new_text(df.withColumn("kind", F.lit("clash"))).collect()}
    assert out["2"] is None and out["3"] == "" and out["1"].startswith("Dear Anna,") and "confidential" not in out["1"]
    assert mail_spans.found(df.filter("false")).count() == 0
    assert {(r.line_no, r.kind) for r in mail_spans.lines(df).filter("id = '1'").collect()} >= {(1, "authored"), (9, "note"), (11, "introduction")}


# Splitting -------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\ń‍éx", min_size=0, max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_cuts_cover_the_text(text, limit, overlap):
    cuts = splitting.cuts_of(text, limit, overlap)
    end, joined = 0, ""
    for a, b in cuts:
        assert b - a <= limit and a <= end and end - a <= overlap
        joined += text[end:b]
        end = b
    assert joined == text


def greedy(text, limit, overlap):
    """The same cuts one after another, without tables."""
    pos, level = splitting.boundaries(text, max(1, min(limit // 4, (limit - overlap) // 2)))
    pos, level = pos.tolist(), level.tolist()
    out, cut = [], 0
    while cut < len(text):
        begin = 0 if cut == 0 else min(p for p in pos if p >= max(cut - overlap, 0))
        reach = [i for i, p in enumerate(pos) if cut < p <= begin + limit]
        last = reach[-1]
        if pos[last] != len(text):
            for least in (3, 2):
                good = [i for i in reach if level[i] >= least and pos[i] >= begin + limit // 2]
                if good:
                    last = good[-1]
                    break
        out.append((begin, pos[last]))
        cut = pos[last]
    return out


def test_doubling_equals_greedy():
    text = "One sentence here. Another one\nthere! " * 40 + "\n\n" + "wordswithoutanyspace" * 20 + " end."
    assert splitting.cuts_of(text, 100, 20) == greedy(text, 100, 20)


def test_split_tables(spark):
    rows = [("c", 1, 0, "short"), ("c", 1, 1, "word " * 500), ("c", 1, 1, "word " * 500), ("c", 2, 2, None), ("c", 2, 3, ""), ("d", 1, 0, "x" * 1001)]
    df = spark.createDataFrame(rows, "content_id string, page int, chunk_index int, text string").withColumn("pieces", F.lit("clash"))
    out = splitting.split_items(df).orderBy("content_id", "chunk_index").collect()
    assert [r.chunk_index for r in out if r.content_id == "c"] == list(range(len([r for r in out if r.content_id == "c"])))
    assert all(r.text is None or len(r.text) <= 1000 for r in out)
    assert {tuple(r) for r in splitting.found(df).collect()} == {("c", 1, 1), ("d", 1, 0)}
    assert splitting.split_items(df.filter("false")).count() == 0


# Personal data ---------------------------------------------------------------


def kinds(text):
    return [(k, text[a:b]) for a, b, k in personal_data.spans(text)]


def test_personal_data():
    t = "Dear Jörg,\nCall me at 05553039042 or write to a.b@x.example. Order 60730045423 for Kastor Finance. Ditinede, Jonathan, passport z00 12311, lives at 12 Kiln Road, Velkonda."
    assert kinds(t) == [("NAME", "Jörg"), ("PHONE", "05553039042"), ("EMAIL", "a.b@x.example"), ("NAME", "Ditinede, Jonathan"), ("ID_NUMBER", "z00 12311"), ("ADDRESS", "12 Kiln Road, Velkonda")]
    assert kinds("") == [] and kinds(None) == []
    assert kinds("noor.x@y.example") == [("EMAIL", "noor.x@y.example")]


def test_pseudonyms_keep_format_and_links():
    key = b"k"
    a = personal_data.pseudonym("+91 83920 11823", "PHONE", key)
    assert re.fullmatch(r"\+\d\d \d{5} \d{5}", a)
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(a) == digits(personal_data.pseudonym("+918392011823", "PHONE", key)) != digits(personal_data.pseudonym("+918392011823", "PHONE", b"other"))
    assert re.fullmatch(r"[A-Z]{5}\d{4}[A-Z]", personal_data.pseudonym("PYKZD2787X", "ID_NUMBER", key))
    assert sorted(personal_data.permute(i, 257, key, b"t") for i in range(257)) == list(range(257))
    assert personal_data.pseudonym("2021-05-06", "DATE", key)[4] == "-"
    assert "[PHONE:" in personal_data.redact("Call 05553039042.", key)


def test_spelled_out_addresses():
    t = "Copy a.b+c (at) corp (dot) x-y (dot) example on it, or d_e [at] post.z.example. Then (at) noon."
    assert kinds(t) == [("EMAIL", "a.b+c (at) corp (dot) x-y (dot) example"), ("EMAIL", "d_e [at] post.z.example")]
    assert personal_data.pseudonym("d_e [at] post (dot) z.example", "EMAIL", b"k") == personal_data.pseudonym("d_e@post.z.example", "EMAIL", b"k")


def test_numbers_that_no_format_allows():
    assert kinds("000-00-0000 and 1234 5678 9012 3456 7") == []
    assert kinds("Card 4111 1111 1111 1111, call 098765 43210 ext. 12.") == [("CARD_NUMBER", "4111 1111 1111 1111"), ("PHONE", "098765 43210 ext. 12")]


def test_phone_pseudonyms_keep_the_country_and_link_its_forms():
    key = b"k"
    a, b, c = (personal_data.pseudonym(v, "PHONE", key) for v in ("+91 98765 43210", "098765 43210", "0091 98765 43210"))
    digits = lambda s: re.sub(r"\D", "", s)
    assert a.startswith("+91 ") and b.startswith("0") and c.startswith("0091 ") and digits(a)[2:] == digits(b)[1:] == digits(c)[4:]
    assert personal_data.pseudonym("+1 555 010 9999", "PHONE", key).startswith("+1 ")


def test_check_digits_stay_valid():
    key = b"k"
    assert personal_data.luhn_valid("4111111111111111") and personal_data.verhoeff_valid("2363") and not personal_data.verhoeff_valid("2364")
    card = personal_data.pseudonym("4111 1111 1111 1111", "CARD_NUMBER", key)
    assert personal_data.luhn_valid(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    number = "23412341234" + str(personal_data.verhoeff_digit("23412341234"))
    assert personal_data.verhoeff_valid(personal_data.pseudonym(number, "ID_NUMBER", key))


HELD_OUT = "Beatrix Oldenburg;Tobias Kranz;Nkechi Obi;Ewa Nowak;Giulia Conti;Henrik Lund;Ingrid Solheim;Hiroshi Tanaka;Leila Haddad;Matteo Ricci;Oksana Bondar;Rutger Dekker;Saoirse Byrne;Tadeusz Wilk;Yolanda Cruz;Zainab Qureshi;Dmitri Orlov;Elodie Marchand;Fiona Gallagher;Anders Holm".split(";")
CONTEXTS = ("Dear {0},\nthe parcel came.", "Regards,\n{0}\n", "Yesterday {0} wrote to us.", "We met {0} in town.", "Mrs. {0} was there.", "Signed by {0}.")


def test_names_that_no_list_holds_are_found_by_context():
    assert not any(personal_data.LIST_ONLY.given(n.split()[0]) for n in HELD_OUT)
    found = [n for c in CONTEXTS for n in HELD_OUT if ("NAME", n) in kinds(c.format(n))]
    assert len(found) >= 0.95 * len(HELD_OUT) * len(CONTEXTS)
    assert kinds("We asked Kastor Traders. Consulting Engineers says so. \nDear Team,\nDear Customer,") == []


def test_names_are_learned_from_the_mails(spark):
    m = spark.createDataFrame([("1", "Then Beatrix Oldenburg came, and Beatrix left.", "a@x.example", "Beatrix Oldenburg <b@x.example>, Kastor Traders <k@x.example>"), ("2", "Nothing.", '"Beatrix Amsel" <c@x.example>', "Kastor Finance <f@x.example>")], "id string, body string, sender string, recipients string")
    t = spark.createDataFrame([], "content_id string, chunk_index int, text string")
    assert {r.pii_value for r in personal_data.found(m, t).filter("field = 'body'").collect()} == {"Beatrix Oldenburg", "Beatrix"}
    pieces = {(r.field, r.pii_value): r.pseudonym for r in personal_data.replaced(m, t, b"k").collect()}
    text = {(r.record_id, r.field): r.text for r in personal_data.redacted(m, t, b"k").collect()}
    assert text["1", "body"] == f"Then [NAME:{pieces['body', 'Beatrix Oldenburg']}] came, and [NAME:{pieces['body', 'Beatrix']}] left."
    # Without a key every run has its own.
    one, two = (personal_data.redacted(m, t).filter("record_id = '1' and field = 'body'").first().text for _ in range(2))
    assert one != two


def test_personal_data_tables(spark):
    m = spark.createDataFrame([("1", "Dear Anika,", "b@x.example", "<a@x.example>"), ("1", "Dear Anika,", "b@x.example", "<a@x.example>"), ("2", None, None, None)], "id string, body string, sender string, recipients string")
    t = spark.createDataFrame([("c", 0, "Dr. Sharma"), ("c", None, "")], "content_id string, chunk_index int, text string")
    assert {tuple(r) for r in personal_data.found(m, t).collect()} == {("messages", "1", "body", "NAME", "Anika"), ("messages", "1", "recipients", "EMAIL", "a@x.example"), ("attachment_texts", "c:0", "text", "NAME", "Sharma")}
    assert personal_data.found(m.filter("false"), t.filter("false")).count() == 0


# Leaks -----------------------------------------------------------------------

ITEM = "Given 41 doses of sarum, the jar sealed mossy hemen until the warden balanced 29 more. Near linet the drawer weighed a uneven orchard."


def brute_leaks(docs, items):
    words = lambda t: eval_leaks.WORD.findall((t or "").lower())
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t)) - 11) for i in grams.get(tuple(words(t)[k : k + 12]), ())}


def test_leaks(spark):
    other = ITEM.replace("41", "17").replace("29", "8")
    docs = [(1, "Intro. " + ITEM.upper().replace(" ", "\n") + " tail"), (2, other), (3, ITEM[:40]), (4, None), (5, ""), (6, "the " * 50), (7, ITEM.replace("29", "41"))]
    items = [(10, ITEM), (11, ITEM), (12, "too short"), (13, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in eval_leaks.found(d, i).collect()} == brute_leaks(docs, items)
    kinds = {(r.doc_id, r.kind) for r in eval_leaks.leaks(d, i).filter("item_id = 10").collect()}
    assert (2, "reparameterised") in kinds and (1, "verbatim") in kinds
    assert eval_leaks.slot_kind(["a", "1", "1"], ["a", "2", "3"]) is None
    assert eval_leaks.found(d.filter("false"), i).count() == 0 and eval_leaks.found(d, i.filter("false")).count() == 0


def test_a_full_vocabulary_loses_no_leak(spark, monkeypatch):
    filler = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(3000))
    docs = [(1, filler[:200] + " " + ITEM), (2, "12 13 " * 40), (3, ITEM.replace("41", "17"))]
    items = [(10, ITEM), (11, filler), (12, "12 13 " * 30), (13, "14 15 " * 30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert {tuple(r) for r in eval_leaks.found(d, i).collect()} == want
    kinds = {tuple(r) for r in eval_leaks.leaks(d, i).select("doc_id", "item_id", "kind").collect()}
    assert (3, 10, "reparameterised") in kinds and not any(doc == 2 and item == 13 for doc, item, _ in kinds)
    monkeypatch.setattr(bit_sets, "bits_for", lambda n, most=None: 1 << 10)
    assert {tuple(r) for r in eval_leaks.found(d, i).collect()} == want


# Mixing ----------------------------------------------------------------------


def test_rates():
    for most in (1, 3, 6):
        for mean in (0.1, 0.5, 0.9 * most):
            assert mixing.cut_mean(mixing.solve_rate(mean, most), most) == pytest.approx(mean)
    assert mixing.thresholds(mixing.solve_rate(2, 2), 2) == [0.0, 0.0]


def test_mix(spark):
    docs = [(i, "alpha beta gamma delta " * (1 + i % 3), "Mail" if i % 4 else " mail ") for i in range(3000)] + [(10_000 + i, "one two three", "lab-report") for i in range(200)] + [(20_000, "x", None), (20_001, "", "mail"), (20_002, None, "mail"), (20_003, "y", "blog")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n", F.lit("clash"))
    t = spark.createDataFrame([("mail", 0.9, 1), ("lab_report", 0.1, 5), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t)
    rep = {r.source: r for r in m.report().collect()}
    assert abs(rep["lab_report"].actual_share - 0.1) < 0.02 and abs(rep["mail"].actual_share - 0.9) < 0.02
    assert rep["mail"].largest_repeat == 1 and rep["lab_report"].largest_repeat <= 5 and rep[None].mixed_tokens == 0 and rep["blog"].mixed_tokens == 0
    out = m.mixed()
    assert {tuple(r) for r in out.select("doc_id", "copy").collect()} == {tuple(r) for r in mixing.Mix(d, t).mixed().select("doc_id", "copy").collect()}
    assert out.filter("doc_id >= 20000").count() == 0
    assert mixing.Mix(d.filter("false"), t).mixed().count() == 0


def test_reached_shares_of_documents_of_unlike_sizes(spark):
    import random

    rng = random.Random(3)
    docs = [(i, "word " * int(3 * 1.02 ** rng.randrange(0, 300)), f"s{i % 5}") for i in range(1500)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("s0", 0.1, 2), ("s1", 0.15, 2), ("s2", 0.2, 3), ("s3", 0.25, 3), ("s4", 0.3, 4)], "source string, target_share double, max_repeats int")
    rep = mixing.Mix(d, t).report().collect()
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in rep), rep
    assert all(r.largest_repeat <= r.max_repeats for r in rep)


# Garbled text ----------------------------------------------------------------

CLEAN = "Überprüfung für 20 € – “schöne” Grüße, São 34 páginas, crème brûlée"


@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp850", "cp1251"])
def test_round_trip(page):
    raw = CLEAN.encode("utf-8")
    table = garbled_text.char_of_byte(page)
    seen = "".join(chr(b) if b < 128 else table[b] for b in raw)
    kind, restored, complete = garbled_text.repair("Hello. " + seen)
    assert (kind, restored, complete) == ("utf8", "Hello. " + CLEAN, True)


def test_garbled_kinds():
    twice = "didn’t".encode().decode("cp1252").encode("utf-8").decode("cp1252")
    assert garbled_text.repair(twice)[1] == "didn’t"
    assert garbled_text.repair("O relat≤rio mΘdico estß")[1] == "O relatório médico está"
    assert garbled_text.repair("It is \x93final\x94")[:2] == ("controls", "It is “final”")
    assert garbled_text.repair("Ger�t") == ("lost", None, False)
    for t in ("ATENÇÃO: A CONSULTA NÃO SERÁ NO DIA", "├── scans\n│   ├── a.pdf\n└── b", "╔══╗ TOTAL ╚══╝", "Ответ пришёл, спасибо за счёт", "Ödeme yapıldı, teşekkürler", "plain", "", None, "नमस्ते 5 °C ½ page"):
        assert garbled_text.repair(t) is None


def test_garbled_tables(spark):
    df = spark.createDataFrame([(1, "KÃ¼che"), (2, "Küche"), (3, None), (4, "")], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    assert [r.doc_id for r in garbled_text.found(df).collect()] == [1]
    assert garbled_text.found(df.filter("false")).count() == 0




def test_irregular_words_are_reported_also_if_not_restored():
    bad = "Die Prüfung der Gebühren läuft".encode("cp1252").decode("mac_roman")
    assert garbled_text.repair(bad + ".") == ("page", "Die Prüfung der Gebühren läuft.", True)
    assert garbled_text.repair(bad + " für ₹5 अ.") == ("page", None, False)
    assert garbled_text.repair("Die Prüfung der Gebühren für ₹5 अ läuft.") is None
