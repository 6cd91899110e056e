"""Personal data: plain spans against the patterns as they are written, disguised ones against where they were put."""
import hashlib
import random
import re
import time

import pytest

from navlens.llm import pii as P, queries
from navlens.llm.common import table

rnd = random.Random(5)
LITERAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def literal_spans(text):
    out = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(LITERAL[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_plain_spans_are_those_of_the_patterns():
    for _ in range(20_000):
        text = "".join(rnd.choices("a@.1+- ()%é\n", [3, 3, 4, 6, 1, 1, 1, .5, .5, .5, .3, .3], k=rnd.randint(0, 40)))
        assert [tuple(s) for s in P.plain_spans(text)] == literal_spans(text)
    for n in range(11, 21):
        for _ in range(60):
            text = "x " + "".join(rnd.choice("0123456789") + rnd.choice(["", "", " ", "-"]) for _ in range(n)) + "."
            assert [tuple(s) for s in P.plain_spans(text)] == literal_spans(text)


def test_layers_lead_back():
    for _ in range(2000):
        text = "".join(rnd.choices("abcdef", k=rnd.randint(1, 30)))
        edits, at, parts = [], 0, []  # parts: (piece of the new text, its span in the old one)
        while at < len(text):
            end = min(len(text), at + rnd.randint(1, 3))
            if rnd.random() < .5:
                put = "X" * rnd.randint(0, 3)
                edits.append((at, end, put))
                parts += [(c, at, end) for c in put]
            else:
                parts += [(text[i], i, i + 1) for i in range(at, end)]
            at = end
        layer = P.Layer(text, edits)
        assert layer.text == "".join(c for c, _, _ in parts)
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                assert layer.back(i, j) == (parts[i][1], parts[j - 1][2])


def wide(s):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)


SPELL = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
DISGUISED = [
    ("email", "john.smith (at) example [dot] com"), ("email", "anna at mail7 dot example dot org"),
    ("email", "john dot smith at example dot com"), ("email", "thinb.27 at mail6.example.com"),
    ("email", "mia{at}web{dot}de"), ("email", "ana arroba correo punto es"), ("email", "max @ example.com"),
    ("email", "karl-at-example-dot-net"), ("email", "jоhn@exаmple.com"), ("email", wide("john@example.com")),
    ("email", "jo​hn@exam­ple.com"), ("ip", "10 dot zero dot zero dot one"), ("ip", "192[.]168[.]1[.]7"),
    ("ip", wide("192.168.0.1")), ("ip", "one nine two dot one six eight dot one dot seven"),
    ("card", " ".join(SPELL[c] for c in "4952935900253052")), ("card", wide("4417744280351547")),
    ("card", "4952 9359 OO25 3052"), ("card", "4952 9359 0025 3052"),
    ("phone", "plus " + " ".join(SPELL[c] for c in "14155551234")), ("phone", "+1 (O17) 555–7713"),
    ("phone", "plus 1 415 555 1234")]


@pytest.mark.parametrize("kind,said", DISGUISED)
def test_disguised_spans_are_found_where_they_stand(kind, said):
    for lead in ("", "Wörter davor: ", "\U0001F600 mail "):
        for tail in ("", ", und so weiter.", "\nmore words"):
            base, spans = P.all_spans(lead + said + tail)
            assert (kind, len(lead), len(lead) + len(said)) in [tuple(s) for s in spans]
            assert set(base) <= set(spans)


def test_clean_texts_are_left_alone():
    for text in ["meet me at example.com at noon", "stared at the dot com bubble", "one two three go", "see figure 3 plus 4",
                 "in 10 dot 5 years", "Привет, как дела? Ответ: 42.", "version 1.2.3 at 12:30", "(at) the [dot] end"]:
        assert P.all_spans(text) == ([], [])


def test_long_texts_take_time_in_proportion():
    for piece in ["a", "1", "1 ", "a at ", "a dot ", " ", "+1", "a.b-", "one ", "a (at) ", "@", "1.1.", "a-at-", "O1"]:
        start = time.perf_counter()
        P.all_spans(piece * (100_000 // len(piece)))
        assert time.perf_counter() - start < 5, piece


def test_query_counts(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = queries.op12_pii(spark, sf).collect()
    assert len(got) == len(texts) and any(r.n_email for r in got) and any(r.n_card for r in got)
    for r in got:
        want = literal_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in P.KINDS]
        joined = ",".join("%s:%d:%d" % s for s in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.n_added or r.spans == joined
