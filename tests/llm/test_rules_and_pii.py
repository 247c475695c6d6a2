"""op1 and op3 against plain Python, and their edge cases."""

import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm import pii
from fabula.llm import quality_rules as Q
from fabula.llm.textbatch import TextBatch, take

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c|#\xa0", max_size=80)), min_size=1, max_size=6))
def test_base_statistics(texts):
    got = Q.base_statistics(TextBatch.of(texts))
    for i, t in enumerate(texts):
        assert {k: v[i] for k, v in got.items()} == base(t)


def test_repeated_windows():
    words = [f"w{i}" for i in range(40)]
    for text in (" ".join(words + words[:8]), " ".join(words + words[:7]), "x " * 30, " ".join(words[:8] * 3)):
        assert Q.base_statistics(TextBatch.of(["", text, "y"]))["n_repeat_words"].tolist() == [0, base(text)["n_repeat_words"], 0]


def test_order_doesnt_change_verdicts():
    clean = " ".join(f"word{i}" for i in range(60))
    texts = [clean, clean.upper(), "word " * 60, " ".join(f"w{i}***" for i in range(60)), "", clean + "\n" + "same line\n" * 200]
    b = TextBatch.of(texts)
    want = [True] + [False] * 5
    one = Q.verdicts(b, Q.RULES, Q.base_statistics(b)["n_words"] > 0)
    assert one.tolist() == want and Q.verdicts(b, Q.RULES[::-1], Q.base_statistics(b)["n_words"] > 0).tolist() == want
    assert take(b, [1, 3]).n_words.tolist() == [60, 60]


def test_quality_rules_query(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "x"), (1, clean, "x"), (2, None, "x"), (3, "", "x"), (4, "a " * 5000, "x"), (None, clean, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Q.quality_rules(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].kept and by[None].kept and not by[2].kept and not by[3].kept and not by[4].kept
    assert by[4].n_words == 5000 and by[2].base_failed
    assert Q.quality_rules(df.limit(0)).count() == 0
    measured = Q.calibrate(df)
    assert {m.name for m in measured} == {r.name for r in Q.RULES} and measured == sorted(measured, key=lambda m: (-m.worth, m.name))


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    found = [(m.start(), i, pii.Span(k, m.start(), m.end())) for i, (k, (p, ok)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [s for *_, s in sorted(found)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1290.@+- ()é:/\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert [s for s in pii.spans(text) if s.kind in pii.BASE_KINDS] == base_spans(text)


def test_cards_and_phones():
    for text in ("4716 3376-7199 88201 4944339490429605", "x" * 9 + "+1 (988) 555-2485.", "1.2.3.4.5.6.7.8.256.1.1.1", "a@b.c@d.e a.b@c-d.e.f", "+1+22 333 444 55 66"):
        assert [s for s in pii.spans(text) if s.kind in pii.BASE_KINDS] == base_spans(text)


def test_added_kinds():
    text = "see https://ann:pw@host.example/x and https://host.example/users/ann, https://host.example/page. password=b7db7aa4a5 IBAN DE89 3704 0044 0532 0130 00 account no. 12345678 accountant 1234567890"
    got = [(s.kind, text[s.start : s.end]) for s in pii.spans(text) if s.kind not in pii.BASE_KINDS]
    assert got == [("url", "https://ann:pw@host.example/x"), ("url", "https://host.example/users/ann"), ("secret", "b7db7aa4a5"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert pii.mask("hi a@b.cd!", pii.spans("hi a@b.cd!")) == "hi <email>!"


def test_pii_query(spark):
    rows = [(1, "a@b.cd é 42.144.35.254"), (2, None), (3, ""), (1, "a@b.cd é 42.144.35.254"), (4, "+" * 20000 + "1 (988) 555-2485")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as kind")
    got = sorted(pii.digest(pii.find_pii(df)).collect())
    assert len(got) == 5
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        spans = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.kind == k for s in spans) for k in pii.BASE_KINDS)
        assert r.spans == pii.joined(pii.spans(text))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.kind == k for s in pii.spans(text)) for k in pii.KINDS] and r.n_spans == len(pii.spans(text))
    assert pii.find_pii(df.limit(0)).count() == 0
