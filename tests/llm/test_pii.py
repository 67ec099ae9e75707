import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visitlens.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def base(text):
    out = []
    for no, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def check(rows, got):
    for r in got:
        texts = {t for k, t in rows if k == r.doc_id}
        answers = {}
        for t in texts:
            spans = base(t)
            joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
            answers[hashlib.sha256(joined.encode()).hexdigest()] = spans
        assert r.base_sha256 in answers
        spans = answers[r.base_sha256]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[3] for x in spans) for k in RULES]
        assert {f"{k}:{s}:{e}" for s, _, e, k in spans} <= set(r.spans.split(",")) | {""}


CASES = [
    "mail a.b@c.de, x@y and z@q.r.s; a@b.c_d@e.f",
    "1.2.3.4 256.1.1.1 1.2.3 001.02.3.4 1.2.3.4.5 9.9.9.300",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4 1 1 1",
    "+1 (619) 555-0053, +12 34, +1-2-3-4-5-6-7-8-9-0 tail +",
    "\U0001f600 é +49 30 1234567 \U0001f600 me@host.org",
    "5" * 3000,
    "a" * 3000 + "@" + "b." * 500,
    "1 " * 2000,
    "",
    None,
    "@@@ ++ 1..2 a@b..c a@.b",
]


def test_base_spans(docs_of):
    rows = list(enumerate(CASES))
    check(rows, pii.personal_data(docs_of(rows)).collect())


def test_random_texts(docs_of):
    found = []

    @settings(max_examples=400, deadline=None, derandomize=True)
    @given(st.text("a1 2.@+-()3_%é", max_size=60))
    def collect(text):
        found.append(text)

    collect()
    rows = list(enumerate(found))
    check(rows, pii.personal_data(docs_of(rows)).collect())


def test_small_table_and_odd_rows(docs_of, sf_docs, odd_rows):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    check(rows, pii.personal_data(sf_docs).collect())
    got = pii.personal_data(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    check([r[:2] for r in odd_rows], got)


@pytest.fixture(scope="module")
def taught():
    """Contexts that mostly hold addresses, then an address of another form after one of them."""
    rows = [(i, f"note {i} please write to user{i}@host{i}.org today") for i in range(12)]
    rows += [(100, "note please write to user77.at.host77 today"), (101, "page 77 of chapter9 is user78.at.host78 here")]
    return rows


def test_contexts_find_unseen_identifiers(docs_of, taught):
    got = {r.doc_id: r for r in pii.personal_data(docs_of(taught)).collect()}
    text = dict(taught)[100]
    start = text.index("user77")
    assert got[100].spans == f"context:{start}:{start + len('user77.at.host77')}" and got[100].n_found == 1
    assert got[101].spans == ""


def test_trusted_patterns_need_support(docs_of):
    rows = [(1, "contact: a1@b.org"), (2, "contact: x9z")]
    assert {r.n_found for r in pii.personal_data(docs_of(rows)).collect()} == {0}


def planted(n=60, seed=3):
    """Identifiers of each kind in a form that no base pattern takes, in contexts that base ones teach, and traps."""
    import random

    rng = random.Random(seed)
    filler = lambda k: " ".join(rng.choice(["stone", "river", "of", "the", "to", "green", "reach", "at", "call", "line 4", "v2"]) for _ in range(k))
    known = {
        "email": lambda i: f"user{i}@host{i}.org",
        "ip": lambda i: f"10.{i % 250}.{i // 250}.7",
        "phone": lambda i: f"+1 619 555 {1000 + i}",
    }
    hidden = {
        "email": lambda i: f"user{i}.at.host{i}",
        "ip": lambda i: f"10-{i % 250}-7-9",
        "phone": lambda i: f"619.555.{1000 + i}",
    }
    frames = {"email": "{f} my mailbox is {v} thanks {g}", "ip": "{f}\nclient={v}\n{g}", "phone": "{f}\n{v} rings here {g}"}
    rows, want = [], {}
    for kind, frame in frames.items():
        for i in range(n):
            rows.append((len(rows), frame.format(f=filler(8), v=known[kind](i), g=filler(8))))
        for i in range(n // 4):
            v = hidden[kind](i)
            text = frame.format(f=filler(8), v=v, g=filler(8))
            want[len(rows)] = f"{kind}:{text.index(v)}:{text.index(v) + len(v)}"
            rows.append((len(rows), text))
    # Words that stand before many plain words as well earn no trust, however often a seed follows them.
    rows += [(len(rows) + i, f"{filler(5)} beside user{i}@host{i}.org {filler(5)}") for i in range(n)]
    rows += [(len(rows) + i, f"{filler(5)} beside {chr(97 + i // 26)}{chr(97 + i % 26)}word {filler(5)}") for i in range(n)]
    rows += [(len(rows) + i, f"{filler(5)} beside part{i} {filler(5)}") for i in range(n // 4)]
    return rows, want


def test_recall_and_precision_of_each_kind(docs_of):
    rows, want = planted()
    got = {r.doc_id: r.found.split(",") for r in pii.personal_data(docs_of(rows)).collect() if r.found}
    for kind in ("email", "ip", "phone"):
        wanted = {(k, w) for k, w in want.items() if w.startswith(kind)}
        found = {(k, f) for k, fs in got.items() for f in fs if f.startswith(kind)}
        assert len(wanted & found) >= 0.9 * len(wanted), (kind, wanted - found)
        assert len(wanted & found) >= 0.9 * len(found), (kind, found - wanted)


def test_plain_words_take_trust_away(docs_of):
    rows = [(i, f"note from user{i}@host{i}.org today") for i in range(15)] + [(50, "note from x9z today")]
    assert [r.n_found for r in pii.personal_data(docs_of(rows)).collect() if r.doc_id == 50] == [1]
    rows += [(100 + i, f"note from {w} today") for i, w in enumerate("anna berta clara dora emil fritz gustav hans ida".split())]
    assert [r.n_found for r in pii.personal_data(docs_of(rows)).collect() if r.doc_id == 50] == [0]


def test_only_built_in_functions(sf_docs):
    plan = pii.personal_data(sf_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(docs_of):
    assert pii.personal_data(docs_of([])).count() == 0


def test_many_matches_in_one_text(docs_of):
    """Places, overlaps and time where a text has more matches than a block."""
    rows = [(1, " ".join(f"a{i}@b.cd x{i} 10.0.{i % 256}.{i % 300}" for i in range(3000))), (2, " ".join(f"n{i}" for i in range(100_000)))]
    got = pii.personal_data(docs_of(rows)).collect()
    check(rows, got)
    assert {r.doc_id: r.n_email for r in got} == {1: 3000, 2: 0}


def test_candidates_that_meet_base_spans_are_left_out(spark):
    import random

    rng = random.Random(2)
    for _ in range(20):
        some, at = [], 0
        for _ in range(rng.randint(1, 400)):
            at += rng.randint(1, 9)
            some.append((at, at := at + rng.randint(1, 6)))
        others = [(b, b + rng.randint(1, 40)) for b in (rng.randrange(at) for _ in range(rng.randint(1, 300)))]
        kind = "array<struct<start:int,end:int>>"
        df = spark.createDataFrame([(some, others)], f"a {kind}, b {kind}")
        got = df.select(pii.unmet(pii.F.col("a"), pii.F.col("b")).alias("x")).first().x
        assert [tuple(x) for x in got] == [s for s in some if not any(s[0] < o[1] and o[0] < s[1] for o in others)]


@pytest.mark.parametrize("first_look", [1, 3, 1 << 40])
def test_plain_words_refute_before_all_texts_are_read(spark, docs_of, monkeypatch, first_look):
    """What is left is the same however much the first look sees, and its words are counted in all texts."""
    monkeypatch.setattr(pii, "FIRST_LOOK", first_look)
    word = lambda i: "w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    rows = [(i, f"so the {word(i)} and mail {word(i % 2)} end", "en", "a", 0) for i in range(60)]
    proposed = pii.stage(spark.createDataFrame([("the", 20), ("mail", 20), ("card", 10)], "pattern string, instances long"), "proposed")
    got = {r.pattern: r.plain for r in pii.plain_counts(docs_of(rows), proposed).collect()}
    assert got == {"mail": 2, "card": None}
