import hashlib
import itertools
import random
import re

from hypothesis import given, settings, strategies as st

from lendlane.llm import pii
from tests.conftest import as_dicts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@+-0123456789 ()_%é\n٣", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_near_misses():
    dice = random.Random(1)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (702) 555-4777", "+49", " ", ".", "-", "7"]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(1, 7)))
        assert pii.base_spans(text) == plain(text)


def field():
    dice, rows = random.Random(2), []
    for i in range(500):
        n = "".join(str(dice.randrange(10)) for _ in range(10))
        card = next(c for c in (f"4{n}{k:05d}" for k in range(10)) if pii.luhn(c))
        entity = (f"ab{i}.c@mail{i % 9}.example.com", f"{i % 200 + 20}.1{i % 90}.7.{i % 250}", card, f"+1 ({n[:3]}) 555-{n[:4]}")[i % 4]
        rows += pii.examples(f"the rest anonly was {entity} thing of there, and so on", seed=i)
        rows += pii.examples(f"General Public License, version {i % 9}.{i % 7}. and token = \"{i:05d}ab{n}c\" more", seed=i)
    return pii.train(rows)


def test_field_adds_hidden_forms_and_leaves_others():
    own = field()
    for text, kind in (("write to jo.doe (at) example.org soon", "email"), ("call (702) 555-4777 now", "phone"),
                       ("ann.88 [at] mail3.example [dot] com", "email"), ("paid 4111/1111/1111/1111 for it", "card")):
        base, added = pii.all_spans(text, own)
        assert not base and [s[2] for s in added] == [kind], (text, added)
    for text in ("Apache License, Version 2.0.", "in 1999 and 2004 there", "at 10 of 12", "section 3.1.2"):
        assert pii.all_spans(text, own) == ([], [])


def test_every_hidden_form_is_looked_for(frame):
    own = field()
    for hidden in ("jo.doe (at) example.org", "jo.doe [at] example [dot] org", "jo.doe at example dot org", "jo.doe ( at ) example.org", "jo.doe (At) example.org",
                   "jo.doe [ AT ] example ( dot ) org", "jo.doe At mail.example Dot org", "jo.doe at departmentofphysicalchemistryandmaterials dot universityofsomewhere dot org"):
        text = f"write to {hidden} soon"
        assert pii.all_spans(text, own) == ([], [(9, 9 + len(hidden), "email")]), hidden
        assert as_dicts(pii.redacted(frame("doc_id long, text string", (1, text)), own))[0]["text"] == "write to <email> soon"
    for text in ("we met at noon. then left", "look at that", "at home"):
        assert pii.all_spans(text, own) == ([], [])


def test_entities_anywhere_in_long_dense_text():
    own = field()
    for hidden, kind in (("jo.doe (at) example.org", "email"), ("(702) 555-4777", "phone")):
        for before in (150, 196, 198, 199):
            for turns in (1, 2):
                lead, rest = "7 n " * before * turns, " n 7" * 60
                assert pii.all_spans(lead + hidden + rest, own) == ([], [(len(lead), len(lead) + len(hidden), kind)]), (hidden, before, turns)


def test_best_segmentation_is_the_highest():
    own = field()
    text = "mail a1 (at) b.com or 702-555-4777 x"
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    scored = [(i, j, max(own.score(k, f) for k in pii._possible(f)) - 1) for i, j, f in own.candidates(text, tokens) if pii._possible(f)]
    scored = [s for s in scored if s[2] > 0]
    best = 0.0
    for n in range(4):
        for chosen in itertools.combinations(scored, n):
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(chosen, 2)):
                best = max(best, sum(s[2] for s in chosen))
    got = sum(own.score(k, f) - 1 for _, _, k, f in own.best(text, tokens, 1.0))
    assert abs(got - best) < 1e-9


def test_operator(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, given_texts = as_dicts(pii.find_personal_data(docs, pii.fit(docs)), "doc_id"), {r["doc_id"]: r["text"] for r in as_dicts(docs)}
    assert rows.keys() == given_texts.keys()
    for i, r in rows.items():
        want = plain(given_texts[i] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in want) for k in PATTERNS]
        assert set(pii.joined(want).split(",")) - {""} <= set(r["spans"].split(","))
    assert sum(r["n_added"] for r in rows.values()) < 0.02 * len(rows)
    odd = frame("doc_id long, text string, spans int", (1, None, 1), (None, "a@b.cc", 2), (1, "", 3), (2, "7" * 200000 + "@" * 3000, 4))
    assert len(as_dicts(pii.find_personal_data(odd, pii.Field({})))) == 4
    clean = as_dicts(pii.redacted(odd, pii.Field({})))
    assert [r["text"] for r in clean][:3] == [None, "<email>", ""]
    assert pii.find_personal_data(odd.limit(0), pii.fit(odd.limit(0))).count() == 0
