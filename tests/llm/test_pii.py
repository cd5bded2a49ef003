import re

import pytest

from markloom.llm.pii import KINDS, all_spans, look_alikes, personal_data, plain_spans, signs, spelled_digits
from tests.llm.conftest import CLASHING, odd_rows


def brute(text):
    """Base rules, scanned by hand."""
    out = []
    for number, (kind, head, rule) in enumerate([
        ("email", "[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", "[0-9]", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        ("card", "[0-9]", r"[0-9](?:[ -]?[0-9])+"), ("phone", r"\+", r"\+[0-9][ ().0-9-]+[0-9]"),
    ]):
        at = 0
        while at < len(text):
            m = re.match(rule, text[at : at + 5000]) if re.match(head, text[at]) else None
            if not m:
                at += 1
                continue
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1])) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((number, at, at + m.end()))
            at += m.end()
    return out


def test_whole_table(docs_of, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 20_000] + [r for r in odd_rows() if r[0] not in (6, 7)]
    rows += [(900, "é🙂 a.b@c-d.co.uk x@y 1.2.3.256 1.2.3.4.5 4111 1111 1111 1111 4111-1111-1111-1112 +1 (212) 555-0100 +12 a@b.c@d.e +1234567890123456")]
    found = {}
    for r in personal_data(docs_of(rows, **CLASHING)).collect():
        found.setdefault(str(r.doc_id), []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base))
    for doc_id, text in {str(r[0]): r[1] for r in rows if r[0] is not None and r[0] > 9}.items():
        spans = brute(text or "")
        want = (*(sum(s[0] == k for s in spans) for k in range(4)), ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
        assert found[doc_id] == [want]
    assert sum(map(len, found.values())) == len(rows)


@pytest.mark.parametrize(("text", "kind", "shown"), [
    ("write to john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
    ("mail jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
    ("pay 4111 1111 one one one one 1111 soon", "card", "4111 1111 one one one one 1111"),
    ("call +one two one two five five five zero one zero zero ok", "phone", "+one two one two five five five zero one zero zero"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("ｊｏｅ＠ｍａｉｌ．ｃｏｍ", "email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ"), ("a​b@c​d.ef", "email", "a​b@c​d.ef"),
    ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
])
def test_disguises(text, kind, shown):
    for before in ("", "é🙂 "):
        base, spans = all_spans(before + text)
        assert (KINDS.index(kind), shown) in [(k, (before + text)[a:b]) for k, a, b in spans] and set(base) <= set(spans)


@pytest.mark.parametrize(("shown", "kind"), [
    ("jane@example dot com", "email"), ("jane [at] example dot com", "email"), ("jane at example[dot]com", "email"), ("jane at mail.example dot com", "email"),
    ("jane@mail[.]example dot com", "email"), ("192 dot 168 dot 0 dot 1", "ip"), ("192 dot 168[.]0.1", "ip"),
    ("plus one five five five one two three four", "phone"), ("Plus four nine 1 five five one two three", "phone"),
])
def test_mixed_disguises(shown, kind):
    for before in ("", "é🙂 or "):
        text = f"{before}{shown}, ok"
        assert [(KINDS[k], text[a:b]) for k, a, b in all_spans(text)[1]] == [(kind, shown)]


@pytest.mark.parametrize(("text", "kind", "stump"), [("+1 555 1234 five six", "phone", "+1 555 1234"), ("a@mail.example(dot)com", "email", "a@mail.example")])
def test_longer_disguised_span_joins_its_plain_part(text, kind, stump):
    base, spans = all_spans(text)
    assert [text[a:b] for _, a, b in base] == [stump] and {(KINDS[k], text[a:b]) for k, a, b in spans} == {(kind, stump), (kind, text)}


def test_at_before_a_plain_host_is_no_address():
    for text in ("look at example.com and the (at) sign", "3 dot 14 is near pi", "one plus one two three four"):
        assert all_spans(text) == ([], [])


def test_clean_text_stays_clean():
    for text in ("we met at noon on the dot and left", "one two three", "the Москва дом и сад", "look at this dot", "no one at home"):
        assert all_spans(text) == ([], [])


def test_offsets_stay_in_order():
    text = "аб one two three four five at home dot net (at) х"
    piece = (text, list(range(len(text))), list(range(1, len(text) + 1)))
    for f in (look_alikes, spelled_digits, signs):
        piece = f(piece)
        assert len(piece[0]) == len(piece[1]) == len(piece[2]) and piece[1] == sorted(piece[1]) and all(a < b for a, b in zip(piece[1], piece[2], strict=True))
    assert plain_spans("") == []


def test_empty_table(docs_of):
    assert personal_data(docs_of([])).collect() == []
