import re
import time

from cardprism.llm import pii

FIND = pii.Deobfuscator()


def spans(text):
    base, every = pii.find_spans(text, FIND)
    return pii.joined(base), pii.joined(every)


def naive(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


BASE = [
    "a@b.c@d.e x@@y.z a.b+c@x-1.y.co. @a.b q@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "+49 (0)30.123-4567 +1 +12345678 +1234567890123456 ++1 499 555 6503 +1((((", "5500005555555559 and +4111111111111111", "", "é@é.é ü1.2.3.4ü",
    "12345678901234567890123 " * 3, "0000000000000000", "a@b.c" * 10, "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5",
]


def test_base_against_the_plain_patterns():
    for t in BASE:
        assert pii.detect(t) == naive(t), t


def test_disguises_map_back_to_the_source():
    cases = {
        "mail john (at) example [dot] org!": "email:5:32",
        "mail bob at mail dot example dot com now": "email:5:36",
        "jоhn@exаmple.com": "email:0:16",
        "４１１１ １１１１ １１１１ １１１１": "card:0:19",
        "call plus four nine one five one two three four five six seven": "phone:5:62",
        "ip one nine two dot one six eight dot zero dot one": "ip:3:50",
        "tel ＋49 30 1234567": "phone:4:18",
        "10․0․0․1": "ip:0:8",
        "mail a\u200bb@ex.org": "email:5:15",
    }
    for text, want in cases.items():
        assert want in spans(text)[1].split(","), (text, spans(text))


def test_base_spans_stay_and_plain_prose_adds_none():
    for t in [*BASE, "look at the dot on the i. dot com at home", "un un un un un un un un", "he was at home dot"]:
        base, every = pii.find_spans(t, FIND)
        assert set(base) <= set(every)
    assert spans("she sat at the table. dot")[1] == "" and spans("un deux trois quatre cinq six sept huit")[1] == ""


def test_very_long_texts_stay_linear():
    began = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 150_000, "@" * 100_000, "a@" * 100_000, "1." * 150_000, " at x dot y" * 20_000, "one " * 50_000):
        pii.find_spans(t, FIND)
    assert time.time() - began < 30


def test_operator(docs):
    rows = [(1, "a@b.c 1.2.3.4"), (1, "a@b.c 1.2.3.4"), (2, None), (None, ""), (3, "x")]
    got = pii.detect_pii(docs(rows, extra=True)).collect()
    assert sorted((r.doc_id or 0, len(r.base), len(r.spans)) for r in got) == [(0, 0, 0), (1, 2, 2), (1, 2, 2), (2, 0, 0), (3, 0, 0)]
    assert tuple(next(r for r in got if r.doc_id == 1).spans[1]) == (6, 13, "ip")
    assert pii.detect_pii(docs(rows).where("false")).count() == 0


def test_every_bracketed_dot_opens_the_gate():
    for word in ("dot", "punkt", "point", "punto", "Dot", "PUNKT"):
        for a, b in ("[]", "()", "{}", "<>"):
            for blank in ("", " ", "\n"):
                text = f"jane@host{blank}{a}{blank}{word}{blank}{b}{blank}fr"
                assert spans(text)[1] == f"email:0:{len(text)}", text
    for at in ("(at)", "{ AT }", "<at>", "[ at\n]"):
        text = f"jane{at}host.de"
        assert spans(text)[1] == f"email:0:{len(text)}", text
    assert spans("jane\tat\thost\ndot\nde")[1] == "email:0:19"
    assert pii._AT_DOT_HINT.search("a\ndot\nb") and not pii._AT_DOT_HINT.search("the data, (patterned) dots")


def test_spelled_addresses_of_few_digits():
    for text in ("eight dot eight dot eight dot eight", "one two seven dot zero dot zero dot one", "eight dot 8 dot eight dot 8",
                 "one zero dot one dot two dot three", "eins dot zwei dot drei dot vier", "one two seven.zero.zero.one"):
        assert spans(f"ip {text}, so")[1] == f"ip:3:{3 + len(text)}", text
    for text in ("one dot two dot three", "nine nine nine dot one dot one dot one", "one. two. three. four", "one two three four"):
        assert spans(text)[1] == "", text
