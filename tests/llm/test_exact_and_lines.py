import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cardprism.llm import exact_dedup, line_dedup

WHITE = " \t\n\x0b\x0c\r"


def plain(text):
    return (text or "").translate({ord(c): None for c in WHITE})


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    out = Counter()
    for norm, members in groups.items():
        keep = min(members)[2]
        for n, _, i in members:
            out[i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


TEXTS = [
    "a b", "ab", " a\tb\r", "", None, " \n", "x" * 5000, "x" * 5000 + " ", "x" * 5001, "é" * 9000, "é" * 8999 + "e", " ", "ab",
    "x" * 4096 + "y" * 4096, "y" * 4096 + "x" * 4096, "x" * 4096, "long " * 30000, "long" * 30000, "👍" * 4097, "👍" * 4096 + "x",
]


def test_copies_against_brute_force(docs):
    for block in (4096, 7):
        rows = list(enumerate(TEXTS if block > 7 else [t and t[:200] for t in TEXTS]))
        got = exact_dedup.find_copies(docs(rows, extra=True), block=block).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_copies(rows)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_routing_collisions_do_not_merge_texts(docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))) for i in range(200)]
    got = exact_dedup.find_copies(docs(rows), block=3, route=lambda c: (F.length(c) % 2).cast("long")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_copies(rows)


def test_copies_repeated_rows_null_ids_and_empty_table(docs):
    got = exact_dedup.find_copies(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "a ")])).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 2, 4), (None, 2, 4), (2, 2, 4), (None, None, 1)}
    twice = exact_dedup.find_copies(docs([(1, "a"), (1, "a")])).collect()
    assert sorted(r.kept for r in twice) == [False, True]
    assert exact_dedup.find_copies(docs([(1, "a")]).where("false")).count() == 0


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines_against_brute_force(docs):
    rng = random.Random(5)
    pool = [f"line {k} " + "abc É " * (k % 11 + 3) for k in range(30)] + ["", " ", "short", "\t" + "Z" * 40, "z" * 40 + " \r", "y" * 39 + "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 10, 150])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, pool[0] + "\n" + pool[0]), (104, pool[0] + "\nend")]
    frame = docs(rows, extra=True)
    got = line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(rows)


def test_line_bitmaps_hold_no_text_and_only_changed_words(docs):
    long = "common line of more than forty characters, really"
    rows = [(i, "\n".join([f"own {i}-{k}" for k in range(70)] + [long])) for i in range(6)]
    marks = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs(rows)).collect()}
    assert sorted(marks) == [0, 1, 2, 3, 4]  # the largest document keeps its line
    assert marks[0].n_dropped == 1 and list(marks[0].keep_words) == [1] and marks[0].keep_words[1] == ~(1 << 6)


def test_lines_repeated_rows_null_ids_and_empty_table(docs):
    long = "x" * 50
    rows = [(1, long), (1, long), (2, long + "\nb"), (3, long), (4, long)]
    frame = docs(rows)
    assert all(r.n_dropped == 0 for r in line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame)).collect())
    frame = docs(rows + [(None, long)])
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 0), (None, 1)}
    none = frame.where("false")
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
