import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cardprism.llm import packing, token_rollup
from cardprism.llm.common import Scratch
from cardprism.llm.tokens import ByteBpe

ODD = ["", "a", "The quick brown fox, it's 12 o'clock!", "ñandú œuvre Straße İstanbul", "日本語 テスト", "a\u00a0b\u2003c\x85d", "x" * 5000, " " * 3000,
       "<|endoftext|> text", "e\u0301 \u200b \U0001f44d\U0001f3fd", "²³¼ Ⅷ", "tab\tnew\n\n line\r\n", "\x00\x1f", "don't we'll I'VE"]


def test_ids_are_those_of_the_tokenizers_library():
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    bpe, rng = ByteBpe(), random.Random(4)
    chars = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x250)]]
    for text in [*ODD, *("".join(rng.choice(chars) for _ in range(400)) for _ in range(60))]:
        assert bpe.ids(text) == exact.encode(text, add_special_tokens=False).ids, text[:40]
    assert bpe.ids(None) == []


def brute_pieces(rows, capacity):
    bpe, out = ByteBpe(), Counter()
    for i, t in rows:
        ids = [*bpe.ids(t), 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check(rows, got, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows, capacity)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_round_trip(docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(1, rows[1][1]), (None, "null id"), (7, None)]
    for capacity, tasks in ((64, 10**9), (64, 2000), (1024, 10**9)):
        got = packing.pack_documents(docs(rows, extra=True), capacity=capacity, tokens_per_task=tasks).collect()
        n, total = check(rows, got, capacity), sum(r.length for r in got)
        assert n <= 1.05 * total / capacity + 2 + 3 * (total // tasks)
    assert packing.pack_documents(docs(rows).where("false")).count() == 0


def test_bounded_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert fit.place(6) == (0, 0) and fit.place(7) == (1, 0)  # free: 4, 3
    assert fit.place(3) == (1, 7)  # the tightest; bin 1 is full and closes
    assert fit.place(5) == (2, 0)  # free: 4 (bin 0), 5 (bin 2)
    assert fit.place(8) == (3, 0)  # bin 0, the fullest, closes
    assert fit.place(4) == (2, 5) and fit.open == 2
    fit = packing.BestFit(10, open_bins=100)
    sizes = [random.Random(1).randint(1, 10) for _ in range(2000)]
    used = Counter()
    for n in sizes:
        at, offset = fit.place(n)
        assert offset == used[at] and (used.update({at: n}) or used[at] <= 10)


def test_ids_travel_on_request(docs):
    got = packing.pack_documents(docs(["hello world", None]), with_ids=True).collect()
    assert sorted(r.ids for r in got) == sorted([[2], [*ByteBpe().ids("hello world"), 2]])


CHANGE = "op string, doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches_of_signed_deltas(make, spark):
    rollup = token_rollup.TokenRollup(spark, Scratch(spark, "test").path("store"))
    assert totals(rollup) == {}
    first = make([("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5), ("insert", 2, "a", "en", "v2", 7), ("insert", None, None, None, "v1", None)], CHANGE)
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert totals(rollup) == {("a", "en", "v1"): (2, 15), ("a", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)}
    assert rollup.commit("b2", make([("revise", 1, "b", "en", "v1", 12), ("delete", 2, None, None, "v2", None), ("delete", 99, None, None, "v1", 1)], CHANGE))
    assert totals(rollup) == {("a", "en", "v1"): (1, 5), ("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0)}
    assert not rollup.commit("b1", first)
    assert rollup.commit("b3", first.where("false")) and totals(rollup)["b", "en", "v1"] == (1, 12)
    assert {(r.doc_id, r.n_tokens) for r in rollup.live().collect()} == {(1, 12), (2, 5), (None, 0)}


def test_a_torn_commit_is_not_seen_and_can_be_repeated(make, spark):
    rollup = token_rollup.TokenRollup(spark, Scratch(spark, "test").path("store"))
    rows = make([("insert", 1, "a", "en", "v1", 10)], CHANGE)
    junk = spark.createDataFrame([(5, "x", "x", "x", 5, 1)], "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, sign int")
    junk.write.parquet(f"{rollup.root}/ledger/batch=b1")  # the ledger was written, the delta was not
    assert totals(rollup) == {} and rollup.live() is None
    assert rollup.commit("b1", rows) and totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_several_changes_of_one_document_in_a_batch(make, spark):
    rollup = token_rollup.TokenRollup(spark, Scratch(spark, "test").path("store"))
    rows = [("insert", 1, "a", "en", "v1", 10, 1), ("revise", 1, "a", "en", "v1", 4, 2), ("insert", 2, "a", "en", "v1", 1, 1), ("delete", 2, "a", "en", "v1", None, 2)]
    rollup.commit("b", make(rows, CHANGE + ", seq int"))
    assert totals(rollup) == {("a", "en", "v1"): (1, 4)}


def test_rollup_of_a_corpus_against_brute_force(make):
    rows = [(i, t, f"s{i % 2}", "en" if i % 3 else None, 0) for i, t in enumerate([*ODD, None, "  \n", "more text here"])]
    df = make(rows, "doc_id bigint, text string, source string, lang string, sign int")
    bpe, want = ByteBpe(), Counter()
    for i, t, source, lang, _ in rows:
        if (t or "").strip(" \t\n\x0b\x0c\r"):
            want.update({(source, lang, "byte_bpe_50k", "docs"): 1, (source, lang, "byte_bpe_50k", "n"): len(bpe.ids(t)),
                         (source, lang, "words", "docs"): 1, (source, lang, "words", "n"): len(t.encode().split())})
    got = Counter()
    for r in token_rollup.rollup_documents(df).collect():
        got.update({(r.source, r.lang, r.tokenizer, "docs"): r.n_docs, (r.source, r.lang, r.tokenizer, "n"): r.n_tokens})
    assert got == want
    assert token_rollup.rollup_documents(df.where("false")).count() == 0
