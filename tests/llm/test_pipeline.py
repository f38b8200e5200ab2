import random
import re

import corpus_pipeline
from cardprism.llm.queries import ORACLE, QUERIES

from .test_exact_and_lines import plain
from .test_minhash import shingle_set
from .test_toxicity_and_leaks import BAD, GOOD


def build(tmp_path, spark, rows, bench, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def corpus():
    rng = random.Random(20)
    words = GOOD + [f"w{i}" for i in range(800)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    bench = [(i, " ".join(text(40))) for i in range(5)]
    rows, labels, i = [], [], 0
    plain_docs = [text(rng.randint(30, 200)) for _ in range(250)]
    for ws in plain_docs:
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, 0))
        i += 1
    for k in range(120):  # toxic
        ws = text(rng.randint(10, 60))
        ws[k % len(ws)] = BAD[k % len(BAD)]
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, 1))
        i += 1
    for k in range(30):  # copies with other white space, near copies, leaks
        rows.append((i, "  ".join(plain_docs[k])))
        near = list(plain_docs[k + 40])
        near[3] = "changed"
        rows.append((i + 1, " ".join(near)))
        rows.append((i + 2, " ".join([*text(20), bench[k % 5][1], *text(20)])))
        i += 3
    rows += [(9000, None), (9001, ""), (9002, " "), (None, "a row without an id")]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows], bench, labels


def expected(rows, bench, labels):
    """The stages by brute force, toxicity by its label."""
    toxic = {d for d, _, t in labels if t}
    rows = [(d, t) for d, t, *_ in rows if d not in toxic]
    groups = {}
    for d, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), d is None, d, t))
    rows = [min(g, key=lambda m: m[:3])[2:] for g in groups.values()]
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    linked = {d: d for d in sets}
    for d in sorted(sets):
        for e in sorted(sets):
            if e < d and sets[d] and sets[e]:
                both = len(sets[d] & sets[e])
                if 100 * both >= 80 * (len(sets[d]) + len(sets[e]) - both):
                    linked[d] = min(linked[d], linked[e])
    rows = [(d, t) for d, t in rows if d is None or linked[d] == d]
    joined = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    return {d for d, t in rows if not any(joined(i) in joined(t) for _, i in bench)}


def test_every_stage_takes_effect(tmp_path, spark):
    rows, bench, labels = corpus()
    sf = build(tmp_path, spark, rows, bench, labels)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == expected(rows, bench, labels)
    assert len(got) == len({(r.doc_id, r.piece) for r in got})


def test_stages_keep_columns_and_stand_empty_tables(tmp_path, spark):
    rows, bench, labels = corpus()
    sf = build(tmp_path, spark, rows[:40], bench, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as node", "'x' as leaks", "1 as row", "2 as name", "3 as `meta.url`", "4 as `a``b`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() > 0
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert corpus_pipeline.pack(spark, docs.where("false"), sf).count() == 0


def test_repeated_rows_stay_once(spark, tmp_path):
    rows, bench, labels = corpus()
    sf = build(tmp_path, spark, [rows[0]] * 3 + [rows[1]], bench, labels)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()) == [0, 1]


def test_every_operator_is_registered():
    heads = {q.split("_")[0] for q in QUERIES}
    assert heads == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(ORACLE) == {"op2_exact_dedup", "op8_url_filter", "op10_line_dedup", "op11_phrase_collocations", "op13_importance_resampling"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
