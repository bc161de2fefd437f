import collections
import random

import corpus_pipeline
from tests.llm.helpers import SCHEMA, awkward_documents, prose
from tests.llm.test_pairs_and_packs import best_fit_decreasing, brute_components
from tests.llm.test_texts import brute_hits
from tessera.llm import secrets
from tessera.llm.queries import oracle_sql, queries, tokenizer_path
from tessera.llm.tokens import WordwiseEncoder


def write_tables(spark, path):
    rng = random.Random(8)
    rows = [r for r in awkward_documents() if r[0] is not None]
    rows = [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}]
    bench = [(1, prose(rng, 30)), (2, "short item"), (3, None)]
    labels = [(r[0], 1, 0) for r in rows[:40]]
    for i in range(2000, 2040):
        bad = i % 2 == 0
        words = prose(rng, 30).split()
        if bad:
            for k in range(3):
                words[k * 7] = rng.choice(["grumbleton", "snarfwick"])
        rows.append((i, " ".join(words), "en", "web", None, None, None))
        labels.append((i, 1, int(bad)))
    rows.append((3000, "intro " + bench[0][1] + " outro", "en", "web", 9, None, None))
    rows.append((3001, "key password=hunter2222 is here " + prose(rng, 12), "en", "web", 40, None, None))
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return rows, bench


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows, bench = write_tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = spark.createDataFrame(stages["toxicity"](spark, docs, path).collect(), SCHEMA)
    assert clean.columns == columns
    gone = {r[0] for r in rows} - {r.doc_id for r in clean.collect()}
    assert gone == {i for i in range(2000, 2040) if i % 2 == 0}

    want = [(r.doc_id, r.text) for r in clean.collect()]
    one = spark.createDataFrame(stages["ngram_jaccard_join"](spark, clean, path).collect(), SCHEMA)
    heads = {c for d, _, c in brute_components(want) if d == c}
    assert sorted(r.doc_id for r in one.collect()) == sorted(heads)

    left = [(r.doc_id, r.text) for r in one.collect()]
    pure = spark.createDataFrame(stages["benchmark_decontamination"](spark, one, path).collect(), SCHEMA)
    assert {r.doc_id for r in pure.collect()} == {d for d, _, hit, _ in brute_hits(left, bench) if not hit}
    assert 3000 not in {r.doc_id for r in pure.collect()}

    masked = stages["secret_scan"](spark, pure, path)
    texts = {r.doc_id: secrets.masked(r.text, secrets.scan(r.text)) for r in pure.collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == texts and "[assign]" in texts[3001]

    enc = WordwiseEncoder(tokenizer_path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, path).collect()
    per = collections.Counter()
    for r in packed:
        per[r.doc_id] += r.length
    assert dict(per) == {d: len(enc.encode(t or "")) // 4 + 1 for d, t in texts.items()}
    assert len({r.sequence_id for r in packed}) == best_fit_decreasing([r.length for r in packed], 2048)


def test_registration():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).collect() == [] and stage(spark, docs, path).columns == docs.columns, name
    assert corpus_pipeline.run(spark, path).count() == 0


def test_null_and_repeated_ids_go_through_all_stages(spark, tmp_path):
    """Rows without an id all stay; rows that repeat an id and its text are one from the join on; a word of any length is handled."""
    path = f"file://{tmp_path}"
    rows, _ = write_tables(spark, path)
    rng = random.Random(3)
    more = [(None, prose(rng, 40), "en", "web", None, None, None) for _ in range(5)] + [(None, None, None, None, None, None, None)] * 2
    again = [r for r in rows if r[0] in (1, 2, 5, 2001)]
    long_ = [(4000, "y" * 150_000, "en", "web", 150_000, None, None), (4001, "start " + "w" * 150_000, None, None, None, None, None)]
    spark.createDataFrame([*rows, *more, *again, *long_], SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, clean = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        clean = spark.createDataFrame(stage(spark, clean, path).collect(), SCHEMA)
        kept[name] = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert sum(d is None for d, _ in kept["toxicity"]) == 7 and sum(d == 1 for d, _ in kept["toxicity"]) == 2
    for name in ("ngram_jaccard_join", "benchmark_decontamination", "secret_scan"):
        assert sum(d is None for d, _ in kept[name]) == 7
        known = [x for x in kept[name] if x[0] is not None]
        assert len(known) == len(set(known)) and {4000, 4001} <= {d for d, _ in known}
    enc = WordwiseEncoder(tokenizer_path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, path).collect()
    assert sum(r["length"] for r in packed) == sum(len(enc.encode(t or "")) // 4 + 1 for _, t in kept["secret_scan"])
    assert sum(r["doc_id"] is None and r["piece"] == 0 for r in packed) == 7
