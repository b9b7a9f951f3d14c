"""The corpus pipeline stage by stage on a small planted corpus, and its entry in the driver's contract."""

import random
from pathlib import Path

import corpus_pipeline
from maskspan.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item, passage = text(30), text(80)
    texts = [text(120) for _ in range(120)]
    toxic = set(range(40, 80, 2))
    for k in toxic:
        texts[k] = f"{texts[k]} idiot {text(3)} moron {text(5)}"
    copied = texts[3].split()
    copied[5] = "different"
    texts += [texts[1], " ".join(copied), f"{text(40)} {item} {text(30)}", f"{text(20)} {passage} {text(20)}", f"{text(50)} {passage} {text(10)}", "", None]
    docs = spark.createDataFrame([(k, t, "en", f"src{k % 5}", None if t is None else len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(0, 100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic, passage


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts, toxic, passage = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(({r.doc_id for r in docs.collect()}, docs.columns))
    everything = set(range(len(texts)))
    assert seen[0] == (everything - toxic, COLUMNS)
    assert seen[1] == (seen[0][0] - {120, 121}, COLUMNS)
    assert seen[2] == (seen[1][0], COLUMNS)
    assert seen[3] == (seen[2][0] - {122}, COLUMNS)
    assert seen[4][0] == seen[3][0]
    cut = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/substring").collect()}
    assert passage in cut[123] and passage not in cut[124] and len(cut[124].split()) == 60
    assert docs.where("round_trip is null or round_trip").count() == docs.count()


def test_run_and_contract(spark, tmp_path):
    import __spark_entry__ as entry

    corpus(spark, str(tmp_path))
    out = entry.queries()["pipeline"](spark, str(tmp_path))
    assert out.count() == 127 - 20 - 2 - 1
    assert not [p for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("pipeline-*/*") if p.name != corpus_pipeline.STAGES[-1][0]]
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an empty table, extra columns with clashing names: each stage
    keeps what its docstring says and all columns."""
    folder = str(tmp_path)
    corpus(spark, folder)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic int, item_id bigint, of_doc bigint, root bigint, _id bigint, _doc int, _key int, _spans string, _gone int, _good int, _own0 int, _OWN1 int, text_key bigint, start int"
    long = " ".join(f"longword{i % 5003}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " ... "), (None, "text without an id"), (4, long), (5, "two equal texts"), (5, "two equal texts"), (6, "two equal texts"), (None, None)]
    docs = spark.createDataFrame([(k, t, None, None, None if t is None else len(t), 1, None, 3, None, 7, 1, None, "s", 2, 3, 4, 5, 6, 7) for k, t in rows], schema)
    kept = {"toxicity": 9, "simhash": 8, "substring": 9, "decontamination": 9, "bpe": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == kept[name], name
        assert name == "bpe" or out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_copies_go_by_parts_as_by_tiles(spark, tmp_path):
    """Stage 2 on a table that is compared by parts, with texts of few words, some in many near copies."""
    rng = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice((5, 40, 120)))) for _ in range(150)]
    for k in range(200):
        base = texts[k % 20].split()
        base[rng.randrange(len(base))] = f"other{k}"
        texts.append(" ".join(base))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert {r.doc_id for r in simhash.keep_one(docs, direct=0).collect()} == kept
    assert 150 <= len(kept) < 300
