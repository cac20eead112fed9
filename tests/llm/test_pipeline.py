"""The whole pipeline against a chain of plain versions of its stages."""

import random

import brute
import corpus_pipeline
import pytest
from tetragrid.llm import secret_scan, source_mix
from tetragrid.llm.pieces import decode_pieces, load_model
from tetragrid.llm.spans import masked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Rows of four sources: clean texts, copies, near copies, short and repeating ones, texts with a secret."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    for text in rows[:10]:
        own = text.split()
        own[-1] = "other"
        rows.append(" ".join(own))
    rows += rows[20:26]
    rows += ["too short", "", None, "a b c d e f " * 20]
    rows += [f"{rows[i + 30]} extra words here password: hunter{i}secret and AKIAABCDEFGHIJKLMNO{i}" for i in range(5)]
    rows += [" ".join(rng.choice(words) for _ in range(30)) + f" api_key=abcdef{i} ok" for i in range(5)]
    return [(i, t, "en", ("a", "a", "a", "b", None)[i % 5], None if t is None else len(t)) for i, t in enumerate(rows)]


def plain_mix(rows):
    """How often the mix takes each row, by a sort of each source on the hash of the id."""
    size = {i: len(brute.WORD.findall(text or "")) for i, text, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    words = [sum(size[i] for i, _, s in rows if s == name) for name in names]
    wanted = source_mix.targets(words, [source_mix.WEIGHTS[j % 3] for j in range(len(names))])
    return {name: (n, t) for name, n, t in zip(names, words, wanted, strict=True)}, size


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_equals_plain_stages(spark, folder):
    rows = [r for r in corpus() if not brute.quality(r[1])[5]]
    classes = brute.jaccard_components([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if classes[i][1] == i]
    clean = {r[0]: masked(r[1], secret_scan.base_spans(r[1]), "[SECRET]") for r in rows}
    plan, size = plain_mix([(r[0], clean[r[0]], r[3]) for r in rows])

    out = corpus_pipeline.run(spark, folder)
    model = load_model(spark)
    got = decode_pieces(out, model).collect()
    taken = {}
    for r in got:
        assert r.text == clean[r.doc_id] == r.decoded and r.n_chars == len(r.text) and r.n_pieces == len(r.piece_ids) > 0
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= source_mix.MOST_REPEATS
    for source, (_, target) in plan.items():
        own = [r[0] for r in rows if r[3] == source]
        assert abs(sum(size[i] * taken.get(i, 0) for i in own) - target) <= max(size[i] for i in own)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns


def test_an_empty_corpus_stays_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_with_labels_and_random_keys(spark, tmp_path):
    """Unlabelled rows go by what labelled ones taught, and keys no pattern names are masked in what stays."""
    rng = random.Random(23)
    words = "the of and to in market price water house record letter garden summer report number station people answer".split()
    alphabet = dict(secret_scan.ENCODINGS)["base64"]
    good, rows = set(), []
    keys = {}
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 120))]
        if i % 3 == 0:
            text = [w + rng.choice(("##", "$|", "&&%", "<>")) for w in text]
        else:
            good.add(i)
            if i % 6 == 1:
                keys[i] = "".join(rng.choice(alphabet) for _ in range(44))
                text.insert(30, keys[i])
        rows.append((i, " ".join(text), "en", "a", None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i in good), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    unseen = set(range(200, 300))
    assert len(unseen & good & set(out)) >= 0.95 * len(unseen & good)
    assert len((unseen - good) & set(out)) <= 0.05 * len(unseen - good)
    planted = set(keys) & set(out)
    assert sum(keys[i] not in out[i] for i in planted) >= 0.9 * len(planted) > 0
    before = dict(r[:2] for r in rows)
    assert all(out[i] == before[i] for i in set(out) - set(keys))


def test_stages_keep_columns_with_names_of_their_own(spark, tmp_path):
    names = ["doc", "row", "file", "mix", "whole", "below", "_of", "id", "text", "hash", "bucket", "span", "repeats", "size", "least", "grams", "piece", "kept"]
    rows = [(i, "a", *(t if n == "text" else f"{n}{i}" for n in names)) for i, t in enumerate([" ".join(f"w{j * (i + 1) % 97}" for j in range(40)) for i in range(12)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/docs")
    for table in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.columns[: len(table.columns)] == table.columns, name
            got = out.collect()
            assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names if n != "text"), name
