"""Every operator on awkward rows, on no rows, and on rows with clashing columns."""

import pytest

from cairn.llm import op1_language, op2_shard, op3_fingerprint, op4_toxicity, op5_decontaminate, op6_sentencepiece, op7_tokens, op8_jaccard, op9_secrets, op10_binary
from cairn.plans import storage

from .texts import BENCHMARK, LABELS, awkward, clashing


def run(name, spark, docs):
    bench = spark.createDataFrame([(0, "a"), (1, None), (2, ""), (3, "one two three"), (3, "one two three")], BENCHMARK)
    if name == "op1":
        return op1_language.predict(spark, docs, op1_language.train(docs))
    if name == "op1 accepted":
        return op1_language.accepted(spark, docs)
    if name == "op8 deduplicated":
        return op8_jaccard.deduplicated(spark, docs)
    if name == "op5 decontaminated":
        return op5_decontaminate.decontaminate(spark, docs, bench)
    if name == "op2":
        return op2_shard.sharded(docs, [1.0] * 16)
    if name == "op3":
        return op3_fingerprint.neighbours(docs).mapInArrow(op3_fingerprint._report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    if name == "op3 fingerprinted":
        return op3_fingerprint.fingerprinted(docs)
    if name == "op4":
        labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(3, None, None), (None, 1, 1)], LABELS)
        return op4_toxicity.scored(spark, docs, op4_toxicity.learn(op4_toxicity.sample(docs, labels)))
    if name == "op5":
        return op5_decontaminate.report(op5_decontaminate.scan(spark, docs, bench))
    if name == "op5 removed":
        return op5_decontaminate.remove_spans(spark, docs, bench)
    if name == "op6":
        return op6_sentencepiece.encoded(docs)
    if name == "op7":
        return op7_tokens.counted(docs)
    if name == "op8":
        return op8_jaccard.classes(spark, docs)
    if name == "op9":
        return op9_secrets.report(spark, docs)
    if name == "op9 redacted":
        return op9_secrets.redacted(spark, docs)
    folder = f"{storage.shared_dir(spark)}/edge-{id(docs)}"
    return op10_binary.read(op10_binary.write(spark, docs, folder, rows_per_shard=5), folder)


KEEPING = ["op1 accepted", "op8 deduplicated", "op5 decontaminated", "op5 removed", "op9 redacted"]
NAMES = ["op1", "op2", "op3", "op3 fingerprinted", "op4", "op5", "op5 removed", "op6", "op7", "op8", "op9", "op9 redacted", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    assert run(name, spark, docs).count() == docs.count()


@pytest.mark.parametrize("name", KEEPING)
def test_whole_rows_stay(spark, name):
    """Columns of any name and type pass through the filtering operators; what is dropped is dropped for its text."""
    docs = clashing(spark)
    got = run(name, spark, docs)
    assert got.schema == docs.schema
    rows = [tuple(r) for r in got.collect()]
    index = docs.columns.index("text")
    if name == "op8 deduplicated":  # one row of each text with words, all without
        want = [tuple(r) for r in docs.collect() if not (r[0] == 11 and r[index] == "a plain text that is here twice")]
        assert sorted(map(str, rows)) == sorted(map(str, want))
    elif name == "op1 accepted":
        assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in docs.collect() if any(c.isalpha() for c in r[index] or ""))
    else:
        hit = (lambda t: "a" in t.split() or "one two three" in t) if name.startswith("op5") else (lambda t: "hunter22" in t)
        want = [tuple(r) for r in docs.collect() if not hit(r[index] or "")]
        same = [r for r in rows if str(r) in set(map(str, want))]
        assert sorted(map(str, same)) == sorted(map(str, want))
        assert len(rows) == (len(want) if name == "op5 decontaminated" else docs.count())


@pytest.mark.parametrize("name", [n for n in KEEPING if n not in NAMES])
def test_awkward_rows_are_filtered(spark, name):
    docs = awkward(spark)
    assert 0 < run(name, spark, docs).count() < docs.count()


@pytest.mark.parametrize("name", [*NAMES, *KEEPING[:3]])
def test_no_rows(spark, name):
    assert run(name, spark, awkward(spark, empty=True)).count() == 0


def test_defined_results(spark):
    docs = awkward(spark)
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in run("op1", spark, docs).collect()}
    assert lang[0] == lang[1] == lang[6] == lang[7] == ("und", 0.0)
    size = {(r["doc_id"], r["size"], r["text_crc32"]) for r in run("op2", spark, docs).collect()}
    assert {(0, 1, 0), (1, 1, 0)} <= size
    print_ = {r["doc_id"]: r for r in run("op3", spark, docs).collect()}
    assert print_[0]["fingerprint"] == print_[1]["fingerprint"] == "0:" and print_[8]["fingerprint"] == print_[9]["fingerprint"]
    dirty = {r["doc_id"]: r for r in run("op5", spark, docs).collect()}
    assert dirty[0]["n_words"] == 0 and not dirty[0]["contaminated"] and dirty[4]["contaminated"] and dirty[4]["n_items"] == 1
    classes = run("op8", spark, docs).collect()
    by = {r["doc_id"]: r for r in classes}
    assert by[8]["class_id"] == by[9]["class_id"] == by[10]["class_id"] == 8 and by[8]["n_copies"] == 4 and by[8]["n_links"] == 4 and by[0]["n_links"] == 0
    found = {r["doc_id"]: r for r in run("op9", spark, docs).collect()}
    assert found[0]["spans"] == "" and found[14]["spans"] == "assign:0:19,access:24:44"


def test_empty_benchmark_hits_nothing(spark):
    none = spark.createDataFrame([], BENCHMARK)
    assert not op5_decontaminate.report(op5_decontaminate.scan(spark, awkward(spark), none)).filter("n_hit > 0").count()


def test_one_row_is_its_own_next(spark):
    docs = spark.createDataFrame([(5, "a text of a few words")], "doc_id long, text string")
    r = run("op3", spark, docs).first()
    assert r["near_next"] == 1.0


def test_decontamination_goes_by_row(spark):
    """Missing and shared ids, and items without an id, whatever the size of the benchmark."""
    passages = [" ".join(f"{k}{i}" for i in range(20)) for k in "abc"]
    bench = spark.createDataFrame([(0, passages[0]), (None, passages[1]), (2, passages[2])], BENCHMARK)
    rows = [(None, passages[0]), (None, "clean text"), (7, passages[1]), (7, "another clean text"), (8, passages[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (16 << 20, 50):
        kept = op5_decontaminate.decontaminate(spark, docs, bench, limit=limit)
        assert kept.columns == docs.columns
        assert sorted(r["text"] for r in kept.collect()) == ["another clean text", "clean text"]
        found = op5_decontaminate.report(op5_decontaminate.scan(spark, docs, bench, limit=limit)).collect()
        assert sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"]) for r in found) == [(0, 0, 0), (0, 20, 1), (7, 0, 0), (7, 20, 1), (8, 20, 1)]
