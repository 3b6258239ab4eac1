"""Each stage of the pipeline on its own input against a plain version, and the whole on the smallest data."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_operators import DOCS, brute_components, brute_lines, corpus, plain_language, same, shingle_set, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return [r[:5] for r in corpus(11)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_language_stage_rejects_only_texts_without_letters(spark, docs, rows, empty):
    found = P.language_id(spark, docs, "")
    assert found.columns == docs.columns
    told = plain_language([(r[1], r[2]) for r in rows], [r[1] for r in rows])
    same(found.collect(), [(*r[:2], r[2] or lang, *r[3:]) for r, (lang, _) in zip(rows, told, strict=True) if lang != "und"])
    same(P.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").select("doc_id", "text").collect(), [r[:2] for r in rows if any(map(str.isalpha, r[1] or ""))])
    assert P.language_id(spark, empty, "").collect() == []


def test_language_stage_without_a_usable_label(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 10), (2, "123", "en", "a", 3), (3, None, "en", "a", None)], COLUMNS)
    assert [r.doc_id for r in P.language_id(spark, docs, "").collect()] == [1]


def test_line_stage(spark, docs, rows, empty):
    found = P.line_deduplication(spark, docs, "")
    assert found.columns == docs.columns
    want = [(i, t) for i, n, t in brute_lines([r[:2] for r in rows]) if not (n and t == "")]
    assert len(want) < len(rows)
    same(found.select("doc_id", "text").collect(), want)
    assert found.where("text is not null and n_chars <> char_length(text)").count() == 0
    assert P.line_deduplication(spark, empty, "").collect() == []


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, rows, empty):
    component = {}
    for i, n, c, _ in brute_components([(r[0], shingle_set(r[1])) for r in rows]):
        component[i] = (n, c)
    want, seen = [], set()
    for r in rows:
        n, c = component[r[0]]
        if n and r[0] is not None:
            if c != r[0] or r[0] in seen:
                continue
            seen.add(r[0])
        want.append(r)
    found = P.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    same(found.collect(), want)
    assert P.near_duplicates(spark, empty, "").collect() == []


def test_near_duplicate_stage_with_one_identifier_on_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 2), (5, b, "en", "s", 3), (5, b, "fr", "s", 4), (7, c, "en", "s", 5), (7, c, "en", "s", 5), (None, a, None, None, None)]
    found = P.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS).repartition(2), "")
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == sorted([(0, a), (1, a), (5, b), (7, c)])


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_with_columns_of_their_own_names(spark, docs, rows, stage):
    names = ["_found", "_gone", "_twice", "_key", "key", "mark", "n", "flags", "p", "source_size", "_copies", "_size", "_c0", "_drop_id"]
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    found = stage(spark, wide, "")
    if stage is not P.encode_pieces:
        assert found.columns == wide.columns
        assert found.where(" or ".join(f"`{n}` <> {i}" for i, n in enumerate(names))).count() == 0
    same(found.select("doc_id").collect(), stage(spark, docs, "").select("doc_id").collect())


def test_mixing_stage(spark, docs, rows, empty):
    found = P.mix_sources(spark, docs, "")
    assert found.columns == docs.columns
    report = {r.doc_id: r for r in P.mixing.mix_report(docs).collect()}
    total = sum(r.taken for r in P.mixing.mix_report(docs).collect())
    assert sum(len(words(r.text)) for r in found.collect()) == total
    per = found.groupBy("doc_id").count().where("doc_id is not null").collect()
    assert all(r["count"] % report[r.doc_id].copies == 0 for r in per)
    assert P.mix_sources(spark, empty, "").collect() == []


def test_piece_stage(spark, docs, rows, empty):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=P.queries.piece_model_path())
    found = P.encode_pieces(spark, docs, "").collect()
    same([(r.doc_id, r.piece_ids) for r in found], [(r[0], None if r[1] is None else library.encode(r[1])) for r in rows])
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids or ()) for r in found)
    assert P.encode_pieces(spark, empty, "").collect() == []


def test_run(spark, small):
    found = P.run(spark, small)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "sentencepiece"]
    rows = found.collect()
    assert rows and all(r.round_trip for r in rows)
    again = P.run(spark, small)
    same([(r.doc_id, r.n_pieces) for r in again.collect()], [(r.doc_id, r.n_pieces) for r in rows])


assert DOCS.startswith(COLUMNS)
