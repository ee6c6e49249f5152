"""Every text operator and pipeline stage on nulls, repeated ids and rows, empty and very long texts, ties, empty tables and
columns whose names clash with the operators' own."""

import hashlib

import pytest

from spectralake.llm import embedding_dedup, exact_dedup, jaccard_join, license_scan, mixing, ngram_lm, piece_codec, secret_scan, sharding, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CLASHES = ["digest", "block", "bucket", "row", "id", "kept_id", "copies", "low", "score", "ids", "decoded", "n", "doc", "gid", "component_id", "first_id", "domain", "key", "base", "labels", "threshold", "toxic"]
LONG = "lange Worte wiederholt " * 12_000
ROWS = [
    (None, None, "en", "s"), (None, "", None, None), (None, "one two three four five six", "en", "s"), (1, None, "en", "s"), (1, "one two three four five six", "en", "s"), (1, "one two three four five six", "en", "s"),
    (2, LONG, "de", "s"), (3, LONG, "de", "t"), (4, "", "fr", None), (5, " \t\n", "fr", "t"), (5, "under the mit license token = 0a1b2c3d4e", "en", "t"), (6, "é 日本 ▁", None, "s"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, len(r[1] or ""), *[f"clash{i}"] * len(CLASHES)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).persist()


@pytest.fixture(scope="module")
def model():
    import pandas as pd

    rows = [(i, f"word{i % 7} {'grumbl' if i % 2 else 'fine'} more", "en", i % 2) for i in range(400)]
    return toxicity.ToxicityModel.fit(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "toxic"]), rows=1 << 12)


OPERATORS = {
    "op1": exact_dedup.exact_dedup, "op2": ngram_lm.score_documents, "op5": license_scan.scan_licenses, "op6": sharding.minimax_shards, "op7": mixing.mix_sources,
    "op8": jaccard_join.jaccard_components, "op9": secret_scan.scan_secrets, "op10": lambda d: piece_codec.decode_pieces(piece_codec.encode_pieces(d, MODEL), MODEL),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(table, name):
    got = OPERATORS[name](table).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    assert OPERATORS[name](table.limit(0)).count() == 0


def test_exact_dedup_of_odd_rows(table):
    got = exact_dedup.exact_dedup(table).collect()
    by_hash = {}
    for r in got:
        by_hash.setdefault(r.text_sha256, set()).add(r.keep_id)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(len(ids) == 1 for ids in by_hash.values()) and by_hash[empty] == {1}  # null and empty: ids null, null, 1, 4
    assert sum(r.group_size for r in got if r.text_sha256 == empty) == 16
    kept = exact_dedup.keep_first(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 5, 5, 6]


def test_language_model_of_odd_rows(table):
    got = [(r.doc_id, r.n_words, r.score, r.mean_score) for r in ngram_lm.score_documents(table).collect()]
    assert sum(n == 0 and score == 0 and mean is None for _, n, score, mean in got) == 5
    assert len({round(s, 9) for _, n, s, _ in got if n == 6}) == 1 and len({round(s, 6) for _, n, s, _ in got if n == 36_000}) == 1


def test_toxicity_of_odd_rows(spark, table, model):
    got = toxicity.score_toxicity(table, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and toxicity.score_toxicity(table.limit(0), model).count() == 0
    kept = toxicity.without_toxic(table, model)
    assert kept.columns == table.columns and toxicity.without_toxic(table.limit(0), model).count() == 0
    # Next to nothing to learn from: nothing is rejected. Ties at the threshold are.
    few = toxicity.ToxicityModel.fit(toxicity.labelled_sample(table, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")))
    assert toxicity.without_toxic(table, few).count() == len(ROWS)
    few.default = float(toxicity.score_toxicity(table, few).first().score)
    assert toxicity.without_toxic(table, few).count() == 0


def test_embeddings_of_odd_rows(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, []), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1e300, 1e300])]
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, node string, signs string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(given).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 10)]
    assert embedding_dedup.near_duplicates(given.limit(0)).count() == 0


def test_shards_of_odd_rows(table):
    got = sharding.minimax_shards(table, 3).collect()
    assert sorted(r.size for r in got) == sorted(len((r[1] or "").encode()) + 1 for r in ROWS)
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert len({r.shard for r in got if r.size > 1000}) == 1  # equal texts


def test_components_of_odd_rows(table):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table).collect()]
    assert {c for _, n, c in got if n == 2} == {1} and {c for _, n, c in got if n == 3} == {2, 5} and all(c == i for i, n, c in got if n == 0)
    kept = jaccard_join.keep_representatives(table)
    assert kept.columns == table.columns


def test_pieces_of_odd_rows(table):
    got = OPERATORS["op10"](table).collect()
    assert all(r.decoded == r.text for r in got) and all((r.ids is None) == (r.text is None) for r in got)
    verified = piece_codec.encode_pieces(table, MODEL, verify=True).collect()
    assert all(r.round_trip for r in verified) and sorted(map(str, (r.ids for r in verified))) == sorted(map(str, (r.ids for r in got)))


def test_mixed_keeps_columns(table):
    got = mixing.mixed(table, share=2.0)
    # Twice all rows of leaves with words; leaves without are a prefix of no words, taken once.
    assert got.columns == table.columns and got.count() == 2 * 9 + 3


def test_stages_on_odd_rows(spark, table, tmp_path):
    import corpus_pipeline

    # A folder whose labels teach nothing.
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (table, table.limit(0)):
        docs = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("not round_trip").count() == 0
