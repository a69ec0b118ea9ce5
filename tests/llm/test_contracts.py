"""Every registered query on a small table with nulls, empty texts, repeated rows and columns of clashing names: names and types of its result."""

import zlib

import pytest

LONG, INT = "bigint", "int"
WANT = {
    "op1_near_dedup": {"doc_id": LONG, "class_id": LONG, "class_size": LONG},
    "op2_exact_dedup": {"doc_id": LONG, "keep_id": LONG, "group_size": LONG, "kept": "boolean", "text_sha256": "string"},
    "op3_quality": {"doc_id": LONG, "held_out": "boolean", "score": "double", "predicted": INT},
    "op4_pii": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": "string", "spans": "string"},
    "op5_sharding": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": "string", "shard": INT, "slot": LONG, "grown_shard": INT},
    "op6_packing": {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG},
    "op7_secret_scan": {"doc_id": LONG, "n_assign": LONG, "n_access": LONG, "n_hex": LONG, "base_sha256": "string", "spans": "string"},
    "op8_decontaminate": {"doc_id": LONG, "item_id": LONG, "score": "double"},
    "op9_toxicity": {"doc_id": LONG, "held_out": "boolean", "score": "double", "predicted": INT},
    "op10_katz": {"doc_id": LONG, "held_out": "boolean", "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": "double", "score": "double"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    texts = [None, "", "  ", "a b c d e f g", "a b c d e f g", "you idiot, mail a@b.org or +1 415 555 1234", "password = hunter2hunter2", "the quick brown fox jumps over the lazy dog", "é " * 3000]
    rows = [(i, t, "en", f"_h{i}", 1, 0.5) for i, t in enumerate(texts)] + [(None, "without id", None, None, None, None)] + [(3, texts[3], "en", "x", 1, 0.5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, hash string, `group` int, _toxicity double")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over"), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, rows


@pytest.mark.parametrize("name", WANT)
def test_contract(spark, tables, name):
    from palisade.llm.queries import QUERIES

    base, rows = tables
    out = QUERIES[name](spark, base)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in WANT[name]} == WANT[name]
    got = out.collect()
    if name == "op8_decontaminate":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(7, 1)}
        return
    assert sorted(((r["doc_id"] is None), r["doc_id"] or 0) for r in got if name != "op6_packing" or r["start"] == 0) == sorted(((r[0] is None), r[0] or 0) for r in rows)
    if name == "op6_packing":
        assert all(sum(p["length"] for p in got if p["doc_id"] == r["doc_id"]) == r["doc_tokens"] * sum(x[0] == r["doc_id"] for x in rows) for r in got)
    if name in ("op3_quality", "op9_toxicity", "op10_katz"):
        folds, fold = {"op3_quality": (3, 1), "op9_toxicity": (5, 0), "op10_katz": (5, 1)}[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in got if r["doc_id"] is not None)
