import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cellweft.llm import perplexity

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        assert docs.columns == columns or name == "best_fit_packing"
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rated = perplexity.rate_documents(given).filter("kept").select("id").collect()
    assert sorted(r["doc_id"] for r in seen["quality_rules"].collect()) == sorted(r["id"] for r in rated)
    deduped = seen["near_dedup"]
    assert deduped.groupBy("text").count().filter("count > 1").isEmpty()
    assert seen["secret_scans"].count() == deduped.count()
    assert seen["secret_scans"].filter(F.length("text") != F.col("n_chars")).isEmpty()
    packed = seen["best_fit_packing"].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = seen["mixing"].collect()
    total = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in packed) == total
    assert len({r["sequence_id"] for r in packed}) <= math.ceil(total / 2048) + 3
    assert np.bincount([r["piece"] for r in packed])[0] == len(mixed)


def test_run_gives_the_packed_pieces(spark):
    got = entry.queries()["pipeline"](spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
