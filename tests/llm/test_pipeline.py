"""The corpus pipeline, stage by stage, against brute force."""

import os
import subprocess
import sys

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from lectern.llm import minhash, secrets


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    extra = spark.createDataFrame([(10**9, "1234 5678 ...", "en", "x", 13), (10**9 + 1, None, "en", "x", 0), (None, "the one without an id is there", "en", "x", 30), (10**9 + 2, "zxqj vwkq xjzq kqwv zzxq jjqk vwxz qkjx qzwx jkvq", None, "x", 50), (2**53 + 1, "des mots de la langue", "fr", "x", 21)], docs.schema)
    docs = docs.union(extra)
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "toxicity", "near_copies", "secrets", "packing"]

    said = P.languages(spark, docs, tiny).cache()
    ids = {r.doc_id for r in said.select("doc_id").collect()}
    assert not {10**9, 10**9 + 1, 10**9 + 2} & ids and {None, 2**53 + 1} <= ids and said.columns == docs.columns
    assert said.count() >= 0.99 * (docs.count() - 3)

    calm = P.toxic(spark, said, tiny).cache()
    assert calm.columns == docs.columns and 0.8 * said.count() < calm.count() < said.count()

    kept = P.near_copies(spark, calm, tiny).cache()
    wanted = minhash.brute_force({r.doc_id: r.text for r in calm.where("doc_id is not null").collect()}, P.PERCENT)
    assert {r.doc_id for r in kept.collect()} == set(wanted.values()) | {None}

    clean = P.without_secrets(spark, kept, tiny).collect()
    assert len(clean) == kept.count()
    assert not any(secrets.brute_force(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)


def test_run(spark, tiny):
    out = P.run(spark, tiny)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100


def test_empty_and_clashing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(3).withColumn("node", F.lit("clash")).withColumn("toxicity", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    for rows in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, rows, tiny)
            n = out.count()
            assert name == "packing" or set(docs.columns) - {"toxicity", "lang_pred"} <= set(out.columns) and n <= rows.count()


def test_repeated_rows_stay_once(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(5)
    assert P.near_copies(spark, docs.union(docs), tiny).count() == P.near_copies(spark, docs, tiny).count()


HELD = """
import re
from lectern.llm import common

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

before = held()
words = [bytes(2000) for _ in range(50_000)]
last = bytes(2000)  # what is in use above keeps the C library from returning what is below by itself
common.keep_only("one", words.clear)
full = held()
common.keep_only("two", list)
print(full - before, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_stage_gives_its_memory_back():
    """What one stage has kept in a worker doesn't stand beside what the next one needs."""
    here = os.path.dirname(os.path.abspath(P.__file__))
    said = subprocess.run([sys.executable, "-c", HELD], cwd=here, capture_output=True, text=True, check=True, timeout=60).stdout
    full, left = map(float, said.split())
    assert full > 90 and left < 20
