import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.fixtures import documents, empty, odd_rows
from tests.llm.test_simhash import brute_kept, wide_link
from wirelens.llm import toxicity
from wirelens.llm.common import BATCH_BYTES, table

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    bad = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    once = stages["exact_dedup"](spark, clean, SF).cache()
    last = {}
    for r in clean.collect():
        key = (r.text or "").translate(FOLD)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(last.values()) == sorted(r.doc_id for r in once.collect())
    far = stages["simhash_near_dedup"](spark, once, SF).cache()
    assert sorted(((r.doc_id is None, r.doc_id) for r in far.collect()), key=str) == brute_kept(once.collect(), wide_link)
    mixed = stages["mixing"](spark, far, SF).cache()
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in far.collect()}
    packed = stages["packing"](spark, mixed, SF).cache()
    per = {}
    for r in packed.collect():
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packed.where("piece = 0").count() == mixed.count()
    bare = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in packed.collect():
        own = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        ids.setdefault(r.doc_id, {})[r.piece] = own.tolist()
    for r in mixed.limit(50).collect():
        assert [x for k in sorted(ids[r.doc_id]) for x in ids[r.doc_id][k]] == [*bare.encode(r.text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("make", [odd_rows, empty, documents])
def test_stages_take_odd_rows(spark, make):
    """Nulls, repeated ids, rows repeated whole, an empty table and clashing names: all stages but the last keep the columns."""
    docs = make(spark)
    texts = {(r.text or "").translate(FOLD) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        left = {(r.text or "").translate(FOLD) for r in docs.collect()}
        assert left <= texts, name
        if name == "exact_dedup":
            assert left == texts
        texts = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def test_run_gives_the_same_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() == corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["toxicity", "simhash_near_dedup", "packing"])
def test_stages_send_batches_of_bounded_bytes(spark, name):
    """A batch was 10,000 rows, whatever they held: 60 MB here."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(corpus_pipeline.STAGES)[name](spark, table(spark, SF, "documents"), SF)

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"rows": [part.num_rows], "bytes": [part.nbytes]})

    found = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text")).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 3000
    assert max(r.bytes for r in found) <= 2 * BATCH_BYTES
