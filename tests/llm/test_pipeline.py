import math
import zlib
from collections import Counter
from hashlib import md5

import corpus_pipeline
from gradeloom.llm import decontaminate
from test_near_dup import brute as near_brute
from test_simple import targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run_stages(spark, docs, sf_dir):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(found.collect(), found.schema)
        out.append(docs)
    return out


def brute(kept, benchmark):
    """Stages two to five over the rows that the first one keeps."""
    near = {r[0] for r in near_brute([(r.doc_id, r.text) for r in kept]) if r[3]}
    rows = [r for r in kept if r.doc_id in near]
    items = [b" ".join(decontaminate.plain_words(t.encode())) for t in benchmark]
    rows = [r for r in rows if not any(i in b" ".join(decontaminate.plain_words(r.text.encode())) for i in items)]
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text.encode().split())
    want = targets(sizes, (5, 2, 1), 1.5, 2)
    mixed = []
    for r in rows:
        rate = want[r.source] / sizes[r.source]
        drawn = int(md5(f"{r.doc_id}:17".encode()).hexdigest()[:13], 16) / 2**52
        mixed += [r] * (math.floor(rate + 1e-12) + (drawn < rate - math.floor(rate + 1e-12)))
    order = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in mixed)
    total, before, shards = sum(o[1] for o in order), 0, []
    for doc_id, size, crc in order:
        shards.append((doc_id, size, crc, (2 * before + size) * 8 // (2 * total)))
        before += size
    return near, rows, mixed, shards


def test_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stages = [stage.collect() for stage in run_stages(spark, docs, small_dir)]
    kept = stages[0]
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept}
    assert len(lost) <= 2 and all(len(r.text) < 200 for r in docs.collect() if r.doc_id in lost)
    near, rows, mixed, shards = brute(kept, [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()])
    assert {r.doc_id for r in stages[1]} == near
    assert sorted(map(tuple, stages[2])) == sorted(map(tuple, rows))
    assert sorted(map(tuple, stages[3])) == sorted(map(tuple, mixed))
    assert all(r.__fields__ == COLUMNS for stage in stages[:4] for r in stage)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in stages[4]) == shards
    whole = corpus_pipeline.run(spark, small_dir)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in whole.collect()) == shards
    assert whole.columns == [*COLUMNS, "size", "text_crc32", "shard", "slot"]
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(map(tuple, mixed))


def test_odd_rows(spark, small_dir):
    source = spark.read.parquet(f"{small_dir}/documents.parquet")
    some = source.orderBy("doc_id").limit(30).collect()
    odd = [(None, some[0].text, None, None, 3), (900, None, "en", None, 0), (901, "", None, "s", 0), (902, "12 ! 34", "en", "s", 7), (some[1].doc_id, some[1].text, "en", None, None)]
    frame = spark.createDataFrame([tuple(r) for r in some] + odd, source.schema)
    ids = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, frame, small_dir).collect()}
    assert not ids & {900, 901, 902} and None in ids
    last = run_stages(spark, frame, small_dir)[-1].collect()
    assert last and {r.doc_id for r in last} <= ids
    assert run_stages(spark, frame.limit(0), small_dir)[-1].collect() == []
