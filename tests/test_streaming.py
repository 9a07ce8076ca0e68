"""Streaming running shares equal the batch shares over the same rows."""

import os
import tempfile

from conftest import SF01
from plurality.operators import scoring, shares
from plurality.plans import standard as S
from plurality.sources import profiles
from plurality.streaming import shard_stream, start_running_shares


def test_running_shares_match_batch(spark):
    prof = profiles.order_profile(spark, SF01).select("unit_id", "priority", "basket", "segment")
    d = tempfile.mkdtemp(prefix="plurality-stream-")
    src = os.path.join(d, "shards")
    prof.repartition(4).write.parquet(src)
    stream = shard_stream(spark, src, prof.schema, max_files_per_trigger=1)
    assert stream.isStreaming
    q = start_running_shares(spark, stream, S.STANDARD_RULE, "plurality_running", checkpoint=os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    got = sorted((r.choice, r.n, r.percent) for r in spark.sql("SELECT * FROM plurality_running").collect())
    want = sorted((r.choice, r.n, r.percent)
                  for r in shares.shares(scoring.probabilities(prof, S.STANDARD_RULE, keep=[]), S.STANDARD_RULE).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert abs(g[2] - w[2]) < 1e-6


def test_scored_sink_matches_batch_scoring(spark):
    from plurality.operators import scoring
    from plurality.streaming import start_scored_sink

    prof = profiles.order_profile(spark, SF01).select("unit_id", "priority", "basket", "segment")
    d = tempfile.mkdtemp(prefix="plurality-stream-")
    src, out = os.path.join(d, "shards"), os.path.join(d, "scored")
    prof.repartition(3).write.parquet(src)
    q = start_scored_sink(spark, shard_stream(spark, src, prof.schema), S.STANDARD_RULE, out, checkpoint=os.path.join(d, "ckpt"))
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in scoring.probabilities(prof, S.STANDARD_RULE, keep=[]).collect())
    assert got == want
