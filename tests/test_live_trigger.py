"""Live trigger over several micro-batches: the batch replay's rows, and a bounded number of visits to the state."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.functions import texts as X
from callmetrics.functions import trace_kernels as K
from callmetrics.operators import traces as TR
from callmetrics.streaming import trigger as TG

LEXICON = {"backtrack": ("undo",), "hedge": ("maybe", "é"), "giveup": ("stuck",)}
POOL = ["undo", "maybe", "É", "stuck", "so", "then", "we", "set", "it", "on", "up", "by", "at", "of"]


@pytest.fixture(scope="module")
def traces(spark):
    rng = np.random.default_rng(3)
    text = lambda n, risk: " ".join(rng.choice(POOL, n, p=[risk] * 4 + [(1 - 4 * risk) / 10] * 10))
    ids = [*range(-40, 160), 10**17, 10**17 + 1, -(2**63), 2**63 - 1]
    rows = [(i, text(int(n), r)) for i, n, r in zip(ids, rng.integers(0, 1500, len(ids)), rng.choice([0.0, 0.001, 0.004], len(ids)))]
    rows += [(1000, None), (1001, ""), (1002, text(79, 0.2)), (1003, text(80, 0.2)), (1004, text(9000, 0.0)), (None, text(400, 0.2))]
    return spark.createDataFrame(rows, "call_id bigint, reasoning_text string").withColumns({"outcome": F.lit("pass"), "latency_ms": F.lit(1.0)})


def run(spark, chunks, folder, cuts):
    """Fired calls and the progress of every micro-batch; batch i has the chunks from cuts[i] on."""
    for number, (first, stop) in enumerate(zip(cuts, [*cuts[1:], 1 << 40])):
        chunks.where((F.col("chunk") >= first) & (F.col("chunk") < stop)).coalesce(1).write.parquet(f"{folder}/{number}")
        for name in os.listdir(f"{folder}/{number}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.link(f"{folder}/{number}/{name}", f"{folder}/in/{number}.parquet")
                os.utime(f"{folder}/in/{number}.parquet", (1_700_000_000 + number,) * 2)
    live = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    fired = TG.live_triggers(live)
    running = (
        fired.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    try:
        running.awaitTermination()
        progress = [p for p in running.recentProgress if p["numInputRows"]]
    finally:
        running.stop()
    return spark.read.schema(fired.schema).parquet(f"{folder}/out").collect(), progress


@pytest.mark.parametrize("cuts", [[0], [0, 1, 2, 5, 9, 17, 30]])
def test_batches_fire_like_the_replay(spark, traces, tmp_path, cuts):
    calls = traces.where("call_id IS NOT NULL")
    scores = {(r.call_id, r.chunk): r.score for r in TR.risk_scores(calls, LEXICON).collect()}
    want = {(r.call_id, r.trigger_chunk, scores[r.call_id, r.trigger_chunk]) for r in TR.replay(calls, LEXICON).where("fired").collect()}
    got, progress = run(spark, TG.chunk_stream(traces, LEXICON), str(tmp_path), cuts)
    assert len(progress) == len(cuts) and len(got) == len(want) > 50
    assert {tuple(r) for r in got} == want
    # Ids -64 to 191, 1000 to 1004 and three far away: states are kept by blocks of at most 64 calls.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4 + 1 + 3


def test_chunks_carry_hashes_of_words(spark, traces):
    rows = TG.chunk_stream(traces, LEXICON).collect()
    texts = {r.call_id: (r.reasoning_text or "").lower().split() for r in traces.where("call_id IS NOT NULL").collect()}
    assert sorted((r.call_id, r.chunk) for r in rows) == sorted((c, j) for c, w in texts.items() for j in range(len(w) // X.CHUNK_WORDS))
    worth = {"undo": 1, "maybe": 1, "é": 1, "stuck": 2}
    for r in rows:
        words = texts[r.call_id][r.chunk * X.CHUNK_WORDS:(r.chunk + 1) * X.CHUNK_WORDS]
        assert bytes(r.words) == K.marker_hashes(words).tobytes() and r.points == sum(worth.get(w, 0) for w in words)


def test_scores_by_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 40, 30)
    hashes = [rng.integers(0, 12, 40 * n).astype(np.uint64) for n in counts]
    points = [rng.integers(0, 3, n) for n in counts]
    whole = K.chunk_scores(hashes, points, 40)
    for h, p, score in zip(hashes, points, whole):
        for j in range(len(p)):
            window = h[max(0, j - 7) * 40:(j + 1) * 40]
            runs = [tuple(window[i:i + 4]) for i in range(len(window) - 3)]
            assert score[j] == p[max(0, j - 7):j + 1].sum() + len(runs) - len(set(runs))
    monkeypatch.setattr(K, "PIECE_WORDS", 1000)
    assert all((a == b).all() for a, b in zip(whole, K.chunk_scores(hashes, points, 40), strict=True))
