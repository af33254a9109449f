"""The pipeline's stages against brute force on a small corpus."""

import re

import pyarrow as pa
import pytest

import corpus_pipeline as C
from callmetrics.llm import mixing
from callmetrics.llm.private_data import masked
from tests.llm.helpers import ODD_ROWS, sentence, write_documents, write_table
from tests.llm.test_near_copies import least_of_groups

GERMAN = "der hund und die katze gehen über die straße zum fluss und schlafen dort bis zum morgen "


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    item = sentence(500, 30)
    rows = [(i, sentence(i, 60), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, GERMAN * 2 + sentence(i, 12), "de", None) for i in range(20)]
    rows += [(200 + i, sentence(i, 60), "en", "s9") for i in range(10)]  # copies
    rows += [(300, f"{sentence(301, 40)} {item} {sentence(302, 40)}", "en", "s1")]  # leak
    rows += [(310, f"{sentence(303, 40)} mail me@x.example or +1 (017) 555-7713", "en", "s1")]
    rows += [(400 + i, f"{sentence(i, 60)} and one more ending", "en", "s9") for i in range(2)]  # near copies
    rows += [(320, "12 34 !!", "en", "s1"), (321, None, "en", "s1")]
    write_documents(path, rows)
    write_table(path, "benchmark", {"item_id": [1, 2, None], "text": [item, None, ""]}, [("item_id", pa.int64()), ("text", pa.string())])
    return str(path), rows


def test_run(spark, folder):
    path, rows = folder
    kept = [r for r in rows if r[0] not in (320, 321)]
    least, links = least_of_groups({i: t for i, t, _, _ in kept})
    kept = [r for r in kept if r[0] in least and r[0] != 300]
    assert links and not {200, 209, 300, 400, 401} & {r[0] for r in kept} and {0, 9, 310} <= {r[0] for r in kept}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", masked(t))) for i, t, _, _ in kept}
    total = {}
    for i, _, _, source in kept:
        total[source] = total.get(source, 0) + sizes[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([total[s] for s in order])))
    got = C.run(spark, path).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == sorted(
        (i, sizes[i], total[s], round(goal[s], 6)) for i, _, _, s in kept
    )
    for s in order:
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 40


def test_masking_takes_effect(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id = 310")
    text = C.private_data(spark, docs, path).first().text
    assert "[EMAIL]" in text and "[PHONE]" in text and "@" not in text


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    write_documents(tmp_path, ODD_ROWS)
    write_table(tmp_path, "benchmark", {"item_id": [], "text": []}, [("item_id", pa.int64()), ("text", pa.string())])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for table in (docs, docs.limit(0)):
        for number, (name, stage) in enumerate(C.STAGES):
            found = stage(spark, table, str(tmp_path))
            rows = found.collect()
            assert number == len(C.STAGES) - 1 or found.columns == docs.columns, name
            assert len(rows) <= table.count()
    assert C.run(spark, str(tmp_path)).count() > 0
    assert [name for name, _ in C.STAGES] == ["language_id", "near_dedup", "decontamination", "private_data", "mixing"]


def test_check_sql_where_there_is_one(spark):
    import duckdb

    from callmetrics.llm.queries import CHECKS, QUERIES
    from tools.check import compare, connect

    assert set(CHECKS) <= set(QUERIES) and duckdb.__version__
    for name, sql in CHECKS.items():
        with connect("/root/testdata/sf0.001") as duck:
            assert compare(QUERIES[name](spark, "/root/testdata/sf0.001"), duck.execute(sql)) is None, name
