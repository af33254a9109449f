"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callmetrics.llm import near_dedup as N
from callmetrics.llm.graph import connected_components
from callmetrics.llm.near_sets import one_per_group
from tests.llm.helpers import ODD_ROWS, docs_frame, sentence, write_documents


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b", "A b C", "Éa É b c D", "x y z " * 500, "q" * 100_000])
def test_fingerprint(text):
    assert N.fingerprint_of(text) == plain_fingerprint(text)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, sentence(i, 40), "en", "a") for i in range(40)]
    rows += [(100 + i, sentence(i % 5, 40).upper(), "en", "a") for i in range(30)]  # exact copies
    rows += [(200 + i, sentence(7, 400) + f" w{i}", "en", "a") for i in range(40)]  # near copies
    rows += [r for r in ODD_ROWS if r[0] is not None]
    write_documents(tmp_path, rows)
    got = N.op8_simhash_near_dedup(spark, str(tmp_path)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    parts = groups(prints)
    least = {}
    for row, part in zip(rows, parts):
        least[part] = min(row[0], least.get(part, row[0]))
    want = sorted((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, parts))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len(set(prints[70:110])) > 5  # the near copies differ in their bits


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_links_connect_what_brute_force_connects(spark, block_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    values = set(base.tolist())
    for x in base.tolist():
        for _ in range(12):  # chains that wander off, three bits at a time
            for bit in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                x ^= 1 << bit
            values.add(x)
    near = int(base[0])
    values |= {near ^ (1 << i) for i in range(64)}  # a ball around one value
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed], "simhash long")
    found = N.links(prints, block_rows).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found)
    assert block_rows < 10 or len(found) <= 8 * len(values)
    roots = {r.node: r.root for r in connected_components(N.links(prints, block_rows)).collect()}
    want = groups(values)
    got = [roots.get(v, v) for v in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_one_document_of_each_group_stays(spark):
    text = sentence(1, 50)
    rows = [(5, text, "en", "a"), (3, text.upper(), "de", "b"), (3, text, "en", "a"), (9, sentence(2, 50), "en", "a"), *ODD_ROWS]
    docs = docs_frame(spark, rows, extra=True)
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {r.score for r in got} == {"kept"} and {r.simhash for r in got} == {"kept"}
    ids = sorted(str(r.doc_id) for r in got)
    # 1, 2 and 3 (no words) share the fingerprint zero: 1 stays, and takes 3's copies with it only if they match.
    assert ids == sorted(["3", "1", "4", "5", "6", "7", "8", "9", "9", "10", "None"])


def test_groups_without_ids(spark):
    docs = docs_frame(spark, [(None, "a b c d", "en", "a"), (None, "a b c d", "en", "a"), (2, "e f g h", "en", "a")])
    narrow = N.fingerprints(docs).select("doc_id", "simhash")
    assert sorted(str(r.component_id) for r in N.components(narrow).collect()) == ["2", "None", "None"]
    assert one_per_group(docs).count() == 2


def test_empty(spark):
    docs = docs_frame(spark, [])
    assert one_per_group(docs).count() == 0
    assert N.components(N.fingerprints(docs).select("doc_id", "simhash")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (2000, 1999)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[1000 + i] == 1000 for i in range(50))
    assert roots[2000] == roots[1999] == 1999 and found.count() == len(roots)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
