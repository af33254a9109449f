"""Benchmark items in scripts without spaces, inside longer documents."""

import pyarrow as pa

from callmetrics.llm import decontaminate as D
from callmetrics.llm.kernels import text_buffer
from tests.llm.helpers import docs_frame

CHINESE = "北京是中华人民共和国的首都，也是全国的政治中心。"
JAPANESE = "吾輩は猫である。名前はまだ無い。"
THAI = "กรุงเทพมหานครเป็นเมืองหลวง"


def test_tokens_are_code_points():
    texts = ["ab東京cd", "東", "京", "ＡＢ，か・𠀀é", "한국어 말", "", "x"]
    want = [["ab", "東", "京", "cd"], ["東"], ["京"], ["ＡＢ", "か", "𠀀", "é"], ["한국어", "말"], [], ["x"]]
    hashes, owner = D.tokens_of(*text_buffer(pa.array(texts)))
    flat = [(row, t) for row, found in enumerate(want) for t in found]
    assert owner.tolist() == [row for row, _ in flat]
    names = {}
    for h, (_, t) in zip(hashes.tolist(), flat):
        assert names.setdefault(h, t) == t
    assert len(names) == len({t for _, t in flat})


def test_items_inside_documents_are_found(spark):
    items = [(1, CHINESE), (2, JAPANESE), (3, THAI), (4, "東京都"), (5, "two words")]
    docs = docs_frame(spark, [
        (1, f"前面还有一些别的话{CHINESE}后面也有。", "zh", "a"),
        (2, f"むかし{JAPANESE}と書いた", "ja", "a"),
        (3, f"คำนำ{THAI}และ", "th", "a"),
        (4, "昨日は東京都へ行った", "ja", "a"),
        (5, "京都は東にある", "ja", "a"),
        (6, "全国的政治中心，也是北京是中华人民共和国的首都", "zh", "a"),  # reordered
        (7, "these are two words here", "en", "a"),  # a short item as one run
    ])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, benchmark).collect())
    assert found == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 1), (7, 5)]
    assert sorted(r.doc_id for r in D.without_leaks(docs, benchmark).collect()) == [5]
