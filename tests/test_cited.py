"""Claims with their references, rule by rule."""

import pytest
from pyspark.sql import functions as F

from docsight.operators import cite, cited

CASES = [
    ("甲公司成立于一九九〇年[1]，乙公司成立于二〇〇〇年[2][3]。", [("甲公司成立于一九九〇年", ["[1]"]), ("乙公司成立于二〇〇〇年[2][3]", ["[2]", "[3]"])]),
    ("模型能力很强。[6]", [("模型能力很强[6]", ["[6]"])]),
    ("作者在[3]中说模型会变好。", [("作者在[3]中说模型会变好", ["[3]"])]),
    ("结论见[1-5]。", []),
    ("全部内容[1]-[5]都在。", []),
    ("“先这样。再那样。”他说[2]。", [("“先这样。再那样。”他说[2]", ["[2]"])]),
    ("| 项目 | 结果 |\n| --- | :---: |\n| 速度 | 很快[1] |\n| 成本 | 低[2]、[4] |", [("很快[1]", ["[1]"]), ("低[2]、[4]", ["[2]", "[4]"])]),
    ("- 列表一[1]\n- 列表二\n\n123[2]", [("- 列表一[1]", ["[1]"])]),
    ("需要说明的是资料有限[1]。", []),
    ("A is fast[1], B is slow [2] and C stops.", [("A is fast", ["[1]"]), (", B is slow", ["[2]"])]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("answer, want", [c for c in CASES if c[1] is not None])
def test_claims_by_hand(answer, want):
    got = [(t, r) for u in cited.units_of(answer or "") if not cited._ABOUT_MATERIAL.search(u) for raw, r in cited.unit_claims(u) if cited._CONTENT.search(t := raw.strip().strip(cited._TRIMMED))]
    assert got == want


def test_claims_of_rows(spark):
    answers = [(i, c[0], ["s1", "s2"]) for i, c in enumerate(CASES)] + [
        (90, "《产品手册》指出这款设备的续航时间可以达到二十个小时。", ["s1"]),
        (91, "《产品手册》指出这款设备的续航时间可以达到二十个小时。", ["s3"]),
        (92, "《产品手册》和年报都指出这款设备的续航时间达到二十小时。", ["s1", "s2"]),
        (93, "产品手册很短。", ["s1"]),
    ]
    df = spark.createDataFrame(answers, "id int, answer string, present array<string>")
    rows = cited.cited_claims(df, "id", F.col("answer"), [("产品手册", "s1"), ("年报", "s2")], "present").collect()
    got = {}
    for r in sorted(rows):
        got.setdefault(r["id"], []).append((r["claim"], r["refs"], r["note"]))
    for i, (_, want) in enumerate(CASES):
        if want is not None:
            assert got.get(i, []) == [(t, refs, "block") for t, refs in want]
    assert got[90] == [("《产品手册》指出这款设备的续航时间可以达到二十个小时。", ["s1"], "source")]
    assert not {91, 92, 93} & got.keys()
    hits = spark.createDataFrame([(1, "s1", "b1"), (2, "s2", "b2")], "position int, source string, block string")
    claims = spark.createDataFrame(rows).filter("id in (0, 90)").withColumn("key", F.concat_ws("-", "id", "seq"))
    state = {r["key"]: (r["state"], r["missing"]) for r in cite.citation_groups(claims, hits, "key").collect()}
    assert state == {"0-0": ("ok", []), "0-1": ("fail", ["[3]"]), "90-0": ("ok", [])}
    assert cited.cited_claims(df.limit(0), "id", F.col("answer")).count() == 0
