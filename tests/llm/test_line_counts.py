"""Words of line templates counted by sums per token, also where a doc_id has several texts, against sets of documents."""

from collections import defaultdict

import pytest

from duecourse.llm import line_dedup


@pytest.mark.parametrize("several", [False, True])
def test_words_are_counted_by_documents(spark, several):
    rows = [(k if k % 9 else None, f"total amount due {'soon' if k % 2 else 'later'} x\ntotal amount due now x\ntotal amount due now x\nonly here{'a' * k} y") for k in range(40)]
    rows += [(100 + k, rows[5][1]) for k in range(30)]  # copies of one text count once
    if several:
        rows += [(3, f"total amount due never{'b' * k} x") for k in range(12)]
    lines = line_dedup.leaf_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).localCheckpoint()
    once = defaultdict(set)
    for r in lines.collect():
        for place, word in enumerate(r.words.split(" ")):
            once[r.leaf, place, word, r.context].add(r.doc_id)
    docs = defaultdict(set)
    for (leaf, place, word, _), ids in once.items():
        docs[leaf, place, word] |= {min((i for i in ids if i is not None), default=None)} - {None}
    want = sorted(sum(len(d) >= 2 * 4**k for k in range(1, 14)) for d in docs.values() if len(d) >= 2)
    found = line_dedup._often(lines, 2)
    assert sorted(r.step for r in found.collect()) == want and max(want) > 1
    assert found.schema.names == ["token", "step"]
