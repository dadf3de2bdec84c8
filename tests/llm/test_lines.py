from collections import defaultdict

import pytest

from sensorloom.llm import lines
from tests.llm.helpers import AWKWARD, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, min_chars=1):
    key = lambda line: line.strip(lines.BLANKS).translate(LOWER)
    where = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(d)
    out = []
    for d, t in rows:
        held = (t or "").split("\n")
        kept = [x for x in held if len(key(x)) < min_chars or len(where[key(x)]) < min_docs]
        out.append((d, len(held), len(held) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_awkward_documents(spark, min_docs):
    rows = [(d, t) for d, t, _ in AWKWARD] + [(20 + k, f"  Shared Line\x0b\nown {k}\nÉ same\n\nx") for k in range(12)] + [(20, "shared line"), (40, "Shared line\nshared LINE\nend")]
    docs = awkward(spark, [(d, t, None) for d, t in rows])
    got = sorted((tuple(r) for r in lines.dedup_lines(docs, min_docs=min_docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)
    assert got == brute(rows, min_docs)


def test_row_is_kept_and_empty_table(spark):
    docs = awkward(spark)
    assert lines.dedup_lines(docs).select("row.*").columns == docs.columns
    assert lines.dedup_lines(awkward(spark, [])).count() == 0
