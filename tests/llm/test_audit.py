"""The audit against its SQL, and against a walk through all orders on odd rows."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import duckdb
import pytest
from compare import connection, differences
from odd import documents, nothing

from lodestream.llm import audit
from lodestream.llm.queries import OP12_SQL, op12_audit

LABELS = "doc_id long, quality int, toxic int, n int, mask string"


def plain(docs, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in zip("ABCD", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search(r"[#$%&*|]", text)]) if bad}
        if i is not None and text in first and first[text] < i:
            fails.add("E")
        parts[source or ""].append((fails, i in good, i in toxic))
    out, removed_by = [], defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = [r for r in rows if r[0] & set(order[:k])]
                here = [r for r in rows if x in r[0] and not r[0] & set(order[:k])]
                removed_by[part, x] += len(here)
                out.append([part, "".join(order), k + 1, len(rows) - len(gone) - len(here), len(here), sum(x in r[0] for r in gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), x])
    return sorted((*r[:-1], removed_by[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    assert differences(op12_audit(spark, f"/root/testdata/{sf}"), connection(f"/root/testdata/{sf}"), OP12_SQL) == ""


def test_odd_rows_against_plain(spark):
    rows = [
        (1, "One two", "a"), (2, None, "a"), (3, "", None), (4, "", ""), (5, "One two", "b"), (5, "One two", "b"), (5, "one", "a"), (None, "One two", "b"), (None, "only without id", "b"), (0, "w " * 300, "a"), (6, "w " * 300, "c"),
        (7, " ".join(f"w{i}" for i in range(200_000)), "b"), (8, " ".join(f"w{i}" for i in range(200)), "b"), (9, " ".join(f"\x01w{i}é #" for i in range(250)), "d"), (10, "ABC " * 250, "d"), (9, "\U0001f600" * 49 + "A", "d"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, None), (7, None, 1), (None, 1, 1), (0, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*r, 0, "x") for r in labels], LABELS)
    got = audit.interaction_audit(documents(spark, rows), table)
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)
    assert audit.interaction_audit(documents(spark, rows), table.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_empty(spark):
    got = audit.interaction_audit(nothing(spark), spark.createDataFrame([], LABELS))
    assert got.count() == 0 and dict(got.dtypes)["part"] == "string" and dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"


def test_many_copies_and_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text", "if(id % 2 = 0, 'hot', concat('s', id % 50)) AS source")
    got = audit.interaction_audit(docs, spark.createDataFrame([], LABELS))
    con = duckdb.connect()
    want = con.execute("SELECT CASE WHEN i % 2 = 0 THEN 'hot' ELSE 's' || i % 50 END AS part, count(*) FILTER (i % 3 = 0 AND i > 0) FROM range(3000) r(i) GROUP BY ALL ORDER BY 1").fetchall()
    assert sorted((r.part, r.removed) for r in got.where("filter_order = 'EABCD' AND step = 1").collect()) == want
