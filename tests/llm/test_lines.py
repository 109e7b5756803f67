"""Line dedup against a plain version."""

from __future__ import annotations

import hashlib

import pytest

from tests.llm.helpers import CLASHING, LOWERED, awkward, documents, folder, prose, rows
from trailmetrics.llm import lines
from trailmetrics.llm.common import free_names
from trailmetrics.llm.lines import LineRuns, dedup_lines, op12_levelled_runs, sightings

BLANKS = " \t\n\x0b\x0c\r"


def plain(given, least_chars=20, least_docs=3):
    def key(line):
        found = line.strip(BLANKS).translate(LOWERED)
        return found if len(found) >= least_chars else None

    holders: dict[str, set] = {}
    for doc_id, text in given:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders.setdefault(key(line), set()).add(doc_id)
    last = {
        k: max((x for x in found if x is not None), default=None) for k, found in holders.items() if len(found) >= least_docs
    }
    out = []
    for doc_id, text in given:
        cut = (text or "").split("\n")
        kept = [line for line in cut if key(line) not in last or last[key(line)] == doc_id]
        out.append((doc_id, len(cut), len(cut) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def many_lines():
    common, other = "  A licence line that everyone has\t", "x" * 19 + "é"
    out = [(i, "\n".join([common, prose(i, 12), other if i % 3 == 0 else "short", f"shared by two {i // 2} texts only", ""])) for i in range(60)]
    out += [(100 + i, common.upper()) for i in range(40)]  # all but one of them lose their only line
    out += [(200, f"{common}\n{common}\n\n{common}\n"), (200, "other text\n" + common), (None, f"{common}\nleft"), (None, f"{other}\n{common}")]
    out += [(300, "\n".join([common] * 500 + [prose(7, 30)] * 500)), (301, "\n"), (302, "\n\n\n"), (303, "x" * 19 + "\nwide " + "y" * 20_000)]
    # a key that batches see late only: in the three smallest ids
    return out + [(-i, f"{prose(500, 9)}\n{prose(500 + i, 9)}") for i in range(1, 5)]


CASES = [(), awkward(), many_lines(), awkward() + many_lines()]


@pytest.mark.parametrize("batches, fan_in, hot_keys", [(6, 3, 10_000), (1, 2, 10_000), (8, 2, 3), (4, 9, 1)])
def test_kept_lines_equal_a_plain_version(spark, monkeypatch, batches, fan_in, hot_keys):
    monkeypatch.setattr(lines, "HOT_KEYS", hot_keys)
    given = awkward() + many_lines()
    found = dedup_lines(documents(spark, given), batches=batches, fan_in=fan_in)
    found = found.selectExpr("doc_id", "n_lines", "n_dropped", "coalesce(text, '')")
    assert rows(found) == plain(given)


@pytest.mark.parametrize("given", CASES)
def test_query(spark, given):
    path = folder(spark, documents=documents(spark, given))
    expected = [(i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in plain(given)]
    assert rows(op12_levelled_runs(spark, path)) == sorted(expected, key=repr)


def test_other_columns_stay_whatever_their_names(spark):
    docs = documents(spark, many_lines())
    for name in ("doc", "text_hash", "positions", "position", "batch", "line", "key", "n_docs", "last", "known"):
        docs = docs.withColumnRenamed("n_chars", name) if name == "doc" else docs.selectExpr("*", f"'mine' AS {name}")
    found = dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    (row,) = found.where("doc_id = 3").collect()
    assert all(row[name] == "clash" for name in CLASHING) and row["positions"] == row["known"] == "mine"


def test_runs_are_merged_by_level_and_can_be_opened_again(spark, root):
    batches = [[(i, k) for k in range(i % 4, 9)] for i in range(9, 0, -1)]
    runs = LineRuns(spark, root, fan_in=2)
    for batch in batches[:5]:
        rows_ = spark.createDataFrame([(i, k, -k) for i, k in batch], "doc long, key_a long, key_b long")
        runs.add(sightings(rows_, "doc"), least_docs=3)
    assert [run.level for run in runs.runs] == [2, 0]
    runs.close()
    again = LineRuns.open(spark, root, fan_in=2)
    assert again.runs == runs.runs
    for batch in batches[5:]:
        rows_ = spark.createDataFrame([(i, k, -k) for i, k in batch], "doc long, key_a long, key_b long")
        again.add(sightings(rows_, "doc"), least_docs=3)
    found = {row.key_a: (row.n_docs >= 3, row["last"]) for row in again.repeated(3).collect()}
    assert found == {k: (True, max(i for i in range(1, 10) if i % 4 <= k)) for k in range(1, 9)}
    again.close()


def test_a_run_is_joined_without_a_shuffle(spark, root):
    runs = LineRuns(spark, root)
    first = spark.createDataFrame([(1, k, k) for k in range(50)], "doc long, key_a long, key_b long")
    runs.add(sightings(first, "doc"))
    batch = spark.createDataFrame([(0, k, k) for k in range(50)], "doc long, key_a long, key_b long")
    plan = runs.undecided(sightings(batch, "doc"), 1, 1 << 62)._jdf.queryExecution().executedPlan().toString()
    of_run = plan.split("SortMergeJoin")[1].split("FileScan")[0].rsplit("Sort [", 1)[-1]
    assert "Bucketed: true" in plan and "Exchange" not in of_run
    assert runs.undecided(sightings(batch, "doc"), 1, 1 << 62).isEmpty()
    runs.close()


def test_free_names():
    assert free_names(["Doc", "_doc", "x"], "doc", "y", "Y") == ["__doc", "y", "_Y"]
