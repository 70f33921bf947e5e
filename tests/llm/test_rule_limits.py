"""The line rule of op7 with production parameters, on a host large enough for it."""

from __future__ import annotations

from test_text import documents

from strataledger.llm import rules


def test_lines_go_and_a_document_is_rejected(spark):
    line = " ".join(f"menu{j}" for j in range(20))
    body = lambda k, n=30: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, f"{line}\n{body(k)}", "large") for k in range(rules.MAX_DOCS)] + [(500, f"{line}\n{body(500, 9)}", "large")]
    rows += [(1000 + k, f"{line}\n{body(k)}", "at the limit") for k in range(rules.MAX_DOCS)]
    got = {r["doc_id"]: r for r in rules.judge_quality(documents(spark, rows)).collect()}
    assert all(got[k]["n_removed"] == 20 and got[k]["kept"] for k in range(rules.MAX_DOCS))
    assert got[500]["n_removed"] == 20 and not got[500]["base_failed"] and not got[500]["kept"]  # depleted
    assert all(got[1000 + k]["n_removed"] == 0 and got[1000 + k]["kept"] for k in range(rules.MAX_DOCS))
