"""The absolute limit of the line rules on a host with many documents."""

from quizspark.llm import line_rules


def test_a_line_above_the_limit_goes_below_the_share(make):
    def body(i):
        return " ".join(f"w{i}x{k}" for k in range(12))

    line = "Licensed under the terms printed below"
    rows = [(i, body(i) + (f"\n{line}" if i < 12 else ""), "hot") for i in range(400)]
    rows += [(1000 + i, f"{body(1000 + i)}\n{line}", "small") for i in range(10)]
    rows += [(2000 + i, body(2000 + i) + (f"\n{line}" if i < 10 else ""), "even") for i in range(300)]
    by = {r.doc_id: r.removed_lines for r in line_rules.judge(make(rows), most=10).collect()}
    assert all(by[i] == (1 if i < 12 else 0) for i in range(400))
    assert all(by[1000 + i] == 1 for i in range(10)) and not any(by[2000 + i] for i in range(300))
    assert not any(r.removed_lines for r in line_rules.judge(make(rows)).collect() if r.doc_id < 1000)
