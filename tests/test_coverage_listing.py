import re
from pathlib import Path

from evalframe import plans
from evalframe.sources import adapters

ROWS = dict(re.findall(r"^\| ([A-Z]\d+) \| (.*) \|$", (Path(__file__).parents[1] / "COVERAGE.md").read_text(), re.M))


def test_what_does_not_exist_is_listed_as_not_built():
    assert {"F30", "F31", "F32", "F33"} <= ROWS.keys()
    for operator, name in (("S10", "flowlearn_sim"), ("S14", "svg_word_mc")):
        assert name in adapters.names() or "**not built**" in ROWS[operator]
    for operator in ("F31", "F32"):
        assert "**not built**" in ROWS[operator] or any(q.startswith(operator.lower()) for q in plans.QUERIES)
