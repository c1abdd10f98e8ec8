import re
import xml.etree.ElementTree as ET

import pytest

from maskline.sources import sinks

NS = "{http://www.w3.org/2000/svg}"


@pytest.mark.parametrize("most", [0, 1e-7, 0.07, 0.3, 0.9, 0.95, 0.999, 1, 1.2, 9.5, 37, 1000, 123_456])
def test_ticks_are_round_and_reach_the_most(most):
    found = sinks.ticks(most)
    steps = {round((b - a) / found[1], 6) for a, b in zip(found, found[1:])}
    assert found[0] == 0 and found[-1] >= most and steps == {1.0} and 4 <= len(found) <= 11
    assert found[-2] < (most or 1)
    assert float(f"{found[1]:.2g}") == pytest.approx(found[1])


def test_charts_are_to_scale(spark):
    table = spark.createDataFrame([("a<b", 0.5, 40.0), ("c & d", 1.0, None), ("e", 0.25, 10.0)], "model_id string, x double, y double")
    bars = ET.fromstring(sinks.bar_chart(table.drop("y"), "R & <b>"))
    heights = [float(r.get("height")) for r in bars.iter(f"{NS}rect") if r.get("width") == "12"]
    assert heights == pytest.approx([150, 300, 75])
    assert {"0", "0.2", "1", "a<b", "c & d", "x", "R & <b>"} <= {t.text for t in bars.iter(f"{NS}text")}
    both = ET.fromstring(sinks.bar_chart(table, "t"))
    assert len([r for r in both.iter(f"{NS}rect") if r.get("width") == "12"]) == 5
    dots = ET.fromstring(sinks.scatter_chart(table, "t", "x", "y"))
    at = [(float(c.get("cx")), float(c.get("cy"))) for c in dots.iter(f"{NS}circle")]
    assert [x for p in at for x in p] == pytest.approx([560, 40, 310, 265])
    assert re.search(">40<", sinks.scatter_chart(table, "t", "x", "y"))
    assert ET.fromstring(sinks.bar_chart(table.limit(0), "t")) is not None and ET.fromstring(sinks.scatter_chart(table.limit(0), "t", "x", "y")) is not None
