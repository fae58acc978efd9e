from tracecast.sources.xes import read_xes, write_xes, write_xes_per_model

SAMPLE = """<?xml version="1.0" encoding="UTF-8"?>
<log>
  <trace>
    <string key="concept:name" value="north"/>
    <event><string key="concept:name" value="paid"/></event>
    <event><string key="concept:name" value="sent 01"/></event>
  </trace>
</log>
"""


def test_reads_a_log_file(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(SAMPLE)
    assert [(r.trace_name, r.acts) for r in read_xes(spark, str(path)).collect()] == [("north", ["paid", "sent 01"])]


MANY = """<log>
  <trace>
    <string key="source" value="bob"/>
    <string key="concept:name" value="c1"/>
    <string key="last" value="z"/>
    <event>
      <string key="org:resource" value="r1"/>
      <date key="time:timestamp" value="2020-01-01T00:00:00Z"/>
      <string key="concept:name" value="A"/>
      <int key="cost" value="3"/>
      <string key="lifecycle:transition" value="complete"/>
    </event>
    <event><string key="concept:name" value="B"/></event>
  </trace>
</log>
"""


def test_attributes_are_picked_by_key(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(MANY)
    row = read_xes(spark, str(path), who="org:resource", when="time:timestamp").first()
    assert (row.trace_name, row.acts, row.who) == ("c1", ["A", "B"], ["r1", None])
    assert row.when == ["2020-01-01T00:00:00Z", None]


def test_roundtrip(spark, small, tmp_path):
    write_xes(small, str(tmp_path / "xes"))
    back = {int(r.trace_name): r.acts for r in read_xes(spark, str(tmp_path / "xes")).collect()}
    assert back == {r.case_id: r.acts for r in small.collect()}


def test_one_folder_per_model(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2_0", 7, ["a", "b"]), ("2_1", 7, ["a", "b"]), ("2_1", 9, ["c"])], "model_id string, variant_id bigint, acts array<string>"
    )
    write_xes_per_model(rows, str(tmp_path / "xes"))
    found = {(r.trace_name, tuple(r.acts)) for r in read_xes(spark, str(tmp_path / "xes" / "model_id=2_1")).collect()}
    assert found == {("7", ("a", "b")), ("9", ("c",))}
