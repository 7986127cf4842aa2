from pyspark.sql import functions as F

from fieldpulse.operators import counters as C
from fieldpulse.sources import messages as M

FULL = ('{"device_id":"plot-12","timestamp":"2024-05-06 07:08:09","temperature":18.75,"humidity":47.5,'
        '"location":"north field","crop_type":"Barley","season":"spring","rainfall":2.5,"soil_moisture":30.25,'
        '"soil_ph":7.1,"light_intensity":410.0,"fertilizer_used":12.0,"irrigation_needed":1,"crop_health":"Fair",'
        '"yield_estimate":3.5,"pest_risk":"High","anomaly_flag":0}')
ALERT = '{"temperature":61.5,"published_at":"2024-05-06T07:08:10Z","device_id":"probe-7","message_id":"m-1"}'

CASES = [
    (1, FULL), (2, '{"temperature": 50}'), (3, '{"device_id":"d","temperature":"24.5",'
                                                '"timestamp":"2024-01-01 00:00:00"}'),
    (4, '{"temperature": null}'), (5, '{"temperature": "abc"}'), (6, '{"temperature": NaN}'),
    (7, "{bad"), (8, "[1,2]"), (9, ALERT), (10, FULL),
    (11, '{"timestamp":"2024-01-01 00:00:00","device_id":"' + "x" * 51 + '","temperature":1.0}'),
    (12, "null"), (13, "5"), (14, ""),
]


def _msgs(spark):
    return spark.createDataFrame(CASES, "id int, value string")


def test_analytics_side(spark):
    v = M.analytics_view(M.decode(_msgs(spark))).select("id", "is_json", "a_device_id", "a_temperature",
                                                        "temperature_ok")
    rows = {r.id: r for r in v.collect()}
    assert rows[1].temperature_ok and rows[1].a_temperature == 18.75
    assert rows[2].a_device_id == "unknown" and rows[2].a_temperature == 50.0
    assert rows[3].a_temperature == 24.5 and rows[3].temperature_ok
    assert not rows[4].temperature_ok and rows[4].is_json
    assert not rows[5].temperature_ok
    assert not rows[6].temperature_ok          # NaN rejected
    assert not rows[7].is_json                  # not received
    assert rows[8].is_json and not rows[8].temperature_ok
    assert rows[9].temperature_ok and rows[9].a_temperature == 61.5
    assert rows[12].is_json and rows[13].is_json and not rows[14].is_json   # JSON scalars are received


def test_storage_side(spark):
    v = M.storage_view(M.decode(_msgs(spark)))
    rows = {r.id: r for r in v.select("id", "is_valid", "reject_reason").collect()}
    assert rows[1].is_valid and rows[10].is_valid          # duplicates are both stored
    assert rows[2].reject_reason == "null_required"
    assert rows[3].is_valid
    assert rows[5].reject_reason == "bad_value"
    assert rows[7].reject_reason == "not_json_object"
    assert rows[8].reject_reason == "not_json_object"
    assert rows[9].reject_reason == "null_required"         # alert payload has no timestamp
    assert rows[11].reject_reason == "too_long"
    counts = v.agg(F.count(F.lit(1)).alias("received"), F.count_if("is_valid").alias("stored"),
                   F.count_if(~F.col("is_valid")).alias("errors"))
    c = C.storage_counters(counts, 1).first()
    assert (c.received, c.stored, c.errors, c.buffered, c.batches_flushed) == (14, 3, 11, 0, 0)
    c2 = C.storage_counters(counts, 2).first()
    assert (c2.stored, c2.buffered, c2.batches_flushed) == (2, 1, 1)
    assert rows[12].reject_reason == "not_json_object"


def test_projection_types(spark):
    v = M.storage_view(M.decode(_msgs(spark))).where("is_valid").where(F.col("id") == 1)
    r = v.first()
    assert r.humidity == 47.5 and r.irrigation_needed == 1 and r.pest_risk == "High"
    assert str(r.timestamp) == "2024-05-06 07:08:09"


def test_counter_field(spark):
    docs = ['{"stored": 12}', '{"stored": "x"}', "{}", "garbage", '{"stored": 12.7}', '{"stored": -3.9}',
            '{"stored": "12"}', '{"stored": "12.5"}', '{"stored": true}', '{"stored": null}', '{"stored": NaN}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    got = [r[0] for r in df.select(M.counter_field("j", "stored")).collect()]
    assert got == [12, 0, 0, 0, 12, -3, 12, 0, 1, 0, 0]
    df = spark.createDataFrame([(d,) for d in docs[:4]], "j string")
    got = [r[0] for r in df.select(M.counter_field("j", "stored", missing_as_empty=True)).collect()]
    assert got == ["12", "x", "", ""]


def test_only_whole_texts_count(spark):
    texts = ['{"temperature":1} garbage', '{"temperature":1}{"a":1}', "5} x", '1,"w":2', "1],[2", '{"temperature":1}]',
             '{"temperature":1},{"temperature":2}', "null null", "{'temperature':1}", '{"v":1}}', ""]
    rows = M.decode(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert not any(r.is_json or r.is_object or r.m for r in rows)
    good = M.decode(spark.createDataFrame([(t,) for t in [' {"temperature":1} ', "{}", "[1]", '"x"', "5", "null"]],
                                          "value string")).select("is_json", "is_object").collect()
    assert [(r.is_json, r.is_object) for r in good] == [(True, True)] * 2 + [(True, False)] * 4


def test_integral_numbers_fit_integer_columns(spark):
    base = '{"timestamp":"2024-05-06 07:08:09","device_id":"d","irrigation_needed":%s}'
    df = spark.createDataFrame([(base % x,) for x in ("1.0", "1.5", "2e0", "3000000000", "true")], "value string")
    got = [(r.irrigation_needed, r.is_valid) for r in M.storage_view(M.decode(df)).collect()]
    assert got == [(1, True), (None, False), (2, True), (None, False), (None, False)]


def test_counter_field_keeps_every_digit(spark):
    df = spark.createDataFrame([('{"k": 9007199254740993}',)], "j string")
    assert df.select(M.counter_field("j", "k")).first()[0] == 9007199254740993


def test_one_parse_and_nothing_closes_it_early(spark):
    """Texts that are no JSON value though their beginning, or what they are wrapped in, is one."""
    import contextlib
    import io

    broken = ['1,"w":["x"],"end":1}', '{"device_id":"d","temperature":9},"w":["x"],"end":1}', '{"a":1}],"end":1}', "5] x", "5} x",
              '1,"w":2', "1,2", '{"a":1},{"b":2}', '{"a":1} {"b":2}', '{"a":1}]', '{"a":1}}', "", " ", "nul", '"open', '{"a":', "[1,2",
              '"x","y"', '{"a":1},"k":{"b":2}']
    whole = ["5", "null", "[1,2]", '"text"', "true", " 7 ", '{"a":[{"b":"]}"}]}', '{}', ' {"temperature":1} ', '"end"', "-1.5e3"]
    df = M.decode(spark.createDataFrame([(x,) for x in broken + whole], "value string"))
    got = {r.value: (r.is_json, r.is_object) for r in df.select("value", "is_json", "is_object").collect()}
    assert {x for x in broken if got[x] != (False, False)} == set()
    assert {x for x in whole if got[x] != (True, x.strip().startswith("{"))} == set()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        M.storage_view(df).explain("formatted")
    assert buf.getvalue().count("from_json(") <= 2              # an operator's list of expressions and its output
