import pytest
from pyspark.sql import types as T

from rowloom.plans.infer import ForeignKeySpec, KeySpec, infer_spec, list_columns, list_keys, list_tables
from rowloom.plans.spec import Call, ColumnSpec, ForeignKey, Identity, Range, TableSpec, ValueSet

PARCEL = T.StructType([
    T.StructField("parcel_id", T.StringType(), metadata={"sql_type": "uuid"}),
    T.StructField("depot_id", T.StringType(), metadata={"sql_type": "uuid"}),
    T.StructField("city", T.StringType()), T.StructField("weight", T.DecimalType(19, 2)),
    T.StructField("currency", T.StringType()), T.StructField("remark", T.StringType(), metadata={"length": 20}),
    T.StructField("payload", T.StringType(), metadata={"sql_type": "json"}), T.StructField("at", T.TimestampNTZType()),
    T.StructField("raw", T.BinaryType(), metadata={"length": 4000}), T.StructField("first_name", T.StringType()),
])


def test_json_round_trip():
    spec = TableSpec("t", (
        ColumnSpec("a", identity=Identity("sequence", 1, 10, 2)), ColumnSpec("b", range=Range("time", "10:00:00", step=5)),
        ColumnSpec("c", value_set=ValueSet(("x", "y"), (1.0, 2.0)), hidden=True), ColumnSpec("d", call=Call("randomInt", (1, 5))),
        ColumnSpec("e", foreign_key=ForeignKey("p", "id")), ColumnSpec("f", constant="k"), ColumnSpec("g", expression="1 + 1"),
    ), "10k", "public")
    assert TableSpec.from_json(spec.to_json(), expect="public.t") == spec
    assert spec.row_count == 10_000 and [c.name for c in spec.visible_columns()] == list("abdefg")
    with pytest.raises(ValueError, match="not other"):
        TableSpec.from_json(spec.to_json(), expect="other")


@pytest.mark.parametrize("text", [
    '{"name": "t", "columns": []}', '{"name": "t", "rows": "10x", "columns": [{"name": "a", "constant": "1"}]}',
    '{"name": "t", "columns": [{"name": "a"}, {"name": "a"}]}', '{"name": "t", "columns": [{"name": "a", "odd": 1}]}',
    '{"name": "t", "columns": [{"name": "a", "value_set": {"values": []}}]}',
    '{"name": "t", "columns": [{"name": "a", "identity": {"type": "odd"}}]}',
])
def test_bad_specs_are_refused(text):
    with pytest.raises(ValueError):
        TableSpec.from_json(text)


def test_precedence():
    everything = dict(range=Range("date"), identity=Identity("uuid"), constant="c", expression="1", value_set=ValueSet(("v",)))
    order = ["range", "identity", "constant", "expression", "value_set"]
    for i, kind in enumerate(order):
        assert ColumnSpec("a", **{k: everything[k] for k in order[i:]}).kind == kind
    assert ColumnSpec("a", constant="", expression="1").kind == "expression"
    with pytest.raises(ValueError, match="no generator"):
        ColumnSpec("a").kind


def test_inference_of_types_names_and_keys():
    keys = KeySpec(("parcel_id", "depot_id"), (ForeignKeySpec(("parcel_id",), "transaction", ("id",)),))
    spec = infer_spec("item", PARCEL, keys, enums={"currency": ["USD", "EUR"]})
    assert spec.column("parcel_id").foreign_key == ForeignKey("transaction", "id")
    assert spec.column("depot_id").identity == Identity("uuid")
    calls = {c.name: (c.call.name, c.call.args) for c in spec.columns if c.call}
    assert calls == {
        "city": ("randomCity", ()), "weight": ("randomBigDecimal", (0, 10**17, 2)), "currency": ("selectRandom", ("USD", "EUR")),
        "remark": ("randomString", (20,)), "payload": ("randomJson", (1, 1)), "at": ("randomDateTime", ()),
        "raw": ("randomBytesBase64", (512,)), "first_name": ("randomString", (512,)),
    }


@pytest.mark.parametrize("default,generated,expected", [
    ("unique_rowid()", False, Identity("unordered", batch_size=512)), ("unordered_unique_rowid()", False, Identity("unordered", batch_size=512)),
    ("gen_random_uuid()", False, Identity("uuid")), ("", True, Identity("unordered", batch_size=512)),
    ("", False, Identity("sequence", start=1, step=1)),
])
def test_integer_primary_keys(default, generated, expected):
    schema = T.StructType([T.StructField("id", T.LongType())])
    keys = KeySpec(("id",), defaults={"id": default}, generated=frozenset(["id"] if generated else []))
    assert infer_spec("t", schema, keys).column("id").identity == expected


def test_text_primary_key_keeps_its_generator():
    schema = T.StructType([T.StructField("code", T.StringType(), metadata={"length": 8})])
    assert infer_spec("t", schema, KeySpec(("code",))).column("code").call == Call("randomString", (8,))


def test_listings(spark):
    keys = KeySpec(("parcel_id",), (ForeignKeySpec(("depot_id",), "account", ("id",)),))
    columns = list_columns(spark, "item", PARCEL, keys)
    assert len(columns.columns) == 10 and columns.count() == len(PARCEL.fields)
    assert columns.filter("column_name = 'weight'").first()["precision"] == 19
    assert list_keys(spark, {"item": keys}).count() == 2
    spark.range(1).createOrReplaceTempView("listed")
    assert not list_tables(spark).filter("name = 'listed'").isEmpty()
