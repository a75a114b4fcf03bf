"""Key ranges, sharding functions, schema checks, text rewrites and DDL translation."""

import pytest
from hypothesis import given
from pyspark.sql import functions as F
from hypothesis import strategies as st

from shardloom.dialect import ddl
from shardloom.dialect.text import joined, row_values_spread, single_statement, split_commas, to_spark, with_tables
from shardloom.errors import Invalid, NotFound, Unsupported
from shardloom.functions.vindex import create
from shardloom.keyrange import KeyRange, check_cover, even_split, shard_column, successor, to_range
from shardloom.plans.vschema import VSchema
from shardloom.queries import GOLDEN, SCHEMA, VALUES
from shardloom.types import as_u64, canonical_bytes, compare


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 100])
def test_even_split_covers_all(n):
    assert len(check_cover(even_split(n))) == n


def test_shard_names():
    assert [r.name for r in even_split(3)] == ["-5555555555555556", "5555555555555556-aaaaaaaaaaaaaaac", "aaaaaaaaaaaaaaac-"]
    assert KeyRange.parse("-8") == KeyRange.parse("-80") and KeyRange.parse("-8").name == "-80"
    long = KeyRange.parse("-0000000000000400")
    assert long.name == "-0000000000000400" and long == KeyRange.parse("-00000000000004")
    low = KeyRange.parse("-80")
    assert low.contains(b"\x7f\xff\xff") and low.contains(b"\0") and not low.contains(b"\x80") and not low.contains(b"\x80\0")
    for bad in ("80", "zz-", "80-40"):
        with pytest.raises(Invalid):
            KeyRange.parse(bad)
    with pytest.raises(Invalid, match="hole"):
        check_cover([KeyRange.parse("-40"), KeyRange.parse("80-")])
    with pytest.raises(Invalid, match="overlap"):
        check_cover([KeyRange.parse("-80"), KeyRange.parse("40-")])


@given(st.binary(max_size=10), st.sampled_from([1, 2, 3, 4, 8]))
def test_each_id_has_one_shard(ksid, n):
    assert sum(s.contains(ksid) for s in even_split(n)) == 1


@pytest.mark.parametrize("kind", GOLDEN)
def test_golden_ids(kind):
    assert [create(kind, kind).id_of(v).hex() for v in VALUES[kind]] == GOLDEN[kind]


def test_hash_extremes():
    h = create("hash", "h")
    assert h.id_of(9223372036854775807).hex() == "f77d48aadda1f1bb"
    assert h.id_of(-9223372036854775808).hex() == "95f8a5e5dd31d900"
    assert h.id_of(18446744073709551615) == h.id_of(-1)
    assert h.map(None).shards(even_split(2)) == [] and h.map("not-a-number").shards(even_split(2)) == []
    assert h.value_of(h.id_of(12345)) == 12345


def test_multicol():
    m = create("multicol", "m", {"column_count": "2"})
    assert m.id_of(1, 2).hex() == "166b40b406e7ea22"
    assert m.map(1) == to_range(bytes.fromhex("166b40b4"), bytes.fromhex("166b40b5"))
    for bad in ({}, {"column_count": "9"}, {"column_count": "2", "column_bytes": "4,5"}):
        with pytest.raises(Invalid):
            create("multicol", "m", bad)
    assert successor(b"\xff\xff") == b"" and successor(b"a\xff") == b"b"


def test_columns_agree_with_scalars(spark):
    rows = [(v,) for v in ["0", "1", " 12 ", "-1", "18446744073709551615", "9223372036854775808", "x", None, "1.5", ""]]
    df = spark.createDataFrame(rows, "v string")
    shards = even_split(4)
    for kind, params in (("hash", {}), ("xxhash", {}), ("numeric", {}), ("reverse_bits", {}), ("binary", {}), ("binary_md5", {}), ("null", {}), ("numeric_static_map", {"json": '{"1": 5, "x": 9}', "fallback_type": "hash"})):
        from shardloom.functions.vindex import ready

        ready(spark)
        v = create(kind, kind, params)
        got = df.select("v", v.ksid(df.v).alias("k")).withColumn("s", shard_column(F.col("k"), shards)).collect()
        for r in got:
            want = v.id_of(r.v)
            assert (None if r.k is None else bytes(r.k)) == want, (kind, r.v)
            assert r.s == (None if want is None else v.map(r.v).shards(shards)[0])


def test_values():
    assert as_u64(True) == 1 and as_u64(" 7 ") == 7 and as_u64(1.5) is None and as_u64(1 << 64) is None
    assert canonical_bytes(None) == b"" and canonical_bytes(True) == b"\x01"
    assert compare(None, 0) == -1 and compare(2**60, 2**60 + 1) == -1 and compare("a", "b") == -1


def changed(**change):
    import copy

    schema = copy.deepcopy(SCHEMA)
    commerce = schema["keyspaces"]["commerce"]
    for path, value in change.items():
        at, *keys = commerce, *path.split("__")
        for k in keys[:-1]:
            at = at[k]
        at[keys[-1]] = value
    return schema


@pytest.mark.parametrize(
    "change, message",
    [
        ({"vindexes__hash": {"type": "nothing"}}, "unknown vindex kind"),
        ({"vindexes__hash": {"type": "hash", "params": {"x": "1"}}}, "unknown parameter"),
        ({"vindexes__extra": {"type": "hash", "owner": "nobody"}}, "owner"),
        ({"tables__orders": {"column_vindexes": [{"column": "a", "name": "nothing"}]}}, "unknown vindex"),
        ({"tables__orders": {"column_vindexes": [{"name": "hash"}]}}, "at least one column"),
        ({"tables__orders": {"column_vindexes": [{"columns": ["a", "b"], "name": "hash"}]}}, "takes 1"),
        ({"tables__orders": {}}, "needs a unique vindex"),
        ({"tables__orders": {"type": "sequence"}}, "may not live"),
        ({"sharded": False, "shards": 1}, "has no column_vindexes"),
        ({"tables__ticket__auto_increment__sequence": "main.documents"}, "no sequence"),
    ],
)
def test_schema_errors(change, message):
    with pytest.raises(Invalid, match=message):
        VSchema(changed(**change))


def test_finding_tables():
    v = VSchema({**SCHEMA, "routing_rules": {"rules": [{"from_table": "commerce.old", "to_tables": ["commerce.orders"]}, {"from_table": "gone", "to_tables": []}]}})
    assert v.find("ORDERS").full_name == "commerce.orders" and v.find("commerce.old").name == "orders"
    with pytest.raises(Invalid, match="denied"):
        v.find("gone")
    with pytest.raises(NotFound, match="unknown table"):
        v.find("nothing")
    with pytest.raises(NotFound, match="unknown keyspace"):
        v.find("x.y")
    assert [cv.vindex.cost for cv in v.find("customer").vindexes] == [1, 10]


def test_text_rewrites():
    back = lambda s, a=None: joined(to_spark(single_statement(s), a)[0])
    assert back('SELECT "a" FROM t LIMIT 5, 10') == "SELECT `a` FROM t LIMIT 10 OFFSET 5"
    assert back("SELECT 1 WHERE x = ANY(ARRAY[1, 2])") == "SELECT 1 WHERE x IN ( 1 , 2 )"
    assert to_spark(single_statement("SELECT ? , $2"), [1, 2])[1] == {"p1": 1, "p2": 2}
    assert joined(row_values_spread(single_statement("SELECT 1 WHERE (a, b) NOT IN ((1, 2))"))) == "SELECT 1 WHERE NOT ( ( a = 1 AND b = 2 ) )"
    views = {"ks.t": "v1", "u": "v2"}
    text = joined(with_tables(single_statement("SELECT t.a FROM ks.t JOIN u AS x ON t.a = x.a WHERE EXISTS (SELECT 1 FROM u)"), views.get))
    assert text == "SELECT t . a FROM v1 AS `t` JOIN v2 AS x ON t . a = x . a WHERE EXISTS ( SELECT 1 FROM v2 AS `u` )"
    with pytest.raises(Unsupported, match="single statement"):
        single_statement("SELECT 1; SELECT 2")
    assert len(split_commas(single_statement("a, f(b, c)"))) == 2


def test_ddl_translation():
    mysql = "CREATE TABLE `user` (`user_id` BIGINT UNSIGNED NOT NULL AUTO_INCREMENT, email VARCHAR(128), balance DECIMAL(12,2), payload JSON, avatar BLOB, created DATETIME, PRIMARY KEY (`user_id`)) ENGINE=InnoDB"
    pg, warnings = ddl.translate(mysql, "mysql", "postgres")
    assert '"user_id" BIGSERIAL' in pg and "JSONB" in pg and "BYTEA" in pg and "TIMESTAMP" in pg and "ENGINE" not in pg
    assert any("unsigned" in w for w in warnings) and any("ENGINE" in w for w in warnings)
    ms, _ = ddl.translate(mysql, "mysql", "mssql")
    assert "IDENTITY(1,1)" in ms and "NVARCHAR(128)" in ms and "[user]" in ms
    assert "INTEGER" in ddl.translate("CREATE TABLE a (id BIGINT)", "mysql", "sqlite")[0]
    back, warnings = ddl.translate("CREATE TABLE account (id BIGSERIAL PRIMARY KEY, ref UUID, doc JSONB, seen TIMESTAMPTZ, place INET)", "postgres", "mysql")
    assert "BIGINT AUTO_INCREMENT" in back and "CHAR(36)" in back and "TIMESTAMP" in back and "INET" in back and warnings
    assert ddl.spark_columns(single_statement("(id BIGINT, n DECIMAL(10,2), t DATETIME, PRIMARY KEY (id))"), "mysql")[0] == "`id` BIGINT, `n` DECIMAL(10,2), `t` TIMESTAMP_NTZ"
